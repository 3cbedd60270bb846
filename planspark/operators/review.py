"""Sheet plans, intake views, row shapes, blockers, section readiness and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_up

#: What the runner does with pages of a role, which step owns them, and how they are planned.
RUNNER_WORK = {"plan": "count", "schedule": "read_schedule", "legend": "skip", "detail": "skip", "tr_room": "skip", "rack_detail": "skip", "fiber_riser": "skip", "skip": "skip"}
PAGE_WORK = {"legend": "discover", "detail": "skip", "schedule": "read_schedule", "plan": "count_labels"}
BOTH_SOURCES = "Set has both plan and schedule sheets: schedule is count authority per type; plans provide location. Do not sum both."
EXIT_PIN = r"_exit_pg\d+$"
#: What keeps a rule, feed, cable or allowance from being confirmed.
REREAD_RULE, REREAD, UNPICKED = "the sheet now reads differently — take the new read or edit, then confirm", "the sheet now reads differently — review it", "pick how it is counted first"
#: Lengths of old runs.
OLD_FACTOR, OLD_LIMIT, OLD_LIMIT_WIRELESS = 1.35, 295.0, 270.0


def looked_up(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


# pages and sets ------------------------------------------------------------------------------------


def runner_work(role: Column) -> Column:
    """What a run does with a page; pages without a known role block it."""
    return looked_up(RUNNER_WORK, role, "needs_role")


def page_plan(pages: DataFrame) -> DataFrame:
    """pages (role, confidence, needs_user, archetype) with work and needs_confirm: an uncertain role goes to the user first."""
    unsure = F.col("needs_user") | (F.col("confidence") == "low")
    return pages.withColumns({"needs_confirm": unsure, "work": F.when(unsure, "confirm").otherwise(looked_up(PAGE_WORK, F.col("role"), "confirm")), "archetype": F.when(F.col("role").isin("schedule", "plan") | F.col("needs_user"), F.col("archetype"))})


def set_summary(planned: DataFrame) -> DataFrame:
    """A row a set: pages by work, pages that count and that list, and whether both do. planned: set_id, page_no, work."""
    by = {w: F.count_if(F.col("work") == w).alias(w) for w in ("count_labels", "read_schedule", "discover", "skip", "confirm")}
    numbers = lambda w: F.array_sort(F.collect_list(F.when(F.col("work") == w, F.col("page_no"))))
    got = planned.groupBy("set_id").agg(F.count("*").alias("total"), *by.values(), numbers("count_labels").alias("count_pages"), numbers("read_schedule").alias("schedule_pages"))
    both = (F.size("count_pages") > 0) & (F.size("schedule_pages") > 0)
    return got.withColumns({"cross_sheet": both, "note": F.when(both, BOTH_SOURCES)})


def decision_text(d: DataFrame) -> DataFrame:
    """d with text, the question that a decision asks. d: kind, sheet_number, rev_label, rev_assumed, current_label, base_label, page_number, role, step_code, filename."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    text = (
        F.when((F.col("kind") == "new_revision") & F.col("rev_assumed"), F.concat(c("sheet_number"), F.lit(" changed but shows no revision number. Treat it as a new revision?")))
        .when(F.col("kind") == "new_revision", F.concat(c("sheet_number"), F.lit(" "), c("rev_label"), F.lit(" replaces "), F.coalesce(F.nullif("current_label", F.lit("")), F.lit("the current revision")), F.lit(". The reference stays pinned.")))
        .when(F.col("kind") == "conflict", F.concat(F.lit("Two different pages both claim to be "), c("sheet_number"), F.lit(" "), c("base_label"), F.lit(". Keep which one?")))
        .when(F.col("kind") == "move", F.concat(F.coalesce(F.nullif("sheet_number", F.lit("")), F.concat(F.lit("Page "), c("page_number"))), F.lit(" reads as "), c("role"), F.lit(" — that belongs in "), c("step_code"), F.lit(".")))
        .when(F.col("kind") == "unnumbered", F.concat(F.lit("Page "), c("page_number"), F.lit(" of "), c("filename"), F.lit(" has no readable sheet number.")))
        .otherwise("")
    )
    return d.withColumn("text", text)


def current_revisions(revisions: DataFrame) -> DataFrame:
    """Revisions (sheet_id, revision_id, accepted_at, status) with is_current and superseded_by: each accepted one by the next accepted."""
    w = Window.partitionBy("sheet_id").orderBy("accepted_at", "revision_id")
    accepted = revisions.where("status = 'accepted'").withColumn("superseded_by", F.lead("revision_id").over(w)).select("sheet_id", "revision_id", "superseded_by")
    rows = revisions.join(accepted, ["sheet_id", "revision_id"], "left")
    return rows.withColumn("is_current", (F.col("status") == "accepted") & F.col("superseded_by").isNull())


def intake_view(pages: DataFrame, documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """pages (page_id, document_id, sheet_id, role) with their file, sheet's revision and what is pending of it.

    documents: document_id, filename. revisions: from current_revisions() with page_id and rev_label.
    """
    rev = revisions.select("page_id", "rev_label", F.col("status").alias("rev_status"), "is_current")
    rows = pages.join(documents.select("document_id", "filename"), "document_id", "left").join(rev, "page_id", "left")
    pending = F.col("rev_status") == "pending"
    kind = F.when(pending & F.col("rev_label").contains("(alt "), "conflict").when(pending, "new_revision")
    return rows.withColumns({"pending": kind, "rev_assumed": pending & F.startswith("rev_label", F.lit("Unlabelled "))})


def snapshot_numbers(snapshots: DataFrame) -> DataFrame:
    """snapshots (project, snapshot, kind, created_at) with number (the latest is 1) and is_reference (the latest reference)."""
    w = Window.partitionBy("project").orderBy(F.desc("created_at"), F.desc("snapshot"))
    nth = F.row_number().over(w)
    reference = F.row_number().over(Window.partitionBy("project", "kind").orderBy(F.desc("created_at"), F.desc("snapshot")))
    return snapshots.withColumns({"number": nth, "is_reference": (F.col("kind") == "reference") & (reference == 1)})


# row shapes ----------------------------------------------------------------------------------------


def pin_rows(pins: DataFrame) -> DataFrame:
    """Pins as drawn (name, source, pin_kind) as rows: tr_name without an exit suffix, kind, placement and source."""
    off = F.col("source") == "off_sheet"
    kind = F.when(off, "off_sheet").when((F.col("pin_kind") == "exit") | F.coalesce(F.col("name").rlike(EXIT_PIN), F.lit(False)), "exit").otherwise("serving")
    user = F.coalesce(F.col("source") == "user_pin", F.lit(False))
    return pins.withColumns({"tr_name": F.regexp_replace(F.coalesce("name", F.lit("")), EXIT_PIN, ""), "kind": kind, "placement": F.when(user, "manual").otherwise("auto_center"), "row_source": F.when(user, "manual").otherwise("extracted")})


def drawn_source(kind: Column, placement: Column) -> Column:
    """The source of a pin as it is drawn, from its row."""
    return F.when(kind == "off_sheet", "off_sheet").when(placement == "manual", "user_pin").otherwise("auto")


def culled(rows: DataFrame) -> DataFrame:
    """rows (flags) with excluded: a person has culled the device."""
    return rows.withColumn("excluded", F.coalesce(F.array_contains("flags", "manual_excluded"), F.lit(False)))


def stale_routes(devices: DataFrame, rejected: DataFrame) -> DataFrame:
    """devices with the flag of a stale calibration, once, on routed ones of projects whose confirmed signature was rejected.

    devices: project, route_method, flags. rejected: project, was_confirmed.
    """
    gone = rejected.where("was_confirmed").select("project").distinct().withColumn("_gone", F.lit(True))
    rows = devices.join(gone, "project", "left")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return rows.withColumn("flags", F.when(F.col("_gone") & (F.col("route_method") == "routed"), F.array_union(flags, F.array(F.lit("wall_calibration_stale")))).otherwise(F.col("flags"))).drop("_gone")


def old_lengths(devices: DataFrame) -> DataFrame:
    """devices with run_ft, total_ft and over_limit as old passes measured: straight, by a factor; wireless types have a limit of their own.

    devices: name, x, y, pin_x, pin_y (shares of the page), width, height (points), points_per_ft, stub_ft.
    """
    dx, dy = (F.col("x") - F.col("pin_x")) * F.coalesce("width", F.lit(1.0)), (F.col("y") - F.col("pin_y")) * F.coalesce("height", F.lit(1.0))
    run = F.when(F.col("points_per_ft") > 0, round_up(F.hypot(dx, dy) * OLD_FACTOR / F.col("points_per_ft"), 1))
    total = round_up(run + F.coalesce("stub_ft", F.lit(0.0)), 1)
    limit = F.when(F.coalesce(F.upper("name").contains("WAP"), F.lit(False)), OLD_LIMIT_WIRELESS).otherwise(OLD_LIMIT)
    return devices.withColumns({"run_ft": run, "total_ft": total, "over_limit": F.coalesce(total > limit, F.lit(False))})


def verified_types(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types that count, and the names of those that are skipped as nobody has verified them. types: name, verified, detection_config."""
    known = types.where("detection_config is not null")
    return known.where("verified"), known.where("not coalesce(verified, false)").select("name")


def types_of_projects(projects: DataFrame, types: DataFrame) -> DataFrame:
    """project, and the types of its library, or its own where it has none. projects: project, library; types: project, type_id, ..."""
    own = projects.select("project", F.coalesce("library", "project").alias("of"))
    return own.join(types.withColumnRenamed("project", "of"), "of").drop("of")


def type_counts(projects: DataFrame, types: DataFrame) -> DataFrame:
    """project, types: how many rows types_of_projects() has for each; types are counted before they meet the projects that share a library."""
    held = types.groupBy(F.col("project").alias("of")).agg(F.count("*").alias("types"))
    own = projects.select("project", F.coalesce("library", "project").alias("of"))
    return own.join(held, "of").groupBy("project").agg(F.sum("types").alias("types"))


def copied_types(source: DataFrame, existing: DataFrame, project: int) -> DataFrame:
    """Types of another project that this one lacks, by legend_id, as its own."""
    new = source.join(existing.select("legend_id").distinct(), "legend_id", "left_anti")
    return new.withColumns({"source_project": F.col("project"), "project": F.lit(project)})


def filled(rows: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    """rows with one column set where the condition holds."""
    return rows.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def instance_counts(types: DataFrame, instances: DataFrame) -> DataFrame:
    """type_id, instances of every type, none included."""
    n = instances.groupBy("type_id").agg(F.count("*").alias("instances"))
    return types.select("type_id").join(n, "type_id", "left").withColumn("instances", F.coalesce("instances", F.lit(0)))


# discovery -----------------------------------------------------------------------------------------


def session_clusters(clusters: DataFrame, matches: DataFrame) -> DataFrame:
    """clusters (session, cluster_id, is_noise) with the legend entry each was matched to and its review state. matches: session, cluster_id, legend_name, confidence."""
    rows = clusters.join(matches, ["session", "cluster_id"], "left")
    state = F.when(F.col("is_noise"), "noise").when(F.col("legend_name").isNull(), "unmatched").when(F.col("confidence") == "high", "matched").otherwise("review")
    return rows.withColumn("state", state)


def session_counts(rows: DataFrame) -> DataFrame:
    """A row a session: clusters found, by confidence, and noise."""
    real = ~F.col("is_noise")
    return rows.groupBy("session").agg(F.count_if(real).alias("found"), *[F.count_if(real & (F.col("confidence") == c)).alias(c) for c in ("high", "medium", "low")], F.count_if(F.col("is_noise")).alias("noise"))


def device_evidence(sightings: DataFrame, notes: int = 8) -> DataFrame:
    """legend, instances, texts (different ones nearby), repeated (those of two sightings or more) and the first visual notes.

    sightings: legend, seq, nearby (array), note.
    """
    words = sightings.select("legend", F.explode(F.array_distinct(F.coalesce("nearby", F.array().cast("array<string>")))).alias("text")).groupBy("legend", "text").agg(F.count("*").alias("n"))
    words = words.groupBy("legend").agg(F.array_sort(F.collect_list("text")).alias("texts"), F.array_sort(F.collect_list(F.when(F.col("n") >= 2, F.col("text")))).alias("repeated"))
    w = Window.partitionBy("legend").orderBy("seq")
    said = sightings.where("coalesce(note, '') <> ''").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= notes)
    said = said.groupBy("legend").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "note"))), lambda x: x["note"]), "; ").alias("notes"))
    none = F.array().cast("array<string>")
    got = sightings.groupBy("legend").agg(F.count("*").alias("instances")).join(words, "legend", "left").join(said, "legend", "left")
    return got.withColumns({"texts": F.coalesce("texts", none), "repeated": F.coalesce("repeated", none), "notes": F.coalesce("notes", F.lit(""))})


# rules, risers and the report ----------------------------------------------------------------------


def missing_params(required: Column, params: Column) -> Column:
    """Names of the required parameters (array) that params (map) lacks or leaves blank."""
    return F.filter(required, lambda p: F.coalesce(params[p], F.lit("")) == "")


def rule_blocker(rows: DataFrame) -> DataFrame:
    """rows (conflict, required, params, qty_rule) with blocker: why a rule can't be confirmed yet, or null."""
    lacks = missing_params(F.col("required"), F.col("params"))
    return rows.withColumn("blocker", F.when(F.col("conflict"), REREAD_RULE).when(F.size(lacks) > 0, F.concat(F.lit("set "), F.array_join(lacks, ", "), F.lit(" first"))).when(F.col("qty_rule") == "not_stated", UNPICKED))


def cable_blocker(conflict: Column, plant: Column) -> Column:
    return F.when(conflict, REREAD).when(plant.isNull(), "set ISP or OSP first")


def allowance_blocker(conflict: Column, per_unit: Column, units: Column) -> Column:
    return F.when(conflict, REREAD).when(per_unit.isNull(), "set the quantity per unit first").when(units.isNull(), "set the unit count first")


def rule_counters(rules: DataFrame) -> DataFrame:
    """A row a project: rules that count, confirmed ones, coded notes, parameters set by the user and still missing.

    rules: project, rule_key, note_kind, qty_rule, confirmed, user_set, missing.
    """
    counting = (F.col("note_kind") != "drawing") & ~F.col("qty_rule").isin("layout", "none")
    return rules.groupBy("project").agg(
        F.count_if(counting).alias("counting"), F.count_if(counting & F.col("confirmed")).alias("confirmed"), F.count_if((F.col("note_kind") == "coded") & ~F.col("rule_key").contains("-")).alias("coded"),
        F.sum("user_set").alias("user_set"), F.sum(F.when(F.col("note_kind") != "drawing", F.col("missing")).otherwise(0)).alias("user_missing"),
    )


def new_feeds(feeds: DataFrame, taken: DataFrame) -> DataFrame:
    """feeds (project, seq, riser_key, kind, tr_name from match_riser) with tr_name, match_kind and suggested_tr: a room goes to its first exact feed, if no feed has it.

    taken: project, tr_name. Close matches are suggested while the room is free.
    """
    rows = feeds.join(taken.select("project", "tr_name").distinct().withColumn("_taken", F.lit(True)), ["project", "tr_name"], "left")
    exact = F.when((F.col("kind") == "exact") & F.col("_taken").isNull(), F.col("seq"))
    first = F.min(exact).over(Window.partitionBy("project", "tr_name"))
    mine = exact.isNotNull() & (exact == first)
    close = (F.col("kind") == "close") & F.col("_taken").isNull() & (first.isNull() | (F.col("seq") < first))
    return rows.select("project", "seq", "riser_key", F.when(mine, F.col("tr_name")).alias("tr_name"), F.when(mine, "exact").when(close, "close").alias("match_kind"), F.when(close, F.col("tr_name")).alias("suggested_tr"))


def rack_inputs(rooms: DataFrame, cells: DataFrame, plant: DataFrame) -> DataFrame:
    """rooms (tr_name, terminations, panels) with racks, wall_mount (null where nothing is entered for the room) and isp_osp."""
    entered = cells.groupBy("tr_name").agg(F.max(F.when(F.col("category") == "rack_new", F.col("quantity"))).alias("racks"), F.bool_or((F.col("category") == "wall_mount") & (F.col("quantity") > 0)).alias("wall_mount"))
    return rooms.join(entered, "tr_name", "left").join(plant.select("tr_name", "isp_osp"), "tr_name", "left")


def cassettes(plant: Column, per_cassette: int = 12) -> Column:
    """Cassettes of a room for both cores: strands of a core by plant, over what a cassette holds, rounded up."""
    strands = F.when(plant == "ISP", 36).otherwise(24)
    return F.ceil(strands / per_cassette).cast("long") * 2


def sidecars(racks: Column) -> Column:
    return F.when(racks > 0, racks + 1).otherwise(0)


def panels_for(terminations: Column, ports: int = 48) -> Column:
    """Patch panels for so many terminations; null stays null."""
    return F.ceil(terminations / ports).cast("long")


def section_readiness(sections: DataFrame, steps: DataFrame, unconfirmed: DataFrame) -> DataFrame:
    """sections (project, section, steps, has_data) with status and why: no data, waiting for steps, items to review, or ready.

    steps: project, step, status. unconfirmed: project, step, n (items not confirmed).
    """
    rows = sections.select("project", "section", "has_data", F.col("steps").alias("of"), F.posexplode("steps").alias("at", "step"))
    rows = rows.join(steps, ["project", "step"], "left").join(unconfirmed, ["project", "step"], "left")
    waits = F.col("status").isNotNull() & ~F.col("status").isin("confirmed", "not_applicable")
    listed = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("at", "step")))), lambda x: x["step"]), ", ")
    got = rows.groupBy("project", "section", "has_data", "of").agg(listed(waits).alias("waiting"), F.sum(F.coalesce("n", F.lit(0))).alias("open"), listed(F.coalesce("n", F.lit(0)) > 0).alias("where"))
    status = F.when(~F.col("has_data"), "no data").when(F.col("waiting") != "", "waiting").when(F.col("open") > 0, "to review").otherwise("ready")
    why = (
        F.when(~F.col("has_data"), F.concat(F.lit("nothing confirmed yet in "), F.array_join("of", ", "))).when(F.col("waiting") != "", F.concat("waiting", F.lit(" not confirmed")))
        .when(F.col("open") > 0, F.concat(F.col("open").cast("string"), F.lit(" item(s) not confirmed in "), "where")).otherwise("confirmed")
    )
    return got.select("project", "section", status.alias("status"), why.alias("why"))


def port_mismatches(by_room: DataFrame, ports: DataFrame, rooms: DataFrame, shown: int = 12) -> DataFrame:
    """A row a project: rooms whose ports in plan differ from their terminations, how many, and the first of them with the difference.

    by_room: project, tr_name, type, n. ports: type, ports. rooms: project, tr_name, terminations. Types without a port count add none.
    """
    plan = by_room.join(ports, "type", "left").groupBy("project", "tr_name").agg(F.sum(F.coalesce(F.col("n") * F.col("ports"), F.lit(0))).alias("ports"))
    met = rooms.where("terminations is not null").join(plan, ["project", "tr_name"]).withColumn("off", F.col("ports") - F.col("terminations")).where("off <> 0")
    text = F.concat("tr_name", F.lit(" "), F.when(F.col("off") > 0, "+").otherwise(""), F.col("off").cast("long").cast("string"))
    met = met.withColumns({"text": text, "_n": F.row_number().over(Window.partitionBy("project").orderBy("tr_name"))})
    detail = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= shown, F.struct("_n", "text")))), lambda x: x["text"]), ", ")
    return met.groupBy("project").agg(F.count("*").alias("rooms_off"), detail.alias("detail"))


def pricing_notes(items: DataFrame) -> DataFrame:
    """topic and text of every item that is priced in part. items: item, status, missing (array)."""
    return items.where("status = 'partial'").select(F.concat(F.lit("Not fully priced — "), "item").alias("topic"), F.concat(F.lit("left blank: "), F.array_join("missing", ", ")).alias("text"))


def generated_columns(rows: DataFrame) -> DataFrame:
    """Lines of a change order (ref_qty, cur_qty, unit_price, per_unit_qty, unit_count) with total, delta and extended."""
    delta = F.col("cur_qty") - F.col("ref_qty")
    return rows.withColumns({"total": F.col("per_unit_qty") * F.col("unit_count"), "delta": delta, "extended": round_up(delta * F.col("unit_price"), 2)})


def report_tables(items: DataFrame, prices: DataFrame, labor: DataFrame, checks: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report, by sheet: items with their price columns, labour sorted by task, checks and open notes; each is written on its own."""
    priced = items.join(prices, "key", "left").withColumn("extended", round_up(F.col("qty") * F.col("unit_price"), 2))
    return {
        "items": priced.orderBy("step", F.lower("item"), "key"), "labor": labor.orderBy(F.lower("task")), "checks": checks.orderBy("name"),
        "unpriced": priced.where("unit_price is null").select("key", "item", "step").orderBy("step", "key"),
    }


def last_events(events: DataFrame, n: int = 50) -> DataFrame:
    """The latest n events, as the report of usage shows them."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
