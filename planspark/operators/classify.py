"""Decision tables over columns: page roles, table archetypes, rack rules, prototypes and routing settings."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Title words of page roles; a phrase grants the first role whose pattern it matches.
TITLE_ROLES = [
    ("schedule", r"\bSCHEDULE\b"),
    ("legend", r"\b(LEGEND|ABBREVIATION|ABBREVIATIONS|SYMBOLS?)\b"),
    ("tr_room", r"ENLARGED\s+(DATA\s+ROOMS?|TELECOM)\b"),
    ("detail", r"\b(DETAIL|ELEVATION|TYPICAL|ENLARGED|RISER|DIAGRAM)\b"),
    ("plan", r"\bPLAN\b"),
]
#: Ties go to the role that stands first here.
ROLE_ORDER = ["plan", "schedule", "legend", "detail", "tr_room"]


def phrase_role(phrase: Column | str) -> Column:
    """The one role a title phrase votes for, or null."""
    t = S.norm(phrase)
    out = None
    for role, pattern in TITLE_ROLES:
        out = F.when(t.rlike(pattern), role) if out is None else out.when(t.rlike(pattern), role)
    return out


def _same(role: str, vote: Column) -> Column:
    return vote == role


def page_role(pages: DataFrame) -> DataFrame:
    """page_id, role, score, confidence and needs_user by votes of phrases and structure.

    pages: page_id, phrases (array), has_grand_total, has_scale_bar, room_numbers, abbreviations.
    A page without votes is unknown; confidence follows the lead over the runner-up.
    """
    votes = F.transform(F.coalesce("phrases", F.array().cast("array<string>")), phrase_role)
    extra = {
        "schedule": F.when(F.col("has_grand_total"), 2).otherwise(0), "plan": F.when(F.col("has_scale_bar"), 1).otherwise(0) + F.when(F.col("room_numbers") >= 15, 1).otherwise(0), "legend": F.when(F.col("abbreviations") >= 20, 2).otherwise(0),
    }
    scored = F.array(*[F.struct((F.size(F.filter("_v", partial(_same, r))) * 2 + extra.get(r, F.lit(0))).alias("score"), F.lit(-i).alias("order"), F.lit(r).alias("role")) for i, r in enumerate(ROLE_ORDER)])
    ranked = pages.withColumn("_v", votes).withColumn("_s", F.sort_array(scored, asc=False))
    best, margin = F.col("_s")[0], F.col("_s")[0]["score"] - F.col("_s")[1]["score"]
    none = best["score"] <= 0
    confidence = F.when(none, "low").when(margin >= 4, "high").when(margin >= 2, "medium").otherwise("low")
    return ranked.select("page_id", F.when(none, "unknown").otherwise(best["role"]).alias("role"), F.when(none, 0).otherwise(best["score"]).alias("score"), confidence.alias("confidence"), (confidence == "low").alias("needs_user"))


#: Header words of table archetypes.
DEVICE_ID = r"^(UIN|TAG|DEVICE\s*ID|EQUIPMENT\s*ID|OUTLET\s*ID|ITEM)$"
QUANTITY = r"\bQUANTITY\b|\bQTY\b|\bGRAND\s*TOTAL\b|\bTOTAL\b"
TYPE = r"^TYPE$|OUTLET\s*TYPE|DEVICE\s*TYPE|^DESIGNATOR$"
GRAND_TOTAL = r"\bGRAND\s*TOTAL\b"
ROOM_KEY = r"\bROOM\s*NUMBER\b|\bTELECOMMUNICATIONS\s*ROOM\b|^TR$|^TR\s*(NUMBER|NAME|ID)$"
ROOM_METRIC = r"\bTERMINATIONS\b|\bPATCH\s*PANELS?\b"


def table_archetype(tables: DataFrame) -> DataFrame:
    """table_id, archetype and score from headers, the grand-total row and the values of the id column.

    tables: table_id, headers, grand_total_row, id_values. A tie for the best score, or none, is unknown.
    """
    heads = F.transform(F.coalesce("headers", F.array().cast("array<string>")), S.norm)

    def has(pattern: str) -> Column:
        return F.exists("_h", lambda h: h.rlike(pattern))

    values = F.filter(F.transform(F.coalesce("id_values", F.array().cast("array<string>")), S.norm), lambda v: v != "")
    rows = tables.withColumns({"_h": heads, "_v": values})
    share = F.size(F.array_distinct("_v")) / F.when(F.size("_v") > 0, F.size("_v"))
    device_id, total, i = has(DEVICE_ID), F.coalesce("grand_total_row", F.lit(False)) | has(GRAND_TOTAL), lambda c, n: F.when(c, n).otherwise(0)
    scores = {
        "device_list": i(device_id, 2) + i(share > 0.8, 2),
        "quantity_matrix": i(has(TYPE) & has(QUANTITY), 2) + i(total, 2) + i(share <= 0.5, 1) - i(device_id & ~total, 1),
        "tr_summary": i(has(ROOM_KEY), 2) + i(has(ROOM_METRIC), 2) - i(device_id, 3) - i(total, 1),
    }
    rows = rows.withColumn("_s", F.sort_array(F.array(*[F.struct(v.alias("score"), F.lit(k).alias("k")) for k, v in scores.items()]), asc=False))
    best, second = F.col("_s")[0], F.col("_s")[1]
    unknown = (best["score"] <= 0) | (best["score"] == second["score"])
    return rows.select("table_id", F.when(unknown, "unknown").otherwise(best["k"]).alias("archetype"), best["score"].alias("score"))


def effective_routing(project_mode: Column, project_multiplier: Column, page_mode: Column, page_multiplier: Column) -> tuple[Column, Column]:
    """Mode and multiplier of a page: its own, else its project's, else straight at 1.4."""

    def known(m: Column) -> Column:
        return F.when(m.isin("straight", "right_angle", "routed"), m)

    return F.coalesce(known(page_mode), known(project_mode), F.lit("straight")), F.coalesce(F.when(page_multiplier > 0, page_multiplier), F.when(project_multiplier > 0, project_multiplier), F.lit(1.4))


def settings_change(devices: DataFrame) -> DataFrame:
    """What a change of routing settings does to each measured device: recount its page, rescale it, or nothing.

    devices: id, page_id, route_method, route_multiplier, route_ft_raw, stub_ft, limit_ft, mode and multiplier (effective).
    """
    rows = devices.where(F.col("route_method").isNotNull() & ~F.col("route_method").isin("none", "fallback"))
    other = F.col("route_method") != F.col("mode")
    moved = ~other & F.col("route_ft_raw").isNotNull() & (F.abs(F.col("route_multiplier") - F.col("multiplier")) >= 1e-9)
    feet = S.rescale_ft("route_ft_raw", "multiplier", "stub_ft")
    out = rows.withColumn("action", F.when(other, "recount").when(moved, "rescale").otherwise("none")).where("action <> 'none'")
    out = out.withColumn("route_ft", F.when(F.col("action") == "rescale", feet))
    return out.select("id", "page_id", "action", "route_ft", (F.coalesce(F.col("route_ft") > F.col("limit_ft"), F.lit(False))).alias("tia_flag"))


#: Rows of a settings table (rules, prototypes) that are sent to all tasks at most.
SETTINGS = 10_000


def with_settings(rows: DataFrame, settings: DataFrame, name: str) -> DataFrame:
    """rows with all settings as one array, broadcast; over SETTINGS of them is an error, as such a table is no settings table."""
    packed = settings.agg(F.collect_list(F.struct(*settings.columns)).alias(name)).withColumn("_one", F.lit(1))
    packed = packed.where(F.assert_true(F.size(name) <= SETTINGS, f"over {SETTINGS} rows of settings").isNull())
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(packed), "_one").drop("_one")


def size_racks(rooms: DataFrame, rules: DataFrame) -> DataFrame:
    """Quantity of each counted rule in each room, or a note on what is missing.

    rooms: tr_name, racks, panels, terminations, wall_mount, plant. rules: rule_key, qty_rule, each, ports,
    fibers, cores, strands_isp, strands_osp. Every room needs every rule; rules go to the rooms as one array of SETTINGS at most.
    """
    both = with_settings(rooms, rules.where(~F.col("qty_rule").isin("layout", "none")), "_rule")
    both = both.select(*rooms.columns, F.explode("_rule").alias("_r")).select(*rooms.columns, "_r.*")
    r, kind = F.col("racks"), F.col("qty_rule")
    each = F.coalesce("each", F.lit(1.0))
    strands = F.when(F.col("plant") == "osp", F.col("strands_osp")).when(F.col("plant") == "isp", F.col("strands_isp"))
    qty = (
        F.when(kind == "per_wall_mount", F.when(F.col("wall_mount"), each).when(~F.col("wall_mount"), 0.0))
        .when(r.isNull(), None)
        .when(kind == "per_rack", r * each)
        .when(kind == "racks_plus_one", F.when(r > 0, r + 1.0).otherwise(0.0))
        .when(kind == "per_tr", F.when(r > 0, each).otherwise(0.0))
        .when(kind == "strands_div_cassette", F.when(r <= 0, 0.0).otherwise(F.ceil(strands / F.col("fibers")) * F.coalesce("cores", F.lit(1.0))))
        .when(kind == "schedule_div_racks", F.col("panels").cast("double"))
        .when(kind == "terminations_div_ports", F.ceil(F.col("terminations") / F.col("ports")).cast("double"))
        .when(kind == "per_panel", F.ceil(F.col("panels") * F.col("each")).cast("double"))
    )
    note = F.when(qty.isNotNull(), None).when((kind == "per_wall_mount"), "no wall-mount entry").when(r.isNull(), "rack count not entered").when(kind == "not_stated", "quantity not stated on the sheet").otherwise("value missing")
    return both.select("tr_name", "rule_key", "qty_rule", qty.alias("qty"), note.alias("note"))


def unused_units(sized: DataFrame, rules: DataFrame, rooms: DataFrame, rack_units: float) -> DataFrame:
    """Rack units that stay free in each room: capacity less the height of counted items; null if an item has no quantity."""
    used = sized.join(rules.where("ru > 0").select("rule_key", "ru"), "rule_key").groupBy("tr_name").agg(F.sum(F.col("qty") * F.col("ru")).alias("used"), F.count_if(F.col("qty").isNull()).alias("open"))
    out = rooms.select("tr_name", "racks").join(used, "tr_name", "left")
    free = F.greatest(F.lit(0.0), F.floor(F.col("racks") * rack_units - F.coalesce("used", F.lit(0.0))).cast("double"))
    return out.select("tr_name", F.when(F.coalesce("open", F.lit(0)) == 0, free).alias("free_ru"))


def prototypes(signatures: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mean signature of each label."""
    return signatures.groupBy(label).agg(*[F.avg(f).alias(f) for f in features])


def nearest_prototype(items: DataFrame, protos: DataFrame, features: list[str], key: str, label: str, tolerance: float) -> DataFrame:
    """The label of the nearest prototype by summed absolute differences, or no_match beyond the tolerance.

    protos is a settings table, a row a label (SETTINGS at most), sent to all tasks as one array.
    """
    packed = protos.select(F.col(label).alias("label"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    rows = with_settings(items.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("v")), packed, "protos")
    scored = F.transform("protos", lambda p: F.struct(F.aggregate(F.zip_with("v", p["v"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d).alias("distance"), p["label"].alias("label")))
    rows = rows.withColumn("best", F.array_min(scored))
    return rows.select(key, F.when(F.col("best.distance") <= tolerance, F.col("best.label").cast("string")).otherwise("no_match").alias("match"), F.col("best.distance").alias("distance"))
