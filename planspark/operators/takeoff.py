"""The take-off of route sheets in one call: segments with their callouts, checks to verify, quantities, and what could not be recognised."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import callout, round_even
from .graph import checkpointed
from .plant import callout_texts, described_places, end_tags, landmarks, leader_tips, nearest_piece, request_text, segment_rows
from .route_graph import PAGE, Routes, routes
from .shapes import nearest_piece_within, piece_distance
from .spatial import in_boxes, within

#: How far a leader begins from its callout's first or last line, and off its middle; how near its tip comes to a segment, or to a vault's tag.
START, OFF, HIT, TAG = 14.0, 6.0, 8.0, 4.0
#: Thin black strokes that may be leaders.
LEADER_WIDTH, LEADER_LENGTH = (0.05, 1.0), (0.5, 900.0)

#: Statuses, and what makes a finding doubtful.
CANDIDATE, VERIFY = "RFI candidate", "verify on overlay"
NO_CALLOUT, BY_PROXIMITY, MIXED, LOOP = "%s has no callout", "%s callout placed by proximity", "%s carries 2+ different callouts", "%s is a closed loop (chaining artifact)"
INFERRED, NO_OUTLINE = "%s is script-inferred (no MH/HH symbol)", "%s tag outline not found"
MISSED, CONFIRM = "leader may have been missed by the script", "plan-view bend total; confirm on overlay"

#: Section, item, unit and note of the quantity table, in its order.
ITEMS = [
    ("Structures", "Manholes (MH)", "ea", "typ 6'x6'x6' per CU602"),
    ("Structures", "Handholes (HH)", "ea", "typ 3'x3'x4' per T-502"),
    ("Structures", "Junctions with no vault shown", "ea", "script-inferred - review in discrepancy log"),
    ("Structures", "Building entries / continuation ends", "ea", ""),
    ("Route length (plan, center-to-center)", "New route (red)", "ft", ""),
    ("Route length (plan, center-to-center)", "Existing route (blue)", "ft", ""),
    ("Route length (plan, center-to-center)", "Total route", "ft", ""),
    ("Route length (plan, center-to-center)", "New duct bank / trench", "ft", 'new route carrying new 4" conduit'),
    ("Conduit - new install", '4" conduit (total)', "ft", "conduit count x new route length"),
    ("Conduit - new install", '4" conduit - with cables', "ft", ""),
    ("Conduit - new install", '4" conduit - spare', "ft", ""),
    ("Conduit - new install", '1" fire-alarm fiber conduit', "ft", ""),
    ("Conduit - coordination (by EC / electrical dwgs)", '4" with electrical cables', "ft", "shown for coordination only"),
    ("Conduit - existing (reused)", '4" conduit in existing routes', "ft", "field-verify condition and fill"),
    ("Cable (plan length, no slack / vertical)", "Core-A cable", "ft", ""),
    ("Cable (plan length, no slack / vertical)", "Core-B cable", "ft", ""),
    ("Cable (plan length, no slack / vertical)", "Demarc cables", "", "quantity not given on drawings - RFI"),
    ("Completeness", "Segments", "ea", ""),
    ("Completeness", "Segments with no callout (not in conduit/cable totals)", "ea", "ft of route"),
    ("Completeness", "Callouts matched by proximity (verify)", "ea", ""),
    ("Completeness", "Runs over pull-length limit", "ea", ""),
    ("Completeness", "Runs over 180 deg plan bends", "ea", ""),
    ("Completeness", "Discrepancies - RFI candidates", "ea", ""),
    ("Completeness", "Discrepancies - verify on overlay", "ea", ""),
]
NOT_STATED = "not stated"

#: Why a sheet gave less than a take-off.
NO_SCALE = "No scale bar recognised — enter the scale (feet per inch) to measure this sheet."
NO_LINES = "No red or blue conduit linework recognised — check the line types in WF1."
NO_VAULTS = "No MH or HH labels recognised on this sheet."
NO_SYMBOL = "No symbol outline found around %s — position taken from the label."
NO_CALLOUTS = 'No cable callouts recognised — expected text starting "(n) CORE-A" or "(n) CORE-B".'


@dataclass
class TakeOff:
    """segments, nodes, callouts, discrepancies, quantities and problems of all sheets."""

    segments: DataFrame
    nodes: DataFrame
    callouts: DataFrame
    discrepancies: DataFrame
    quantities: DataFrame
    problems: DataFrame


def _text(c: Column) -> Column:
    return round_even(c).cast("long").cast("string")


def leader_strokes(strokes: DataFrame) -> DataFrame:
    """page_id, leader, x0, y0, x1, y1 of strokes (page_id, leader, width, black, pts) thin and short enough for a leader."""
    first, last = F.get("pts", F.lit(0)), F.element_at("pts", -1)
    steps = F.zip_with(F.slice("pts", 1, F.greatest(F.size("pts") - 1, F.lit(0))), F.slice("pts", 2, F.greatest(F.size("pts") - 1, F.lit(0))), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    length = F.aggregate(steps, F.lit(0.0), lambda a, s: a + s)
    rows = strokes.where(F.col("black") & F.col("width").between(*LEADER_WIDTH) & length.between(*LEADER_LENGTH))
    return rows.select(PAGE, "leader", first["x"].alias("x0"), first["y"].alias("y0"), last["x"].alias("x1"), last["y"].alias("y1"))


def placed_callouts(lines: DataFrame, leaders: DataFrame, made: Routes, zones: DataFrame, sheets: DataFrame) -> DataFrame:
    """page_id, callout (its label), segment, method, text and the fields of its wording, of every callout of every sheet.

    lines: page_id, block, seq, text, x0, y0, x1, y1. leaders: page_id, leader, x0, y0, x1, y1. zones: page_id, zone and box. A callout belongs to
    the segment that its leader comes nearest to within HIT; else to the nearest segment at a vault whose tag a tip of its leader
    touches; else to the nearest of its page, which its method says.
    """
    found = checkpointed(callout_texts(lines, [PAGE, "block"]).withColumn("callout", F.concat_ws("/", F.col("block").cast("string"), F.col("callout").cast("string"))))
    ends = leaders.select(PAGE, "leader", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"x{e}").alias("rx"), F.col(f"y{e}").alias("ry")) for e in (0, 1)])).alias("e")).select(PAGE, "leader", "e.*")
    sides = [F.struct(F.col(f"{line}.{x}").alias("x"), ((F.col(f"{line}.y0") + F.col(f"{line}.y1")) / 2).alias("y")) for line in ("first", "last") for x in ("x0", "x1")]
    anchors = found.select(PAGE, "callout", F.explode(F.array(*sides)).alias("a")).select(PAGE, "callout", "a.*")
    starts = within(anchors, ends, START, [PAGE]).where(F.abs(F.col("ry") - F.col("y")) <= OFF).select(PAGE, "callout", "leader", "end").distinct()
    tips = checkpointed(leader_tips(starts, leaders))
    pieces = made.pieces.select(PAGE, "segment", "ax", "ay", "bx", "by")
    led = nearest_piece_within(tips, pieces, HIT, [PAGE], [PAGE, "callout"], "segment").select(PAGE, "callout", "segment")
    # tips under a vault's tag: the nearest segment of those that end there
    core = zones.select(PAGE, F.concat_ws(":", F.lit("Z"), F.col(PAGE).cast("string"), F.col("zone").cast("string")).alias("node"), *[(F.col(c) + d).alias(c) for c, d in (("x0", -TAG), ("y0", -TAG), ("x1", TAG), ("y1", TAG))])
    under = in_boxes(tips.join(led, [PAGE, "callout"], "left_anti"), core, 50.0, [PAGE]).select(PAGE, "callout", "x", "y", "node")
    at = made.segments.select("segment", F.explode(F.array("from_node", "to_node")).alias("node"))
    met = under.join(at, "node").join(made.pieces.select("segment", "ax", "ay", "bx", "by"), "segment")
    tagged = met.groupBy(PAGE, "callout").agg(F.min(F.struct(piece_distance().alias("d"), "segment")).alias("m")).select(PAGE, "callout", "m.segment")
    led = checkpointed(led.unionByName(tagged).withColumn("method", F.lit("leader")))
    rest = found.join(led, [PAGE, "callout"], "left_anti").select(PAGE, "callout", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    near = nearest_piece(rest, pieces, 1.0).join(sheets.select(PAGE, "per_ft"), PAGE)
    near = near.select(PAGE, "callout", "segment", F.concat(F.lit("NEAREST ONLY ("), _text(F.col("dist") / F.col("per_ft")), F.lit(" ft) - verify")).alias("method"))
    n = F.row_number().over(Window.partitionBy(PAGE).orderBy(round_even(F.col("y0") / 20), "x0", "y0", "callout")).cast("string")
    rows = found.withColumn("label", F.concat(F.lit("toC"), F.lpad(n, F.greatest(F.lit(2), F.length(n)), "0"))).withColumn("f", callout("text"))
    return rows.join(led.unionByName(near), [PAGE, "callout"]).select(PAGE, F.col("label").alias("callout"), "segment", "method", "text", "f.*")


def _risks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (labels from_node, to_node) with risks: what makes a finding on the segment doubtful, in order."""
    flags = F.coalesce("flags", F.lit(""))
    of_node = nodes.select(PAGE, F.col("label").alias("_n"), F.filter(F.array(F.when(F.col("type").isin("JUNCTION", "BEND"), F.format_string(INFERRED, "label")), F.when(F.col("source") == "label-only", F.format_string(NO_OUTLINE, "label"))), lambda r: r.isNotNull()).alias("_w"))
    for side in ("from_node", "to_node"):
        rows = rows.join(of_node.withColumnsRenamed({"_n": side, "_w": f"_{side}"}), [PAGE, side], "left")
    own = F.array(
        F.when(F.col("core") == "", F.format_string(NO_CALLOUT, "segment")), F.when(flags.contains("proximity"), F.format_string(BY_PROXIMITY, "segment")),
        F.when(flags.contains("multi-config"), F.format_string(MIXED, "segment")), F.when(F.col("from_node") == F.col("to_node"), F.format_string(LOOP, "segment")),
    )
    none = F.array().cast("array<string>")
    risks = F.array_distinct(F.filter(F.concat(own, F.coalesce("_from_node", none), F.coalesce("_to_node", none)), lambda r: r.isNotNull()))
    return rows.withColumn("risks", risks).drop("_from_node", "_to_node")


FINDING = ["category", "at", "x", "y", "legs", "expected", "found", "whats_off", "risks"]


def _node_findings(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings at vaults and junctions whose cables don't add up, and page_id, label, balance of each."""
    ends = rows.select(PAGE, "segment", "core", "cables", "risks", F.explode(F.array("from_node", "to_node")).alias("label"))
    at = nodes.where(F.col("type").isin("MH", "HH", "JUNCTION")).select(PAGE, "label", "type", "source", "x", "y")
    legs = at.join(ends, [PAGE, "label"], "left")
    leg = F.struct((-F.col("cables")).alias("less"), "segment", "cables")
    core = lambda c: F.collect_list(F.when(F.col("core") == c, leg))
    some = legs.groupBy(PAGE, "label", "type", "source", "x", "y").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment", "risks"))), lambda r: r["risks"])).alias("risks"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("core") == "", F.struct("segment", F.lit(1).alias("one"))))), lambda r: r["segment"]).alias("missing"), core("A").alias("A"), core("B").alias("B"),
    )
    own = F.filter(F.array(F.when(F.col("source") == "label-only", F.format_string(NO_OUTLINE, "label")), F.when(F.col("type") == "JUNCTION", F.format_string(INFERRED, "label"))), lambda r: r.isNotNull())
    some = some.withColumn("risks", F.array_distinct(F.concat(own, F.filter("risks", lambda r: r.isNotNull()))))
    each = some.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("core"), F.col(c).alias("legs")) for c in "AB"])).alias("c")).select("*", "c.*").where(F.size("legs") > 0).drop("A", "B", "c")
    # the leg with the most cables first, of equal ones the last name first
    order = F.array_sort("legs", lambda a, b: F.when(a["cables"] != b["cables"], F.when(a["cables"] > b["cables"], -1).otherwise(1)).when(a["segment"] > b["segment"], -1).when(a["segment"] < b["segment"], 1).otherwise(0))
    each = each.withColumn("legs", order).withColumns({"head": F.get("legs", F.lit(0)), "named": F.array_join(F.transform("legs", lambda g: F.concat(g["segment"], F.lit("="), g["cables"].cast("string"))), ", ")})
    each = each.withColumn("rest", F.aggregate(F.slice("legs", 2, F.greatest(F.size("legs") - 1, F.lit(1))), F.lit(0).cast("long"), lambda a, g: a + g["cables"].cast("long")))
    one, many = (F.size("legs") == 1) & (F.size("missing") == 0), (F.size("legs") > 1) & (F.col("head.cables") != F.col("rest"))
    trunk, lost = F.col("head.cables").cast("long"), F.array_join("missing", " ")
    diff, vault = trunk - F.col("rest"), F.col("type") != "JUNCTION"
    s = lambda c: c.cast("string")
    name = F.concat(F.lit("Core-"), "core")
    found = each.where(one | many).select(
        PAGE, F.when(one, "NO CONTINUATION").when(vault, "COUNT IMBALANCE").otherwise("COUNT CHANGE, NO VAULT").alias("category"), F.col("label").alias("at"), "x", "y",
        F.concat(name, F.lit(": "), "named", F.when(many & (F.size("missing") > 0), F.concat(F.lit("; no callout on "), lost)).otherwise("")).alias("legs"),
        F.when(one, F.concat(name, F.lit(" continues on another leg"))).otherwise(F.concat("head.segment", F.lit(" ("), s(trunk), F.lit(") = sum of other legs"))).alias("expected"),
        F.when(one, "only one leg carries it").otherwise(F.concat(F.lit("other legs sum to "), s(F.col("rest")))).alias("found"),
        F.when(one, F.concat(s(trunk), F.lit(" "), name, F.lit(" end at "), "label", F.lit(" with no outgoing leg"))).when(vault, F.concat(F.lit("off by "), F.when(diff >= 0, "+").otherwise(""), s(diff), F.lit(" "), name))
        .otherwise(F.concat(F.lit("count changes "), s(F.least(trunk, F.col("rest"))), F.lit("->"), s(F.greatest(trunk, F.col("rest"))), F.lit(" where no MH/HH is shown"))).alias("whats_off"),
        "risks",
    )
    message = F.when(one, F.concat(name, F.lit(" only on "), "head.segment", F.lit(" - no continuation"))).when(many, F.concat(name, F.lit(": "), "head.segment", F.lit("="), s(trunk), F.lit(" vs others="), s(F.col("rest"))))
    said = each.groupBy(PAGE, "label").agg(F.transform(F.array_sort(F.collect_list(F.when(one | many, F.struct("core", message.alias("m"))))), lambda r: r["m"]).alias("said"))
    balance = some.select(PAGE, "label", "missing").join(said, [PAGE, "label"], "left")
    words = F.concat(F.coalesce("said", F.array().cast("array<string>")), F.when(F.size("missing") > 0, F.array(F.concat(F.lit("no callout on "), lost))).otherwise(F.array().cast("array<string>")))
    return found, balance.select(PAGE, "label", F.when(F.size(words) > 0, F.concat(F.lit("CHECK "), F.array_join(words, "; "))).otherwise("OK").alias("balance"))


def _segment_findings(rows: DataFrame, callouts: DataFrame, bend: float) -> DataFrame:
    """Findings on segments: loops, and where there is none missing callouts, mixed ones, pulls and bends over the limit."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("callout", F.concat("callout", F.lit(": "), F.col("cables").cast("string"), F.lit(" Core-"), "core", F.lit(", "), F.col("n4").cast("string"), F.lit("x4in")).alias("t")))), lambda r: r["t"])
    of = callouts.groupBy("segment_id").agg(F.array_join(said, "; ").alias("said"), F.count("*").alias("many"))
    rows = rows.join(of, "segment_id", "left")
    run, flags = F.concat("from_node", F.lit("->"), "to_node"), F.coalesce("flags", F.lit(""))
    loop = F.col("from_node") == F.col("to_node")
    limit = F.regexp_replace(F.col("pull_limit_ft").cast("string"), r"\.0$", "")
    over = F.col("total_ft") - F.col("pull_limit_ft")

    def finding(when: Column, category: str, legs: Column, expected: Column | str, found: Column | str, off: Column | str, *more: str) -> Column:
        text = lambda c: c if isinstance(c, Column) else F.lit(c)
        return F.when(when, F.struct(F.lit(category).alias("category"), legs.alias("legs"), text(expected).alias("expected"), text(found).alias("found"), text(off).alias("whats_off"), F.array_distinct(F.concat("risks", F.array(*[F.lit(m) for m in more]).cast("array<string>"))).alias("risks")))

    checks = F.array(
        finding(loop, "TOPOLOGY", run, "run between two different nodes", "closed loop", "script chaining artifact - not a drawing issue"),
        finding(~loop & (F.col("core") == ""), "MISSING CALLOUT", run, "a cable/conduit callout on the run", "none attached", "configuration unknown for this run", MISSED),
        finding(~loop & flags.contains("multi-config"), "CONFIG CHANGE MID-RUN", F.col("said"), "one configuration per MH/HH-to-MH/HH run", F.concat(F.col("many").cast("string"), F.lit(" different callouts")), "configuration changes with no MH/HH between"),
        finding(~loop & flags.contains("PULL LIMIT"), "PULL LENGTH", run, F.concat(F.lit("<= "), limit, F.lit(" ft between pull points")), F.concat(_text(F.col("total_ft")), F.lit(" ft")), F.concat(F.lit("exceeds limit by "), _text(over), F.lit(" ft"))),
        finding(~loop & flags.contains("BENDS"), "BENDS", run, f"<= {bend:g} deg cumulative", F.concat(F.col("bends_deg").cast("string"), F.lit(" deg ("), "bend_detail", F.lit(")")), F.concat(F.lit("exceeds by "), (F.col("bends_deg") - F.lit(int(bend))).cast("string"), F.lit(" deg")), CONFIRM),
    )
    return rows.select(PAGE, F.col("segment").alias("at"), "x", "y", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c")).select(PAGE, "at", "x", "y", "c.*").select(PAGE, *FINDING)


def discrepancies(rows: DataFrame, nodes: DataFrame, callouts: DataFrame, bend: float, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """page_id, item, status, category, at, location, legs, expected, found, whats_off, verify_first of everything to verify, and the balance of nodes.

    rows: page_id, segment (label), segment_id, from_node, to_node (labels), core, cables, flags, total_ft, pull_limit_ft, bends_deg, bend_detail, x, y.
    nodes: page_id, label, type, source, x, y. places: page_id, at, location. A finding nothing speaks against is a candidate to
    ask about; the others come after it. Items are numbered a sheet by status, category and place.
    """
    rows = checkpointed(_risks(rows, nodes))
    at_nodes, balance = _node_findings(rows, nodes)
    found = at_nodes.unionByName(_segment_findings(rows, callouts, bend))
    if places is None:
        found = found.withColumn("location", F.lit(""))
    else:
        found = found.join(places.select(PAGE, "at", "location"), [PAGE, "at"], "left").withColumn("location", F.coalesce("location", F.lit("")))
    status = F.when(F.size("risks") > 0, VERIFY).otherwise(CANDIDATE)
    n = F.row_number().over(Window.partitionBy(PAGE).orderBy(F.size("risks") > 0, "category", "at", "legs")).cast("string")
    item = F.concat(F.lit("toD"), F.lpad(n, F.greatest(F.lit(2), F.length(n)), "0"))
    return found.select(PAGE, item.alias("item"), status.alias("status"), "category", "at", "location", "legs", "expected", "found", "whats_off", F.array_join("risks", "; ").alias("verify_first")), balance


def quantities(rows: DataFrame, nodes: DataFrame, callouts: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place (the row's number), section, item, quantity, quantity_text, unit, note: the whole quantity table of each sheet.

    quantity_text is set where the quantity isn't a number; numbers that aren't whole are rounded.
    """
    f = lambda c, when=None: F.sum(c if when is None else F.when(when, c).otherwise(0.0))
    new, old, total = F.col("new_ft"), F.col("existing_ft"), F.col("total_ft")
    bare, flags = F.col("core") == "", F.coalesce("flags", F.lit(""))
    by_segment = rows.groupBy(*keys).agg(
        f(new).alias("i4"), f(old).alias("i5"), (f(new) + f(old)).alias("i6"), f(new, (F.col("n4") > 0) & (F.col("pathway") == "duct bank")).alias("i7"), f(F.col("n4") * new).alias("i8"), f(F.col("with_cables") * new).alias("i9"), f(F.col("spare") * new).alias("i10"),
        f(F.col("n1_fa") * new).alias("i11"), f(F.col("elec") * total).alias("i12"), f(F.col("n4") * old).alias("i13"), f(F.col("cables") * total, F.col("core") == "A").alias("i14"), f(F.col("cables") * total, F.col("core") == "B").alias("i15"),
        F.count("*").alias("i17"), F.count_if(bare).alias("i18"), f(total, bare).alias("bare_ft"), F.count_if(flags.contains("PULL LIMIT")).alias("i20"), F.count_if(flags.contains("BENDS")).alias("i21"),
    )
    by_node = nodes.groupBy(*keys).agg(*[F.count_if(F.col("type") == k).alias(f"i{i}") for i, k in enumerate(("MH", "HH", "JUNCTION", "END"))])
    by_callout = callouts.groupBy(*keys).agg(F.count_if(F.col("method") != "leader").alias("i19"))
    by_finding = found.groupBy(*keys).agg(F.count_if(F.col("status") == CANDIDATE).alias("i22"), F.count_if(F.col("status") != CANDIDATE).alias("i23"))
    wide = by_segment.join(by_node, keys, "left").join(by_callout, keys, "left").join(by_finding, keys, "left")
    whole = lambda c: F.when(c == F.floor(c), c).otherwise(round_even(c))
    bare_note = F.concat(F.regexp_replace(F.format_number(round_even(F.col("bare_ft")), 0), " ", ""), F.lit(" ft of route"))
    lines = [
        F.struct(F.lit(i).alias("place"), F.lit(section).alias("section"), F.lit(item).alias("item"), (F.lit(None).cast("double") if i == 16 else whole(F.coalesce(F.col(f"i{i}"), F.lit(0)).cast("double"))).alias("quantity"), F.lit(NOT_STATED if i == 16 else None).cast("string").alias("quantity_text"), F.lit(unit).alias("unit"), (bare_note if i == 18 else F.lit(note)).alias("note"))
        for i, (section, item, unit, note) in enumerate(ITEMS)
    ]
    return wide.select(*keys, F.explode(F.array(*lines)).alias("q")).select(*keys, "q.*")


def combined(sheets: DataFrame) -> DataFrame:
    """The quantity tables of many sheets as one: numbers are added by section and item, text quantities stay, notes that count feet go."""
    rows = sheets.groupBy("section", "item").agg(F.min("place").alias("place"), F.sum("quantity").alias("quantity"), F.first("quantity_text", True).alias("quantity_text"), F.first("unit", True).alias("unit"), F.min("note").alias("note"))
    return rows.select("place", "section", "item", "quantity", "quantity_text", "unit", F.when(F.col("note").rlike("ft of route$"), "").otherwise(F.col("note")).alias("note"))


def border_labels(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """columns and rows (page_id, name, at) of the grid that a sheet's border names: 1 to 12 along it, A to H up it, each at its middle place.

    words: page_id, str, x, y (their middles), width and height of the page.
    """
    w, h = F.col("width"), F.col("height")
    along = words.where(F.col("str").rlike("^([1-9]|1[0-2])$") & ((F.col("y") < h * 0.04) | (F.col("y") > h * 0.96))).select(PAGE, F.col("str").alias("name"), F.col("x").alias("at"))
    up = words.where(F.col("str").rlike("^[A-H]$") & ((F.col("x") < w * 0.03) | (F.col("x") > w * 0.97))).select(PAGE, F.col("str").alias("name"), F.col("y").alias("at"))
    middle = lambda df: df.groupBy(PAGE, "name").agg(F.array_sort(F.collect_list("at")).alias("all")).select(PAGE, "name", F.get("all", F.floor(F.size("all") / 2).cast("int")).alias("at"))
    return middle(along), middle(up)


def take_off(points: DataFrame, zones: DataFrame, lines: DataFrame, leaders: DataFrame, sheets: DataFrame, words: DataFrame, osp: float, interior: float, bend: float) -> TakeOff:
    """The whole take-off of every sheet of ``sheets``.

    points: page_id, chain, seq, x, y, cls, as dashes.dashed_lines() gives them. zones: page_id, zone, kind, source (symbol or label-only), x0, y0, x1,
    y1: the tag's outline. lines: page_id, block, seq, text and a box. leaders: page_id, leader, x0, y0, x1, y1. sheets: page_id, sheet, bridge,
    per_ft (null: no scale). words: as border_labels() takes them. osp, interior and bend: the limits.
    """
    sheets, points = checkpointed(sheets), checkpointed(points)
    scaled = sheets.where("per_ft is not null")
    grown = zones.join(scaled.select(PAGE, "bridge"), PAGE).select(PAGE, "zone", "kind", *[(F.col(c) + s * F.col("bridge")).alias(c) for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])
    made = routes(points.join(scaled.select(PAGE), PAGE, "left_semi"), grown, scaled)
    said = checkpointed(placed_callouts(lines, leaders, made, zones, scaled))
    source = zones.select(F.concat_ws(":", F.lit("Z"), F.col(PAGE).cast("string"), F.col("zone").cast("string")).alias("node"), "source")
    nodes = made.nodes.join(source, "node", "left")
    blocks = lines.groupBy(PAGE, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), "\n").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    tags = end_tags(nodes.where("type = 'END'").select(PAGE, F.col("node").alias("end"), "x", "y"), blocks).select(F.col("end").alias("node"), "note")
    nodes = checkpointed(nodes.join(tags, "node", "left").withColumn("note", F.when(F.col("type") == "END", F.col("note")).when(F.startswith("node", F.lit("T:")), "tee").otherwise("")))
    numbered = said.withColumn("seq", F.substring("callout", 4, 9).cast("int"))
    # cut here: constraints on so many columns that follow from one another take the optimizer minutes
    rows = checkpointed(segment_rows(made.segments.drop("edges"), numbered, osp, interior, bend))
    of_callouts = said.groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list("callout")), " ").alias("callouts"))
    label = lambda side: nodes.select(F.col("node").alias(side), F.col("label").alias(f"_{side}"), F.col("type").alias(side.replace("node", "type")))
    rows = rows.join(label("from_node"), "from_node").join(label("to_node"), "to_node").join(of_callouts, "segment", "left")
    feet = ("total_ft", "new_ft", "existing_ft")
    kept = [c for c in rows.columns if c not in ("segment", "label", "from_node", "to_node", "_from_node", "_to_node", "callouts", *feet)]
    rows = rows.select(F.col("segment").alias("segment_id"), F.col("label").alias("segment"), F.col("_from_node").alias("from_node"), F.col("_to_node").alias("to_node"), F.coalesce("callouts", F.lit("")).alias("callouts"), *[round_even(F.col(c), 1).alias(c) for c in feet], *kept)
    rows = checkpointed(rows)
    said = said.withColumnRenamed("segment", "segment_id").join(rows.select("segment_id", "segment"), "segment_id")
    columns, up = border_labels(words)
    spots = nodes.select(PAGE, F.col("label").alias("id"), "x", "y").unionByName(rows.select(PAGE, F.col("segment").alias("id"), "x", "y"))
    marks = landmarks(lines).select(PAGE, "name", "x", "y")
    scale = scaled.select(PAGE, "per_ft")
    places = described_places(spots.join(scale, PAGE), columns, up, marks, F.col("per_ft")).select(PAGE, F.col("id").alias("at"), F.col("place").alias("location"))
    found, balance = discrepancies(rows, nodes, said, bend, places)
    found = checkpointed(found)
    nodes = nodes.join(checkpointed(balance), [PAGE, "label"], "left").withColumn("balance", F.coalesce("balance", F.lit("")))
    table = quantities(rows, nodes, said, found, [PAGE])
    asked = found.join(sheets.select(PAGE, "sheet"), PAGE)
    asked = asked.withColumn("rfi", request_text(F.col("category"), F.col("sheet"), F.col("location"), F.col("legs"), F.col("expected"), F.col("found"), F.col("whats_off"))).drop("sheet")
    return TakeOff(rows, checkpointed(nodes), checkpointed(said), checkpointed(asked), checkpointed(table), checkpointed(_problems(sheets, points, zones, rows, said)))


def _problems(sheets: DataFrame, points: DataFrame, zones: DataFrame, rows: DataFrame, said: DataFrame) -> DataFrame:
    """page_id, place, problem: what could not be recognised of each sheet; nothing where all was."""
    has = lambda df, name: df.select(PAGE).distinct().withColumn(name, F.lit(True))
    n = F.row_number().over(Window.partitionBy(PAGE, "kind").orderBy("zone")).cast("string")
    bare = zones.withColumn("label", F.concat(F.lit("to"), "kind", F.lit("-"), n)).where("source <> 'symbol'").groupBy(PAGE).agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("bare"))
    all_ = sheets.join(has(points, "lines"), PAGE, "left").join(has(zones, "vaults"), PAGE, "left").join(has(rows, "routes"), PAGE, "left").join(has(said, "said"), PAGE, "left").join(bare, PAGE, "left")
    scale, lines = F.col("per_ft").isNotNull(), F.col("lines").isNotNull()
    found = F.array(
        F.when(~scale, NO_SCALE), F.when(scale & ~lines, NO_LINES), F.when(scale & lines & F.col("vaults").isNull(), NO_VAULTS), F.when(scale & lines & F.col("bare").isNotNull(), F.format_string(NO_SYMBOL, "bare")),
        F.when(scale & F.col("routes").isNotNull() & F.col("said").isNull(), NO_CALLOUTS),
    )
    return all_.select(PAGE, F.posexplode(F.filter(found, lambda p: p.isNotNull())).alias("place", "problem"))
