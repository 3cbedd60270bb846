"""Notes and title blocks: fields of a note, drawing notes, rack elevations, allowances, sheet numbers and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import feet_of, round_up, slug
from .islands import folded, split_notes

#: Title wordings of sheet roles, the first that fits, and roles of the older reading.
SHEET_ROLES = [
    ("osp_overview", r"\bSITE\b.*\b(FIBER|TELECOM|COMMUNICATIONS?)\b.*\bOVERALL\b|\bOVERALL\b.*\bSITE\b"), ("osp_route", r"\bSITE\b.*\b(FIBER|TELECOM|COMMUNICATIONS?)\b.*\b(ROUTING|PLAN|ZONE)\b|\bOUTSIDE PLANT\b|\bOSP\b"),
    ("key_plan", r"\bZONES\b|\bKEY PLAN\b|\bOVERALL\b.*\bFLOOR PLAN\b"), ("legend", r"\bLEGEND\b|\bABBREV"), ("notes", r"\bGENERAL NOTES\b|\bPHASING\b|\bSPECIFICATIONS?\b"), ("schedule", r"\bSCHEDULES?\b"),
    ("tr_room", r"\bENLARGED\b.*\b(DATA ROOMS?|TELECOM|TR)\b|\bTELECOM(MUNICATIONS)? ROOMS?\b"), ("rack", r"\bRACK ELEVATIONS?\b|\bRACK DETAILS?\b"), ("riser", r"\bRISER\b|\bTELECOM DIAGRAMS?\b|\bBACKBONE\b"), ("detail", r"\bDETAILS?\b|\bTYPICAL\b"),
    ("plan", r"\bNEW WORK\b|\bFLOOR PLAN\b|\bZONE\b|\bPLAN\b"),
]
KNOWN_ROLES = ["plan", "schedule", "legend", "detail", "tr_room"]
SHEET_NUMBER = r"(?i)^[A-Z]{1,3}[-.]?\d[\w.\-]*$"
LABELS = {"number": r"(?i)^(drawing|sheet)\s*(number|no\.?|#)$", "title": r"(?i)^(drawing|sheet)\s*title$", "building": r"(?i)^(building|bldg)\s*(number|no\.?|#)?$"}
BUILDING = r"(?i)^(\d{1,3}[A-Z]?|[A-Z]\d{1,3})$"
#: Anchors of a described device: what the description says, its anchors, those that go with it, and what is noted of it.
DESCRIBED = [
    (r"\bWAP\b", ["WAP"], [], "WAP — rectangle with arrowhead, always 2 CAT6A runs"), (r"\b180\b", ["180"], [], "Security camera 180° — degree symbol may be non-ASCII in PDF"), (r"\bPTZ\b", ["PTZ"], [], ""),
    (r"\bDD[1-9]\b", ["DD1", "DD2", "DD3"], ["DV1", "DV2", "N1", "N2", "N3"], "Data/VoIP outlet — DD suffix = port count, DV = voice, N = node"),
    (r"\bN[1-9]\b.*ONLY|ONLY.*\bN[1-9]\b|NURSE|N-LABEL ONLY|SOLE LABEL.*N", ["N1", "N2", "N3", "N4", "N5"], [], "Nurse station — N label only, no DD or DV present"),
    (r"\bDV[1-9]\b.*ONLY|ONLY.*\bDV[1-9]\b|VOICE.ONLY|VOICE ONLY", ["DV1", "DV2"], [], "Voice-only outlet — DV label only, no DD present"),
]
NOT_DESCRIBED = "No standard label pattern detected — verify text_anchors manually"


def described_anchors(description: Column) -> Column:
    """primary, associated, port_count (the suffix counts ports) and notes of a device from what is said of it."""
    d = F.upper(F.coalesce(description, F.lit("")))
    which = None
    for i, (pattern, *_) in enumerate(DESCRIBED):
        which = F.when(d.rlike(pattern), i) if which is None else which.when(d.rlike(pattern), i)
    at = F.coalesce(which, F.lit(len(DESCRIBED)))
    lists = lambda n: F.array(*[F.array(*map(F.lit, x[n])) if x[n] else F.array().cast("array<string>") for x in DESCRIBED], F.array().cast("array<string>"))
    notes = F.array(*[F.lit(x[3]) for x in DESCRIBED], F.lit(NOT_DESCRIBED))
    ports = (at < len(DESCRIBED)) & d.rlike("DD[1-9]") & d.rlike("SUFFIX|PORT COUNT|DIGIT")
    return F.struct(F.get(lists(1), at).alias("primary"), F.get(lists(2), at).alias("associated"), ports.alias("port_count"), F.get(notes, at).alias("notes"))


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def _strands(text: Column) -> Column:
    n = F.regexp_extract_all(text, F.lit(r"(?i)(\d+)[- ]STRANDS?(?: OF)? (OM\d|OS\d)"), 1)
    return F.when(F.size(n) > 0, F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")))


def note_fields(text: Column) -> Column:
    """item, part, ru, ports, slots, strands_isp, strands_osp, cores, owner_furnished and refer_only of a note's wording."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    part = F.regexp_extract(t, r"(?i)BASIS OF DESIGN(?: IS|:)\s+(.+?)(?:,?\s+OR APPROVED EQUAL|\.(?:\s|$)|,\s)", 1)
    part = F.trim(F.regexp_replace(F.regexp_replace(part, r"-\s+", "-"), r"(?i)\s+WITH\s+.*$", ""))
    at = F.regexp_instr(t, F.lit(r"(?i)OUT ?SIDE PLANT|\bOSP\b"))
    inside = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
    outside = F.when(at > 0, F.substring(t, at, F.length(t)))
    cores = F.size(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)CORE-([A-Z])\b"), 1), F.upper)))
    item = F.trim(F.regexp_replace(F.get(F.split(F.regexp_replace(t, r"(?i)^PROVIDE\s+", ""), r"(?i)\.\s|\. ?BASIS OF DESIGN"), F.lit(0)), r"\.$", ""))
    return F.struct(
        item.alias("item"), F.nullif(part, F.lit("")).alias("part"), _number(t, r"(?i)(\d+)\s*RU\b").alias("ru"), _number(t, r"(?i)(\d+)[- ]PORT\b").alias("ports"), _number(t, r"(?i)\((\d+)\)\s*CASSETTES?").alias("slots"),
        _strands(inside).alias("strands_isp"), _strands(outside).alias("strands_osp"), F.nullif(cores, F.lit(0)).alias("cores"), t.rlike(r"(?i)FURNISHED BY (?:THE )?(?:VA|OWNER|GOVERNMENT)").alias("owner_furnished"), t.rlike(r"(?i)^REFER TO\b").alias("refer_only"),
    )


def drawing_notes(runs: DataFrame) -> DataFrame:
    """page_id, ref, note of the numbered notes under a page's DRAWING NOTES title, down to the next title of notes (or 0.3 of the page).

    runs: page_id, seq, str, x, y, left (of the page).
    """
    title = runs.where(F.col("str").rlike(r"(?i)DRAWING\s*NOTES")).groupBy("page_id").agg(F.min(F.struct("seq", "y", "left")).alias("t")).select("page_id", F.col("t.seq").alias("ts"), F.col("t.y").alias("ty"), (F.col("t.left") - 0.01).alias("tl"))
    rows = runs.join(title, "page_id").where(F.col("y") > F.col("ty"))
    ends = rows.where(F.trim("str").rlike(r"(?i)^[A-Z ]*NOTES:?\s*$") & (F.col("seq") != F.col("ts"))).groupBy("page_id").agg(F.min("y").alias("end"))
    body = rows.join(ends, "page_id", "left").where((F.col("y") < F.coalesce("end", F.col("ty") + 0.3)) & (F.col("left") >= F.col("tl")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "seq", "str"))), lambda r: r["str"]), " ")
    return split_notes(body.groupBy("page_id").agg(text.alias("text"))).select("page_id", "ref", "note")


def elevations(titles: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, title, passive, active: capacity labels of rack elevations, which stand in rows with their labels above.

    titles: page_id, title, row (its row from the top), x, left. labels: page_id, kind (passive or active), value, row, x (row: that of the
    elevations below it). As many labels as titles go left to right; else each goes to the nearest title, and the last one counts.
    """
    t = titles.withColumns({"nth": F.row_number().over(Window.partitionBy("page_id", "row").orderBy("x", "title")), "many": F.count("*").over(Window.partitionBy("page_id", "row"))})
    each = Window.partitionBy("page_id", "row", "kind")
    lab = labels.withColumns({"lab": F.row_number().over(each.orderBy("x", "value")), "n": F.count("*").over(each)})
    met = lab.join(t.select("page_id", "row", "title", "nth", "many", "left"), ["page_id", "row"])
    best = met.withColumn("_far", F.when(F.col("n") == F.col("many"), F.abs(F.col("nth") - F.col("lab")).cast("double")).otherwise(F.abs(F.col("left") - F.col("x"))))
    best = best.groupBy("page_id", "row", "kind", "lab").agg(F.min(F.struct("_far", "nth", "title", "value")).alias("m"))
    last = best.groupBy("page_id", F.col("m.title").alias("title"), "kind").agg(F.max_by("m.value", "lab").alias("value"))
    wide = last.groupBy("page_id", "title").agg(F.max(F.when(F.col("kind") == "passive", F.col("value"))).alias("passive"), F.max(F.when(F.col("kind") == "active", F.col("value"))).alias("active"))
    return titles.select("page_id", "title").join(wide, ["page_id", "title"], "left")


def allowances(bullets: DataFrame) -> DataFrame:
    """Lines of allowance notes: key, item, per_unit_qty, unit, unit_count and per_text of every bullet.

    bullets: group, system, seq, y, str, the lines under a note's head in order. A gap over 0.012 ends the note; a line without a bullet sign
    goes on with the one before; the first bullet that provides so many units sets the unit count of all that are per unit.
    """
    w = Window.partitionBy("group").orderBy("y", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = bullets.withColumn("s", F.trim(F.regexp_replace("str", r"\s+", " "))).withColumn("_end", F.sum(F.when(F.col("y") - F.lag("y").over(w) > 0.012, 1).otherwise(0)).over(upto)).where("_end = 0")
    sign = F.col("s").rlike(r"^[•·\-*]\s*")
    rows = rows.withColumn("n", F.sum(sign.cast("int")).over(upto)).where("n > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "seq", F.regexp_replace("s", r"^[•·\-*]\s*", "").alias("s")))), lambda x: x["s"]), " ")
    lines = rows.groupBy("group", "system", "n").agg(text.alias("item"))
    units = F.regexp_extract("item", r"(?i)PROVIDE\s*\((\d+)\)\s*(?:NEW\s+)?(.+?)\.?$", 1).try_cast("int")
    lines = lines.withColumn("_u", units).withColumn("_first", F.min(F.when(F.col("_u").isNotNull(), F.col("n"))).over(Window.partitionBy("group")))
    lines = lines.withColumn("is_unit", F.coalesce(F.col("n") == F.col("_first"), F.lit(False))).withColumn("count", F.max(F.when(F.col("is_unit"), F.col("_u"))).over(Window.partitionBy("group")))
    each = F.regexp_extract("item", r"(?i)\bEACH\s+(?:NEW\s+)?([A-Z]+)", 1)
    per = F.when(each != "", F.concat(F.lit("per "), F.lower(each)))
    feet = F.when(F.col("item").contains("'"), feet_of("item"))
    new = F.col("item").rlike(r"(?i)PROVIDE\s+(?:A\s+|ONE\s+|\(1\)\s+)?NEW\b")
    qty = F.when(F.col("is_unit"), 1.0).when(feet.isNotNull(), round_up(feet, 2)).when(new, 1.0)
    unit = F.when(F.col("is_unit"), "ea").when(feet.isNotNull(), "ft").when(new, "ea")
    per_text = F.when(~F.col("is_unit") & unit.isNotNull(), per)
    return lines.select("group", F.concat(slug("system"), F.lit("-"), F.col("n").cast("string")).alias("key"), "item", qty.alias("per_unit_qty"), unit.alias("unit"), F.when(F.col("is_unit") | per_text.isNotNull(), F.col("count")).alias("unit_count"), per_text.alias("per_text"))


def _labelled(items: DataFrame, label: str, dx: float, dy: float) -> DataFrame:
    """Items under or beside a label of their page, with the label's place (lx, ly, lh, ls)."""
    labels = items.where(F.trim("s").rlike(LABELS[label])).select("page_id", F.col("seq").alias("ls"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("h").alias("lh"))
    other = items.where(~F.exists(F.array(*map(F.lit, LABELS.values())), lambda p: F.rlike(F.trim("s"), p)))
    met = other.join(labels, "page_id")
    return met.where((F.abs(F.col("x") - F.col("lx")) <= dx) & (F.col("y") > F.col("ly") - 0.004) & (F.col("y") - F.col("ly") <= dy))


def title_blocks(items: DataFrame) -> DataFrame:
    """page_id, sheet_number, number_via, title, building_label of each page.

    items: page_id, seq, s, x, y, h (height of the text), places as shares of the page. The sheet number is the highest value under
    its label, else the highest such text in the lower right corner; titles are the lines under theirs, in a larger letter.
    """
    shaped = F.trim("s").rlike(SHEET_NUMBER)
    under = _labelled(items, "number", 0.05, 0.04).where(shaped).groupBy("page_id").agg(F.min(F.struct("ls", -F.col("h"), "y", "x", F.trim("s").alias("s"))).alias("n")).select("page_id", F.col("n.s").alias("under"))
    corner = items.where((F.col("x") > 0.75) & (F.col("y") > 0.8) & shaped & F.col("s").rlike("[A-Za-z]")).groupBy("page_id").agg(F.min(F.struct(-F.col("h"), "seq", F.trim("s").alias("s"))).alias("n")).select("page_id", F.col("n.s").alias("corner"))
    line = _labelled(items, "title", 0.08, 0.04).where((F.col("h") >= F.col("lh") * 1.2) & (F.col("x") >= F.col("lx") - 0.005))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.trim("s").alias("s")))), lambda r: r["s"]), " "), r"\s+", " "))
    title = line.groupBy("page_id", "ls").agg(text.alias("title")).groupBy("page_id").agg(F.min_by("title", "ls").alias("title"))
    building = _labelled(items, "building", 0.04, 0.02).where(F.trim("s").rlike(BUILDING)).groupBy("page_id").agg(F.min(F.struct("ls", "y", "x", F.trim("s").alias("s"))).alias("b")).select("page_id", F.col("b.s").alias("building_label"))
    pages = items.select("page_id").distinct()
    for df in (under, corner, title, building):
        pages = pages.join(df, "page_id", "left")
    via = F.when(F.col("under").isNotNull(), "label").when(F.col("corner").isNotNull(), "position")
    return pages.select("page_id", F.coalesce("under", "corner").alias("sheet_number"), via.alias("number_via"), "title", "building_label")


def sheet_role(title: Column, read_role: Column, read_confidence: Column) -> Column:
    """role, confidence and via: the title's wording is sure; else the reading of the page, one step less so; else none."""
    t = F.upper(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    named = F.coalesce(*[F.when(t.rlike(p), r) for r, p in SHEET_ROLES])
    known = F.when(read_role.isin(KNOWN_ROLES), read_role)
    confidence = F.when(named.isNotNull(), "high").when(known.isNotNull() & (read_confidence == "high"), "medium").otherwise("low")
    return F.struct(F.coalesce(named, known).alias("role"), confidence.alias("confidence"), F.when(named.isNotNull(), "title").when(known.isNotNull(), "classifier").otherwise("none").alias("via"))


def page_lines(runs: DataFrame, tolerance: float = 0.35, merge: float = 1.0, space: float = 0.15) -> DataFrame:
    """page_id, line, str, left, right, y: runs on a line as high as a share of the letter, joined where the gap allows.

    runs: page_id, seq, s, x0, x1, y, size. A run is on the line (by y) if it is at most ``tolerance`` letters, the smaller of both, off the line's
    first run; in a line runs go from the left and are held against the joined run so far. Rows further apart than the tallest
    letter of their page allows never meet: folds go over what lies between.
    """
    runs = runs.where(F.trim("s") != "")
    w = Window.partitionBy("page_id").orderBy("y", "seq")
    off = F.col("y") - F.lag("y").over(w) > F.max("size").over(Window.partitionBy("page_id")) * tolerance
    rows = runs.withColumn("_off", off).withColumn("island", F.sum(F.when(F.col("_off"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the anchor of each run of an island: the first of its line
    held = rows.groupBy("page_id", "island").agg(F.array_sort(F.collect_list(F.struct("y", "seq", "s", "x0", "x1", "size"))).alias("items"))
    one = lambda it, n: F.struct(n.alias("line"), it["y"].alias("ay"), it["size"].alias("asize"), it["x0"].alias("x0"), it["y"].alias("y"), it["seq"].cast("long").alias("seq"), it["s"].alias("s"), it["x1"].alias("x1"), it["size"].alias("size"))
    none = F.array().cast("array<struct<line:int,ay:double,asize:double,x0:double,y:double,seq:bigint,s:string,x1:double,size:double>>")

    def step(acc: Column, it: Column) -> Column:
        last = F.element_at(acc, -1)
        near = F.abs(it["y"] - last["ay"]) <= F.least(it["size"], last["asize"]) * tolerance
        on = F.struct(last["line"].alias("line"), last["ay"].alias("ay"), last["asize"].alias("asize"), *[one(it, F.lit(0))[c].alias(c) for c in ("x0", "y", "seq", "s", "x1", "size")])
        return F.concat(acc, F.array(F.when(near, on).otherwise(one(it, last["line"] + 1))))

    placed = F.aggregate("items", none, lambda acc, it: F.when(F.size(acc) == 0, F.array(one(it, F.lit(0)))).otherwise(step(acc, it)))
    lines = held.select("page_id", "island", F.explode(placed).alias("p")).groupBy("page_id", "island", "p.line").agg(F.array_sort(F.collect_list(F.struct("p.x0", "p.y", "p.seq", "p.s", "p.x1", "p.size"))).alias("items"))
    items = F.transform("items", lambda i: F.struct(i["s"].alias("s"), i["y"].alias("cy"), i["x0"].alias("left"), i["x1"].alias("right"), i["size"].alias("fs"), F.lit(1).alias("n")))
    gap = lambda cur, it: it["left"] - cur["right"]
    done = folded(items, lambda cur, it: (gap(cur, it) < -cur["fs"] * 0.3) | (gap(cur, it) > cur["fs"] * merge), lambda cur, it: gap(cur, it) > cur["fs"] * space)
    order = Window.partitionBy("page_id").orderBy("island", "line")
    numbered = lines.withColumn("line", F.row_number().over(order))
    return numbered.select("page_id", "line", F.explode(done).alias("r")).select("page_id", "line", F.col("r.s").alias("str"), "r.left", "r.right", F.col("r.cy").alias("y"))
