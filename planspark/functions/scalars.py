"""Scalar functions over columns: rounding, names, labels, lengths and text extractors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# rounding ------------------------------------------------------------------------------------------


def round_up(x: Column | str, digits: int = 0) -> Column:
    """Half goes toward plus infinity: -2.5 gives -2."""
    p = 10.0**digits
    return F.floor(_c(x) * p + 0.5) / p


def round_even(x: Column | str, digits: int = 0) -> Column:
    """Half goes to the even neighbour."""
    return F.bround(_c(x), digits)


def missing_as(x: Column | str, default: float) -> Column:
    """Null and zero count as not given."""
    return F.when(_c(x).isNull() | (_c(x) == 0), F.lit(default)).otherwise(_c(x))


# names and labels ----------------------------------------------------------------------------------


def norm(s: Column | str) -> Column:
    """Trimmed, upper case, runs of white space as one space."""
    return F.upper(F.trim(F.regexp_replace(_c(s), r"\s+", " ")))


def ascii_core(s: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(s), r"[^\x20-\x7E]", ""))


def label_family(token: Column | str) -> Column:
    """Leading letters of a label, or the whole label if it has none; null if blank."""
    t = F.trim(_c(token))
    return F.when(t == "", F.lit(None)).when(t.rlike("^[A-Za-z]"), F.regexp_extract(t, "^[A-Za-z]+", 0)).otherwise(t)


def families(labels: Column | str) -> Column:
    """Distinct families of an array of labels, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(_c(labels), F.array().cast("array<string>")), label_family), lambda x: x.isNotNull()))


def lead_capitals(s: Column | str) -> Column:
    return F.regexp_extract(_c(s), "^[A-Z]+", 0)


def natural_key(s: Column | str) -> Column:
    """Sort key in which numbers inside names count by value."""
    parts = F.regexp_extract_all(F.lower(_c(s)), F.lit(r"(\d+|\D+)"), 1)
    # a number of any length: how many digits it has, then the digits
    number = lambda p: F.concat(F.lpad(F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")).cast("string"), 4, "0"), F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "")


def to_int(s: Column | str) -> Column:
    """Whole number with thousands commas, else null."""
    t = F.regexp_replace(F.trim(_c(s)), ",", "")
    return F.when(t.rlike("^-?[0-9]{1,18}$"), t.try_cast("bigint"))


def tr_key(name: Column | str) -> Column:
    """Telecom-room name without case, blanks and punctuation."""
    return F.regexp_replace(F.upper(_c(name)), "[^A-Z0-9]", "")


def without_instance(key: Column | str) -> Column:
    """Name key without the instance number 1 that plan titles append."""
    return F.regexp_replace(_c(key), "-?1$", "")


def without_letter(name: Column | str) -> Column:
    """Name key without its last letter, be it before an instance number 1 or between a digit and that 1."""
    return F.regexp_replace(F.regexp_replace(tr_key(name), "[A-Z](1?)$", "$1"), "([0-9])[A-Z](?=1$)", "$1")


def slug(s: Column | str) -> Column:
    """Key of an allowance's system: capitals and digits, at most 30 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.upper(_c(s)), "[^A-Z0-9]+", "-"), "^-|-$", ""), 1, 30)


# title blocks and notes ----------------------------------------------------------------------------


def revision_of(filename: Column | str) -> Column:
    found = F.regexp_extract(F.coalesce(_c(filename), F.lit("")), r"(?i)\bREV\.?\s*[-_]?\s*([0-9]+|[A-Z])\b", 1)
    return F.when(found != "", F.concat(F.lit("Rev."), F.upper(found)))


#: Names of levels.
LEVEL_WORDS = {"FIRST": "1", "SECOND": "2", "THIRD": "3", "FOURTH": "4", "FIFTH": "5", "SIXTH": "6", "BASEMENT": "B", "GROUND": "G"}


def level_of(title: Column | str) -> Column:
    t = F.upper(F.coalesce(_c(title), F.lit("")))
    numbered = F.regexp_extract(t, r"\b(?:LV|LEVEL)\s*([\w,]+)", 1)
    floor = F.regexp_extract(t, r"\b(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH)\s+FLOOR\b", 1)
    other = F.regexp_extract(t, r"\b(BASEMENT|GROUND)\b", 1)
    found = F.when(numbered != "", numbered).when(floor != "", floor).when(other != "", other)
    words = F.create_map(*[F.lit(x) for kv in LEVEL_WORDS.items() for x in kv])
    return F.coalesce(words[found], found)


def building_of(title: Column | str) -> Column:
    t = F.upper(F.coalesce(_c(title), F.lit("")))
    short, long = F.regexp_extract(t, r"\bBLDG\.?\s*([\w-]+)", 1), F.regexp_extract(t, r"\bBUILDING\s+([\w-]+)", 1)
    found = F.when(short != "", short).when(long != "", long)
    return F.when(found.isNotNull(), F.concat(F.lit("BLDG-"), found))


#: A sheet number that names level and zone, and a zone in a title.
SHEET_LEVEL_ZONE = r"^[A-Z]+\d\.([0-9B])(?:\.?([A-Z][A-Z0-9]*))?$"
TITLE_ZONE = r"\bZONES?\s+([A-Z0-9][A-Z0-9,& ]*?)(?=\s+-|\s*$)"


def location(title: Column | str, sheet_number: Column | str, building_label: Column | str) -> Column:
    """building, level and zone of a sheet: its title's, then its building label's, then its sheet number's."""
    t, sheet = F.upper(F.coalesce(_c(title), F.lit(""))), F.upper(F.coalesce(_c(sheet_number), F.lit("")))
    label = F.when(F.coalesce(_c(building_label), F.lit("")) != "", F.concat(F.lit("BLDG-"), _c(building_label)))
    level, zone = (F.nullif(F.regexp_extract(sheet, SHEET_LEVEL_ZONE, i), F.lit("")) for i in (1, 2))
    named = F.regexp_extract(t, TITLE_ZONE, 0)
    said = F.when((named != "") & ~named.rlike(r"^ZONES\b"), F.regexp_replace(F.regexp_extract(t, TITLE_ZONE, 1), r"\s+", ""))
    return F.struct(F.coalesce(building_of(t), label).alias("building"), F.coalesce(level_of(t), level).alias("level"), F.coalesce(said, zone).alias("zone"))


def room_reference(text: Column | str) -> Column:
    """Telecom room that a page's patch-panel note names; phrases that only look like a name are none."""
    found = F.upper(F.regexp_extract(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "), r"(?i)PATCH PANELS IN TR\s+([A-Z0-9][A-Z0-9\-]*)", 1))
    return F.when((found != "") & ~found.isin("LOCATED", "REFER", "THE", "ALL"), found)


def phasing_sheets(text: Column | str) -> Column:
    flat = F.upper(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))
    return F.array_distinct(F.regexp_extract_all(flat, F.lit(r"\b([A-Z]{1,2}-?\d{3}[A-Z]?)\s+[A-Z ,&]*PHASING\b"), 1))


#: What a coded note is about, by the keyword that comes first in it.
NOTE_KEYWORDS = [
    ("backboard", r"BACKBOARD"), ("ground_busbar", r"GROUND\s*BUS\s*BAR"), ("cable_tray", r"CABLE\s*TRAY"), ("wire_manager", r"WIRE\s*MANAGER"),
    ("camera_connection", r"\bSSTV\b|CAMERA"), ("access_control", r"ACCESS\s*CONTROL"), ("motion_sensor", r"MOTION\s*SENSOR|INTRUSION\s*DETECTION"), ("sleeves", r"\bSLEEVES?\b"),
]


def note_category(text: Column | str) -> Column:
    """Racks first, existing before new; then the earliest keyword; null if none."""
    t = F.upper(F.coalesce(_c(text), F.lit("")))
    found = F.array(*[F.struct(F.regexp_instr(t, F.lit(p)).alias("at"), F.lit(i).alias("n"), F.lit(k).alias("category")) for i, (k, p) in enumerate(NOTE_KEYWORDS)])
    first = F.array_min(F.filter(found, lambda x: x["at"] > 0))["category"]
    rack = t.rlike(r"\bRACK\b")
    return F.when(rack & t.contains("EXISTING"), F.lit("rack_existing")).when(rack & t.contains("PROVIDE"), F.lit("rack_new")).otherwise(first)


def note_limit(text: Column | str, kind: str) -> Column:
    """Feet (kind 'ft') or degrees (kind 'deg') that a conduit note allows; null if it sets no limit."""
    t = F.upper(F.coalesce(_c(text), F.lit("")))
    limits = t.rlike(r"\b(PULL ?BOX|PULL ?POINT|MANHOLE|HANDHOLE|CONDUIT)\b") & t.rlike(r"\b(MAXIMUM|NOT TO EXCEED|SHALL NOT EXCEED)\b")
    pattern = r"(\d{2,4})\s*(?:'|FT\b|FEET\b)" if kind == "ft" else r"(\d{2,3})\s*DEGREES?"
    return F.when(limits, F.regexp_extract(t, pattern, 1).try_cast("int"))


#: Most cables a 4-inch conduit takes, and what is said beyond.
FILL = [(27, ">27/conduit exceeds 24-str OS2 fill"), (24, ">24/conduit exceeds 12-str OS2 fill")]
DEMARC_FLAG = "+demarc qty not stated"


def callout(text: Column | str) -> Column:
    """Conduit callout as a struct: cables, core, conduit counts, pathway, cables per conduit and fill flag."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.upper(_c(text)), "[”″]|''", '"'), r"\s+", " "))

    def grab(pattern: str, default: Column | int = 0) -> Column:
        return F.coalesce(F.regexp_extract(t, pattern, 1).try_cast("int"), default if isinstance(default, Column) else F.lit(default))

    cables, core = F.regexp_extract(t, r"^\(\s*(\d+)\s*\)\s*CORE-([AB])", 1).try_cast("int"), F.regexp_extract(t, r"^\(\s*(\d+)\s*\)\s*CORE-([AB])", 2)
    n4 = grab(r'\((\d+)\)\s*4\s*"\s*CONDUITS?')
    filled = grab(r"\((\d+)\)\s*CONDUITS?\s*WITH\s*CABLES", F.when(n4 == 1, 1).otherwise(0))
    path = F.when(t.contains("PIPE BASEMENT"), "pipe basement").when(t.contains("EXISTING TUNNEL"), "existing tunnel").when(t.contains("EXISTING UNDERGROUND CONDUIT"), "existing UG conduit").otherwise("duct bank")
    per = F.when(filled > 0, round_even(cables / filled, 1))
    over = F.when((filled > 0) & (cables / filled > FILL[0][0]), FILL[0][1]).when((filled > 0) & (cables / filled > FILL[1][0]), FILL[1][1])
    flag = F.concat_ws("; ", over, F.when(t.contains("DEMARC"), DEMARC_FLAG))
    return F.struct(
        cables.alias("cables"), core.alias("core"), t.contains("DEMARC").alias("demarc"), n4.alias("n4"), grab(r'\((\d+)\)\s*1\s*"\s*CONDUITS?\s*FOR\s*FIRE').alias("n1_fa"),
        filled.alias("with_cables"), grab(r"\((\d+)\)\s*SPARE").alias("spare"), grab(r"\((\d+)\)\s*CONDUITS?\s*WITH\s*ELECTRICAL").alias("elec"), path.alias("pathway"), per.alias("cables_per_conduit"), flag.alias("fill_flag"),
    )


def strands_per_core(text: Column | str) -> Column:
    """Sum of the strand counts that a cable note names; null if none."""
    hits = F.regexp_extract_all(F.upper(_c(text)), F.lit(r"(\d+)[- ]STRANDS? (OS\d|OM\d)"), 1)
    return F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")))


#: Wordings of outside and inside plant and what they are called.
OUTSIDE = [(r"INDOOR\s*/\s*OUTDOOR", "indoor/outdoor"), (r"LOOSE[- ]TUBE", "loose tube"), (r"GEL[- ]FILLED", "gel-filled"), (r"OUTSIDE PLANT|\bOSP\b", "outside plant")]
INSIDE = [(r"\bINDOOR\b", "indoor"), (r"TIGHT[- ]BUFFER", "tight buffered"), (r"INSIDE PLANT|\bISP\b", "inside plant")]


def plant_basis(text: Column | str) -> Column:
    """isp_osp (osp, isp or null) and basis (the wordings that say so) of a cable note; words of outside plant win."""
    t = F.upper(_c(text))
    out, inside = (F.concat_ws(" · ", *[F.when(t.rlike(p), name) for p, name in words]) for words in (OUTSIDE, INSIDE))
    return F.struct(F.when(out != "", "osp").when(inside != "", "isp").alias("isp_osp"), F.when(out != "", out).when(inside != "", inside).alias("basis"))


def plant_of(text: Column | str) -> Column:
    """osp, isp or null by the wording of a cable note."""
    return plant_basis(text)["isp_osp"]


# lengths -------------------------------------------------------------------------------------------


def feet_of(s: Column | str) -> Column:
    """Feet and inches as feet."""
    feet, inches = (F.regexp_extract(_c(s), r"(\d+)'\s*-?\s*(\d+)?\"?", i) for i in (1, 2))
    return F.when(feet != "", feet.try_cast("double") + F.coalesce(F.when(inches != "", inches.try_cast("double")) / 12, F.lit(0.0)))


_SCALE = r"(\d+(?:-\d+/\d+)?|\d+/\d+)\s*[\"”″]\s*=\s*1\s*['’′]\s*-?\s*0\s*[\"”″]"


def inches_of(size: Column) -> Column:
    """``2``, ``1/2`` or ``1-1/2`` as a number."""
    whole = F.when(size.contains("-"), F.substring_index(size, "-", 1).try_cast("double")).otherwise(F.lit(0.0))
    part = F.substring_index(size, "-", -1)
    return F.when(size.contains("/"), whole + F.substring_index(part, "/", 1).try_cast("double") / F.substring_index(part, "/", -1).try_cast("double")).otherwise(size.try_cast("double"))


def feet_per_inch(label: Column | str) -> Column:
    """Feet to a paper inch of an architectural scale label, to 4 digits; null if it is none."""
    inches = inches_of(F.regexp_extract(_c(label), _SCALE, 1))
    return F.when(inches > 0, round_up(1 / inches, 4))


def scales(text: Column | str) -> Column:
    """Sizes of all scale labels of a text."""
    return F.regexp_extract_all(_c(text), F.lit(_SCALE), 1)


def length_ft(points: Column | str, points_per_ft: Column | str, multiplier: Column | str, stub: Column | str) -> Column:
    """raw, run and total feet of a measured length; null if it or the scale is unknown."""
    ok = _c(points).isNotNull() & (_c(points_per_ft) > 0)
    run = round_up(_c(points) * _c(multiplier) / _c(points_per_ft), 1)
    total = round_up(run + F.coalesce(_c(stub), F.lit(0.0)), 1)
    return F.struct(F.when(ok, round_up(_c(points) / _c(points_per_ft), 1)).alias("raw_ft"), F.when(ok, run).alias("run_ft"), F.when(ok, total).alias("total_ft"))


def rescale_ft(raw: Column | str, multiplier: Column | str, stub: Column | str) -> Column:
    """Stored raw length under another multiplier, without measuring anew."""
    return F.when(_c(raw).isNotNull() & (_c(multiplier) > 0), round_up(round_up(_c(raw) * _c(multiplier), 1) + F.coalesce(_c(stub), F.lit(0.0)), 1))


def token_cost(inputs: Column, outputs: Column, read: Column, write: Column, in_price: Column, out_price: Column) -> Column:
    """US dollars of a call: cache reads cost a tenth of the input price, cache writes five quarters."""
    z = [F.coalesce(x, F.lit(0)) for x in (inputs, outputs, read, write)]
    return round_up((z[0] * in_price + z[1] * out_price + z[2] * in_price * 0.1 + z[3] * in_price * 1.25) / 1e6, 6)
