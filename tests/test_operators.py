"""Small frames for the drawing-quantity operators: literals, invariants and order independence."""

import pytest
from pyspark.sql import functions as F

from planspark.functions import scalars as S
from planspark.operators import bom, classify, graph, islands, merge, rollup, spatial
from planspark.sources import imports, sinks
from planspark.streaming import usage_stream


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_rounding(spark):
    r = one(spark, a=S.round_up(F.lit(-2.5)), b=S.round_up(F.lit(2.25), 1), c=S.round_even(F.lit(2.5)), d=S.missing_as(F.lit(0.0), 1.0), e=S.missing_as(F.lit(None).cast("double"), 3.0))
    assert tuple(r) == (-2.0, 2.3, 2.0, 1.0, 3.0)


def test_text_scalars(spark):
    r = one(
        spark, fam=S.label_family(F.lit("DV1")), digits=S.label_family(F.lit(" 180 ")), blank=S.label_family(F.lit(" ")), key=S.tr_key(F.lit("B050 C-1")), inst=S.without_instance(F.lit("EB51A1")), rev=S.revision_of(F.lit("T-101 Rev_b.pdf")),
        none=S.revision_of(F.lit("plan.pdf")), level=S.level_of(F.lit("Second floor plan")), ground=S.level_of(F.lit("GROUND")), room=S.room_reference(F.lit("patch panels in  TR h335-1.")), located=S.room_reference(F.lit("PATCH PANELS IN TR LOCATED IN BUILDING")),
        note=S.note_category(F.lit('PROVIDE 4" SLEEVES, COORDINATE WITH CABLE TRAY')), rack=S.note_category(F.lit("existing rack, provide")), feet=S.feet_of(F.lit("12'-6\"")), scale=S.feet_per_inch(F.lit("1/2\" = 1'-0\"")), wide=S.feet_per_inch(F.lit("1-1/2\" = 1' - 0\"")),
        natural=S.natural_key(F.lit("TR-10a")), sheets=S.phasing_sheets(F.lit("see t-002 general and phasing notes")), strands=S.strands_per_core(F.lit("(2) 12 strand OS2 and 6-strands OM4")), plant=S.plant_of(F.lit("indoor/outdoor loose tube")), number=S.to_int(F.lit("1,234")), bad=S.to_int(F.lit("1.5")),
    )
    assert r.asDict() == {
        "fam": "DV", "digits": "180", "blank": None, "key": "B050C1", "inst": "EB51A", "rev": "Rev.B", "none": None, "level": "2", "ground": "G", "room": "H335-1", "located": None, "note": "sleeves", "rack": "rack_existing", "feet": 12.5, "scale": 2.0,
        "wide": 0.6667, "natural": "tr-000210a", "sheets": ["T-002"], "strands": 18, "plant": "osp", "number": 1234, "bad": None,
    }


def test_lengths(spark):
    r = one(spark, a=S.length_ft(F.lit(100.0), F.lit(9.0), F.lit(1.4), F.lit(None).cast("double")), b=S.length_ft(F.lit(None).cast("double"), F.lit(9.0), F.lit(1.4), F.lit(5.0)), c=S.rescale_ft(F.lit(11.1), F.lit(2.0), F.lit(10.0)), d=S.rescale_ft(F.lit(None).cast("double"), F.lit(2.0), F.lit(10.0)))
    assert tuple(r.a) == (11.1, 15.6, 15.6) and tuple(r.b) == (None, None, None) and r.c == 32.2 and r.d is None


TYPES = "device_type_id long, name string, assembly map<string,array<struct<part_number:string,part_name:string,manufacturer:string,model:string,qty:double,per_run_ft:boolean>>>, labor map<string,array<struct<task_name:string,hrs:double,setup_hrs:double,qty:double,per_run_ft:boolean>>>"
INSTANCES = "instance_id long, device_type_id long, raw_labels array<string>, total_ft double"


def bom_frames(spark):
    types = [(1, "Data", {"DV": [("P1", "jack", "M", "X", 2.0, False), (None, "Cable", " m ", "c", 1.1, True)], "N": [(None, "cable", "M", "C", 1.0, True)]}, {"DV": [(" pull ", 0.01, 0.5, None, True), ("mount", 0.25, None, 2.0, False)], "__default__": [("check", 0.1, 0.0, None, False)]}), (2, "Bare", None, None)]
    rows = [(1, 1, ["DV1", "DV2", "N3"], 100.0), (2, 1, ["DV1"], None), (3, 2, ["180"], 5.0), (4, 9, None, 0.0), (5, 1, [], 0.0)]
    return spark.createDataFrame(rows, INSTANCES), spark.createDataFrame(types, TYPES)


def test_bom_conserves_and_flags(spark):
    inst, types = bom_frames(spark)
    rows = bom.expand(inst, types)
    got = {r.key: r for r in bom.totals(rows).collect()}
    assert got["pn:P1"].qty == 4 and got["m\x01cable\x01c"].qty == pytest.approx(210) and got["m\x01cable\x01c"].part_name == "Cable"
    assert {(r.gap, r.device_type_id, r.family, r.instances) for r in bom.gaps(rows).collect()} == {("missing_distance", 1, "DV", 1), ("unmodeled", 2, "180", 1)}
    assert tuple(bom.coverage(inst, rows).first()) == (5, 2, 2)
    shuffled = bom.totals(bom.expand(inst.orderBy(F.desc("instance_id")).repartition(3), types)).collect()
    assert {r.key: r for r in shuffled} == got


def test_labour(spark):
    inst, types = bom_frames(spark)
    got = {(r.instance_id, r.task): (r.hours, r.missing_distance) for r in bom.labour(inst, types).collect()}
    assert got == {(1, "pull"): (1.5, False), (1, "mount"): (0.5, False), (2, "pull"): (None, True), (2, "mount"): (0.5, False), (5, "check"): (0.1, False)}


def test_unpriced_lines_are_null_with_a_reason(spark):
    lines = spark.createDataFrame([("a", " P1 ", 3.0), ("b", None, 1.0), ("c", "P9", 1.0), ("d", "P2", 1.0)], "key string, part_number string, qty double")
    cat = spark.createDataFrame([("P1", 1.0, 2.0, True, 1), ("P1", 1.25, 2.0, True, 2), ("P2", 1.0, 1.0, False, 1)], "part_number string, cost_unit double, sale_unit double, active boolean, seq int")
    got = {r.key: (r.line_cost, r.reason) for r in bom.price(lines, cat).collect()}
    assert got == {"a": (3.75, None), "b": (None, "no_part_number"), "c": (None, "not_in_catalog"), "d": (None, "inactive")}


def test_provenance_merge_is_idempotent(spark):
    schema = "key string, value string, original_value string, source string, confirmed boolean"
    old = spark.createDataFrame([("same", "1", "1", "extracted", True), ("new", "1", "1", "extracted", True), ("mine", "9", "1", "edited", True), ("clash", "9", "1", "edited", True), ("gone", "1", "1", "extracted", True), ("hand", "1", None, "manual", False)], schema)
    read = spark.createDataFrame([("same", "1"), ("new", "2"), ("mine", "1"), ("clash", "3"), ("add", "5")], "key string, read string")
    got = {r.key: (r.action, r.value, r.confirmed, r.conflict) for r in merge.provenance_merge(old, read).collect()}
    assert got == {"same": ("refresh", "1", True, None), "new": ("update", "2", False, None), "mine": ("keep", "9", True, None), "clash": ("conflict", "9", False, "3"), "gone": ("delete", "1", False, None), "hand": ("keep", "1", False, None), "add": ("insert", "5", False, None)}
    again = spark.createDataFrame([(k, v[1], v[1], "extracted", v[2]) for k, v in got.items() if k in ("same", "new", "add")], schema)
    assert {r.action for r in merge.provenance_merge(again, read.where("key in ('same', 'new', 'add')")).collect()} == {"refresh"}


def test_name_tiers(spark):
    rows = spark.createDataFrame([("EB51A",), ("B050C-1",), ("X 1",), ("X-1",)], "tr_number string")
    names = spark.createDataFrame([("EB51A-1",), ("B050C1",), ("EB51A",), ("X1",), ("Q",)], "name string")
    got = {r.name: (r.match, r.tier, r.candidates) for r in merge.match_names(names, rows).collect()}
    assert got == {"EB51A-1": ("EB51A", "suffix-dropped", 1), "B050C1": ("B050C-1", "stripped", 1), "EB51A": ("EB51A", "exact", 1), "X1": (None, "none", 2), "Q": (None, "none", 0)}


def test_riser_names_with_one_letter_off(spark):
    rows = spark.createDataFrame([("EB51A",), ("B050C1",), ("C2D",), ("C2E",), ("F7",)], "tr_number string")
    names = spark.createDataFrame([("EB51B",), ("B050D1",), ("C2X",), ("EB51A",), ("F7-1",), ("Q",)], "name string")
    got = {r.name: (r.kind, r.tr_name, r.why) for r in merge.match_riser(names, rows).collect()}
    assert got == {
        "EB51B": ("close", "EB51A", "one letter differs"), "B050D1": ("close", "B050C1", "one letter differs"), "C2X": ("none", None, None),
        "EB51A": ("exact", "EB51A", None), "F7-1": ("close", "F7", "instance suffix differs"), "Q": ("none", None, None),
    }


def test_closed_rings_end_and_are_cut_at_their_least_node(spark):
    links = spark.createDataFrame([(5, 7), (7, 3), (3, 9), (9, 5), (20, 21), (21, 22), (40, 40)], "a long, b long")
    got = {r.node: (r.chain, r.position) for r in graph.chains(links).collect()}
    assert got == {3: (3, 0), 9: (3, 1), 5: (3, 2), 7: (3, 3), 20: (20, 0), 21: (20, 1), 22: (20, 2), 40: (40, 0)}


def test_numbers_beyond_two_digits_and_sheet_places(spark):
    rows = spark.range(150).withColumn("k", F.lit(1))
    labels = [r.label for r in islands.numbered(rows, ["k"], "S", "id").orderBy("id").collect()]
    assert labels[0] == "S01" and labels[99] == "S100" and len(set(labels)) == 150
    long = ["n1234567890123456", "n999999999999999", "n7", "n007", "n10"]
    keys = {r.s: r.k for r in spark.createDataFrame([(x,) for x in long], "s string").select("s", S.natural_key("s").alias("k")).collect()}
    assert sorted(long[:3] + long[4:], key=keys.get) == ["n7", "n10", "n999999999999999", "n1234567890123456"] and keys["n7"] == keys["n007"]
    cases = {("BUILDING 7 LEVEL 3 PLAN", None, None): ("BLDG-7", "3", None), ("PLAN - ZONE A, B - NEW WORK", "T1.5.K", "12"): ("BLDG-12", "5", "A,B"), ("PLAN", "T1.B", ""): (None, "B", None), ("KEY PLAN ZONES A", "T2.4K2", None): (None, "4", "K2")}
    frame = spark.createDataFrame(list(cases), "t string, s string, b string")
    assert {(r.t, r.s, r.b): tuple(r.x) for r in frame.withColumn("x", S.location("t", "s", "b")).collect()} == cases
    one = spark.range(1).select(S.slug(F.lit("Site fiber -- riser diagram, north and south wings")).alias("slug"), S.plant_basis(F.lit("loose tube, gel-filled OSP")).alias("p"), S.callout(F.lit('(60) CORE-A (2) 4" CONDUITS (2) CONDUITS WITH CABLES DEMARC')).alias("c")).first()
    assert one.slug == "SITE-FIBER-RISER-DIAGRAM-NORTH" and tuple(one.p) == ("osp", "loose tube · gel-filled · outside plant") and one.c.fill_flag == ">27/conduit exceeds 24-str OS2 fill; +demarc qty not stated"


def test_spatial_joins_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    a = [(1, k, rng.random(), rng.random()) for k in range(80)]
    b = [(1, k, rng.random(), rng.random()) for k in range(80)]
    left, right = spark.createDataFrame(a, "page long, id long, x double, y double"), spark.createDataFrame(b, "page long, rid long, rx double, ry double")
    near = lambda p, q: ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5
    assert {(r.id, r.rid) for r in spatial.within(left, right, 0.1, ["page"]).collect()} == {(p[1], q[1]) for p in a for q in b if near(p, q) <= 0.1}
    got = {r.id: r.rid for r in spatial.nearest(left, right, 0.2, ["page"], ["id"], F.col("rid")).collect()}
    assert got == {p[1]: min(b, key=lambda q: near(p, q))[1] for p in a if min(near(p, q) for q in b) <= 0.2}
    assert {r.id for r in spatial.suppressed(left, right, 0.05, ["page"], ["id"]).collect()} == {p[1] for p in a if all(near(p, q) > 0.05 for q in b)}


def test_greedy_keep_equals_the_one_by_one_pass(spark):
    import random

    rng = random.Random(8)
    pts = [(k, rng.random(), rng.random(), "p") for k in range(150)]
    kept = []
    for p in pts:
        if all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 > 0.15**2 for q in kept):
            kept.append(p)
    got = graph.greedy_keep(spark.createDataFrame(pts, "id long, x double, y double, page string"), 0.15, ["page"])
    assert sorted(r.id for r in got.collect()) == [p[0] for p in kept]


def test_components_and_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert {got[k] for k in range(1, 31)} == {1} and got[101] == 100
    chain = {r.node: (r.chain, r.position) for r in graph.chains(edges.where("a < 50 and a <> b")).collect()}
    assert chain == {k: (1, k - 1) for k in range(1, 31)}


def test_stitch_and_islands(spark):
    runs = [(1, "PAT", 10.0, 0.0, 20.0, 10.0), (1, "CH", 10.4, 20.5, 30.0, 10.0), (1, "PANEL", 10.0, 33.0, 60.0, 10.0), (1, "LEVEL", 10.0, 75.0, 90.0, 10.0), (1, "x", 30.0, 0.0, 5.0, 10.0)]
    got = islands.stitch(spark.createDataFrame(runs, "page long, s string, cy double, x0 double, x1 double, fs double"), ["page"])
    assert sorted((r.s, r.n) for r in got.collect()) == [("LEVEL", 1), ("PATCH PANEL", 3), ("x", 1)]
    notes = islands.split_notes(spark.createDataFrame([("A 1. FIRST note. 2. SECOND PER 569. MAXIMUM 3. THIRD",), (None,), ("none",)], "text string"))
    assert [(r.ref, r.note) for r in notes.collect()] == [(1, "FIRST note."), (2, "SECOND PER 569. MAXIMUM"), (3, "THIRD")]
    spans = islands.span_matches(spark.createDataFrame([(1, k, w, float(k)) for k, w in enumerate("MIN PATCH PANELS PATCH PANELS".split())], "page long, seq long, str string, x double"), ["page"], "PATCH PANELS")
    assert sorted((r.seq, r.x, r.n_tokens) for r in spans.collect()) == [(1, 1.5, 2), (3, 3.5, 2)]


def test_split_even_keeps_the_sum(spark):
    got = rollup.split_even(spark.createDataFrame([("a", 10, 3), ("b", 2, 4), ("c", 5, 0)], "room string, panels int, racks int"), "panels", "racks").collect()
    assert [r.part for r in got if r.room == "a"] == [4, 3, 3] and sum(r.part for r in got if r.room == "b") == 2 and not [r for r in got if r.room == "c"]


def test_page_role_ties_are_flagged(spark):
    pages = spark.createDataFrame([(1, ["FLOOR PLAN", "SYMBOLS"], False, False, 0, 0), (2, ["OUTLET SCHEDULE"], True, False, 0, 0), (3, [], False, False, 0, 0), (4, None, None, None, None, None)], "page_id long, phrases array<string>, has_grand_total boolean, has_scale_bar boolean, room_numbers int, abbreviations int")
    got = {r.page_id: (r.role, r.confidence, r.needs_user) for r in classify.page_role(pages).collect()}
    assert got == {1: ("plan", "low", True), 2: ("schedule", "high", False), 3: ("unknown", "low", True), 4: ("unknown", "low", True)}


def test_racks(spark):
    rooms = spark.createDataFrame([("A", 2, 5, 100, True, "isp"), ("B", None, None, None, None, None)], "tr_name string, racks int, panels int, terminations int, wall_mount boolean, plant string")
    rules = spark.createDataFrame([("r1", "per_rack", 2.0, None, None, None, None, None, 1.0), ("r2", "terminations_div_ports", None, 48.0, None, None, None, None, 2.0), ("r3", "strands_div_cassette", None, None, 12.0, 2.0, 24.0, None, None), ("r4", "layout", None, None, None, None, None, None, None)], "rule_key string, qty_rule string, each double, ports double, fibers double, cores double, strands_isp double, strands_osp double, ru double")
    sized = classify.size_racks(rooms, rules)
    assert {(r.tr_name, r.rule_key): r.qty for r in sized.collect()} == {("A", "r1"): 4, ("A", "r2"): 3, ("A", "r3"): 4, ("B", "r1"): None, ("B", "r2"): None, ("B", "r3"): None}
    assert {r.tr_name: r.free_ru for r in classify.unused_units(sized, rules, rooms, 45.0).collect()} == {"A": 80.0, "B": None}


def test_sources_and_sinks(spark, tmp_path):
    file = tmp_path / "p.csv"
    file.write_text('Part Number,"Unit ""Cost"""\nP1,"a\nb"\n')
    got = imports.header_names(imports.read_csv(spark, str(file)))
    assert got.columns == ["part_number", "unit_cost"] and got.first().unit_cost == "a\nb"
    base = spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, v string")
    sinks.replace_pages(base, str(tmp_path / "t"))
    sinks.replace_pages(spark.createDataFrame([(2, "c")], "page_id long, v string"), str(tmp_path / "t"))
    assert sorted((r.page_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]
    sinks.append_snapshot(base, str(tmp_path / "s"), "one")
    sinks.append_snapshot(base, str(tmp_path / "s"), "two")
    with pytest.raises(ValueError):
        sinks.append_snapshot(base, str(tmp_path / "s"), "one")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "a", 5), ("2024-01-01 11:00:00", "a", 7), ("2024-01-03 00:00:00", "b", 1), ("2024-01-05 00:00:00", "b", 1)]
    calls = spark.createDataFrame(rows, "created_at string, pass string, tokens long").withColumn("created_at", F.to_timestamp("created_at"))
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = usage_stream.daily_usage(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert ("2024-01-01", "a", 2, 12) in {(str(r.day), r["pass"], r.calls, r.tokens) for r in spark.table("days").collect()}


def test_count_devices_drops_nothing(spark):
    from planspark.operators import reconcile

    schedule = spark.createDataFrame([(1, "U1", "A", 0.1, 0.1), (1, "U2", "A", None, None), (1, "U3", "B", None, None)], "page_id long, uin string, type string, sx double, sy double")
    labels = spark.createDataFrame(
        [(1, 1, "U1", "A", 0.101, 0.1, True), (1, 2, "U1", "A", 0.5, 0.5, True), (1, 3, "U1", "B", 0.6, 0.6, False), (1, 4, "U9", "A", 0.7, 0.7, True), (1, 5, None, "A", 0.2, 0.2, True), (1, 6, None, "A", 0.202, 0.2, True), (1, 7, None, "B", 0.2, 0.2, True)],
        "page_id long, seq long, uin string, type string, x double, y double, in_region boolean",
    )
    symbols = spark.createDataFrame([(1, 1, "A", 0.51, 0.5), (1, 2, "A", 0.9, 0.9), (1, 3, "C", 0.9, 0.1)], "page_id long, sym long, type string, x double, y double")
    leaders = spark.createDataFrame([(1, 1, "B", 0.2, 0.2, 3), (1, 2, "Z", 0.0, 0.0, 2)], "page_id long, leader long, type string, x double, y double, quantity int")
    got = reconcile.count_devices(schedule, labels, symbols, leaders).collect()
    by = {r.device: r for r in got}
    assert len(got) == len(by) == 3 + 1 + 2 + 1 + 2 + 2
    assert (by["u:U1"].x, by["u:U1"].xy_source, by["u:U1"].sources) == (0.51, "symbol", ["schedule", "label", "symbol"]) and by["u:U1"].flags == ["type_conflict"] and by["u:U1"].confidence == "low"
    assert by["u:U2"].flags == ["placement_inferred"] and by["u:U2"].x == 0.9 and by["u:U2"].confidence == "medium"
    assert by["u:U3"].flags == ["needs_placement"] and by["u:U9"].flags == ["not_in_schedule"] and by["s:3"].flags == ["no_uin"]
    assert by["l:5"].confidence == "medium" and "l:6" not in by and by["l:7"].flags == ["leader_expanded"]
    assert sum("leader_unmatched" in r.flags for r in got) == 2 and sum(r.type == "B" and "leader_expanded" in r.flags for r in got) == 3


def test_simplify_equals_recursion(spark):
    import math
    import random

    from planspark.operators import geometry

    rng = random.Random(4)
    pts = [(1, k, float(k), rng.random() * 5) for k in range(60)] + [(2, 0, 0.0, 0.0), (2, 1, 1.0, 0.0)]

    def off(p, a, b):
        n = (b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2
        t = max(0, min(1, ((p[2] - a[2]) * (b[2] - a[2]) + (p[3] - a[3]) * (b[3] - a[3])) / n))
        return math.hypot(p[2] - a[2] - t * (b[2] - a[2]), p[3] - a[3] - t * (b[3] - a[3]))

    def keep(part):
        if len(part) < 3:
            return set(part)
        far = max(range(1, len(part) - 1), key=lambda i: off(part[i], part[0], part[-1]))
        return keep(part[: far + 1]) | keep(part[far:]) if off(part[far], part[0], part[-1]) > 2 else {part[0], part[-1]}

    want = keep([p for p in pts if p[0] == 1]) | {p for p in pts if p[0] == 2}
    got = geometry.simplify(spark.createDataFrame(pts, "path long, seq long, x double, y double"), ["path"], 2.0)
    assert {tuple(r) for r in got.select("path", "seq", "x", "y").collect()} == want


def test_circle_and_line_shapes(spark):
    import math

    from planspark.operators import geometry

    ring = [(1, k, 5 + math.cos(k * 0.6), 5 + math.sin(k * 0.6)) for k in range(10)]
    line = [(2, k, float(k), 2.0 * k + 0.01 * (k % 2)) for k in range(9)]
    pts = spark.createDataFrame(ring + line, "path long, seq long, x double, y double")
    assert [r.path for r in geometry.circles(pts, ["path"]).collect()] == [1]
    got = geometry.lines(pts, ["path"]).collect()
    assert [r.path for r in got] == [2] and got[0].length == pytest.approx(8 * math.sqrt(5), abs=0.05)
    blobs = spark.createDataFrame([(1, 7, 5.0, 5.1, 0.5), (1, 8, 50.0, 5.0, 0.5)], "page_id long, blob long, x double, y double, radius double")
    rings = geometry.circles(pts, ["path"]).selectExpr("cast(1 as bigint) page_id", "cx as rx", "cy as ry", "radius as ring_radius")
    assert [r.blob for r in geometry.encircled(blobs, rings, 2.0).collect()] == [7]


def test_read_schedule_and_notes(spark):
    from planspark.operators import readers

    cells = [(1, k, s, x, y) for k, (s, x, y) in enumerate([("UIN", 0.1, 0.10), ("TYPE", 0.3, 0.10), ("CAM-1", 0.1, 0.20), ("EXT", 0.31, 0.201), ("cam", 0.36, 0.2), ("note", 0.1, 0.25), ("CAM-2", 0.11, 0.30), ("INT", 0.29, 0.3)])]
    items = spark.createDataFrame(cells, "page_id long, seq long, str string, x double, y double")
    heads = spark.createDataFrame([(1, "uin", 0.1, 0.1), (1, "type", 0.3, 0.1)], "page_id long, column string, hx double, hy double")
    got = {r.uin: r.cells["type"] for r in readers.read_schedule(items, heads, 0.01, "^CAM-[0-9]+$").collect()}
    assert got == {"CAM-1": "EXT cam", "CAM-2": "INT"}
    legend = [(1, k, s, x, y) for k, (s, x, y) in enumerate([("1", 0.1, 0.1), ("PROVIDE", 0.2, 0.1), ("RACK", 0.3, 0.1), ("here", 0.2, 0.12), ("2", 0.1, 0.2), ("SLEEVES", 0.2, 0.2), ("4", 0.1, 0.3), ("3", 0.1, 0.31), ("TRAY", 0.2, 0.31)])]
    notes = readers.coded_notes(spark.createDataFrame(legend, "page_id long, seq long, str string, x double, y double"), 0.01)
    assert {r.number: r.text for r in notes.collect()}[1] == "PROVIDE RACK here"
    r = one(spark, a=readers.suggested_rule(F.lit("provide 48 port switch")), b=readers.suggested_rule(F.lit("two per rack")), c=readers.suggested_rule(F.lit("see plan")))
    assert tuple(r) == ("terminations_div_ports", "per_rack", "not_stated")
    lines = spark.createDataFrame([(1, "FIRST FLOOR PLAN"), (1, "first floor plan"), (1, "SEE THE PLAN FOR ALL OF THE ROOMS ON THIS FLOOR"), (1, "FIRST  FLOOR PLAN")], "page_id long, line string")
    assert [r.phrase for r in readers.title_phrases(lines).collect()] == ["FIRST FLOOR PLAN"]
    scales = spark.createDataFrame([(1, "1/4\" = 1'-0\" and 1/2\" = 1'-0\" and 1/2\" = 1' - 0\""), (2, "none")], "page_id long, text string")
    assert [tuple(r) for r in readers.sheet_scale(scales).collect()] == [(1, 2.0, 2)]


def test_waypoint_paths_equal_the_loop(spark):
    import random

    rng = random.Random(6)
    ways = [(1, k, rng.random(), rng.random()) for k in range(25)]
    starts = [(1, d, rng.random(), rng.random(), 0.0, 0.0) for d in range(8)]
    want = set()
    for _, d, x, y, tx, ty in starts:
        hop = 0
        while True:
            near = [w for w in ways if (w[2] - tx) ** 2 + (w[3] - ty) ** 2 < (x - tx) ** 2 + (y - ty) ** 2]
            if not near:
                break
            w = min(near, key=lambda w: ((w[2] - x) ** 2 + (w[3] - y) ** 2, w[1]))
            x, y, hop = w[2], w[3], hop + 1
            want.add((d, hop, w[1]))
    got = graph.waypoint_paths(spark.createDataFrame(starts, "page_id long, device long, x double, y double, tx double, ty double"), spark.createDataFrame(ways, "page_id long, waypoint long, wx double, wy double"))
    assert {(r.device, r.hop, r.waypoint) for r in got.collect()} == want


def test_frames_and_guards(spark):
    from planspark.operators import frames

    n = lambda v: F.lit(v).cast("double")
    r = one(
        spark, strip=frames.strip_place(n(0.5), n(0.5), n(0.2), n(0.4), n(None), n(None)), old=frames.legacy_length(n(0.0), n(0.0), n(0.3), n(0.4), n(100), n(100), n(1), n(10)), ports=frames.ports(F.array(F.lit("dd"), F.lit("DD"), F.lit("N"))),
        gap=frames.bridge_tolerance(n(1.0), n(None)), set=frames.bridge_tolerance(n(1.0), n(3)), none=frames.bridge_tolerance(n(None), n(0)), scale=frames.usable_scale(n(None), n(1), n(2)), bare=frames.usable_scale(n(0), n(None), n(2)),
        zero=frames.limit_ft(n(0)), unset=frames.limit_ft(n(None)), raster=frames.sheet_class(F.lit(5), F.lit(None), F.lit(10)), hit=frames.segment_hits(n(0), n(0), n(6), n(6), n(2.9), n(2.9), n(3.1), n(3.1)), miss=frames.segment_hits(n(0), n(0), n(6), n(6), n(3.2), n(3.2), n(3.3), n(3.3)),
    )
    assert tuple(r.strip) == (0.5, 0.3) and tuple(r.old) == (0.495, 5.0) and tuple(r.ports) == (2, 0, 1) and (r.gap, r.set, r.none) == (2.5, 3.0, 6.0)
    assert (r.scale, r.bare, r.zero, r.unset) == (True, False, 0.0, 295.0) and r.raster.raster_only and r.hit and not r.miss
    rows = frames.expand_counts(spark.createDataFrame([(1, "A", 2), (1, "B", 0)], "page_id long, type string, quantity int"), spark.createDataFrame([("A", "Alpha")], "type string, alias string"))
    assert [(x.type, x.matrix_type, x.nth) for x in rows.orderBy("nth").collect()] == [("Alpha", "A", 1), ("Alpha", "A", 2)]


def test_first_ever_pages_by_batch(spark, tmp_path):
    path = str(tmp_path / "seen")
    rows = lambda *x: spark.createDataFrame(list(x), "sheet_number string, content_hash string, page int")
    assert usage_stream.first_ever(rows(("A", "1", 1), ("A", "1", 2), ("B", "1", 3)), 0, path).count() == 2
    for _ in range(2):  # a batch that is run again
        assert {r.sheet_number for r in usage_stream.first_ever(rows(("A", "1", 4), ("C", "1", 5)), 1, path).collect()} == {"C"}
    assert usage_stream.first_ever(rows(("C", "1", 6)), 2, path).count() == 0


def test_names_are_sorted_by_their_numbers(spark):
    from planspark.operators import bom

    df = spark.createDataFrame([("TR 10",), ("TR 9",), ("TR 2A",), ("TR 100",), ("AP 3",)], "name string")
    assert [r.name for r in bom.in_order(df, "name").collect()] == ["AP 3", "TR 2A", "TR 9", "TR 10", "TR 100"]


def test_a_matrix_finds_its_columns_in_stacked_headers(spark):
    from planspark.operators import discover

    def page(p, dx):
        head = [("OUTLET", 0.10, 0.100), ("QUANTITY", 0.30, 0.100), ("QUANTITY", 0.50, 0.100), ("TYPE", 0.10, 0.112), ("POTS", 0.50, 0.118), ("QUANTITY", 0.05, 0.900)]
        body = [("A1", 0.10, 0.150, 1), ("12", 0.31, 0.150, 1), ("99", 0.50, 0.150, 1), ("B", 0.11, 0.170, 2), ("3", 0.29, 0.170, 2), ("7", 0.02, 0.190, 3), ("GRAND TOTAL: 15", 0.2, 0.210, 4), ("C", 0.10, 0.230, 5), ("8", 0.30, 0.230, 5)]
        return [(p, 0, s, x + dx, y) for s, x, y in head] + [(p, r, s, x + dx, y) for s, x, y, r in body]

    rows = page(1, 0.0) + page(2, 0.2) + [(3, 1, "TYPE", 0.1, 0.1), (3, 2, "A1", 0.1, 0.2), (4, 1, "QTY", 0.1, 0.1)]
    cells = spark.createDataFrame(rows, "page_id long, row int, str string, x double, y double")
    columns = {r.page_id: (round(r.type_x, 2), round(r.quantity_x, 2), r.bottom) for r in discover.matrix_columns(cells).collect()}
    assert columns == {1: (0.1, 0.3, 0.118), 2: (0.3, 0.5, 0.118)}
    got = {(r.page_id, r.type): r.quantity for r in discover.matrix_located(cells, 0.04).collect()}
    assert got == {(p, k): n for p in (1, 2) for k, n in (("A1", 12), ("B", 3))}
    assert all(r.ties and r.total == 15 for r in discover.matrix_ties(discover.matrix_located(cells, 0.04)).collect())
