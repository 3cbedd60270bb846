"""What only larger tables showed: signs of zeros, joins of spread rows, many points at one place."""

import math

from pyspark.sql import functions as F

from planspark.operators import bom, dashes, detect, glyphs, graph, islands, leaders, merge, plant, review, rings, shapes, spatial, tables


def test_turns_next_to_a_step_of_no_length(spark):
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([(5, 5), (5, 5), (2, 1), (2, 1), (7, 3), (0, 1)])]
    got = [r.turn for r in plant.turns(spark.createDataFrame(rows, "k long, seq long, x double, y double"), ["k"]).orderBy("seq").collect()]
    steps = [(b[2] - a[2], b[3] - a[3]) for a, b in zip(rows, rows[1:], strict=False)]
    want = [math.degrees(math.atan2(u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1])) for u, v in zip(steps, steps[1:], strict=False)]
    assert got[1:-1] == want and 180.0 in map(abs, want)


def spread_and_broadcast(df) -> list[str]:
    """The lines of df's plan where rows that explode() made go to a broadcast without being summed up; Spark takes them for as few as before."""
    found, above = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, kind) for d, kind in above if d < depth]
        above += [(depth, kind) for kind in ("BroadcastExchange", "Aggregate") if kind in line]
        if "Generate" in line and above and above[-1][1] == "BroadcastExchange":
            found.append(line.strip())
    return found


def spots(spark, n="id"):
    return spark.range(50).select((F.col("id") % 3).alias("page_id"), F.col("id").alias(n), (F.col("id") * 7.0).alias("x"), (F.col("id") * 3.0).alias("y"))


def strokes(spark, name):
    p = F.struct("x", "y")
    return spots(spark, name).select("page_id", name, F.array(p, F.struct((F.col("x") + 4).alias("x"), "y")).alias("pts"), F.lit("a").alias("cls"))


def test_ends_of_dashes_are_not_broadcast(spark):
    tips = dashes.ends(strokes(spark, "fragment"))
    assert not spread_and_broadcast(dashes.gap_shares(tips).join(dashes.bridges(tips), "page_id")) and not spread_and_broadcast(dashes.links(tips, dashes.bridges(tips)))


def test_cells_of_points_and_shapes_are_not_broadcast(spark):
    pieces = spots(spark).select("page_id", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 9).alias("bx"), F.col("y").alias("by"), F.col("id").alias("piece"))
    boxes = pieces.select("page_id", F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), (F.col("by") + 5).alias("y1"), "piece")
    others = spots(spark, "to").select("page_id", "to", F.col("x").alias("rx"), F.col("y").alias("ry"))
    for got in (spatial.within(spots(spark), others, 5.0, ["page_id"]), spatial.in_boxes(spots(spark), boxes, 10.0, ["page_id"]), shapes.nearest_piece_within(spots(spark), pieces, 5.0, ["page_id"], ["id"], "piece"), shapes.nearest_box_within(spots(spark), boxes, 5.0, ["page_id"], ["id"], "piece")):
        assert got.count() and not spread_and_broadcast(got)


def test_items_below_titles_are_not_broadcast(spark):
    items = spots(spark, "seq").select("page_id", "seq", F.when(F.col("seq") % 5 == 0, "ROOM SCHEDULE").otherwise("x").alias("str"), "x", "y")
    got = tables.regions(items.select(F.explode(F.array("page_id", F.col("page_id") + 1)).alias("page_id"), "seq", "str", "x", "y"))
    assert got.count() and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_strokes_near_blobs_are_not_broadcast(spark):
    blobs = spots(spark, "blob").withColumn("radius", F.lit(2.0))
    many = strokes(spark, "stroke").select("page_id", F.explode(F.array(F.col("stroke"), F.col("stroke") + 100)).alias("stroke"), "pts")
    got = rings.near_strokes(blobs, many, 5.0)
    assert got.count() and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_labour_are_not_broadcast(spark):
    task = F.struct(F.lit("mount").alias("task_name"), F.lit(1.0).alias("hrs"), F.lit(0.5).alias("setup_hrs"), F.lit(None).cast("double").alias("qty"), F.lit(False).alias("per_run_ft"))
    types = spark.range(5).select(F.col("id").alias("device_type_id"), F.create_map(F.lit("DV"), F.array(task)).alias("labor"))
    instances = spark.range(20).select(F.col("id").alias("instance_id"), (F.col("id") % 5).alias("device_type_id"), F.lit(9.0).alias("total_ft"), F.array(F.lit("DV1")).alias("raw_labels"))
    got = bom.labour(instances, types)
    assert got.count() == 20 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def spied(monkeypatch, module, name):
    """The number of rows of the first table that each call of module.name gets."""
    seen, real = [], getattr(module, name)

    def spy(first, *more, **named):
        seen.append(first.count())
        return real(first, *more, **named)

    monkeypatch.setattr(module, name, spy)
    return seen


def test_points_at_one_place_are_decided_once(spark, monkeypatch):
    rows = [(i, float(i % 4 * 3), 0.0, 1) for i in range(200)] + [(900, None, 0.0, 1), (901, None, 0.0, 1), (902, math.nan, 0.0, 1), (903, math.nan, 0.0, 1)]
    seen = spied(monkeypatch, graph, "within")
    got = graph.greedy_keep(spark.createDataFrame(rows, "id long, x double, y double, page long"), 4.0, ["page"])
    assert sorted(r.id for r in got.collect()) == [0, 2, 900, 901, 902, 903] and seen == [4]


def test_ways_from_one_place_are_looked_for_once(spark, monkeypatch):
    starts = [(1, d, float(d % 2 * 50), 0.0, 9.0, 0.0) for d in range(60)] + [(1, 99, None, 0.0, 9.0, 0.0)]
    waypoints = [(1, w, float(w % 5 * 4), 0.0) for w in range(40)]
    seen = spied(monkeypatch, graph, "checkpointed")
    got = graph.waypoint_paths(spark.createDataFrame(starts, "page_id long, device long, x double, y double, tx double, ty double"), spark.createDataFrame(waypoints, "page_id long, waypoint long, wx double, wy double"))
    ways = {}
    for r in got.orderBy("device", "hop").collect():
        ways.setdefault(r.device, []).append((r.hop, r.waypoint, r.x))
    assert ways == {d: [(1, 4, 16.0), (2, 3, 12.0), (3, 2, 8.0)] if d % 2 else [(1, 1, 4.0), (2, 2, 8.0)] for d in range(60)} and max(seen) <= 5


def test_parts_at_one_place_look_for_their_body_once(spark, monkeypatch):
    seen = spied(monkeypatch, glyphs, "nearest_piece_of_all")
    rows = [(1, i, 0.0, [(float(i % 3), 0.0), (float(i % 3 + 1), 5.0)]) for i in range(90)] + [(1, 100 + i, 1.0, [(10.0 * (i % 2), 0.0)]) for i in range(8)] + [(1, 200, 0.0, []), (1, 201, 0.0, [(math.nan, 0.0)]), (2, 300, 0.0, [(0.0, 0.0)])]
    parts = spark.createDataFrame(rows, "page_id long, part long, area double, points array<struct<x:double,y:double>>")
    got = {r.part: r.body for r in glyphs.grouped_parts(parts, 0.5).collect()}
    assert got == {i: 100 for i in (*range(90), 200, 201)} | {100 + i: 100 + i for i in range(8)} and seen == [9]


def test_equal_strokes_and_anchors_make_one_fan(spark, monkeypatch):
    strokes = [(1, s, 10.0, 10.0, 40.0, 10.0 + s % 2 * 30) for s in range(20)]
    anchors = [(1, a, 11.0, 10.0) for a in range(15)] + [(1, 90, 500.0, 10.0), (1, 91, None, 10.0)]
    seen = spied(monkeypatch, leaders, "within")
    got = leaders.fans(spark.createDataFrame(strokes, "page_id long, seg long, ax double, ay double, bx double, by double"), spark.createDataFrame(anchors, "page_id long, anchor long, x double, y double"))
    found = {r.anchor: (r.ok, r.reason, r.fanout) for r in got.collect()}
    assert found == {a: (True, None, 2) for a in range(15)} | {a: (False, "no_leader_segments", None) for a in (90, 91)} and seen == [3]


def test_pins_of_one_place_are_looked_for_once(spark, monkeypatch):
    seen = spied(monkeypatch, spatial, "in_boxes")
    points = spark.createDataFrame([(1, i, float(i % 2 * 30), 0.0) for i in range(50)] + [(1, 70, None, 0.0)], "page_id long, id long, x double, y double")
    pins = spark.createDataFrame([(1, p, 31.0, 0.0) for p in range(9)], "page_id long, near_pin long, rx double, ry double")
    boxes = spark.createDataFrame([(1, 20 + b, 9 - b, -1.0, -1.0, 1.0, 1.0) for b in range(9)], "page_id long, pin_id long, pin_order int, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: (r.pin, r.scoped) for r in spatial.assign_pins(points, boxes, pins, 10.0, 100.0, ["page_id"], ["id"]).collect()}
    assert got == {i: (0, False) if i % 2 else (28, True) for i in range(50)} | {70: (None, False)} and seen == [3]


def test_codes_and_ends_of_one_place_are_looked_for_once(spark, monkeypatch):
    anchors, codes = [(1, i, "W", 0.0, 0.0) for i in range(20)], [(1, 100 + i, f"DV{i % 3}", 3.0, 0.0) for i in range(30)]
    items = spark.createDataFrame(anchors + codes, "page_id long, seq long, str string, x double, y double")
    types = detect.type_catalog(spark.createDataFrame([(1, "wap", '{"anchor": "W", "families": ["DV"], "fam_radius": 9}')], "type_id long, name string, detection_config string"))
    seen = spied(monkeypatch, spatial, "within")
    got = {r.seq: r.codes for r in detect.detected(items, types, 9.0).collect()}
    assert got == {i: ["DV0", "DV1", "DV2"] if i == 0 else [] for i in range(20)} and seen == [1]
    seen = spied(monkeypatch, plant, "nearest_box_within")
    ends = spark.createDataFrame([(1, i, float(i % 2 * 900), 0.0) for i in range(30)] + [(1, 50, None, 0.0)], "page_id long, end long, x double, y double")
    blocks = spark.createDataFrame([(1, "refer to sheet T1.2.", 5.0, 0.0, 9.0, 9.0)] * 4, "page_id long, text string, x0 double, y0 double, x1 double, y1 double")
    notes = {r.end: r.note for r in plant.end_tags(ends, blocks, 50.0).collect()}
    assert notes == {i: "" if i % 2 else "near 'REFER TO T1.2'" for i in range(30)} | {50: ""} and seen == [3]


def test_types_are_counted_before_they_meet_projects(spark):
    projects = spark.createDataFrame([(p, 1 if p % 2 else None) for p in range(10)], "project long, library long")
    types = spark.createDataFrame([(p, i) for p in (1, 2) for i in range(30 * p)], "project long, type_id long")
    rows = review.types_of_projects(projects, types).groupBy("project").agg(F.count("*").alias("types"))
    assert sorted(map(tuple, review.type_counts(projects, types).collect())) == sorted(map(tuple, rows.collect())) == [(1, 30), (2, 60), (3, 30), (5, 30), (7, 30), (9, 30)]


def test_totals_of_causes_are_those_of_the_lines(spark):
    lines = spark.createDataFrame([(f"WF{i % 3}", "add" if i % 2 else "credit", i / 2) for i in range(12)] + [(None, "add", 1.0)], "step string, line_type string, delta double")
    changes = spark.createDataFrame([("T1", "WF1", None, "B"), ("T2", "WF1", "A", None), ("T3", "WF2", "A", "B")], "sheet string, step string, from_rev string, to_rev string")
    each = merge.causes(lines, changes).groupBy("step", "line_type", "cause_kind").agg(F.count("*").alias("lines"), F.sum("delta").alias("delta"), F.max(F.length("cause_note")).cast("long").alias("note_chars"))
    got = merge.cause_totals(lines, changes)
    assert got.columns == each.columns and sorted(map(str, got.collect())) == sorted(map(str, each.collect())) and got.count() == 7


def test_an_island_of_many_runs_is_one_walk(spark):
    """Drifting lines: every row is in reach of the next, so a page is one island."""
    rows = [(1, f"w{i}", i * 0.25, 0.0, 3.0 + i % 2, 4.0) for i in range(4000)]
    got = islands.anchored_runs(spark.createDataFrame(rows, "page long, s string, cy double, x0 double, x1 double, fs double"), ["page"], 0.5).orderBy("run").collect()
    assert [(r.s, r.n, r.cy) for r in got[:2]] == [("w0w1w2", 3, 0.0), ("w3w4w5", 3, 0.75)] and len(got) == 1334 and sum(r.n for r in got) == 4000
    plan = islands.anchored_runs(spark.createDataFrame(rows[:3], "page long, s string, cy double, x0 double, x1 double, fs double"), ["page"], 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan
