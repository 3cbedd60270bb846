"""Walls, ways, leader fans, routes and schedules on small frames, against plain loops."""

import math
import random

from pyspark.sql import functions as F

from planspark.operators import leaders, plant, tables, walls


def test_ways_go_around_walls_and_through_doors(spark):
    devices = spark.createDataFrame([(1, 10, 1, 20.0, 50.0, 180.0, 50.0), (1, 11, 1, 170.0, 90.0, 180.0, 50.0), (2, 12, 1, 20.0, 50.0, 180.0, 50.0), (3, 13, 1, 20.0, 50.0, 180.0, 50.0)], "page_id long, device long, pin long, x double, y double, px double, py double")
    pages = spark.createDataFrame([(p, 0.0, 0.0, 200.0, 100.0) for p in (1, 2, 3)], "page_id long, x0 double, y0 double, x1 double, y1 double")
    wall = spark.createDataFrame([(1, 100.0, 0.0, 100.0, 80.0), (3, 100.0, -10.0, 100.0, 110.0), (2, 100.0, -10.0, 100.0, 110.0)], "page_id long, ax double, ay double, bx double, by double")
    doors = spark.createDataFrame([(2, 100.0, 20.0)], "page_id long, x double, y double")
    tray = doors.limit(0)
    got = {r.device: r for r in walls.routed(devices, pages, wall, doors, tray).collect()}
    around = math.hypot(80, 40) * 2
    assert around * 0.9 < got[10].length < around * 1.15 and any(c[1] > 80 for c in got[10].corners)
    assert got[11].length < 45 and got[13].length is None and got[13].corners is None
    assert any(abs(c[1] - 20) < 22 for c in got[12].corners[1:-1]) and got[12].corners[0] == [20.0, 50.0] and got[12].corners[-1] == [180.0, 50.0]


def test_field_equals_all_shortest_ways():
    rng = random.Random(1)
    import numpy as np

    grid = walls._Grid((0, 0, 40, 40), np.zeros((0, 4)), np.zeros((0, 2)), np.zeros((0, 2)))
    for _ in range(25):
        grid.closed[rng.randrange(10), rng.randrange(10)] = True
    grid.closed[0, 0] = False
    far, _ = grid.field((0, 0))
    best = {(0, 0): 0.0}
    for _ in range(100):
        for r in range(10):
            for c in range(10):
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        a, b = r + dr, c + dc
                        ok = (r, c) in best and 0 <= a < 10 and 0 <= b < 10 and (dr or dc) and not grid.closed[a, b] and not (dr and dc and (grid.closed[r + dr, c] or grid.closed[r, c + dc]))
                        if ok and best[r, c] + math.hypot(dr, dc) < best.get((a, b), math.inf):
                            best[a, b] = best[r, c] + math.hypot(dr, dc)
    for r in range(10):
        for c in range(10):
            want = best.get((r, c), math.inf)
            assert far[(r + 1) * 12 + c + 1] == want or abs(far[(r + 1) * 12 + c + 1] - want) < 1e-9


def test_signatures_join_the_strongest_near_colour(spark):
    rows = [(1, p, [c, c, c], 0.5, s) for p, c, s in [(1, 100, 9), (1, 180, 5), (2, 150, 8), (2, 240, 7), (3, 100, 1), (3, 240, 4)]] + [(1, 1, [100, 100, 100], 2.0, 3)]
    scores = spark.createDataFrame(rows, "project long, page_id long, colour array<int>, width double, score long")
    got = {(r.colour[0], r.width): (r.score, r.pages_agreeing) for r in walls.project_signatures(scores).collect()}
    # by score: 240 (11), 100 (10), 150 (8), 180 (5): 150 is near 100 only, 180 near 240 first
    assert got == {(240, 0.5): (16, 1), (100, 0.5): (18, 2), (100, 2.0): (3, 0)}


def test_leader_fans(spark):
    strokes = [(1, 1, 10.0, 0.0, 60.0, 40.0), (1, 2, 10.0, 1.0, 60.0, 0.0), (1, 3, 10.0, 0.0, 61.0, 41.0), (1, 4, 300.0, 300.0, 340.0, 300.0), (1, 5, 12.0, 12.0, 14.0, 12.0)]
    segments = spark.createDataFrame(strokes, "page_id long, seg long, ax double, ay double, bx double, by double")
    anchors = spark.createDataFrame([(1, 7, 0.0, 0.0), (1, 8, 310.0, 325.0), (1, 9, 900.0, 900.0)], "page_id long, anchor long, x double, y double")
    got = {r.anchor: (r.ok, r.reason, r.fanout) for r in leaders.fans(segments, anchors).collect()}
    assert got == {7: (True, None, 2), 8: (True, None, 1), 9: (False, "no_leader_segments", None)}
    rooms = spark.createDataFrame([(7, "A"), (8, "B"), (9, "A")], "anchor long, room string")
    counts = {r.room: (r.devices, r.needs_review) for r in leaders.room_counts(leaders.fans(segments, anchors), rooms).collect()}
    assert counts == {"A": (2, True), "B": (0, True)}
    notes = rooms.selectExpr("anchor", "room", "1 as note_number", "'rack_new' as category")
    assert leaders.rack_rows(leaders.fans(segments, anchors), notes).count() == 2


def test_leader_traces_follow_touching_strokes(spark):
    starts = spark.createDataFrame([(1, 5, 1, 0)], "page_id long, callout long, leader long, end int")
    strokes = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 0.0), (1, 2, 40.0, 10.0, 20.2, 0.1), (1, 3, 20.0, 50.0, 20.0, 80.0)], "page_id long, leader long, x0 double, y0 double, x1 double, y1 double")
    pieces = spark.createDataFrame([(1, 9, 38.0, 0.0, 38.0, 40.0), (1, 8, 20.0, 30.0, 30.0, 30.0)], "page_id long, segment long, ax double, ay double, bx double, by double")
    got = [tuple(r) for r in plant.leader_traces(starts, strokes, pieces).collect()]
    assert got == [(1, 5, 9, 2.0, 1)]


def test_spikes_and_thinning(spark):
    path = [(0, 0, 0), (1, 100, 0), (2, 98, 0.5), (3, 200, 0), (4, 200.5, 0), (5, 200, 100)]
    points = spark.createDataFrame([(1, k, float(x), float(y)) for k, x, y in path], "path long, seq int, x double, y double")
    assert sorted(r.seq for r in plant.without_spikes(points, ["path"], 20.0).collect()) in ([0, 1, 3, 4, 5], [0, 2, 3, 4, 5], [0, 3, 4, 5])
    assert sorted(r.seq for r in plant.thinned(points, ["path"], 1.5).collect()) == [0, 1, 2, 3, 5]
    square = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)])], "path long, seq int, x double, y double")
    assert plant.total_turning(square, ["path"]).first().turning == 180.0


def test_text_blocks(spark):
    runs = [(1, 0, "CORE", 0.0, 30.0, 10.0, 8.0), (1, 1, "-A", 31.0, 40.0, 10.5, 8.0), (1, 2, "next", 1.0, 20.0, 20.0, 8.0), (1, 3, "far", 300.0, 320.0, 21.0, 8.0), (1, 4, "", 0.0, 0.0, 0.0, 8.0)]
    got = {r.seq: (r.line, r.block) for r in plant.text_blocks(spark.createDataFrame(runs, "page_id long, seq long, str string, x0 double, x1 double, base double, size double"), ["page_id"]).collect()}
    assert got[0] == got[1] and got[2][0] != got[1][0] and got[2][1] == got[1][1] and got[3][1] != got[2][1] and 4 not in got


def test_a_page_with_two_room_schedules_or_a_missing_column_is_not_read(spark):
    heads = ["TR", "TERMINATIONS", "PATCH PANELS"]

    def table(page, title, y, names, x0=0.1):
        rows = [(page, title, x0 + 0.2, y)] + [(page, h, x0 + 0.2 * k, y + 0.02) for k, h in enumerate(names)]
        return rows + [(page, v, x0 + 0.2 * k, y + 0.06 + 0.02 * n) for n in range(2) for k, v in enumerate([f"R{n}", "48", "1"])]

    items = table(1, "ROOM SCHEDULE", 0.1, heads) + table(2, "ROOM SCHEDULE", 0.1, heads[:2] + ["OTHER"]) + table(3, "A SCHEDULE", 0.1, heads, 0.05) + table(3, "B SCHEDULE", 0.1, heads, 5.0) + table(4, "ROOMS", 0.1, heads)
    frame = spark.createDataFrame([(p, k, s, float(x), float(y)) for k, (p, s, x, y) in enumerate(items)], "page_id long, seq long, str string, x double, y double")
    assert sorted((r.page_id, r.tr_number, r.terminations) for r in tables.schedule_rows(frame).collect()) == [(1, "R0", 48), (1, "R1", 48)]
    why = {r.page_id: r.reason for r in tables.proposals(tables.candidates(frame)).collect()}
    assert why[1] is None and why[2].startswith("tr_summary winner") and why[3].startswith("2 candidate") and 4 not in why


def test_running_mean_columns(spark):
    xs = [0.0, 0.9, 1.9, 2.6, 5.0, 5.5]
    frame = spark.createDataFrame([(1, k, "t", x, 0.0) for k, x in enumerate(xs)], "page long, seq long, str string, x double, y double")
    columns = []
    for x in xs:
        at = next((c for c in columns if abs(x - sum(c) / len(c)) <= 1.5), None)
        columns.append([x]) if at is None else at.append(x)
    got = tables.mean_columns(frame, ["page"], 1.5).groupBy("column").agg(F.array_sort(F.collect_list("x")).alias("xs")).orderBy("column").collect()
    assert [r.xs for r in got] == columns
