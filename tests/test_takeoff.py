"""The take-off of a drawn sheet in one call: ids, lengths, callouts, findings and quantities of our own fixture."""

import pytest

from planspark.operators import dashes, takeoff


def drawn(x0, y0, x1, y1, cls, n=8, gap=2.0):
    length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    ux, uy = (x1 - x0) / length, (y1 - y0) / length
    dash = (length - gap * (n - 1)) / n
    return [([(x0 + ux * k * (dash + gap), y0 + uy * k * (dash + gap)), (x0 + ux * (k * (dash + gap) + dash), y0 + uy * (k * (dash + gap) + dash))], cls) for k in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    # MH-1 at 100,100; MH-2 at 500,100; HH-1 at 300,300 on a branch that tees into the run between the manholes
    pieces = drawn(108, 100, 492, 100, "new", 20) + drawn(300, 104, 300, 292, "old", 10) + drawn(508, 100, 700, 100, "new", 10)
    pieces = [(p[::-1] if k % 3 == 0 else p, c) for k, (p, c) in enumerate(pieces)]
    fragments = spark.createDataFrame([(1, k, [(float(x), float(y)) for x, y in p], c) for k, (p, c) in enumerate(pieces)], dashes_schema)
    tips = dashes.ends(fragments)
    points = dashes.dashed_lines(fragments)
    zones = spark.createDataFrame([(1, 1, "MH", "symbol", 92.0, 92.0, 108.0, 108.0), (1, 2, "MH", "symbol", 492.0, 92.0, 508.0, 108.0), (1, 3, "HH", "label-only", 292.0, 292.0, 308.0, 308.0)], "page_id long, zone long, kind string, source string, x0 double, y0 double, x1 double, y1 double")
    said = [
        (1, 1, 1, '(12) CORE-A CABLES IN (2) 4" CONDUITS', 150.0, 40.0, 250.0, 48.0), (1, 1, 2, "(1) CONDUIT WITH CABLES (1) SPARE", 150.0, 50.0, 250.0, 58.0),  # its leader leads to the first run
        (1, 2, 1, '(8) CORE-A (1) 4" CONDUIT', 560.0, 60.0, 640.0, 68.0),  # no leader: nearest
        (1, 3, 1, "BLDG 7", 120.0, 200.0, 140.0, 210.0), (1, 4, 1, "REFER TO SHEET T1.B", 700.0, 120.0, 760.0, 130.0),
    ]
    lines = spark.createDataFrame(said, "page_id long, block long, seq long, text string, x0 double, y0 double, x1 double, y1 double")
    strokes = spark.createDataFrame([(1, 1, 0.5, True, [(252.0, 54.0), (260.0, 70.0)]), (1, 2, 0.5, True, [(260.3, 70.2), (260.0, 98.0)]), (1, 3, 3.0, True, [(600.0, 70.0), (600.0, 99.0)])], "page_id long, leader long, width double, black boolean, pts array<struct<x double, y double>>")
    sheets = spark.createDataFrame([(1, "T-1", 3.6), (2, "T-2", None), (3, "T-3", 3.6)], "page_id long, sheet string, per_ft double").join(dashes.bridges(tips), "page_id", "left").fillna(6.0, ["bridge"])
    words = spark.createDataFrame([(1, "3", 100.0, 5.0, 800.0, 600.0), (1, "4", 400.0, 5.0, 800.0, 600.0), (1, "B", 5.0, 100.0, 800.0, 600.0), (1, "C", 5.0, 300.0, 800.0, 600.0)], "page_id long, str string, x double, y double, width double, height double")
    return takeoff.take_off(points, zones, lines, takeoff.leader_strokes(strokes), sheets, words, 60.0, 40.0, 180.0)


dashes_schema = "page_id long, fragment long, pts array<struct<x double, y double>>, cls string"


def test_segments_keep_their_lineage(made):
    got = {r.segment: r for r in made.segments.collect()}
    assert len(got) == 4
    ends = {(r.from_node, r.to_node) for r in got.values()}
    assert {tuple(sorted(e)) for e in ends} == {("toJ-1", "toMH-1"), ("toJ-1", "toMH-2"), ("toHH-1", "toJ-1"), ("toEND-1", "toMH-2")}
    by = {tuple(sorted((r.from_node, r.to_node))): r for r in got.values()}
    # to the middle of the tags: 100 to the tee at 300, on to 500, down to 300, and on to the open end at 700
    assert [round(by[k].total_ft, 1) for k in (("toJ-1", "toMH-1"), ("toJ-1", "toMH-2"), ("toHH-1", "toJ-1"), ("toEND-1", "toMH-2"))] == pytest.approx([55.6, 55.6, 54.4, 55.6], abs=0.11)
    branch = by["toHH-1", "toJ-1"]
    assert branch.new_ft == 0 and branch.route == "existing" and branch.x == pytest.approx(300, abs=1) and branch.y == pytest.approx(202, abs=2)
    assert all(r.bends_deg == 0 and r.bend_detail == "straight" for r in got.values())
    assert {r.segment for r in got.values()} == {"toS01", "toS02", "toS03", "toS04"}


def test_callouts_follow_their_leader_or_come_to_the_nearest(made):
    rows = {r.segment: r for r in made.segments.collect()}
    got = {r.callout: r for r in made.callouts.collect()}
    assert set(got) == {"toC01", "toC02"} and got["toC01"].cables == 12 and got["toC01"].with_cables == 1 and got["toC01"].spare == 1
    assert got["toC01"].method == "leader" and {rows[got["toC01"].segment].from_node, rows[got["toC01"].segment].to_node} == {"toMH-1", "toJ-1"}
    assert got["toC02"].method == "NEAREST ONLY (10 ft) - verify" and "toEND-1" in (rows[got["toC02"].segment].from_node, rows[got["toC02"].segment].to_node)
    assert rows[got["toC02"].segment].flags == "callout placed by proximity" and rows[got["toC01"].segment].config == "2x4in (1 cabled/1 spare) | 12 Core-A"


def test_findings_say_what_was_expected_and_found(made):
    rows = {tuple(sorted((r.from_node, r.to_node))): r.segment for r in made.segments.collect()}
    found = made.discrepancies.orderBy("item").collect()
    assert [r.item for r in found] == [f"toD{k:02d}" for k in range(1, len(found) + 1)]
    assert [(r.category, r.at) for r in found] == [("MISSING CALLOUT", s) for s in sorted((rows["toHH-1", "toJ-1"], rows["toJ-1", "toMH-2"]))] or {r.category for r in found} == {"MISSING CALLOUT", "NO CONTINUATION"}
    missing = next(r for r in found if r.at == rows["toHH-1", "toJ-1"])
    assert missing.status == "verify on overlay" and missing.expected == "a cable/conduit callout on the run" and missing.location.startswith("grid ") and "BLDG 7" in missing.location
    assert f"{missing.at} has no callout" in missing.verify_first and "toHH-1 tag outline not found" in missing.verify_first and missing.verify_first.endswith("leader may have been missed by the script")
    alone = next(r for r in found if r.category == "NO CONTINUATION")
    assert alone.at == "toMH-1" and alone.whats_off == "12 Core-A end at toMH-1 with no outgoing leg" and alone.rfi.startswith("On sheet T-1 (grid B-3")
    nodes = {r.label: r for r in made.nodes.collect()}
    assert nodes["toMH-1"].balance.startswith("CHECK Core-A only on") and nodes["toEND-1"].note == "near 'REFER TO T1.B'" and nodes["toJ-1"].type == "JUNCTION" and nodes["toJ-1"].note == "tee"
    assert "no callout on" in nodes["toMH-2"].balance and nodes["toEND-1"].balance == ""


def test_quantities_and_problems(made):
    got = {r.item: r for r in made.quantities.collect()}
    assert len(got) == 24 and all(r.page_id == 1 for r in got.values())
    assert got["Manholes (MH)"].quantity == 2 and got["Handholes (HH)"].quantity == 1 and got["Junctions with no vault shown"].quantity == 1 and got["Building entries / continuation ends"].quantity == 1
    assert got["Demarc cables"].quantity is None and got["Demarc cables"].quantity_text == "not stated"
    assert got["Segments"].quantity == 4 and got["Segments with no callout (not in conduit/cable totals)"].quantity == 2 and got["Segments with no callout (not in conduit/cable totals)"].note == "110 ft of route"
    assert got['4" conduit (total)'].quantity == pytest.approx(round(2 * 55.6 + 55.6), abs=1) and got["Core-A cable"].quantity == pytest.approx(20 * 55.6, abs=2)
    both = takeoff.combined(made.quantities.unionByName(made.quantities.withColumn("page_id", made.quantities.page_id + 1))).collect()
    assert len(both) == 24 and {r.item: r.quantity for r in both}["Segments"] == 8 and {r.item: r.note for r in both}["Segments with no callout (not in conduit/cable totals)"] == ""
    problems = sorted((r.page_id, r.problem) for r in made.problems.collect())
    assert problems == sorted([(1, "No symbol outline found around toHH-1 — position taken from the label."), (2, takeoff.NO_SCALE), (3, takeoff.NO_LINES)])
