"""Glyph measures against plain loops; elevations, lens kinds and gates on small frames."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from planspark.operators import detect, glyphs, notes, review

SCHEMA = "glyph long, part long, closed boolean, filled boolean, seq long, x double, y double"


def star(n: int, hub: float, tip: float, cx: float, cy: float, glyph: int) -> list[tuple]:
    """A hub with n triangles around it, each a part of its own."""
    rows = [(glyph, 0, True, True, k, cx + hub * math.cos(k * math.pi / 8), cy + hub * math.sin(k * math.pi / 8)) for k in range(16)]
    for a in range(n):
        turn = 2 * math.pi * a / n + 0.3
        for k, (r, off) in enumerate(((hub, -0.2), (tip, 0.0), (hub, 0.2))):
            rows.append((glyph, a + 1, True, False, k, cx + r * math.cos(turn + off), cy + r * math.sin(turn + off)))
    return rows


def plain_outline(paths: list[list[tuple[float, float]]], bins: int = 72) -> list[float]:
    pts = [p for path in paths for p in path]
    cx, cy = (sum(p[k] for p in pts) / len(pts) for k in (0, 1))
    diag = math.hypot(max(p[0] for p in pts) - min(p[0] for p in pts), max(p[1] for p in pts) - min(p[1] for p in pts))
    env: list = [None] * bins
    for path in paths:
        for i, a in enumerate(path):
            b = path[(i + 1) % len(path)]
            n = min(256, max(2, math.ceil(math.dist(a, b) / (diag / (bins * 2)))))
            for k in range(n + 1):
                x, y = a[0] + (b[0] - a[0]) * k / n - cx, a[1] + (b[1] - a[1]) * k / n - cy
                at = min(bins - 1, int((math.atan2(y, x) % (2 * math.pi)) / (2 * math.pi) * bins))
                env[at] = max(env[at] or 0, math.hypot(x, y))
    out = list(env)
    for i in range(bins):
        if env[i] is None:
            lo = next(k for k in range(1, bins + 1) if env[i - k] is not None)
            hi = next(k for k in range(1, bins + 1) if env[(i + k) % bins] is not None)
            out[i] = env[i - lo] + (env[(i + hi) % bins] - env[i - lo]) * lo / (lo + hi)
    return out


def test_glyph_signatures_equal_plain_loops(spark):
    rng = random.Random(3)
    data = star(4, 1.0, 2.6, 5, 5, 1) + star(3, 1.0, 2.6, 0, 0, 2) + star(1, 1.0, 3.0, 9, 9, 3)
    data += [(4, p, True, True, k, rng.random(), rng.random()) for p in range(3) for k in range(5)] + [(5, 0, True, True, 0, 0.0, 0.0)]
    frame = spark.createDataFrame(data, SCHEMA)
    rim = {}
    for r in glyphs.outline(frame.where("glyph < 5"), ["glyph"]).collect():
        rim.setdefault(r.glyph, {})[r.bin] = r.radius
    got = {r.glyph: r for r in glyphs.signatures(frame, ["glyph"]).collect()}
    assert set(got) == {1, 2, 3, 4}
    for g in got:
        paths = [[(d[5], d[6]) for d in data if d[0] == g and d[1] == p] for p in sorted({d[1] for d in data if d[0] == g})]
        want = plain_outline(paths)
        assert [rim[g][b] for b in range(72)] == pytest.approx(want)
        smooth = [sum(want[(i + k) % 72] for k in (-1, 0, 1)) / 3 for i in range(72)]
        med = statistics.median(v for v in smooth if v > 0)
        over = [v / med > glyphs.SPIKE for v in smooth]
        lobes = 1 if all(over) else sum(over[i] and not over[i - 1] for i in range(72))
        assert got[g].lobes == lobes and got[g].spikiness == pytest.approx(max(smooth) / med) and got[g].parts == len(paths)
    assert (got[1].arms, got[1].confident, got[2].arms, got[2].confident, got[3].arms) == (4, True, 3, True, 1)
    assert got[1].evenness == pytest.approx(0, abs=1e-6) and got[1].fill_ratio == 0.2


def test_lens_kinds_and_gates(spark):
    rows = spark.createDataFrame([(1, 1, 3.0, 0, False, None), (1, 2, 1.1, 4, True, None), (1, 3, 1.1, 4, False, "cam_x"), (1, 4, 1.1, 4, True, "cam_y")], "page_id long, blob long, aspect double, arms int, confident boolean, match string")
    tokens = spark.createDataFrame([("1-lens", "cam_1"), ("3-lens", "cam_3")], "lens string, token string")
    got = {r.blob: (r.type, r.confidence, r.flag, r.via) for r in glyphs.named_lenses(rows, tokens).collect()}
    assert got == {1: ("cam_1", "high", None, "rule"), 2: ("4-lens", "high", None, "rule"), 3: ("cam_x", "low", "verify_lens_count", "prototype"), 4: ("cam_y", "high", None, "prototype")}
    ring, line = rows.where("blob in (1, 2)"), rows.where("blob in (2, 3)")
    assert {r.blob for r in glyphs.gated(rows, ring, line, True, True).collect()} == {2} and {r.blob for r in glyphs.gated(rows, ring, line).collect()} == {1, 2}


def test_elevations_pair_labels_in_order_or_with_the_nearest(spark):
    titles = spark.createDataFrame([(1, "ONE", 1, 0.2, 0.1), (1, "TWO", 1, 0.6, 0.5), (1, "THREE", 2, 0.3, 0.3)], "page_id long, title string, row int, x double, left double")
    labels = spark.createDataFrame([(1, "passive", 960, 1, 0.3), (1, "passive", 480, 1, 0.1), (1, "active", 48, 1, 0.55), (1, "passive", 240, 2, 0.9)], "page_id long, kind string, value int, row int, x double")
    assert {r.title: (r.passive, r.active) for r in notes.elevations(titles, labels).collect()} == {"ONE": (480, None), "TWO": (960, 48), "THREE": (240, None)}


def test_nulls_and_empty_frames(spark):
    one = spark.range(1).select(notes.note_fields(F.lit(None).cast("string")).alias("f"), notes.described_anchors(F.lit(None).cast("string")).alias("d"), notes.sheet_role(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("high")).alias("r")).first()
    assert one.f.item == "" and one.f.part is None and one.d.primary == [] and one.r.role is None and one.r.via == "none"
    empty = spark.createDataFrame([], SCHEMA)
    assert glyphs.signatures(empty, ["glyph"]).count() == 0 and glyphs.arms(empty, ["glyph"]).count() == 0
    catalog = detect.type_catalog(spark.createDataFrame([(1, "A", None), (2, "B", "not json")], "type_id long, name string, detection_config string"))
    assert catalog.count() == 0
    items = spark.createDataFrame([(1, 1, None, 0.0, 0.0)], "page_id long, seq long, str string, x double, y double")
    assert detect.detected(items, catalog, 0.1).count() == 0
    rules = spark.createDataFrame([(None, ["each"], {"each": None}, "per_rack")], "conflict boolean, required array<string>, params map<string,string>, qty_rule string")
    assert review.rule_blocker(rules).first().blocker == "set each first"
