"""Rings and lines that are drawn in pieces."""

import math

from planspark.operators import rings

BLOBS, STROKES = "page_id long, blob long, x double, y double, radius double", "page_id long, stroke long, pts array<struct<x double, y double>>"


def test_a_ring_of_55_pieces_is_found_and_half_a_ring_is_not(spark):
    blobs = spark.createDataFrame([(1, 7, 50.0, 50.0, 2.0), (1, 8, 150.0, 50.0, 2.0), (1, 9, 250.0, 50.0, 0.0)], BLOBS)
    at = lambda cx, k: (cx + 9 * math.cos(k * math.tau / 55), 50 + 9 * math.sin(k * math.tau / 55))
    pieces = [[at(50, k), at(50, k + 1)] for k in range(55)] + [[at(150, k), at(150, k + 1)] for k in range(20)]
    pieces = [p[::-1] if k % 4 == 1 else p for k, p in enumerate(pieces)]
    pieces += [[(50.0 - 2, 50.0), (52.0, 50.5)], [(40.0, 40.0), (41.0, 43.0)], [(9.0, 9.0)]]  # strokes of the symbol and beside it, a point
    strokes = spark.createDataFrame([(1, k, p) for k, p in enumerate(pieces)], STROKES)
    got = rings.ring_around(blobs, strokes, touch=0.01).collect()
    assert [(r.page_id, r.blob) for r in got] == [(1, 7)] and abs(got[0].ring_radius - 9) < 0.01 and abs(got[0].cx - 50) < 0.2
    assert rings.ring_around(blobs, strokes.limit(0)).count() == 0


def test_a_line_in_pieces_passes_through_and_one_beside_does_not(spark):
    blobs = spark.createDataFrame([(1, 7, 50.0, 50.0, 2.0), (1, 8, 150.0, 50.0, 2.0)], BLOBS)
    through = [[(45.0 + k, 50.0 + k * 0.1), (46.0 + k, 50.1 + k * 0.1)] for k in range(10)]
    beside = [[(145.0 + k, 54.0), (146.0 + k, 54.0)] for k in range(10)]
    strokes = spark.createDataFrame([(1, k, p[::-1] if k % 2 else p) for k, p in enumerate(through + beside)], STROKES)
    got = rings.line_through(blobs, strokes, touch=0.01).collect()
    assert [r.blob for r in got] == [7] and abs(got[0].length - math.hypot(10, 1)) < 0.01
