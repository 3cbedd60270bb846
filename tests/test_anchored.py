"""Runs and lines that are held against the first of their group, on rows that drift."""

import random

import pytest

from planspark.operators import islands, notes


def stitched(rows, tol, space=0.15, merge=1.0):
    out, cur = [], None
    for s, cy, left, right, fs in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        size = (cur[4] or 10) if cur else 10
        if cur and abs(cy - cur[1]) <= tol and left - cur[3] <= size * merge:
            cur[0] += (" " if left - cur[3] > size * space else "") + s
            cur[3] = max(cur[3], right)
        else:
            cur = [s, cy, left, right, fs]
            out.append(cur)
    return sorted((c[0], c[1], (c[2] + c[3]) / 2) for c in out)


def lined(rows, tol=0.35, merge=1.0, space=0.15):
    lines = []
    for s, y, left, right, size in sorted(rows, key=lambda r: r[1]):
        if lines and abs(y - lines[-1][0][1]) <= min(size, lines[-1][0][4]) * tol:
            lines[-1].append((s, y, left, right, size))
        else:
            lines.append([(s, y, left, right, size)])
    out = []
    for k, line in enumerate(lines):
        cur = None
        for s, y, left, right, size in sorted(line, key=lambda r: (r[2], r[1])):
            gap = left - cur[3] if cur else 0
            if cur and -cur[4] * 0.3 <= gap <= cur[4] * merge:
                cur[0] += (" " if gap > cur[4] * space else "") + s
                cur[3] = max(cur[3], right)
            else:
                cur = [s, y, left, right, size]
                out.append((k, cur))
    return sorted((k, c[0], c[2], c[3], c[1]) for k, c in out)


def drifting(seed, n=120):
    rng = random.Random(seed)
    rows, y = [], 0.0
    for k in range(n):
        y += rng.choice([0.0, 0.1, 0.3, 0.45, 0.9, 3.0])
        left = rng.choice([0.0, 10.0, 20.0, 30.0]) + rng.random()
        rows.append((f"t{k}", round(y, 2), left, left + rng.choice([3.0, 9.0, 12.0]), rng.choice([2.0, 4.0, 10.0])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_drifting_rows_come_apart_from_the_first_of_their_group(spark, seed):
    pages = {p: drifting(seed * 10 + p) for p in range(3)}
    df = spark.createDataFrame([(p, k, *r) for p, rows in pages.items() for k, r in enumerate(rows)], "page_id long, seq long, s string, cy double, x0 double, x1 double, fs double")
    got = islands.anchored_runs(df, ["page_id"], 1.0).collect()
    lines = notes.page_lines(df.withColumnsRenamed({"cy": "y", "fs": "size"})).collect()
    for p, rows in pages.items():
        assert sorted((r.s, r.cy, r.cx) for r in got if r.page_id == p) == stitched(rows, 1.0)
        assert sorted((r.line - 1, r.str, r.left, r.right, r.y) for r in lines if r.page_id == p) == lined(rows)
