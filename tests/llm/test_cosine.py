"""Embedding near-duplicates against all cosines."""

import numpy as np
import pytest

from planspark.llm import cosine

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, n long, component_id long"


def brute(rows, threshold=0.93):
    """n_links and component of each place of rows."""
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [set() for _ in rows]
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[a].add(b)
    out = []
    for k, (vec, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        least = min(ids) if ids else None
        out.append((vec, len(links[k]), least, vec is not None and vec == least))
    return sorted(out, key=str)


def vectors(seed, many=300, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = []
    for k in range(many):
        v = base[k % 12] + rng.normal(size=dim) * rng.choice([0.05, 0.25, 0.45, 2.0])
        rows.append((k, v.astype(np.float32).tolist(), int(rng.choice([1, 1, 1, 2, 3]))))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]  # a group of copies
    rows += [(2000, rows[0][1], None), (2001, None, 1), (2002, [], 1), (2003, [0.0] * dim, 1), (2004, [None, *rows[0][1][1:]], 1), (2005, [float("nan"), *rows[0][1][1:]], 1), (2006, [float("inf"), *rows[0][1][1:]], 1)]
    rows += [(2007, rows[0][1][:5], rows[0][2]), (2008, rows[0][1][:5], rows[0][2]), (5, rows[7][1], rows[7][2]), (5, rows[7][1], rows[7][2]), (None, rows[9][1], rows[9][2]), (None, rows[9][1], None)]
    rows += [(2010, (np.array(rows[3][1], np.float32) * np.float32(1e30)).tolist(), rows[3][2]), (2011, (np.array(rows[3][1], np.float32) * np.float32(1e-30)).tolist(), rows[3][2])]
    return rows


@pytest.mark.parametrize("tile", [16, 64, 2048])
def test_rows_equal_all_cosines(spark, tile):
    rows = vectors(tile)
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in cosine.near_duplicates(df, tile=tile).collect()), key=str)
    assert got == brute(rows) and sum(r[1] > 0 for r in got) > 100


def test_tiles_far_apart_are_not_compared(spark):
    rng = np.random.default_rng(1)
    base = np.eye(8, 32) * 5
    rows = [(k, (base[k % 8] + rng.normal(size=32) * 0.1).astype(np.float32).tolist(), 1) for k in range(400)]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)
    found = cosine._vectors(df)
    basis, order, middle = cosine.axes(found)
    shape = "cid long, grp string, vec binary, code int, lead array<float>, rest float"
    classes = found.selectExpr("vec_id cid", "label grp", "vec")
    tiled = cosine.written(cosine._tiles(classes.mapInPandas(cosine._coded(basis, order, middle), shape), 50))
    pairs = cosine._pairs(tiled, 0.93)
    tiles = tiled.select("tile").distinct().count()
    assert tiles >= 8 and pairs.count() < tiles * (tiles + 1) // 2
    assert sorted((tuple(r) for r in cosine.near_duplicates(df, tile=50).collect()), key=str) == brute(rows)


def test_near_gives_every_pair_whatever_is_left_after_the_first_dimensions():
    rng = np.random.default_rng(5)
    for spread in (0.01, 0.3, 3.0):
        x = rng.normal(size=(1, 40)) + rng.normal(size=(300, 40)) * spread
        y = rng.normal(size=(1, 40)) + rng.normal(size=(200, 40)) * spread
        y[:50] = x[:50] + rng.normal(size=(50, 40)) * 0.2
        basis = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        a, b = (cosine._Tile([(k, 1, v.tobytes()) for k, v in enumerate(m)], basis) for m in (x, y))
        cos = (x @ y.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))
        assert set(zip(*map(np.ndarray.tolist, cosine.near(a, b, 0.93)), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(cos >= 0.93)), strict=True))


def test_nothing_to_compare(spark):
    assert cosine.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = cosine.near_duplicates(spark.createDataFrame([(1, None, 1, "", 1, 1), (2, [1.0], None, "", 1, 1)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]
