"""Periodic runs against a plain scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from fixtures import SCHEMA, rows, words

from planspark.llm import periodic

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(w, least=24, times=3):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(doc, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(("" if doc is None else str(doc)).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (1, 3)])
def test_runs_equal_a_scan_of_all_periods(least, times):
    rng = random.Random(least)
    for _ in range(60):
        docs = []
        for _ in range(rng.randint(1, 6)):
            d = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 5, 30, 80, 200]))]
            if d and rng.random() < 0.6:
                a = rng.randrange(len(d))
                p = 1 + (len(d) - a) // rng.randint(3, 10)
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(len(d))]
            docs.append(d)
        found = periodic._found([" ".join(map(str, d)) for d in docs], least, times)
        assert [[tuple(r.values()) for r in x[1]] for x in found] == [plain_runs(d, least, times) for d in docs]


def test_query_rows_equal_brute_force(spark):
    data = list(rows())
    for k in range(100, 160):  # some of these are made periodic
        data.append((k, words(k, k) if k % 7 else " ".join(["da", "capo"] * k), "en", "s", 1, 1, "", "", ""))
    data += [(200, "x " * 23, *data[0][2:]), (201, "x " * 24, *data[0][2:]), (202, "a b " * 12 + "c " * 30, *data[0][2:]), (203, "x " * 2_000, *data[0][2:])]
    docs = spark.createDataFrame(data, SCHEMA).drop("component_id").withColumnRenamed("h", "runs")
    got = periodic.rows_of(periodic.periodic_runs(periodic.damaged(docs))).collect()
    want = sorted(((d, *plain_row(d, t)) for d, t, *_ in data), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r.n_runs > 0 for r in got) > 10 and any(zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in data)


def test_empty_table(spark):
    assert periodic.rows_of(periodic.periodic_runs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_one_long_text_is_read_whole():
    text = words(30_000, 1) + " " + "ping pong " * 40 + words(30_000, 2)
    ((n, found, kept),) = periodic._found([text], 24, 3)
    assert n == 60_080 and [(r["length"], r["period"]) for r in found] == [(80, 2)] and len(WORD.findall(kept)) == n - 78
    assert np.isclose(found[0]["start"], 30_000)
