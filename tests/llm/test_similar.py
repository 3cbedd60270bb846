"""Near-duplicates of five-word shingles and similarity 0.8: the long fingerprints, their walk, recall and precision."""

import collections
import random

import numpy as np

from planspark.llm import similar, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(words, edits, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def test_walk_of_long_fingerprints_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    fps = np.repeat(base, 30, axis=0)
    for row in fps:
        for b in rng.integers(0, 256, rng.integers(0, 60)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    fps = np.unique(fps, axis=0)
    group = np.sort(rng.integers(0, 3, len(fps)))
    order = np.lexsort((*fps.T[::-1], group))
    fps, group = fps[order], group[order]
    left, right = simhash.walk(fps, group, 46)
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    want = {(i, j) for i in range(len(fps)) for j in range(i) if apart[i, j] <= 46 and group[i] == group[j]}
    assert {(max(a, b), min(a, b)) for a, b in zip(left.tolist(), right.tolist())} == want and len(left) == len(want) > 100


def test_recall_and_precision_of_pairs(spark):
    rng = random.Random(2)
    rows, pairs = [], []
    for n in range(600):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        other = edited(words, rng.randrange(1, max(2, len(words) // 18)), rng)
        rows += [(2 * n, " ".join(words)), (2 * n + 1, other)]
        pairs.append(alike(" ".join(words), other))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in similar.one_of_each(docs).collect()}
    assert kept >= {2 * n for n in range(600)}  # texts of different pairs are never linked
    near = [2 * n + 1 not in kept for n, s in enumerate(pairs) if s >= 0.8]
    far = [2 * n + 1 not in kept for n, s in enumerate(pairs) if s < 0.65]
    assert len(near) > 100 and sum(near) / len(near) >= 0.9
    assert len(far) > 50 and sum(far) / len(far) <= 0.1


def test_crowded_starts_repeats_nulls_and_clashing_names(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = [(k, edited(words, 2, rng), "n", k) for k in range(5, 205)]  # a crowd of near copies
    rows += [(300, "other words stand here and nowhere else", "n", 1), (300, "two texts share this number of a document", "n", 2), (None, None, "n", 3), (None, " ".join(words), "n", 4), (400, None, "n", 5), (401, " \t", "n", 6), (402, "one", "n", 7)]
    rows += [(403, "two texts share this number of a document", "n", 8), (6, rows[1][1], "n", 9), (404, "long " * 200_000, "n", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, f0 long")
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.f0) for r in kept.collect() if r.doc_id is not None) == [(5, 5), (300, 1), (300, 2), (400, 5), (402, 7), (404, 10)]
    assert sum(r.doc_id is None for r in kept.collect()) == 2
    assert similar.one_of_each(docs.limit(0)).count() == 0
    leaves = similar.fingerprints(docs).groupBy("f0", "f1", "f2", "f3").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "node")
    few, crowded = ({(r.node, r.component) for r in similar.components(similar.links(leaves, crowd=c)).collect()} for c in (700, 16))
    assert few == crowded


def test_all_pairs_of_the_similarity_and_no_others(spark):
    rng = random.Random(4)
    passage = [f"p{n}" for n in range(60)]
    rows = []
    for n in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 4, 5, 9, 13, 14, 30, 45, 90, 200]))]
        words += passage if n % 3 == 0 else []
        for _ in range(3):  # one version after another, most of them near the limit
            rows.append((len(rows), " ".join(words)))
            words = edited(words, min(len(words), rng.choice([1, 1, 2, 3, 5])), rng).split() if rng.random() < 0.6 else words[: len(words) - rng.choice([1, 2, len(words) // 9, len(words) // 5])]
    held = [shingles(t) if t else set() for _, t in rows]
    least = list(range(len(rows)))
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if held[i] == held[j] or 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j])]
    assert sum(held[i] != held[j] and 5 * len(held[i] & held[j]) < 4.3 * len(held[i] | held[j]) for i, j in pairs) > 10
    for _ in rows:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == set(least)
    made = similar.leaves_of(docs)
    few, crowded = ({(r.node, r.component) for r in similar.components(similar.near_links(docs, made, budget=0, crowd=c)).collect()} for c in (700, 3))
    assert few == crowded and len(few) > 100  # equal fingerprints apart, the walks find nothing here and the prefix filter all


def test_forest_connects_what_pairs_connect_with_the_nearest_ones():
    left, right, apart = np.array([0, 1, 0, 3, 4, 5, 3]), np.array([1, 2, 2, 4, 5, 3, 5]), np.array([5, 1, 2, 9, 9, 9, 9])
    kept = similar.forest(left, right, apart, 7).tolist()
    assert set(kept) & {0, 1, 2} == {1, 2} and len(kept) == len(set(kept)) == 4
    assert similar.forest(left[:0], right[:0], apart[:0], 3).tolist() == []


def test_each_set_meets_the_counts_of_its_shingles_once(spark):
    passage = list(range(40))  # held by 2,000 sets, over a thousandth of all rows each
    held = [[*passage, *(1000 + 3 * n + k for k in range(4))] for n in range(2000)]
    sets = similar.written(spark.createDataFrame([(n, len(h), h) for n, h in enumerate(held)], "leaf long, n long, held array<long>"))
    df = collections.Counter(h for hs in held for h in hs)
    kin = similar.ordered(sets)
    want = {n: [h for _, h in sorted((df[h], h) for h in hs if df[h] > 1)] for n, hs in enumerate(held)}
    assert {r.leaf: r.common for r in kin.collect()} == want
    assert {r.leaf: r.first for r in kin.collect()} == {n: common[: 44 // 5 + 1 - (44 - len(common))] for n, common in want.items()}
    plan = kin._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(held") == 1 and "LeftAnti" not in plan
