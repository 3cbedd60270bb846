"""Near-duplicate texts of a stated similarity: all pairs whose sets of word shingles have it, and none below it.

The similarity of two texts is that of their sets of shingles (common ones over all), in exact numbers. Of two texts of
similarity 4/5 each holds 4/5 of the other's shingles, so a text with over 1/5 of its shingles to itself has no
partner. That is first asked of a part of all hashes, the same one for all texts, and drops most texts; only those that
are left, which are mostly copies, go on with all of their shingles.

SimHash of 256 bits finds most of the links between them, walked as binary tries below sampled bits. Texts of
similarity s differ in each bit with the probability acos(2s / (1 + s)) / pi: in 39 of 256 bits for s = 0.8, so four
SimHashes of 64 bits are put together, each of the same shingles under another mixing. No choice of whole blocks
survives 46 differing bits; walks start below K bits that each of L ways samples from the 256, with L such that a pair
of similarity s shares a start with a probability of 0.95 at least. Within a start the trie walk is exact. K grows with
the logarithm of the number of texts, so starts stay small; L grows with about its fourth root (24 ways for 2**18
texts, 70 for 2**24). The walks' links are checked against the shingle sets.

What SimHash misses is found by the prefix filter: with the shingles of all texts in one order, rare ones first, two
texts of similarity 4/5 share one among the first fifth (and one more) of each. Pairs that do, and that no link holds
together yet, are checked unless their sizes or the counts of their shingles in 128 bins rule them out.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, plain, written
from .components import components
from .simhash import majority, shingle_hashes, walked
from .words import mix

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, and bits of it that linked texts differ in at most.
WORDS, BUDGET = 4, 46
#: Pairs of similarity SIMILARITY that share a start, as a share of all at least.
FOUND = 0.95
#: Bits that all fingerprints of a start share at least, and fingerprints of a start at most before it is cut in chunks.
SHARED, CROWD = 10, 700
_FPS = [f"f{i}" for i in range(WORDS)]
#: Hashes below it are asked first for shingles that a text has to itself: three of ten.
LOW = int(0.3 * 2**64)
#: Bins that a text's shingles are counted in.
BINS = 128


def fingerprint(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """The words of a text's long SimHash, the first one its plain SimHash; no words: zeros."""
    return _words(shingle_hashes(text, shingle))


def _words(hashes: np.ndarray) -> list[int]:
    return [majority(hashes if not i else mix(hashes + np.uint64(i))) for i in range(WORDS)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the words f0.. of every document with a doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.uint64).reshape(len(pdf), WORDS).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: fps[:, i] for i, c in enumerate(_FPS)}})

    docs = plain(docs, doc_id="long", text="string").where("doc_id is not null")
    return docs.mapInPandas(frugal(run), "doc_id long, " + ", ".join(f"{c} long" for c in _FPS))


def ways(count: int, similarity: float = SIMILARITY, found: float = FOUND) -> list[list[int]]:
    """For each way the masks, one a word, of the bits that its starts share."""
    shared = max(SHARED, count.bit_length() - 5)
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    many = math.ceil(math.log(1 - found) / math.log(1 - same**shared))
    rng, out = random.Random(1), []
    for _ in range(many):
        bits = rng.sample(range(64 * WORDS), shared)
        out.append([reduce(lambda m, b: m | 1 << b % 64, (b for b in bits if b // 64 == w), 0) for w in range(WORDS)])
    return out


def forest(left: np.ndarray, right: np.ndarray, apart: np.ndarray, count: int) -> np.ndarray:
    """Places of as few index pairs as connect what all of them connect, the nearest ones (Boruvka's rounds)."""
    open_ = np.argsort(apart, kind="stable")
    label, chosen = np.arange(count), []
    while True:
        a, b = label[left[open_]], label[right[open_]]
        cross = a != b
        open_, a, b = open_[cross], a[cross], b[cross]
        if not len(open_):
            return np.concatenate([*chosen, np.zeros(0, np.int64)]).astype(np.int64)
        best = np.full(count, len(open_))
        np.minimum.at(best, a, np.arange(len(open_)))
        np.minimum.at(best, b, np.arange(len(open_)))
        best = np.unique(best[best < len(open_)])
        chosen.append(open_[best])
        over = np.arange(count)  # classes that chosen pairs join take the smallest label among them
        while (over[a[best]] != over[b[best]]).any():
            low = np.minimum(over[a[best]], over[b[best]])
            np.minimum.at(over, a[best], low)
            np.minimum.at(over, b[best], low)
        label = over[label]


def links(leaves: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """(u, v) links by node that connect fingerprints (node, f0.., distinct) within budget bits that share a start."""
    signed = [[x - (1 << 64) if x >> 63 else x for x in masks] for masks in ways(leaves.count())]
    starts = F.array(*[F.xxhash64(*[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(_FPS, masks, strict=True)]) for masks in signed])
    keyed = leaves.select("node", *_FPS, F.posexplode(starts).alias("way", "start"))
    # only crowded starts are joined: where few, Spark broadcasts them by the size of their table
    crowds = written(keyed.groupBy("way", "start").agg(F.count("*").alias("held")).where(F.col("held") > crowd))
    walks = _chunked(keyed.join(crowds, ["way", "start"], "left"), ["way", "start"], F.col("held"), crowd, _FPS)
    return walked(walks, _FPS, "node", budget, 1_000_000, _nearest)


def _nearest(left: np.ndarray, right: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = forest(left, right, np.bitwise_count(fps[left] ^ fps[right]).sum(axis=1), len(nodes))
    return nodes[left[kept]], nodes[right[kept]]


def shingle_set(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct hashes of a text's shingles, ascending, and a number of the set."""
    held = np.unique(hashes)
    return held, int.from_bytes(blake2b(held.tobytes(), digest_size=8).digest(), "little", signed=True)


def leaves_of(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, leaf (the number of its shingle set), n (its size) and low (its hashes below LOW) of documents with a doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [shingle_set(shingle_hashes(t, shingle)) for t in pdf["text"]]
            low = [held[: np.searchsorted(held, np.uint64(LOW))].view(np.int64) for held, _ in rows]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "leaf": [leaf for _, leaf in rows], "n": [len(held) for held, _ in rows], "low": low})

    docs = plain(docs, doc_id="long", text="string").where("doc_id is not null")
    return docs.mapInPandas(frugal(run), "doc_id long, leaf long, n long, low array<long>")


def not_alone(made: DataFrame) -> DataFrame:
    """leaf, first (its smallest doc_id) of the sets whose low hashes don't rule out a partner."""
    met = made.select("leaf", F.explode("low").alias("h")).groupBy("h").agg(F.min("leaf").alias("leaf"), F.max("leaf").alias("other"))
    own = met.where("leaf = other").groupBy("leaf").agg(F.count("*").alias("own"))
    leaves = made.where("n > 0").groupBy("leaf").agg(F.min("n").alias("n"), F.min("doc_id").alias("first"))
    return leaves.join(own, "leaf", "left").where("5 * coalesce(own, 0) <= n").select("leaf", "first")


def sets_of(docs: DataFrame, left: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """leaf, n, f0.., bins (counts of its shingles) and held (all its hashes) of the sets of left (leaf, first)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes = [shingle_hashes(t, shingle) for t in pdf["text"]]
            fps = np.array([_words(h) for h in hashes], np.uint64).reshape(len(pdf), WORDS).view(np.int64)
            rows = [shingle_set(h) for h in hashes]
            bins = [np.minimum(np.bincount((held % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes() for held, _ in rows]
            yield pd.DataFrame({"leaf": [leaf for _, leaf in rows], "n": [len(held) for held, _ in rows], **{c: fps[:, i] for i, c in enumerate(_FPS)}, "bins": bins, "held": [held.view(np.int64) for held, _ in rows]})

    docs = plain(docs, doc_id="long", text="string").join(left.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    made = docs.mapInPandas(frugal(run), "leaf long, n long, " + ", ".join(f"{c} long" for c in _FPS) + ", bins binary, held array<long>")
    return made.join(left, "leaf", "left_semi").dropDuplicates(["leaf"])  # a doc_id can have texts of several sets


def ordered(sets: DataFrame) -> DataFrame:
    """leaf, n, common (hashes that other sets hold too, rare ones first) and first (the leading ones that a partner must meet) of the sets that can have one."""
    rows = sets.select("leaf", F.explode("held").alias("h"))
    shared = written(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    # a hash stands once in a set, so none holds more rows than there are sets; Spark's skew rule splits what passages crowd
    tokens = rows.join(shared, "h").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("tokens"))
    kin = tokens.join(sets.select("leaf", "n"), "leaf").where("5 * (n - size(tokens)) <= n").select("leaf", "n", F.col("tokens.h").alias("common"))
    return kin.withColumn("first", F.expr("slice(common, 1, cast(n div 5 + 1 - (n - size(common)) as int))"))


def alike(pairs: DataFrame, kin: DataFrame) -> DataFrame:
    """The pairs (u, v) of similarity 4/5 or more, by their sets."""
    one, other = (kin.select(F.col("leaf").alias(c), F.col("n").alias(f"n_{c}"), F.col("common").alias(f"held_{c}")) for c in "uv")
    both = pairs.join(one, "u").join(other, "v")
    return both.where(9 * F.size(F.array_intersect("held_u", "held_v")) >= 4 * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def _chunked(rows: DataFrame, keys: list[str], held: Column, crowd: int, by: list[str]) -> DataFrame:
    """rows with a column pair: groups of over ``crowd`` rows are cut in parts, each pair of parts is a group of its own."""
    parts = F.coalesce(F.ceil(held / crowd), F.lit(1)).cast("int")
    met = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, F.col("part")) * F.col("parts") + F.greatest(x, F.col("part")))
    kept = [c for c in rows.columns if c != "held"]
    return met.select(*kept, F.explode(pairs).alias("pair")).repartition(*keys, "pair").sortWithinPartitions(*keys, "pair")


def rest(kin: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct pairs (u, v) of different classes that meet in a leading hash and that neither sizes nor bins rule out.

    kin: leaf, n, bins, class, first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(pdf: pd.DataFrame) -> pd.DataFrame:
            leaf, n, of = (pdf[c].to_numpy() for c in ("leaf", "n", "class"))
            bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, BINS).astype(np.int16)
            out = []
            for at in range(len(pdf) - 1):
                to = np.arange(at + 1, len(pdf))
                to = to[(of[to] != of[at]) & (5 * np.minimum(n[at], n[to]) >= 4 * np.maximum(n[at], n[to]))]
                to = to[9 * np.abs(bins[to] - bins[at]).sum(axis=1, dtype=np.int64) <= n[at] + n[to]]
                out.append(np.stack([np.minimum(leaf[at], leaf[to]), np.maximum(leaf[at], leaf[to])], axis=1))
            u, v = np.concatenate(out).T
            return pd.DataFrame({"u": u, "v": v})

        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf[["h", "pair"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            many = [found(pdf.iloc[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]
            if many:
                yield pd.concat(many)
            held = pdf.iloc[edges[-1] :]  # the last group may go on in the next batch
        if held is not None and len(held) > 1:
            yield found(held)

    rows = kin.select("leaf", "n", "class", "bins", F.explode("first").alias("h"))
    counts = written(rows.groupBy("h").agg(F.count("*").alias("held"), F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("h", "held"))
    walks = _chunked(rows.join(counts, "h"), ["h"], F.col("held"), crowd, ["leaf"])
    return walks.mapInPandas(frugal(run), "u long, v long").distinct()


def near_links(docs: DataFrame, made: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """(u, v) links by leaf, all of similarity 4/5 or more, that connect all such pairs. made: of leaves_of."""
    sets = written(sets_of(docs, written(not_alone(made)), shingle))
    kin = written(ordered(sets))
    prints = sets.join(kin.select("leaf"), "leaf", "left_semi").groupBy(*_FPS).agg(F.min("leaf").alias("node"), F.max("leaf").alias("other"))
    prints = written(prints)
    found = links(prints.select("node", *_FPS), budget).unionByName(prints.where("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v")))
    sure = written(alike(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), kin))
    of = components(sure).select(F.col("node").alias("leaf"), "component")
    classed = kin.select("leaf", "n", "first").join(of, "leaf", "left").withColumn("class", F.coalesce("component", "leaf")).drop("component")
    return sure.unionByName(written(alike(rest(classed.join(sets.select("leaf", "bins"), "leaf"), crowd), kin)))


def one_of_each(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all their columns, of the smallest doc_id of each group of near-duplicates.

    Rows that share that doc_id stay together; rows with null doc_id all stay. Texts without words, null ones too, are
    equal to one another. An empty table gives no rows; very long texts are read whole, as any other.
    """
    made = written(leaves_of(docs, shingle))
    several = made.groupBy("doc_id").agg(F.min("leaf").alias("v"), F.max("leaf").alias("u")).where("u <> v").select("doc_id", "v")
    same = made.join(several, "doc_id").select(F.col("leaf").alias("u"), "v")
    reach = components(near_links(docs, made, budget, shingle).unionByName(same)).withColumnRenamed("node", "leaf")
    leaves = made.groupBy("leaf").agg(F.min("doc_id").alias("least")).join(reach, "leaf", "left")
    keep = leaves.groupBy(F.coalesce("component", "leaf")).agg(F.min("least").alias("kept_id")).select("kept_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.join(keep, docs["doc_id"] == keep["kept_id"], "left_semi"))
