"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are made document by document; equal ones are one trie leaf. The join walks pairs of trie
nodes together, adds up differing bits and drops a pair when they exceed the budget. To spread the walk
over a cluster the 64 bits are cut in m blocks: two fingerprints within the budget of b bits agree in
m - b blocks at least, so walks start below nodes that share those blocks (one set of tries per choice
of blocks), with m grown until a start holds few fingerprints. Starts that are still crowded are cut in
chunks, and each pair of chunks is a walk of its own. A walk hands on the links that connect what it
found, never all pairs; star rounds join them to components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, frugal, join_counted, plain, table
from .components import components

SHINGLE = 4
BUDGET = 4
#: Fingerprints a walk starts from at most, before its start is cut in chunks.
CROWD = 1500
#: Bits that all fingerprints of a start share at least.
SHARED = 12
_LOW = {c: c + 32 for c in range(65, 91)}


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included; fewer words: of the whole sequence."""
    import re

    from xxhash import xxh64_intdigest

    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOW))
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) > shingle:
        parts = [" ".join(x) for x in zip(*[words[i:] for i in range(shingle)], strict=False)]
    else:
        parts = [" ".join(words)]
    return np.fromiter((xxh64_intdigest(p, 42) for p in parts), np.uint64, len(parts))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; none: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * c > len(hashes) else "0" for c in counts), 2)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: bit is 1 if set in over half the XXH64 (seed 42) of its word shingles."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document; no words: 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})

    return plain(docs, doc_id="long", text="string").mapInPandas(frugal(run), "doc_id long, fp long")


def walk(fps: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct fingerprints of one group within budget bits. fps sorted within group, groups together.

    fps: a number each, or a row of several that make one long fingerprint.
    """
    fps = fps.reshape(len(fps), -1)
    last = fps.shape[1] - 1
    top = 64 * (last + 1) - 1
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([starts[1:], [len(fps)]])
    a_lo = b_lo = starts
    a_hi = b_hi = ends
    dist = np.zeros(len(starts), np.int64)
    left, right = [], []
    for bit in range(top, -2, -1):  # the last round only emits what the split on bit 0 left
        crowd = (a_hi - a_lo > 1) | (b_hi - b_lo > 1)
        # one fingerprint against one: the rest of the bits at once
        x, y, d = a_lo[~crowd], b_lo[~crowd], dist[~crowd]
        near = (x != y) & (d <= budget)
        x, y, d = x[near], y[near], d[near]
        for word in range(last - bit // 64 if bit >= 0 else last, last + 1):
            diff = fps[x, word] ^ fps[y, word]
            if word == last - bit // 64 and bit % 64 < 63:
                diff &= np.uint64((1 << (bit % 64 + 1)) - 1)
            elif bit < 0:
                diff &= np.uint64(0)
            d = d + np.bitwise_count(diff)
        near = d <= budget
        left.append(x[near])
        right.append(y[near])
        a_lo, a_hi, b_lo, b_hi, dist = (v[crowd] for v in (a_lo, a_hi, b_lo, b_hi, dist))
        if bit < 0 or not len(a_lo):
            break
        ones = np.concatenate([[0], np.cumsum((fps[:, last - bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.int64)])
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo  # a node with itself: its crossed children are one pair
        parts = [
            (a_lo, a_mid, b_lo, b_mid, dist, None), (a_mid, a_hi, b_mid, b_hi, dist, None),
            (a_lo, a_mid, b_mid, b_hi, dist + 1, None), (a_mid, a_hi, b_lo, b_mid, dist + 1, ~same),
        ]
        kept = []
        for al, ah, bl, bh, d, also in parts:
            ok = (ah > al) & (bh > bl) & (d <= budget) & ~((al == bl) & (ah - al == 1))
            if also is not None:
                ok &= also
            kept.append([v[ok] for v in (al, ah, bl, bh, d)])
        a_lo, a_hi, b_lo, b_hi, dist = (np.concatenate(v) for v in zip(*kept, strict=True))
    return np.concatenate(left), np.concatenate(right)


def stars(left: np.ndarray, right: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the index pairs connect: node -> smallest node it reaches."""
    label = nodes.copy()
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        if (after == label).all():
            break
        label = after
    hung = np.flatnonzero(label != nodes)
    return nodes[hung], label[hung]


def links(fps: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """(u, v) links that connect all fingerprints within budget of each other. fps: fp, distinct."""
    count = fps.count()
    m = budget + 1
    # starts share SHARED bits at least, whatever the count, and then as many as leave few fingerprints in each
    while m < 2 * budget and (64 * (m - budget) // m < SHARED or count >> (64 * (m - budget) // m) > crowd // 8):
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(m), m - budget)]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(x).cast("long") for x in signed])).alias("way", "mask"))
    keyed = keyed.select("fp", "way", F.col("fp").bitwiseAND(F.col("mask")).alias("start"))
    crowds = keyed.groupBy("way", "start").agg(F.count("*").alias("held")).where("held > 1")
    met = keyed.join(crowds, ["way", "start"])
    parts = F.ceil(F.col("held") / crowd).cast("int")
    met = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, F.col("part")) * F.col("parts") + F.greatest(x, F.col("part")))
    met = met.select("way", "start", "fp", F.explode(pairs).alias("pair"))
    walks = met.repartition("way", "start", "pair").sortWithinPartitions("way", "start", "pair", "fp")

    return walked(walks, ["fp"], "fp", budget, 4_000_000)


def walked(walks: DataFrame, words: list[str], node: str, budget: int, most: int, joined: Callable | None = None) -> DataFrame:
    """(u, v) links by node that connect what the walks of each (way, start, pair) find; walks lie together, ``most`` pairs at once.

    joined: gives the links of index pairs, nodes and fingerprints; stars of the nodes without it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(held: pd.DataFrame) -> pd.DataFrame:
            group = held.groupby(["way", "start", "pair"], sort=False).ngroup().to_numpy()
            unsigned = np.stack([held[w].to_numpy().view(np.uint64) for w in words], axis=1)
            order = np.lexsort((*unsigned.T[::-1], group))
            left, right = walk(unsigned[order], group[order], budget)
            nodes = held[node].to_numpy()[order]
            u, v = joined(left, right, nodes, unsigned[order]) if joined else stars(left, right, nodes)
            return pd.DataFrame({"u": u, "v": v})

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["way", "start", "pair"]].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            whole = int(new[-1]) if len(new) else 0  # the last group may go on in the next batch
            sizes = np.diff(np.concatenate([[0], new]))
            at, weight = 0, 0
            for cut, size in zip(new.tolist(), sizes.tolist(), strict=True):
                weight += size * size
                if weight > most:
                    yield found(pdf.iloc[at:cut])
                    at, weight = cut, 0
            if whole > at:
                yield found(pdf.iloc[at:whole])
            rest = pdf.iloc[whole:]
        if rest is not None and len(rest):
            yield found(rest)

    return walks.mapInPandas(frugal(run), "u long, v long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every document.

    docs: doc_id, text (other columns are ignored). Texts without words, null ones too, have
    fingerprint zero and link like any other; repeated rows stay; rows with null doc_id get a
    component of the others only, or null if alone. An empty table gives no rows.
    """
    made = checkpointed(fingerprints(docs, shingle))
    leaves = made.select("fp").distinct()
    # rows that share a doc_id are one document: their fingerprints hang together
    twice = made.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("u")).where("u <> v")
    same = made.join(twice.select("doc_id", "v"), "doc_id").select(F.col("fp").alias("u"), "v")
    reach = components(links(leaves, budget).unionByName(same))
    first = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("held"))
    labels = checkpointed(first.join(reach, first["fp"] == reach["node"], "left").select("fp", "least", "held", F.coalesce("component", "fp").alias("component")))
    of = labels.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    labels = join_counted(labels.drop("least"), of, "component", "nodes").select("fp", "held", "component_id")
    return join_counted(made, labels, "fp", "held").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all their columns, of the smallest doc_id of each group of near-duplicates.

    Rows that share that doc_id stay together; rows with null doc_id all stay.
    """
    keep = near_duplicates(docs, budget, shingle).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.where("doc_id is null").unionByName(docs.join(keep, docs["doc_id"] == keep["kept_id"], "left_semi"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
