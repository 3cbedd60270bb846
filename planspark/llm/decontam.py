"""Benchmark decontamination by the q-gram lemma.

Text and items are lower-cased and runs of anything but letters and digits become one space. If an item
of n characters lies in a document with at most k edits, the two share n - q + 1 - k*q q-grams at least,
and those lie on diagonals (place in text less place in item) at most k apart. So every document's
q-grams look up the items' q-grams, hits are counted in overlapping bands of diagonals, bands under the
bound are dropped, and what stays is verified by an alignment that keeps to the band.

Items too short for a q-gram are looked up word by word and must stand there as they are.

Benchmark items are the stated query set: they go to the tasks in blocks of bounded size, one block after
the other, each a pass over the documents whose finds are written before the next block is read; documents
are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, plain, table, written
from .words import BASES, mix, powers

Q = 10
#: Edits that an item may have taken, as a share of its characters.
EDITS = 0.08
#: Characters of the benchmark that one pass carries to the tasks.
BLOCK = 8_000_000
#: Items shorter than this many characters are found, but a document that holds one is not taken for a leak by clean().
SHORTEST = 20
_CHUNK = 500_000
#: All but letters with their marks (vowel signs, accents) and digits.
_OTHER = regex.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", unicodedata.normalize("NFC", (text or "").lower())).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def _grams(code: np.ndarray, q: int) -> np.ndarray:
    """A key of each q-gram."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    weight, out = powers(BASES[0], q), np.zeros(len(code) - q + 1, np.uint64)
    for j in range(q):
        out += code[j : len(code) - q + 1 + j] * weight[j]
    return mix(out)


def alignment(item: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of item in text that begins at low..high, within budget edits, or None.

    Rows are the item's characters; only the diagonals low - budget .. high + budget are kept, a row at once.
    """
    first, last = max(0, low), min(high, len(text))
    if first > last:
        return None
    at = text.find(item, first, last + len(item))
    if at >= 0:
        return 0, at, at + len(item)
    base, width = low - budget, high - low + 2 * budget + 1
    code = np.zeros(width + len(item), np.int64)  # the characters that the diagonals meet; 0 outside text
    a, b = max(0, base), min(len(text), base + width + len(item))
    code[a - base : b - base] = _codes(text[a:b]).astype(np.int64)
    there = np.arange(base, base + width)
    far, one = np.int64(budget + 1) << 32, np.int64(1) << 32
    # cost and where the place begins in one number: the cheapest, then the first
    value = np.where((there >= first) & (there <= last), np.maximum(there, 0), far)
    slope = np.arange(width, dtype=np.int64) << 32
    for i, ch in enumerate(_codes(item).astype(np.int64).tolist()):
        met = code[i : i + width]
        new = np.where(met > 0, value + np.where(met == ch, 0, one), far)  # this character met, or another in its place
        left_out = np.append(value[1:], far) + one  # not in text
        left_out[there + 1 + i > len(text)] = far
        new = np.minimum(new, left_out)
        put_in = np.minimum.accumulate(np.where(met > 0, new, far + slope) - slope) + slope  # more in text, any number
        new = np.where(met > 0, np.minimum(new, put_in), new)
        value = np.minimum(new, far)
        if value.min() >= far:
            return None
    d = int(value.argmin())
    cost, start = int(value[d] >> 32), int(value[d] & ((1 << 32) - 1))
    return (cost, start, min(len(text), base + d + len(item))) if cost <= budget else None


class Index:
    """The q-grams of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, edits: float):
        self.short = defaultdict(list)
        for i, t in items:
            if len(t) < q:
                self.short[t].append(i)
        self.spans = sorted({t.count(" ") + 1 for t in self.short})
        items = [(i, t) for i, t in items if len(t) >= q]
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.q = q
        self.budget = np.array([self.affordable(len(t), q, edits) for t in self.texts], np.int64)
        self.bound = np.array([len(t) - q + 1 - k * q for t, k in zip(self.texts, self.budget, strict=True)], np.int64)
        grams = [_grams(_codes(t), q) for t in self.texts]
        key = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.at = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64)
        bits = max(16, min(26, (4 * len(key) + 1).bit_length() + 3))
        self.shift = np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[(self.key >> self.shift).astype(np.int64)] = True

    @staticmethod
    def affordable(n: int, q: int, edits: float) -> int:
        """Edits for which the lemma still asks for one shared q-gram at least."""
        return max(0, min(int(edits * n), (n - q) // q))

    def words(self, texts: list[str]) -> Iterator[tuple[int, int | None, int, int, int]]:
        """(text, item's id, edits, start, end) of items shorter than a q-gram; they begin and end with words."""
        for t, text in enumerate(texts if self.short else []):
            begin = [0] + [m.end() for m in re.finditer(" ", text)]
            end = [b - 1 for b in begin[1:]] + [len(text)]
            for n in self.spans:
                for a, b in zip(begin, end[n - 1 :], strict=False):
                    for i in self.short.get(text[a:b], ()):
                        yield t, i, 0, a, b

    def regions(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of verified regions; texts are normal."""
        if not len(self.key):
            return
        size = np.array([len(t) + 1 for t in texts])
        begin = np.cumsum(size) - size
        gram = _grams(_codes("\0".join(texts)), self.q)
        at = np.flatnonzero(self.there[(gram >> self.shift).astype(np.int64)])
        low, high = np.searchsorted(self.key, gram[at]), np.searchsorted(self.key, gram[at], "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        if not len(at):
            return
        which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, diagonal = self.item[which], np.repeat(at, n) - self.at[which]
        text = np.searchsorted(begin, np.repeat(at, n), "right") - 1
        step = self.budget[item] + 1
        band = np.floor_divide(diagonal, step)
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        one = np.concatenate([band, band - 1])  # each hit counts in the two bands over its diagonal
        two, three = np.concatenate([item, item]), np.concatenate([text, text])
        order = np.lexsort((one, two, three))
        one, two, three = one[order], two[order], three[order]
        first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (three[1:] != three[:-1])]))
        count = np.diff(np.append(first, len(one)))
        for k in first[count >= self.bound[two[first]]].tolist():
            step = int(self.budget[two[k]]) + 1
            start = int(one[k]) * step - int(begin[three[k]])
            found.setdefault((int(three[k]), int(two[k])), []).append((start, start + 2 * step - 1))
        for (t, i), bands in found.items():
            taken = None
            for a, b in bands:
                if taken is not None and a < taken:  # inside a region already verified
                    continue
                if hit := alignment(self.texts[i], texts[t], a, b, int(self.budget[i])):
                    yield t, i, *hit
                    taken = hit[2]


def _found(docs: DataFrame, held: list[tuple[int | None, str]], q: int, edits: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(held, q, edits)
        for pdf in batches:
            ids, row = pdf["doc_id"].astype("Int64").array, pdf["h"].to_numpy()
            rows, chunk, size = [], [], 0
            for k, text in enumerate(pdf["text"]):
                chunk.append((k, normal(text)))
                size += len(text)
                if size > _CHUNK or k == len(pdf) - 1:
                    texts = [t for _, t in chunk]
                    rows += [(chunk[t][0], index.ids[i], len(index.texts[i]), e, a, b - a, len(texts[t])) for t, i, e, a, b in index.regions(texts)]
                    rows += [(chunk[t][0], i, b - a, e, a, b - a, len(texts[t])) for t, i, e, a, b in index.words(texts)]
                    chunk, size = [], 0
            if rows:
                k, item, chars, e, a, n, whole = zip(*rows, strict=True)
                k = list(k)
                yield pd.DataFrame({"doc_id": ids[k], "h": row[k], "item_id": pd.array(item, "Int64"), "item_chars": chars, "edits": e, "start": a, "length": n, "n_chars": whole})

    return docs.mapInPandas(frugal(run), "doc_id long, h long, item_id long, item_chars long, edits int, start long, length long, n_chars long")


def _keyed_regions(docs: DataFrame, items: DataFrame, q: int, edits: float, block: int) -> DataFrame:
    """regions() with item_chars and h, the xxhash64 of the document's text."""
    items = plain(items, item_id="long", text="string").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    docs = plain(docs, doc_id="long", text="string").where("text is not null and text <> ''").withColumn("h", F.xxhash64("text"))

    def held(n: int) -> list[tuple[int | None, str]]:
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n) if blocks > 1 else items
        found = {(r["item_id"], normal(r["text"])) for r in mine.toLocalIterator()}
        return sorted(((i, t) for i, t in found if t), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    if blocks == 1:
        return _found(docs, held(0), q, edits)
    return reduce(DataFrame.unionByName, [written(_found(docs, held(n), q, edits)) for n in range(blocks)])


def regions(docs: DataFrame, items: DataFrame, q: int = Q, edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, start, length, n_chars: where a document holds a benchmark item.

    docs: doc_id, text; items: item_id, text (other columns are ignored). start, length and n_chars
    count characters of the normalised text. Null and empty texts hold nothing, and null and empty items (no letter or digit)
    are held by none; repeated rows are found each; empty tables give no rows. Equal items come out with
    each of their ids, null too. A document may hold an item several times and then has a row for each.
    """
    return _keyed_regions(docs, items, q, edits, block).drop("h", "item_chars")


def clean(docs: DataFrame, items: DataFrame, q: int = Q, edits: float = EDITS, block: int = BLOCK, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs, all their columns, whose text holds no item of ``shortest`` normalised characters or more.

    Rows go by their own text, whatever their doc_id (null too): rows with an equal text go together, others
    with the same doc_id stay.
    """
    dirty = _keyed_regions(docs, items, q, edits, block).where(F.col("item_chars") >= shortest).select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["d"]) & (F.xxhash64(docs["text"].cast("string")) == dirty["g"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
