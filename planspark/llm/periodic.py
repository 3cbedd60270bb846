"""Periodic runs of words by the branching-tandem test over an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word extends. Its last square,
the suffixes i and i + q with i = end - 2q, has a longest common prefix of exactly q words: a branching
tandem repeat. So suffixes of a document are ranked by prefix doubling, and every LCP interval (a border
k of the suffix array with the stretch around it in which no common prefix is shorter) is split at k; of
the smaller child each suffix i asks the inverse suffix array whether i + depth or i - depth stands in the
other child. Squares found are rotated left as far as words agree and merged into runs. No tree is built:
intervals are two arrays, and all documents of a batch are worked on at once.

A document is one task's work, as its suffixes are; its memory is about 100 bytes a word. There is no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, plain, table
from .words import keys, places, windows

#: A run has at least this many words, and this many periods.
WORDS, TIMES = 24, 3
#: Words of documents that are ranked together, and pairs of suffix and interval that are tested together.
BATCH, TESTED = 400_000, 4_000_000


def ranks(word: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """For each level L the rank of every suffix by its first 2**L words, within its document (equal rank: equal words).

    word and doc are small non-negative numbers and doc ascends. The last level has no two equal ranks.
    """
    n = len(word)
    key = doc.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    end = np.searchsorted(doc, doc, side="right")
    order = np.argsort(key, kind="stable")
    level = _numbered(order, key[order], np.zeros(n, np.int64))
    out = [level]
    alive = _shared(order, level)
    step = 1
    while len(alive):
        # only suffixes that still share their rank are sorted on: by their rank, then by that of what follows
        after = alive + step
        follow = np.where(after < end[alive], level[np.minimum(after, n - 1)] + 1, 0)
        mixed = level[alive] * (n + 1) + follow
        order = np.argsort(mixed, kind="stable")
        moved = _numbered(alive[order], mixed[order], level[alive[order]], level)
        alive = _shared(alive[order], moved)
        level, step = moved, step * 2
        out.append(level)
    return out


def _numbered(at: np.ndarray, key: np.ndarray, base: np.ndarray, had: np.ndarray | None = None) -> np.ndarray:
    """Ranks of suffixes ``at`` in order of key: the first place of their key within the stretch that starts at base."""
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    stretch = np.concatenate([[True], base[1:] != base[:-1]])
    place = np.arange(len(at))
    rank = base + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(stretch, place, 0))
    out = np.empty(len(at), np.int64) if had is None else had.copy()
    out[at] = rank
    return out


def _shared(order: np.ndarray, level: np.ndarray) -> np.ndarray:
    rank = level[order]
    same = rank[1:] == rank[:-1]
    return order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order


def common(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that suffixes left and right (left before right, in one document that ends at end) have in common."""
    total = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        x, y = left + total, right + total
        fits = np.maximum(x, y) < end
        same = fits.copy()
        same[fits] = levels[k][x[fits]] == levels[k][y[fits]]
        total += same.astype(np.int64) << k
    return total


def common_before(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Words before left and before right (left first) that agree, within the document that starts at begin."""
    total = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        x, y = left - total - (1 << k), right - total - (1 << k)
        fits = x >= begin
        same = fits.copy()
        same[fits] = levels[k][x[fits]] == levels[k][y[fits]]
        total += same.astype(np.int64) << k
    return total


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each border k the first and last rank of the stretch around it where no LCP is smaller than lcp[k].

    Of equal LCPs side by side the first is the parent, so each pair of suffixes is parted at one border only.
    """
    n = len(lcp)
    least = [lcp]
    while 2 << (len(least) - 1) <= n:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    at = np.arange(n)
    first, last = at.copy(), at.copy()  # borders first+1 .. k-1 are > lcp[k]; borders k+1 .. last are >= lcp[k]
    for k in range(len(least) - 1, -1, -1):
        low = first - (1 << k)
        fits = low >= 0
        go = fits.copy()
        go[fits] = least[k][low[fits]] > lcp[fits]
        first -= go.astype(np.int64) << k
        fits = last + (1 << k) < n
        go = fits.copy()
        go[fits] = least[k][last[fits] + 1] >= lcp[fits]
        last += go.astype(np.int64) << k
    return first - 1, last


def squares(levels: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """i and q of every branching tandem repeat: suffixes i and i + q of one document with exactly q words in common."""
    n = len(doc)
    rank = levels[-1]
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    end = np.searchsorted(doc, doc, side="right")
    lcp = np.zeros(n, np.int64)
    if n > 1:
        together = doc[order[1:]] == doc[order[:-1]]
        a, b = order[:-1][together], order[1:][together]
        lcp[1:][together] = common(levels, a, b, end[a])
    first, last = intervals(lcp)
    border = np.flatnonzero(lcp > 0)
    depth, first, last = lcp[border], first[border], last[border]
    left, right = border - first, last - border + 1
    small_left = left <= right
    begin, size = np.where(small_left, first, border), np.minimum(left, right)
    other, width = np.where(small_left, border, first), np.maximum(left, right)
    found_i, found_q = [], []
    cut = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + TESTED, TESTED), side="right")
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        hi = min(hi, len(size))
        if lo >= hi:
            continue
        s = size[lo:hi]
        who = np.repeat(np.arange(lo, hi), s)
        member = order[begin[who] + np.arange(len(who)) - np.repeat(np.cumsum(s) - s, s)]
        for sign in (1, -1):
            there = member + sign * depth[who]
            ok = np.flatnonzero((there >= 0) & (there < n))
            at = rank[there[ok]] - other[who[ok]]
            ok = ok[(at >= 0) & (at < width[who[ok]])]
            found_i.append(np.minimum(member[ok], there[ok]))
            found_q.append(depth[who[ok]])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_q)


def runs(word: np.ndarray, doc: np.ndarray, words: int = WORDS, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (in the whole array), length and smallest period of every run, by document, start and period."""
    if not len(word):
        return (np.zeros(0, np.int64),) * 3
    levels = ranks(word, doc)
    i, q = squares(levels, doc)
    begin = np.searchsorted(doc, doc[i], side="left") if len(i) else i
    start = i - common_before(levels, i, i + q, begin)
    length = i + 2 * q - start
    keep = length >= np.maximum(words, times * q)
    start, length, q = start[keep], length[keep], q[keep]
    # a run is found at multiples of its period too: of one stretch the smallest period counts
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(start) else np.zeros(0, bool)
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _found(texts: list[str | None], words: int, times: int) -> list[tuple[int, list[dict], str]]:
    """Words, runs and what is left without repeats, of each text."""
    datas = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(datas)
    begin = np.cumsum([0] + [len(x) + 1 for x in datas[:-1]]) if datas else np.zeros(0, np.int64)
    start, end = places(data)
    first = np.searchsorted(start, begin)
    count = np.diff(np.append(first, len(start)))
    doc = np.repeat(np.arange(len(texts)), count)
    word = keys(data, start, end)
    # a run holds one window of least words twice, a period apart: documents without such a window have none
    span = min(words - words // times, (words // times + 1) * (times - 1))
    at = np.flatnonzero(np.arange(len(doc)) + span <= (first + count)[doc]) if len(doc) else np.zeros(0, np.int64)
    held = np.zeros(len(texts), bool)
    if len(at):
        key = windows(word, span)[at]
        order = np.lexsort((key, doc[at]))
        twice = (key[order][1:] == key[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        held[doc[at][order][1:][twice]] = True
    chosen = np.flatnonzero(held[doc])
    number = np.unique(word[chosen], return_inverse=True)[1]
    run_start, run_length, run_period = runs(number, doc[chosen], words, times)
    where = chosen[run_start]
    whose = doc[where]
    out = []
    for k in range(len(texts)):
        n, a = int(count[k]), int(first[k])
        lo, hi = np.searchsorted(whose, [k, k + 1])
        mine = [{"start": int(s) - a, "length": int(m), "period": int(q)} for s, m, q in zip(where[lo:hi], run_length[lo:hi], run_period[lo:hi], strict=True)]
        parts = datas[k].split()  # bytes.split() cuts at the six white-space bytes and at no other
        if mine:
            keep = np.ones(n, bool)
            for r in mine:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
            parts = [w for w, kept in zip(parts, keep.tolist(), strict=True) if kept]
        out.append((n, mine, b" ".join(parts).decode("utf-8", "surrogatepass")))
    return out


def periodic_runs(docs: DataFrame, words: int = WORDS, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row of docs.

    docs: doc_id, text (other columns are ignored). Words are ``[^\\x20\\x09-\\x0D]+``. A run has ``words`` words
    and ``times`` periods at least. collapsed is the words outside runs' repeats (all but a run's first period),
    joined by one space. Null, empty and blank texts have no words and no runs; texts of any length are read whole;
    rows that share a doc_id, and null doc_ids, are documents of their own; runs that overlap all count, and of
    periods that fit one stretch the smallest; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = np.cumsum([len(t or "") // 6 for t in pdf["text"]])
            for _, part in pdf.groupby(size // BATCH, sort=False):
                found = _found(part["text"].tolist(), words, times)
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_words": [x[0] for x in found], "runs": [x[1] for x in found], "collapsed": [x[2] for x in found]})

    # ids travel as text: numbers beside nulls would become floating
    found = plain(docs, doc_id="string", text="string").mapInPandas(frugal(run), "doc_id string, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def damaged(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row, the text of one document in ten made periodic from some word on, by crc32(doc_id).

    The crc32 of a null doc_id is taken as that of the empty string, 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for k, doc in enumerate(pdf["doc_id"]):
                h = zlib.crc32((doc or "").encode())
                if h % 10 or not texts[k]:
                    continue
                words = texts[k].encode("utf-8", "surrogatepass").split()
                n, g = len(words), h // 10
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode("utf-8", "surrogatepass")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pd.Series(texts, dtype=object)})

    found = plain(docs, doc_id="string", text="string").mapInPandas(run, "doc_id string, text string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def strongest(found: Column) -> Column:
    """The run with the greatest exact length / period of an array of runs; ties: smallest start, then period. Null if none."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (y > x) | ((x == y) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"]))), b).otherwise(a)

    return F.reduce(found, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def rows_of(found: DataFrame) -> DataFrame:
    """The strongest run, the digests of all runs and of what is left, of what periodic_runs gives."""
    found = found.withColumn("best", strongest("runs"))
    line = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(periodic_runs(damaged(table(spark, sf_dir, "documents"))))
