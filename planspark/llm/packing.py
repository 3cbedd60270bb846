"""Mixture-controlled packing: deficit round-robin over source queues.

Every window takes from each source queue its share of the target mixture. A share is seldom a whole
number of tokens; what a queue is owed stays its deficit and is paid in a later window. The credit of
queue s after T tokens in all has the closed form ``T*cum(s) // total - T*cum(s-1) // total``, where cum(s) is
the running sum of the queues' tokens, so no queue is ever a whole token behind or ahead, every window
but the last is full, and any partition finds the windows of its documents from nothing but their places in the
queues: deficits carry across windows and partitions without a sequential pass.

Without targets the mixture is the corpus's own and all queues end together. With targets, a queue
that runs dry leaves the round and the others go on in their proportions (a new phase, which begins a
window). Sources without a target and under two tokens a window share a queue, so there are at most
half as many queues as tokens in a window, and those with targets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, plain, table, written
from .tokens import WORD_BPE, encoder

WINDOW = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def encode_documents(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, n (ids with the end id), ids (their bytes). Null text: the end id alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for pdf in batches:
            ids = [x + end for x in enc.many(pdf["text"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n": [len(x) // len(end) for x in ids], "ids": ids})

    docs = plain(docs, doc_id="long", source="string", text="string")
    return docs.mapInPandas(frugal(run), "doc_id long, source string, n long, ids binary")


def phases(totals: list[int], shares: list[Fraction], window: int = WINDOW) -> list[tuple[int, int, list[int], list[int]]]:
    """(first window, windows, tokens served before, running sums of the tokens served here) of each phase."""
    left, done, first, out = list(totals), [0] * len(totals), 0, []
    while any(left):
        live = [s if n and s else Fraction(0) for s, n in zip(shares, left, strict=True)]
        if not any(live):  # targets name none of what is left: its own proportions
            live = [Fraction(n) for n in left]
        turn = min(Fraction(n) / s for n, s in zip(left, live, strict=True) if s)
        take = [min(n, int(turn * s)) for n, s in zip(left, live, strict=True)]
        if not any(take):
            take = [n if s else 0 for n, s in zip(left, live, strict=True)]
        # what stays of a queue that would fill less than a token a window goes along now
        take = [n if n - t < max(1, sum(take) // (window * window)) else t for n, t in zip(left, take, strict=True)]
        windows = -(-sum(take) // window)
        out.append((first, windows, list(done), [0, *accumulate(take)]))
        left = [n - t for n, t in zip(left, take, strict=True)]
        done = [d + t for d, t in zip(done, take, strict=True)]
        first += windows
    return out


def _credit(r: np.ndarray, cum: int, total: int, window: int) -> np.ndarray:
    """Tokens of the first cum ones of total that are served in r full windows (all of them in the last), without overflow."""
    if total * total < window << 62:
        part = r * (window * cum // total) + r * (window * cum % total) // total
    else:
        part = np.array([int(x) * window * cum // total for x in r.tolist()], np.int64)
    return np.where(r * window >= total, cum, part)


def cuts(queue: int, at: int, n: int, plan: list, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, sequence, offset) of the pieces of ids at..at+n of a queue."""
    for first, windows, done, cum in plan:
        low, mine, total = done[queue], cum[queue + 1] - cum[queue], cum[-1]
        a, b = max(at, low) - low, min(at + n, low + mine) - low
        if a >= b:
            continue
        slack = 2 + total // (window * mine)  # a queue is up to a token off its share
        r = np.arange(max(0, a * total // (window * mine) - slack), min(windows, b * total // (window * mine) + slack) + 1)
        under, over = _credit(r, cum[queue], total, window), _credit(r, cum[queue + 1], total, window)
        served = over - under
        begin, end = np.maximum(served[:-1], a), np.minimum(served[1:], b)
        keep = np.flatnonzero(begin < end)
        yield begin[keep] + low - at, (end - begin)[keep], first + r[:-1][keep], (under[1:] - under[:-1] + begin - served[:-1])[keep]


def pack(docs: DataFrame, window: int = WINDOW, targets: dict[str, float] | None = None, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``window`` tokens.

    docs: doc_id, text, source (other columns are ignored). targets: source -> weight, however small the source; a
    source it doesn't name comes after those named. Returns one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, source.

    Null text is the empty text (one end id); null sources form a queue of their own; repeated rows
    are packed as often as they come; documents of any length are cut where windows end; an empty
    table gives no rows. Rows with null doc_id are packed too and keep it.
    """
    spark = docs.sparkSession
    encoded = written(encode_documents(docs, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()))
    sizes = encoded.select("row", F.shiftright("row", 33).alias("part"), F.coalesce("source", F.lit("\0")).alias("source"), "n")
    by_source = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    named = [x for x in targets or {} if x is not None]
    # at most window / 2 rows, and those with targets
    large = sorted(by_source.filter((F.col("n") * window >= total * 2) | F.col("source").isin(named)).collect(), key=lambda x: x["source"])
    names, counts = [x["source"] for x in large], [x["n"] for x in large]
    open_ = [i for i, x in enumerate(names) if x not in named]
    pool = max(open_, key=counts.__getitem__, default=len(names))  # the queue of all small sources without a target
    if pool == len(names) and total > sum(counts):
        names.append(None)
        counts.append(0)
    if total > sum(counts):
        counts[pool] += total - sum(counts)
    shares = [Fraction(targets.get(s, 0)).limit_denominator(10**6) if targets else Fraction(n) for s, n in zip(names, counts, strict=True)]
    plan = phases(counts, shares, window)

    queue = F.coalesce(F.create_map(*[F.lit(x) for i, s in enumerate(names) if s is not None for x in (s, i)])[F.col("source")], F.lit(pool)) if any(x is not None for x in names) else F.lit(0)
    queued = sizes.select("row", "part", "n", queue.cast("int").alias("queue"))
    bases = queued.groupBy("queue", "part").agg(F.sum("n").alias("held"))
    bases = bases.select("queue", "part", (F.sum("held").over(Window.partitionBy("queue").orderBy("part")) - F.col("held")).alias("base"))
    within = Window.partitionBy("queue", "part").orderBy("row")
    placed = queued.withColumn("before", F.sum("n").over(within) - F.col("n")).join(bases, ["queue", "part"])
    placed = placed.select("row", "queue", (F.col("base") + F.col("before")).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dtype = encoder(tokenizer).dtype
        for pdf in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for k, (q, at, n, ids) in enumerate(zip(pdf["queue"].tolist(), pdf["at"].tolist(), pdf["n"].tolist(), pdf["ids"], strict=True)):
                wide = memoryview(np.frombuffer(ids, dtype).astype("<u4").tobytes())
                for start, length, sequence, offset in cuts(q, at, n, plan, window):
                    s, m = start.tolist(), length.tolist()
                    rows[0] += [k] * len(s)
                    rows[1] += s
                    rows[2] += m
                    rows[3] += [zlib.crc32(wide[4 * i : 4 * (i + j)]) for i, j in zip(s, m, strict=True)]
                    rows[4] += sequence.tolist()
                    rows[5] += offset.tolist()
            k = np.array(rows[0], np.int64)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64").array[k], "start": rows[1], "length": rows[2], "ids_crc32": rows[3],
                "doc_tokens": pdf["n"].to_numpy()[k], "sequence_id": rows[4], "offset": rows[5], "source": pdf["source"].to_numpy(object)[k],
            })

    return encoded.select("row", "doc_id", "source", "n", "ids").join(placed, "row").mapInPandas(frugal(run), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
