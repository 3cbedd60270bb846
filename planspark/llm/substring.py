"""Substring dedup by fixed-block anchors.

A repeat of 50 words holds one whole block of 25 words that starts at a multiple of 25 in the document
where it came first. So the non-overlapping blocks of every document are the index, every rolling
window of 25 words of every document probes it, and a probe that meets a block is an anchor. Anchors
are extended word by word to the windows of 50 around them; those whose words come in a document with
a smaller id are repeats, and runs of them are the maximal exact repeats that go.

Index and probes meet in buckets of the window key. They travel packed: a task sends each bucket one
row with the keys and places of a few megabytes of text. Buckets answer with places, never with pairs
of documents, so a passage in a million documents costs a million places. Bucket count grows with the
input, bucket size doesn't.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, plain, table
from .words import BASES, keys, mix, places, windows

WINDOW = 50
#: Bytes of text that are packed together.
CHUNK = 2_000_000
#: Windows a bucket holds, about.
BUCKET = 1_200_000
#: Bytes of the second key of a window; with the first and the bucket, over 85 bits tell windows apart.
FAR = 6
#: Least buckets, as a power of two.
LEAST_BITS = 7
PACKED = "bucket int, docs binary, counts binary, at binary, near binary, far binary"
#: Documents without an id come after all others.
LAST = (1 << 63) - 1


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: what is mostly zero then shrinks in the shuffle."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _whole(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _packed(doc: np.ndarray, at: np.ndarray, key: np.ndarray, far: np.ndarray | None, bits: int) -> dict[str, list]:
    """Rows of PACKED. doc and at ascend; key picks the bucket by its top bits and keeps the low 32."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, doc, at, near = bucket[order], doc[order], at[order].astype("<u4"), key[order].astype("<u4")
    far = None if far is None else far[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
    out: dict[str, list] = {"bucket": [], "docs": [], "counts": [], "at": [], "near": [], "far": []}
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        first = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
        out["bucket"].append(int(bucket[a]))
        out["docs"].append(_planes(doc[a:b][first].astype("<i8")))
        out["counts"].append(_planes(np.diff(np.append(first, b - a)).astype("<u4")))
        out["at"].append(_planes(np.diff(at[a:b], prepend=np.uint32(0))))
        out["near"].append(near[a:b].tobytes())
        out["far"].append(b"" if far is None else np.ascontiguousarray(far[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :FAR]).tobytes())
    return out


def _unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc = [np.repeat(_whole(d, "<i8"), _whole(c, "<u4")) for d, c in zip(pdf["docs"], pdf["counts"], strict=True)]
    at = [np.cumsum(_whole(x, "<u4"), dtype=np.uint32) for x in pdf["at"]]
    return np.concatenate(doc), np.concatenate(at), np.concatenate([np.frombuffer(x, "<u4") for x in pdf["near"]])


def _places_of(doc: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """One row a document with its places."""
    order = np.argsort(doc, kind="stable")
    doc, at = doc[order], at[order]
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, int)
    return pd.DataFrame({"doc": doc[cut[:-1]], "at": [at[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]})


def _chunks(ids: list[int], texts: list[str | None]) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """Documents' ids, their bytes joined by line feeds, and where each begins."""
    held, size = [], 0
    for doc, text in zip(ids, texts, strict=True):
        data = (text or "").encode("utf-8", "surrogatepass")
        held.append((doc, data))
        size += len(data) + 1
        if size > CHUNK:
            yield [d for d, _ in held], b"\n".join(x for _, x in held), np.cumsum([0] + [len(x) + 1 for _, x in held[:-1]])
            held, size = [], 0
    if held:
        yield [d for d, _ in held], b"\n".join(x for _, x in held), np.cumsum([0] + [len(x) + 1 for _, x in held[:-1]])


def _probes(bits: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, data, begin in _chunks(pdf["doc"].tolist(), pdf["text"].tolist()):
                start, end = places(data)
                first = np.searchsorted(start, begin)
                count = np.diff(np.append(first, len(start)))
                key = windows(keys(data, start, end), block)
                which = np.repeat(np.arange(len(ids)), count)
                at = np.arange(len(start)) - first[which]
                fits = np.flatnonzero(at + block <= count[which])
                if len(fits):
                    yield pd.DataFrame(_packed(np.array(ids, np.int64)[which[fits]], at[fits], key[fits], None, bits))

    return run


def _anchors(block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, at, key = _unpacked(pdf)
        order = np.argsort(key, kind="stable")
        doc, at, key = doc[order], at[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        met = np.logical_or.reduceat(at % block == 0, first) & (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first))
        keep = met[run_of]
        return _places_of(doc[keep], at[keep])

    return run


def _extend(bits: int, window: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, at, key, far, size = [], [], [], [], 0
            for d, text, found in zip(pdf["doc"].tolist(), pdf["text"], pdf["at"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                start, end = places(data)
                n = len(start) - window + 1
                if n < 1:
                    continue
                hit = np.concatenate([np.frombuffer(x, "<u4") for x in found]).astype(np.int64)
                near = np.zeros(len(start) + 1, np.int64)
                np.add.at(near, np.clip(hit - (window - block), 0, len(start)), 1)
                np.add.at(near, np.clip(hit + 1, 0, len(start)), -1)
                s = np.flatnonzero(np.cumsum(near)[:n] > 0)
                if not len(s):
                    continue
                words = keys(data, start, end)
                doc.append(np.full(len(s), d, np.int64))
                at.append(s)
                key.append(windows(words, window)[s])
                far.append(windows(mix(words + np.uint64(1)), window, BASES[0])[s])
                size += len(s)
                if size > 1_000_000:
                    yield pd.DataFrame(_packed(np.concatenate(doc), np.concatenate(at), np.concatenate(key), np.concatenate(far), bits))
                    doc, at, key, far, size = [], [], [], [], 0
            if size:
                yield pd.DataFrame(_packed(np.concatenate(doc), np.concatenate(at), np.concatenate(key), np.concatenate(far), bits))

    return run


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    doc, at, near = _unpacked(pdf)
    few = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, FAR) for x in pdf["far"]])
    far = np.pad(few, ((0, 0), (0, 8 - FAR))).view("<u8").ravel()
    order = np.lexsort((near, far))
    doc, at, near, far = doc[order], at[order], near[order], far[order]
    first = np.flatnonzero(np.concatenate([[True], (near[1:] != near[:-1]) | (far[1:] != far[:-1])]))
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
    keep = doc > least
    return _places_of(doc[keep], at[keep])


def _kept(window: int, texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, found in zip(pdf["text"], pdf["at"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                # bytes.split() cuts at the six white-space bytes and at no other
                keep = np.ones(len(words), bool)
                if found is not None and len(found):
                    at = np.concatenate([np.frombuffer(x, "<u4") for x in found]).astype(np.int64)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, np.clip(at, 0, len(words)), 1)
                    np.add.at(cover, np.clip(at + window, 0, len(words)), -1)
                    keep = np.cumsum(cover)[: len(words)] == 0
                    kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                else:
                    kept = b" ".join(words)
                out.append((len(words), int(len(words) - keep.sum()), kept))
            if not texts:
                out = [(*x[:2], hashlib.sha256(x[2]).hexdigest()) for x in out]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], "kept_sha256": [x[2] for x in out]})
                continue
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out],
                "kept_text": [x[2].decode("utf-8", "surrogatepass") for x in out], "kept_sha256": [hashlib.sha256(x[2]).hexdigest() for x in out],
            })

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (if texts), kept_sha256 of every document.

    docs: doc_id, text (other columns are ignored). A word goes if a window of ``window`` words over it
    also starts in a document with a smaller doc_id, in the texts as given. Null text has no words;
    rows that share a doc_id are one document for this (neither is smaller); null doc_ids come after
    all others; documents shorter than a window stay whole; an empty table gives no rows.
    """
    block = window // 2
    docs = plain(docs, doc_id="long", text="string").withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(30, max(LEAST_BITS, math.ceil(math.log2(max(1, size / 6 / BUCKET)))))
    answer = "doc long, at binary"
    anchors = docs.select("doc", "text").mapInPandas(frugal(_probes(bits, block)), PACKED).groupBy("bucket").applyInPandas(_anchors(block), answer)
    anchors = anchors.groupBy("doc").agg(F.collect_list("at").alias("at"))
    # both joins read docs with the same columns, so Spark shuffles the texts once
    near = docs.join(anchors, "doc").select("doc_id", "doc", "text", "at").mapInPandas(frugal(_extend(bits, window, block)), PACKED)
    covers = near.groupBy("bucket").applyInPandas(_repeats, answer).groupBy("doc").agg(F.collect_list("at").alias("at"))
    return docs.join(covers, "doc", "left").select("doc_id", "doc", "text", "at").mapInPandas(frugal(_kept(window, texts)), "doc_id long, n_words long, n_removed long, " + "kept_text string, " * texts + "kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False)
