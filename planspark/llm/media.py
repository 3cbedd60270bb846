"""Media columns: ISO base media files, walked box by box without decoding payloads.

``facts`` walks the nested boxes of a file, decodes the sample tables of each track (or its movie
fragments) and gives codec, duration and the byte ranges of the keyframes; sample bytes are never read.
``container`` writes the smallest such file that holds bytes losslessly as 8-bit samples, for tests and
for payloads that should travel as media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, plain, table

#: Fixed names: boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf", b"dinf"}
UNIT = 64
RATE = 8000


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes in data[start:end]; a box that runs over its parent ends with it."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind, head = int.from_bytes(data[start : start + 4]), bytes(data[start + 4 : start + 8]), 8
        if size == 1 and start + 16 <= end:
            size, head = int.from_bytes(data[start + 8 : start + 16]), 16
        elif size == 0:
            size = end - start
        if size < head:
            return
        yield kind, start + head, min(end, start + size)
        start += size


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes with their paths, depth first."""
    for kind, a, b in boxes(data, start, end):
        yield (*path, kind), a, b
        if kind in NESTED:
            yield from walk(data, a, b, (*path, kind))


def _table(data: memoryview, a: int, b: int, width: int, skip: int = 8) -> np.ndarray:
    """Big-endian 32-bit rows after version, flags and count; no more than the box holds."""
    if b - a < skip:
        return np.zeros((0, width), np.int64)
    n = min(int.from_bytes(data[a + skip - 4 : a + skip]), (b - a - skip) // (4 * width))
    return np.frombuffer(data[a + skip : a + skip + 4 * width * n], ">u4").astype(np.int64).reshape(n, width)


def _length(data: memoryview, a: int) -> tuple[int, int]:
    """(time scale, duration) of an mvhd or mdhd box."""
    if data[a] == 1:
        return int.from_bytes(data[a + 20 : a + 24]), int.from_bytes(data[a + 24 : a + 32])
    return int.from_bytes(data[a + 12 : a + 16]), int.from_bytes(data[a + 16 : a + 20])


def _sizes(data: memoryview, a: int, b: int, kind: bytes) -> np.ndarray:
    """Sample sizes; of one fixed size there are no more than the file has room for, whatever the count says."""
    count = int.from_bytes(data[a + 8 : a + 12])
    if kind == b"stsz":
        fixed = int.from_bytes(data[a + 4 : a + 8])
        if fixed:
            return np.full(min(count, len(data) // fixed), fixed, np.int64)
        return np.frombuffer(data[a + 12 : a + 12 + 4 * min(count, (b - a - 12) // 4)], ">u4").astype(np.int64)
    bits = data[a + 7]  # stz2: 4, 8 or 16 bits a size
    raw = np.frombuffer(data[a + 12 : b], np.uint8)
    if bits == 4:
        return np.stack([raw >> 4, raw & 15], 1).ravel()[:count].astype(np.int64)
    return raw[: 2 * (len(raw) // 2)].view(">u2")[:count].astype(np.int64) if bits == 16 else raw[:count].astype(np.int64)


def _places(sizes: np.ndarray, chunks: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Byte offset of each sample from chunk offsets and the sample-to-chunk rows."""
    if not len(chunks) or not len(per):
        return np.zeros(0, np.int64)
    until = np.append(per[1:, 0] - 1, len(chunks))
    turns = np.maximum(0, np.minimum(until, len(chunks)) - (per[:, 0] - 1))
    turns = np.diff(np.minimum(np.cumsum(turns), len(chunks)), prepend=0)
    in_chunk = np.repeat(np.minimum(per[:, 1], len(sizes)), turns)
    in_chunk = np.diff(np.minimum(np.cumsum(in_chunk), len(sizes)), prepend=0)  # chunks hold the samples there are
    first = np.cumsum(in_chunk) - in_chunk
    n = min(len(sizes), int(in_chunk.sum()))
    chunk_of = np.repeat(np.arange(len(in_chunk)), in_chunk)[:n]
    before = np.cumsum(sizes[:n]) - sizes[:n]
    return chunks[chunk_of] + before - before[np.minimum(first, max(0, n - 1))[chunk_of]]


def _fields(data: memoryview, a: int, names: list[tuple[int, int]], flags: int) -> tuple[dict[int, int], int]:
    """The optional fields (flag, bytes) that flags say are there, from a on, and where they end."""
    out = {}
    for flag, width in names:
        if flags & flag:
            out[flag], a = int.from_bytes(data[a : a + width]), a + width
    return out, a


def _run(data: memoryview, a: int, b: int, part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, size, is a keyframe) of the samples of a trun box; part holds what its traf says, and gets where the run ends."""
    flags, n = int.from_bytes(data[a + 1 : a + 4]), int.from_bytes(data[a + 4 : a + 8])
    head, at = _fields(data, a + 8, [(1, 4), (4, 4)], flags)
    columns = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    if columns:
        n = min(n, max(0, b - at) // (4 * len(columns)))
    else:  # no more samples than the file has bytes for
        n = min(n, len(data) // max(1, part["size"]))
    rows = np.frombuffer(data[at : at + 4 * len(columns) * n], ">u4").astype(np.int64).reshape(n, len(columns))
    size = rows[:, columns.index(0x200)] if 0x200 in columns else np.full(n, part["size"], np.int64)
    mark = rows[:, columns.index(0x400)] if 0x400 in columns else np.full(n, part["flags"], np.int64)
    if n and 4 in head:
        mark = np.concatenate([[head[4]], mark[1:]])
    begin = part["base"] + (head[1] - (1 << 32) * (head[1] >> 31)) if 1 in head else part["next"]
    offset = begin + np.cumsum(size) - size
    part["next"] = int(begin + size.sum())
    return offset, size, (mark & 0x10000) == 0


def facts(data: bytes | None) -> dict:
    """codec, duration_s, samples, keyframes [(offset, length)], media [(offset, length)] over all tracks.

    Damaged, cut or empty data give what can be read: null codec and duration, no ranges. No table is
    taken to be longer than the file has bytes for, whatever its count says.
    """
    view = memoryview(data or b"")
    out = {"codec": [], "duration_s": None, "samples": 0, "keyframes": [], "media": []}
    tracks: list[dict] = []
    usual: dict[int, tuple[int, int]] = {}  # track -> size and flags of its samples where a fragment says none
    moof, after, part = 0, 0, {}

    def take(offset: np.ndarray, size: np.ndarray, key: np.ndarray) -> None:
        out["samples"] += len(offset)
        out["media"] += zip(offset.tolist(), size.tolist(), strict=True)
        out["keyframes"] += zip(offset[key].tolist(), size[key].tolist(), strict=True)

    try:
        for path, a, b in walk(view):
            kind = path[-1]
            if kind == b"moof":
                moof = after = a - 8
                part = {}
            elif kind == b"trak":
                tracks.append({})
            elif kind == b"mvhd":
                scale, length = _length(view, a)
                out["duration_s"] = length / scale if scale else None
            elif kind == b"trex":
                track, _, _, size, flags = (int.from_bytes(view[a + 4 + 4 * k : a + 8 + 4 * k]) for k in range(5))
                usual[track] = size, flags
            elif kind == b"tfhd":
                flags, track = int.from_bytes(view[a + 1 : a + 4]), int.from_bytes(view[a + 4 : a + 8])
                said, _ = _fields(view, a + 8, [(1, 8), (2, 4), (8, 4), (16, 4), (32, 4)], flags)
                after = part.get("next", after)
                base = said.get(1, moof if flags & 0x20000 else after)
                size, mark = usual.get(track, (0, 0))
                part = {"base": base, "next": base, "size": said.get(16, size), "flags": said.get(32, mark)}
            elif kind == b"trun" and part:
                take(*_run(view, a, b, part))
            elif tracks:
                t = tracks[-1]
                if kind == b"stsd" and b - a >= 16:
                    out["codec"].append(bytes(view[a + 12 : a + 16]).decode("latin-1"))
                elif kind in (b"stsz", b"stz2"):
                    t["size"] = _sizes(view, a, b, kind)
                elif kind == b"stco":
                    t["chunk"] = _table(view, a, b, 1).ravel()
                elif kind == b"co64":
                    wide = _table(view, a, b, 2)
                    t["chunk"] = (wide[:, 0] << 32) + wide[:, 1]
                elif kind == b"stsc":
                    t["per"] = _table(view, a, b, 3)
                elif kind == b"stss":
                    t["sync"] = _table(view, a, b, 1).ravel() - 1
                elif kind == b"stts":
                    t["time"] = _table(view, a, b, 2)
                elif kind == b"mdhd":
                    t["scale"] = _length(view, a)[0]
        none = np.zeros(0, np.int64)
        for t in tracks:
            sizes = t.get("size", none)
            at = _places(sizes, t.get("chunk", none), t.get("per", np.zeros((0, 3), np.int64)))
            key = np.ones(len(at), bool)
            if "sync" in t:
                key[:] = False
                key[t["sync"][(t["sync"] >= 0) & (t["sync"] < len(at))]] = True
            take(at, sizes[: len(at)], key)
            if out["duration_s"] is None and t.get("scale") and "time" in t:
                out["duration_s"] = float((t["time"][:, 0] * t["time"][:, 1]).sum()) / t["scale"]
    except (IndexError, ValueError, RecursionError, OverflowError, MemoryError):
        pass
    return out | {"codec": ",".join(out["codec"]) or None}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


def container(payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """payload (a multiple of unit) as one track of raw 8-bit sound; every sample is unit bytes and every 16th a keyframe."""
    n = len(payload) // unit
    ftyp = _box(b"ftyp", b"isom", bytes(4), b"isomiso2")
    wide = len(payload) + 8 >= 1 << 32
    mdat = _box(b"mdat", payload)
    sync = np.arange(1, n + 1, 16).astype(">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16))
    stbl = _box(
        b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, unit)), _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), _full(b"stsz", struct.pack(">II", unit, n)), _full(b"co64", struct.pack(">IQ", 1, len(ftyp) + (16 if wide else 8))),
    )
    units = len(payload)
    mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, min(units, 0xFFFFFFFF), 0x55C4, 0))
    hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(13))
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1")))
    minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
    tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, min(units, 0xFFFFFFFF)), bytes(60))
    mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, rate, min(units, 0xFFFFFFFF)), struct.pack(">IH", 0x10000, 0x100), bytes(70), struct.pack(">I", 2))
    return ftyp + mdat + _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))


def sample_bytes(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The stored bytes of sample ranges; neighbours are read at once."""
    if not ranges:
        return b""
    at, size = np.array(ranges, np.int64).T
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + size[:-1]]))
    last = np.append(new[1:], len(at)) - 1
    return b"".join(data[a:b] for a, b in zip(at[new].tolist(), (at[last] + size[last]).tolist(), strict=True))


def scan(media: DataFrame, id_column: str = "id", column: str = "media") -> DataFrame:
    """id, codec, duration_s, samples, keyframes array<struct<offset, length>>, bytes of a column of files.

    Null, empty or damaged files give null codec and duration and no keyframes; rows are independent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [facts(x) for x in pdf["media"]]
            yield pd.DataFrame({
                "id": pdf["id"].astype("Int64"), "codec": [g["codec"] for g in got], "duration_s": pd.array([g["duration_s"] for g in got], "Float64"), "samples": [g["samples"] for g in got],
                "keyframes": [[{"offset": a, "length": n} for a, n in g["keyframes"]] for g in got], "bytes": [len(x) if x is not None else 0 for x in pdf["media"]],
            })

    rows = media.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").cast("binary").alias("media"))
    return rows.mapInPandas(frugal(run), "id long, codec string, duration_s double, samples long, keyframes array<struct<offset:long,length:long>>, bytes long")


def stored(docs: DataFrame) -> DataFrame:
    """Each text stored as a media file, walked and read back; see query for the columns.

    docs: doc_id, text (other columns are ignored). Null text is empty and is stored as 64 zero bytes;
    repeated rows come each; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = container(raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)))
                seen = facts(media)
                back = sample_bytes(media, seen["media"])
                keys = seen["keyframes"]
                ranges = zlib.crc32(np.array(keys, "<i8").tobytes())
                feature = f"codec={seen['codec']};seconds={seen['duration_s']:.6f};samples={seen['samples']};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]};ranges={ranges:08x}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).assign(doc_id=pdf["doc_id"].astype("Int64").array)

    docs = plain(docs, doc_id="long", text="string")
    return docs.mapInPandas(frugal(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
