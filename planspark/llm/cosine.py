"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label are one class. Classes are rotated to the principal axes of a bounded sample, put in
order of which side of the median they lie on along the leading axes, and cut in tiles of a label. Tiles whose
boxes along those axes, with the norms of what is left, allow the threshold are compared: the first few
dimensions of all products at once, then more dimensions only of those pairs that partial product plus the
product of the suffix norms can still carry to the threshold. What is left is decided by the cosine of the vectors
as given, in double precision. The rotation only orders the work: any basis gives the same links.

A comparison hands on, for each class, how many vectors it links with and one link towards the smallest class
that it hangs together with, never pairs. The vectors of a tile go to each tile they may link with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frugal, join_counted, table, written
from .components import components
from .simhash import stars

THRESHOLD = 0.93
#: Classes of a tile, about.
TILE = 2048
#: Vectors that the principal axes are fitted on at most, and bytes of them.
SAMPLE, SAMPLE_BYTES = 4096, 64_000_000
#: Leading axes that order the classes and bound the tiles.
AXES = 16
#: Pairs whose products are taken one by one at a time; beyond one pair in DENSE all products of two tiles are.
PAIRS, DENSE = 100_000, 12


def _vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label (null: links with nothing), vec (bytes of doubles, scaled by a power of two), digest of label and vector."""
    rows = vectors.select(F.col("`vec_id`").cast("string").alias("vec_id"), F.col("`label`").cast("string").alias("label"), F.col("`embedding`").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            labels, vecs, digests = [], [], []
            for label, given in zip(pdf["label"], pdf["embedding"], strict=True):
                v = np.zeros(0) if given is None else np.asarray(given, np.float64)
                if label is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    labels.append(None)
                    vecs.append(None)
                    digests.append(None)
                    continue
                data = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) + 0.0).tobytes()  # the cosine stays to the bit
                labels.append(label)
                vecs.append(data)
                digests.append(hashlib.sha256(label.encode("utf-8", "surrogatepass") + b"\0" + data).digest()[:16])
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": labels, "vec": vecs, "digest": digests}, dtype=object)

    out = rows.mapInPandas(frugal(run), "vec_id string, label string, vec binary, digest binary")
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))


def axes(found: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Basis (columns: principal axes), the leading axes by spread, and the medians along them, of a sample of the commonest length."""
    sizes = found.where("digest is not null").groupBy(F.octet_length("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return np.eye(1), np.zeros(1, int), np.zeros(1)
    size = sizes["size"]
    few = max(1, min(SAMPLE, SAMPLE_BYTES // size))
    sample = found.where(F.octet_length("vec") == size).orderBy(F.xxhash64("digest", "vec_id"), "vec_id").select("vec").limit(few)
    x = _unit(np.array([np.frombuffer(r.vec, "<f8") for r in sample.collect()]))
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    lead = (x @ basis)[:, :AXES]
    order = np.argsort(-lead.var(axis=0), kind="stable")
    return basis, order, np.median(lead, axis=0)[order]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rotated(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    u = _unit(x)
    return u @ basis if x.shape[1] == len(basis) else u


def _coded(basis: np.ndarray, order: np.ndarray, middle: np.ndarray):
    """Place of each class in the order of tiles, its leading coordinates and the norm of the rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            code, lead, rest = np.zeros(len(pdf), np.int32), np.zeros((len(pdf), AXES)), np.zeros(len(pdf))
            sizes = np.array([len(v) for v in pdf["vec"]], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                y = _rotated(np.frombuffer(b"".join(pdf["vec"].iloc[at]), "<f8").reshape(len(at), -1), basis)
                wide = min(AXES, y.shape[1])
                lead[at, :wide] = y[:, :wide]
                rest[at] = np.sqrt((y[:, wide:] ** 2).sum(axis=1))
                if y.shape[1] == len(basis):
                    sides = y[:, order] > middle
                    code[at] = sides @ (1 << np.arange(sides.shape[1])[::-1])
            yield pdf.assign(code=code, lead=list(lead.astype(np.float32)), rest=rest.astype(np.float32))

    return run


class _Tile:
    """Classes of a tile: the vectors as given, their norms, and in float32 rotated coordinates with suffix norms at each cut."""

    def __init__(self, rows: list[tuple], basis: np.ndarray) -> None:
        self.cid = np.array([r[0] for r in rows], np.int64)
        self.n = np.array([r[1] for r in rows], np.int64)
        self.x = np.frombuffer(b"".join(r[2] for r in rows), "<f8").reshape(len(rows), -1)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        y = _rotated(self.x, basis)
        d = y.shape[1]
        self.cuts = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), d})
        self.suffix = [np.sqrt((y[:, c:] ** 2).sum(axis=1)).astype(np.float32) for c in self.cuts]
        self.y = y.astype(np.float32)


def near(a: _Tile, b: _Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of all pairs with a cosine of threshold or more; of a tile with itself each pair once."""
    least = np.float32(threshold - 4e-6 * np.sqrt(a.x.shape[1]) - 1e-6)
    total = len(a.cid) * len(b.cid)
    held, before = None, 0
    i = j = np.zeros(0, np.int64)
    for k, cut in enumerate(a.cuts):
        if held is None or len(i) * DENSE > total:
            part = a.y[:, before:cut] @ b.y[:, before:cut].T
            held = part if held is None else held + part
            alive = held + a.suffix[k][:, None] * b.suffix[k] >= least
            if a is b:
                alive = np.triu(alive, 1)
            i, j = np.nonzero(alive)
            sums = held[i, j]
        else:
            held = False  # few are left: from here on pair by pair
            more = np.concatenate([(a.y[i[o : o + PAIRS], before:cut] * b.y[j[o : o + PAIRS], before:cut]).sum(axis=1) for o in range(0, len(i), PAIRS)] or [np.zeros(0, np.float32)])
            sums = sums + more
            keep = sums + a.suffix[k][i] * b.suffix[k][j] >= least
            i, j, sums = i[keep], j[keep], sums[keep]
        before = cut
        if not len(i):
            return i, j
    if len(i) * DENSE > total:
        cosine = (a.x @ b.x.T)[i, j] / (a.norm[i] * b.norm[j])
    else:
        cosine = np.concatenate([(a.x[i[o : o + PAIRS]] * b.x[j[o : o + PAIRS]]).sum(axis=1) for o in range(0, len(i), PAIRS)]) / (a.norm[i] * b.norm[j])
    keep = cosine >= threshold
    return i[keep], j[keep]


def _compared(basis: np.ndarray, threshold: float):
    """cid, links, hangs_on of classes that link, of rows sorted by home tile with its own rows first, then by guest tile."""

    def found(home: _Tile, guest: _Tile) -> pd.DataFrame | None:
        i, j = near(home, guest, threshold)
        if not len(i):
            return None
        same = home is guest
        node = home.cid if same else np.concatenate([home.cid, guest.cid])
        right = j if same else j + len(home.cid)
        weight = home.n if same else np.concatenate([home.n, guest.n])
        links = np.bincount(i, weight[right], len(node)) + np.bincount(right, weight[i], len(node))
        u, v = stars(i, right, node)
        hang = dict(zip(u.tolist(), v.tolist(), strict=True))
        at = np.flatnonzero(links)
        return pd.DataFrame({"cid": node[at], "links": links[at].astype(np.int64), "hangs_on": [hang.get(c, c) for c in node[at].tolist()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, home = None, [], None

        def closed() -> Iterator[pd.DataFrame]:
            nonlocal home
            if key is None:
                return
            grp, at, guest = key
            if guest == at:
                home = _Tile(rows, basis)
            out = found(home, home if guest == at else _Tile(rows, basis)) if len(rows) > 1 or guest != at else None
            if out is not None:
                yield out

        for pdf in batches:
            ends = pdf[["grp", "home", "guest"]]
            new = np.flatnonzero(np.concatenate([[True], (ends.to_numpy()[1:] != ends.to_numpy()[:-1]).any(axis=1)])) if len(pdf) else np.zeros(0, int)
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(pdf)], strict=True):
                now = tuple(ends.iloc[lo])
                if now != key:
                    yield from closed()
                    key, rows = now, []
                part = pdf.iloc[lo:hi]
                rows += zip(part["cid"], part["n"], part["vec"], strict=True)
        yield from closed()

    return run


def _tiles(coded: DataFrame, tile: int) -> DataFrame:
    """coded with the tile of each class: in order of code, every ``tile`` classes of a group are a tile."""
    codes = coded.groupBy("grp", "code").agg(F.count("*").alias("held"))
    # a group has 2**AXES codes at most
    codes = codes.withColumn("before", F.sum("held").over(Window.partitionBy("grp").orderBy("code")) - F.col("held"))
    codes = codes.select(F.struct("grp", "code").alias("key"), "held", F.col("held").alias("many"), "before")
    with_key = coded.withColumn("key", F.struct("grp", "code"))
    place = F.floor((F.col("before") + F.pmod(F.xxhash64("cid"), F.col("many"))) / tile)
    return join_counted(with_key, codes, "key", "held").withColumn("tile", place.cast("long")).drop("key", "before", "many", "code")


def _pairs(tiled: DataFrame, threshold: float) -> DataFrame:
    """grp, home, guest of tiles that may hold a link, each with itself too: by their boxes along the leading axes and the norms of the rest."""
    edge = [f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(AXES) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = written(tiled.groupBy("grp", "tile").agg(*edge, F.max("rest").alias("rest")))
    a, b = (boxes.select("grp", *[F.col(c).alias(f"{side}_{c}") for c in boxes.columns if c != "grp"]) for side in "ab")
    most = F.col("a_rest") * F.col("b_rest")
    for k in range(AXES):
        most = most + F.greatest(*[F.col(f"a_{x}{k}").cast("double") * F.col(f"b_{y}{k}") for x in ("lo", "hi") for y in ("lo", "hi")])
    met = a.join(b, "grp").where((F.col("a_tile") < F.col("b_tile")) & (most >= threshold - 1e-5))
    even = (F.col("a_tile") + F.col("b_tile")) % 2 == 0
    apart = met.select("grp", F.when(even, F.col("a_tile")).otherwise(F.col("b_tile")).alias("home"), F.when(even, F.col("b_tile")).otherwise(F.col("a_tile")).alias("guest"))
    return apart.unionByName(boxes.select("grp", F.col("tile").alias("home"), F.col("tile").alias("guest")))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    vectors: vec_id, embedding (array of numbers), label (other columns are ignored). Rows of equal, non-null label and
    length link if the cosine of their embeddings is ``threshold`` or more in double precision; n_links counts the other
    rows a row links with, component_id is the smallest vec_id reachable (its own if it links with none), kept says that
    the two are the same. Embeddings that are null, empty, zero, or hold null or non-finite numbers link with
    nothing. Repeated rows are vectors of their own and link like any others, with one vec_id or many; a null vec_id links but is
    no component_id unless alone, and isn't kept. An empty table gives no rows.
    """
    found = _vectors(vectors)
    basis, order, middle = axes(found)
    classes = found.where("digest is not null").groupBy("digest").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "digest", F.concat(F.octet_length("vec").cast("string"), F.lit(":"), "label").alias("grp"), "vec", F.col("least").cast("string"), "n")
    shape = "cid long, digest binary, grp string, vec binary, least string, n long, code int, lead array<float>, rest float"
    coded = written(classes.mapInPandas(frugal(_coded(basis, order, middle)), shape).withColumn("least", F.col("least").cast("long")))
    tiled = written(_tiles(coded, tile).select("cid", "grp", "tile", "n", "vec", "lead", "rest"))
    sent = tiled.select("cid", "n", "vec", "grp", F.col("tile").alias("guest")).join(_pairs(tiled, threshold), ["grp", "guest"])
    sent = sent.repartition("grp", "home").sortWithinPartitions("grp", "home", F.col("guest") != F.col("home"), "guest").select("grp", "home", "guest", "cid", "n", "vec")
    met = written(sent.mapInPandas(frugal(_compared(basis, threshold)), "cid long, links long, hangs_on long"))
    reach = components(met.select(F.col("cid").alias("u"), F.col("hangs_on").alias("v")))
    links = met.groupBy("cid").agg(F.sum("links").alias("links"))
    known = coded.select("cid", "digest", "least", "n").join(links, "cid", "left").join(reach.withColumnRenamed("node", "cid"), "cid", "left")
    known = written(known.select("digest", "least", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    of = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    known = join_counted(known.drop("least"), of, "component", "nodes").select("digest", "n", "n_links", "component_id")
    linked = join_counted(found.where("digest is not null").select("vec_id", "digest"), known, "digest", "n").select("vec_id", "n_links", "component_id")
    alone = found.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE given AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), fit AS (
  SELECT * FROM given WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM fit a JOIN fit b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM given
  UNION
  SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w
)
SELECT g.vec_id, (SELECT count(*) FROM links l WHERE l.u = g.vec_id) AS n_links, min(r.w) AS component_id, min(r.w) = g.vec_id AS kept
FROM given g JOIN reach r ON r.u = g.vec_id GROUP BY g.vec_id
"""
