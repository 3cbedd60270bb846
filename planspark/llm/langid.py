"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it.

A text is the square roots of its relative frequencies of letter pairs and triples, hashed. Linear support vector machines
are trained on a bounded sample of labelled rows: one for each pair of language families and one for
each pair of languages of a family. Prediction reads every text whole, in the tasks that scan it.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, plain, table

#: Languages that are told apart inside their family; any other is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
}
FEATURES = 4096
#: Rows of each language that the classifiers are fitted on, about.
SAMPLE = 1500
SCALE = 100.0
#: Passes over the sample that training takes at most, and the weight of its regularisation.
ROUNDS, REGULAR = 40, 0.01
#: Score under which a text is in no learned language: undecided between families and inside the best one.
LEAST = 0.25
UNKNOWN = "und"
#: All but letters and their marks (vowel signs, accents).
_OTHER = regex.compile(r"[\W\d_]+")
#: Characters, and texts, that are told apart at once.
_CHUNK, _TEXTS = 500_000, 500


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each letter pair and triple of each text, and where each text's features end."""
    clean = [f" {_OTHER.sub(' ', unicodedata.normalize('NFC', t.lower())).strip()} " for t in texts]
    code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(t) for t in clean])
    stop = np.cumsum(size)
    a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    two = (code[:-1] * a + code[1:] * b) >> shift
    three = (code[:-2] * a + code[1:-1] * b + code[2:] * c) * np.uint64(0xD6E8FEB86659FD93) >> shift
    grams = np.full(2 * len(code), FEATURES, np.int64)  # those over a text's end stay at FEATURES: no weight
    grams[0 : 2 * len(two) : 2] = two
    grams[1 : 2 * len(three) : 2] = three
    last = stop - 1
    grams[2 * last] = FEATURES
    grams[2 * last + 1] = FEATURES
    grams[2 * last - 1] = FEATURES
    return grams, 2 * stop


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size > _CHUNK or len(held) >= _TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _letters(text: str | None) -> bool:
    return bool(text) and any(ch.isalpha() for ch in text)


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies, a row a text: a line that a text repeats counts for less."""
    return np.sqrt(counts * (SCALE / np.maximum(1, counts.sum(axis=1, keepdims=True)))).astype(np.float32)


def _features(rows: DataFrame) -> DataFrame:
    """lang, features (array) of rows with text and lang."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[_letters(t) for t in pdf["text"]]]
            for at in range(0, len(pdf), 50):
                part = pdf.iloc[at : at + 50]
                out = []
                for t in part["text"]:
                    grams, _ = _grams([t])
                    counts = np.bincount(grams, minlength=FEATURES + 1)[:FEATURES]
                    out.append(_scaled(counts[None])[0])
                yield pd.DataFrame({"lang": part["lang"].to_numpy(), "features": out})

    return rows.select("lang", "text").mapInPandas(frugal(run), "lang string, features array<float>")


def held_out(doc_id: str = "doc_id"):
    """Column: the row is in the third that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def taught(docs: DataFrame) -> DataFrame:
    """The rows that training may see."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """One linear SVM (hinge loss, L2) by dual coordinate descent over the rows of one duel."""
    x, y = np.stack(pdf["features"].to_numpy()).astype(np.float32), np.where(pdf["left"], 1.0, -1.0)
    order = np.lexsort((*x.T[:8], y))  # the same model however the rows arrive
    x, y = x[order], y[order]
    spread = x.std(axis=0)
    x = np.hstack([np.divide(x, spread, out=np.zeros_like(x), where=spread > 0), np.ones((len(x), 1), np.float32)])
    weights, alpha, most = np.zeros(x.shape[1], np.float32), np.zeros(len(y)), 1 / (REGULAR * len(y))
    norm = (x * x).sum(axis=1)
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            step = min(max(alpha[i] - (y[i] * float(weights @ x[i]) - 1) / norm[i], 0.0), most) - alpha[i]
            if step:
                alpha[i] += step
                weights += np.float32(step * y[i]) * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3 * most:
            break
    scaled = np.divide(weights[:-1], spread, out=np.zeros_like(spread), where=spread > 0)
    return pd.DataFrame({"duel": pdf["duel"].iloc[:1].to_numpy(), "weights": [scaled.astype(float)], "intercept": [float(weights[-1])]})


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights and the pairs they separate, from rows (doc_id, text, lang).

    About ``sample`` rows of each language are drawn by a hash of doc_id, wherever they lie; each duel is
    trained in a task of its own. Rows with null text, lang or doc_id teach nothing. Without rows nothing
    is learned; with one language it is predicted for every text with a letter.
    """
    rows = plain(rows, doc_id="long", text="string", lang="string").where("doc_id is not null and text is not null and lang is not null")
    counts = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "pairs": []}
    family = {g: f for f, members in FAMILIES.items() for g in members}
    groups = defaultdict(list)
    for g in langs:
        groups[family.get(g, g)].append(g)
    tasks = [("family", a, b, groups[a], groups[b]) for a, b in combinations(sorted(groups), 2)]
    tasks += [("language", a, b, [a], [b]) for members in groups.values() for a, b in combinations(members, 2)]
    got = {}
    if tasks:
        share = F.create_map(*[F.lit(v) for g in langs for v in (g, min(1.0, sample / counts[g]))])
        drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
        sides = F.array(*[F.when(F.col("lang").isin(left + right), F.struct(F.lit(k).alias("duel"), F.col("lang").isin(left).alias("left"))) for k, (_, _, _, left, right) in enumerate(tasks)])
        drawn = _features(drawn).select("features", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s")).select("features", "s.duel", "s.left")
        got = {r["duel"]: r for r in drawn.groupBy("duel").applyInPandas(_train, "duel int, weights array<double>, intercept double").collect()}
    pairs = []
    for k, (level, a, b, _, _) in enumerate(tasks):
        weights, intercept = (np.array(got[k]["weights"]), got[k]["intercept"]) if k in got else (np.zeros(FEATURES), 0.0)
        pairs.append((level, a, b, weights, intercept))
    return {"langs": langs, "pairs": pairs, "groups": dict(groups)}


def _duel(names: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner of all one-versus-one votes (ties by the sum of margins), and how sure its closest duel was."""
    if len(names) == 1:
        return np.zeros(n, np.int64), np.ones(n)
    votes, sums, close = (np.zeros((n, len(names))) for _ in range(3))
    close += np.inf
    for i, j in combinations(range(len(names)), 2):
        m = margins[names[i], names[j]]
        for k, v in ((i, m), (j, -m)):
            votes[:, k] += v > 0
            sums[:, k] += np.tanh(v)
            close[:, k] = np.minimum(close[:, k], v)
    best = np.argmax(votes + sums / (4 * len(names)), axis=1)
    return best, 1 / (1 + np.exp(-2 * np.clip(close[np.arange(n), best], -30, 30)))


def _judge(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text."""
    langs, pairs = model["langs"], model["pairs"]
    name, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    known = np.array([i for i, t in enumerate(texts) if langs and _letters(t)], np.int64)
    weights = model["weights"]
    families = sorted(model.get("groups", {}))
    for chunk in _chunks([texts[i] for i in known]):
        rows = known[chunk]
        grams, stop = _grams([texts[i] for i in rows])
        size = np.diff(stop, prepend=0)
        spot = np.repeat(np.arange(len(rows)) * (FEATURES + 1), size) + grams
        counts = np.bincount(spot, minlength=len(rows) * (FEATURES + 1)).reshape(len(rows), -1)[:, :FEATURES]
        margin = _scaled(counts) @ weights + model["intercept"]
        by = {p[:3]: margin[:, k] for k, p in enumerate(pairs)}
        won, sure = _duel(families, {k[1:]: v for k, v in by.items() if k[0] == "family"}, len(rows))
        for f, members in enumerate(model["groups"][x] for x in families):
            mine = np.flatnonzero(won == f)
            if len(mine):
                best, s = _duel(members, {k[1:]: v[mine] for k, v in by.items() if k[0] == "language"}, len(mine))
                name[rows[mine]], score[rows[mine]] = np.array(members, object)[best], sure[mine] * s
    return name, score


def _ready(model: dict) -> dict:
    pairs = model["pairs"]
    weights = np.zeros((FEATURES, max(1, len(pairs))), np.float32)
    for k, p in enumerate(pairs):
        weights[:, k] = p[3]
    return model | {"pairs": [p[:3] for p in pairs], "weights": weights, "intercept": np.array([p[4] for p in pairs] or [0.0])}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; ``und`` and 0 for null or letterless text, or an empty model."""
    model = _ready(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            name, score = _judge(pdf["text"].tolist(), model)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": name, "score": score})

    docs = plain(docs, doc_id="long", text="string").withColumn("held_out", held_out())
    return docs.mapInPandas(frugal(run), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: dict, least: float = LEAST) -> DataFrame:
    """The rows of docs, all their columns, whose text is in a learned language with a score of ``least`` or more."""
    import pyarrow as pa

    model = _ready(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                name, score = _judge(batch.column(at).to_pylist(), model)
                yield batch.filter(pa.array((name != UNKNOWN) & (score >= least), pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the rows that are not held out, predict all. Repeated rows are predicted each; an empty table gives no rows."""
    return predict(docs, fit(taught(docs), sample))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
