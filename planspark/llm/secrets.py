"""Secret scans: a random forest tells real secrets from false positives, in DataFrame functions only.

Candidates are runs of key characters with a digit, and whatever is assigned to a secret's name. Each is
described by its length, its character transitions, how much of it dictionary words cover, its path and its neighbouring
words (what they are by a hash, and whether one is a secret's name). The forest is trained on labelled findings: the
caller's, or those of ``findings`` that were written and labelled by hand. It alone decides; no rule does.

The dictionary is counted over all texts, from words that stand alone as letters and that nothing assigns:
candidates and assigned values are no part of it, and a word must come in many different texts, so copies of a secret don't make it a word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, table, written
from .findings import labelled_texts

CANDIDATE = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}={0,2}"
KEYWORD = "(pass|pwd|secret|token|api|key|auth|cred|bearer|private)"
#: A secret's name, the sign that assigns, and a value up to its quote or space.
_RUN = "[A-Za-z0-9_.\"'\\])-]"
NAME = f"(?<!{_RUN})(?=(?i:{_RUN}*?{KEYWORD})){_RUN}*+"
SIGN = "[:=]++>?+[\"'`]*+"
VALUE = "([^\\s\"'`]+)"
#: Lines that assign to a secret's name.
NAMED = f"{NAME}[ \t\r]*[:=]"
PLACEHOLDER = "(example|sample|dummy|placeholder|changeme|test|xxxx|0000|1234|abcd)"
#: A dictionary word: letters alone between white space, with marks around them, to which nothing is assigned.
WORD = "(?<![^\\s(\"'\\[])(?<![=:>]\\s{0,2}[\"'`]?)[a-z]{3,}(?=[.,;:!?)\"'\\]]*(?:\\s|$))"
#: Texts a word must come in to be in the dictionary, and the share of all texts where that is more.
COMMON = 20
COMMON_SHARE = 1e-4
#: Different texts are told apart by this many marks: COMMON texts set 17.3 of 64 on average, and a word must set so many.
MARKS, MARKED = 64, 16
#: Labelled findings that the forest is fitted on, about.
SAMPLE = 20_000
THRESHOLD = 0.5
TREES, HEIGHT, SEED = 40, 8, 7
#: Buckets of the hashed words before a candidate (its own word's begin among them) and after it.
BEFORE, AFTER = 24, 8

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "distinct", "turns_case", "turns_digit", "turns_other", "hex", "padded", "coverage",
    "path_test", "path_depth", "path_code", "keyword", "assigned", "quoted", "before_length", "after_length", "placeholder",
    *[f"before_{k}" for k in range(BEFORE)], *[f"after_{k}" for k in range(AFTER)],
]


def _share(c: Column, kind: str) -> Column:
    return F.regexp_count(c, F.lit(kind)) / F.length(c)


def _assigned(token: Column, before: Column) -> Column:
    """The values in token that are assigned to a secret's name in it or in the words before it."""
    token = F.regexp_replace(token, "&(?=[A-Za-z0-9_]+=)", " ")  # a URL's query names its values one by one
    inside = F.regexp_extract_all(token, F.lit(NAME + SIGN + VALUE), 2)
    begun = F.when(before.rlike(f"{NAME} ?{SIGN}$"), F.regexp_extract(token, f"^[\"'`]*+{VALUE}", 1)).when(before.rlike(f"{NAME}$"), F.regexp_extract(token, f"^{SIGN}{VALUE}", 1)).otherwise("")
    return F.filter(F.transform(F.concat(F.array(begun), inside), lambda x: F.regexp_replace(x, "[.,;]+$", "")), lambda x: x != "")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, line, word, nth, candidate, before, inside, after of every candidate.

    In a word, values assigned to a secret's name come after the runs of key characters, if they are none of
    them. line and word count from 0; before and after are the words around the candidate's word (before has
    two), inside is what its own word has in front of it.
    """
    lines = docs.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("line", "at")).where(F.col("at").rlike("[0-9]") | F.col("at").rlike(NAMED))
    words = lines.select("doc_id", "path", "line", F.col("at").rlike(NAMED).alias("named"), F.split(F.trim("at", F.lit(" \t\r")), "[ \t\r]+").alias("words"))
    rows = words.select("doc_id", "path", "line", "named", "words", F.posexplode("words").alias("word", "token"))
    n = F.col("word")
    values = F.when(F.col("named"), _assigned(F.col("token"), F.concat_ws(" ", F.get("words", n - 2), F.get("words", n - 1)))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("found", F.regexp_extract_all("token", F.lit(CANDIDATE), 0))
    rows = rows.withColumn("found", F.concat("found", F.array_except(values, "found"))).where(F.size("found") > 0)
    around = rows.select(
        "doc_id", "path", "line", "word", "token",
        F.concat_ws(" ", F.get("words", n - 2), F.get("words", n - 1)).alias("before"), F.coalesce(F.get("words", n + 1), F.lit("")).alias("after"),
        F.posexplode("found").alias("nth", "candidate"),
    )
    return around.withColumn("inside", F.expr("substring_index(token, candidate, 1)")).drop("token")


def dictionary(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """part: the words that ``common`` different texts of docs, about, and COMMON_SHARE of them have.

    Words are counted in each task before any shuffle. Different texts set different bits of a mark of MARKS
    bits; copies set the same one.
    """
    least = max(common, int(COMMON_SHARE * docs.count()) + 1)
    mark = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(text), {MARKS}) as int))").alias("mark")
    words = docs.where("text is not null").select(mark, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("part"))
    words = words.groupBy("part").agg(F.count("*").alias("n"), F.bit_or("mark").alias("marks"))
    return words.where((F.col("n") >= least) & (F.bit_count("marks") >= min(MARKED, common))).select("part")


def _in_bucket(k: int, n: int):
    return lambda h: F.pmod(h, F.lit(n)) == k


def features(found: DataFrame, docs: DataFrame, common: int = COMMON) -> DataFrame:
    """found with the columns FEATURES; the dictionary is dictionary(docs, common)."""
    found = written(found)
    values = found.groupBy("candidate").agg(F.count("*").alias("rows"))
    parts = values.select("candidate", "rows", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), 0)).alias("part"))
    known = written(dictionary(docs, common).join(parts.groupBy("part").agg(F.count("*").alias("held")), "part"))
    covered = join_counted(parts, known, "part", "held").groupBy("candidate").agg(F.sum(F.length("part")).alias("covered"), F.max("rows").alias("rows"))
    out = join_counted(found, written(covered), "candidate", "rows", "left")
    c, context = F.col("candidate"), F.lower(F.concat_ws(" ", "before", "inside"))
    made = {
        "length": F.length(c), "digits": _share(c, "[0-9]"), "uppers": _share(c, "[A-Z]"), "lowers": _share(c, "[a-z]"), "others": _share(c, "[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "turns_case": _share(c, "[a-z](?=[A-Z])|[A-Z](?=[a-z])"), "turns_digit": _share(c, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), "turns_other": _share(c, "[A-Za-z0-9](?=[^A-Za-z0-9])"),
        "hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "padded": c.endswith("="), "coverage": F.coalesce("covered", F.lit(0)) / F.length(c),
        "path_test": F.lower("path").rlike("test|example|sample|mock|fixture|doc"), "path_depth": F.regexp_count("path", F.lit("/")), "path_code": F.lower("path").rlike("\\.(py|js|ts|go|rs|java|rb|php|sh|env|ya?ml|json|toml|ini|cfg|conf)$"),
        "keyword": context.rlike(KEYWORD), "assigned": F.concat_ws(" ", "before", "inside").rlike("[:=]>?[ \"']*$"), "quoted": F.col("inside").rlike("[\"'`]$"),
        "before_length": F.length("before"), "after_length": F.length("after"), "placeholder": F.lower(c).rlike(PLACEHOLDER),
    }
    near = F.concat(F.split(F.lower("before"), " "), F.array(F.regexp_extract(F.lower("inside"), "([a-z_]+)[^a-z_]*$", 1)))
    for name, words, n in (("before", near, BEFORE), ("after", F.array(F.lower("after")), AFTER)):
        hashes = F.transform(F.filter(F.transform(words, lambda x: F.regexp_replace(x, "[^a-z]", "")), lambda x: x != ""), lambda x: F.xxhash64(x))
        made |= {f"{name}_{k}": F.exists(hashes, _in_bucket(k, n)) for k in range(n)}
    return out.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()}).drop("covered")


def labelled_findings(spark: SparkSession, copies: int | None = None) -> DataFrame:
    """The columns of candidates(), label and place of the findings in labelled_texts()."""
    texts = labelled_texts(spark, *([] if copies is None else [copies]))
    known = texts.select("doc_id", "label", "secret", "place")
    found = candidates(texts.select("doc_id", "text", "path")).join(F.broadcast(known), "doc_id")  # some thousands of rows
    real = (F.col("label") == 1) & (F.col("candidate").contains(F.col("secret")) | F.col("secret").contains(F.col("candidate")))
    return found.withColumn("label", F.coalesce(real, F.lit(False)).cast("double")).drop("secret")


def measure(described: DataFrame, folds: int = 3) -> tuple[float, float]:
    """(precision, recall) on labelled lines that are kept aside, each fold of them once. described: FEATURES, label, place."""
    fold = F.pmod(F.xxhash64("place"), F.lit(folds))
    got = reduce(DataFrame.unionByName, [score(described.where(fold == k), fit(described.where(fold != k))) for k in range(folds)])
    right = F.sum((F.col("is_secret") & (F.col("label") == 1)).cast("int"))
    x = got.agg(right.alias("right"), F.sum(F.col("is_secret").cast("int")).alias("said"), F.sum("label").alias("real")).first()
    return (x["right"] or 0) / max(1, x["said"] or 0), (x["right"] or 0) / max(1, x["real"] or 0)


def fit(labelled: DataFrame, sample: int = SAMPLE):
    """The forest, or the only label there is (0.5 if none). labelled: FEATURES and label (null rows teach nothing)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.where("label is not null")
    counts = {x["label"]: x["count"] for x in rows.groupBy("label").count().collect()}  # two rows at most
    if len(counts) < 2:
        return next(iter(counts), 0.5)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, sample / 2 / n))])
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "line", "word", "nth"), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))
    # the drawn sample is bounded; one ordered partition of it makes the forest the same each time
    rows = written(rows.select("label", *FEATURES)).repartition(1).sortWithinPartitions("label", *FEATURES)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=TREES, maxDepth=HEIGHT, seed=SEED).fit(rows)


def score(described: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """described with score (0 to 1) and is_secret."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if isinstance(model, float):
        return described.withColumn("score", F.lit(model)).withColumn("is_secret", F.lit(model > threshold))
    out = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described))
    out = out.withColumn("score", F.round(vector_to_array("probability")[1], 6)).withColumn("is_secret", F.col("score") > threshold)
    return out.drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """doc_id, path, line, word, nth, candidate, score, is_secret of every candidate of docs.

    docs: doc_id, text and a column with the path (other columns are ignored). labelled: rows with the
    columns of candidates() and label; without it, labelled_findings(). Null and empty texts have no candidates; a null path
    counts as no path; repeated rows are found each; an empty table gives no rows. Lines and words may be of any
    length, since each is read once. A score of the threshold exactly is no secret.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(f"`{path}`").cast("string").alias("path"))
    labelled = labelled_findings(docs.sparkSession) if labelled is None else labelled
    columns = ["doc_id", "path", "line", "word", "nth", "candidate", "before", "inside", "after"]
    both = candidates(docs).select(*columns, F.lit(None).cast("double").alias("label"), F.lit(False).alias("taught"))
    both = written(features(both.unionByName(labelled.select(*columns, F.col("label").cast("double"), F.lit(True).alias("taught"))), docs))
    model = fit(both.where("taught"))
    return score(both.where("not taught"), model).select("doc_id", "path", "line", "word", "nth", "candidate", "score", "is_secret")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their values redacted: the first four characters, the length and a hash tell them apart."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("line").cast("long"), F.col("word").cast("long"), F.col("nth").cast("long"), F.substring("candidate", 1, 4).alias("begins"), F.length("candidate").cast("long").alias("n_chars"), F.sha2("candidate", 256).alias("sha256"), "score", "is_secret")
