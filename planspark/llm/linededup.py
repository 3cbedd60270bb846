"""Line dedup by a log-template tree, in DataFrame functions only.

Parsing has a fixed depth: a line's number of tokens, then its first ``DEPTH`` tokens, lead to a leaf.
Tokens with a digit are variable fields. A leaf holds any number of groups. A group forms around a seed line: the
leaf's tokens after the first ones are cut in bands, one more than the tokens in which lines of a group may differ, so
lines of a group agree in a band; of all lines that agree in a band the most frequent one is a seed, and
lines that agree with it in ``SIMILAR`` of their tokens are its group. The tokens in which they differ are
variable fields too.

A template recurs if its group stands in ``MIN_DOCS`` documents that are otherwise their own: documents over
``OWN`` of whose characters lie in leaves that other documents reach as well are copies, and copies are no evidence
for a template. Otherwise a text that was copied a thousand times would lose all its lines. Every line
of a recurring template goes, in all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_counted, plain, table, written

DEPTH = 3
SIMILAR = 0.8
MIN_DOCS = 5
#: Share of a document's characters in shared leaves up to which it counts as evidence.
OWN = 0.5
FIELD = "<*>"
_VARIABLE = "[^ \t]*[0-9][^ \t]*"


def _masked(line: Column) -> Column:
    line = F.trim(line, F.lit(" \t\r"))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, FIELD)).otherwise(line)


def _tokens(masked: Column) -> Column:
    return F.split(masked, "[ \t]+")


def _lead(masked: Column, depth: int) -> tuple[Column, Column]:
    """Number of tokens and the first ones, without cutting the whole line."""
    first = F.regexp_extract(masked, "^[^ \t]+(?:[ \t]+[^ \t]+){0,%d}" % (depth - 1), 0)
    return F.regexp_count(masked, F.lit("[ \t]+")) + 1, F.regexp_replace(first, "[ \t]+", " ")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h"))


def candidate_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, own: float = OWN) -> DataFrame:
    """doc_id, h, ln, masked, shape (its MD5), evidence of the lines in leaves that enough documents of their own share; docs: from _keyed()."""
    lines = docs.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("ln", "line")).where(F.trim("line", F.lit(" \t\r")) != "")
    lines = lines.select("doc_id", "h", "ln", _masked(F.col("line")).alias("m"))
    # texts are cut and read once: what follows needs two keys a line
    lines = written(lines.select("doc_id", "h", F.xxhash64("doc_id", "h").alias("doc"), "ln", F.xxhash64(*_lead(F.col("m"), depth)).alias("leaf"), F.length("m").alias("size")))
    # leaves are summed in each task before they meet
    leaves = lines.groupBy("leaf").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("held"))
    lines = join_counted(lines, written(leaves.select("leaf", (F.col("a") != F.col("b")).alias("shared"), "held")), "leaf", "held")
    of_doc = Window.partitionBy("doc_id", "h")
    alike = F.sum(F.when(F.col("shared"), F.col("size")).otherwise(0)).over(of_doc) / F.sum("size").over(of_doc)
    lines = written(lines.withColumn("evidence", alike <= own).where("shared").select("doc_id", "h", "doc", "ln", "leaf", "evidence"))
    # one row a leaf and document before leaves are counted, so a common leaf is summed in parts
    leaves = lines.groupBy("leaf", "doc").agg(F.max(F.col("evidence").cast("int")).alias("own"), F.count("*").alias("held")).groupBy("leaf").agg(F.sum("own").alias("docs"), F.sum("held").alias("held"))
    leaves = written(leaves.where(F.col("docs") >= min_docs).select("leaf", "held"))
    hot = join_counted(lines, leaves, "leaf", "held").groupBy("doc_id", "h").agg(F.collect_set("ln").alias("lns"), F.first("evidence").alias("evidence"))
    hot = hot.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "lns", "evidence")
    met = docs.join(hot, docs["doc_id"].eqNullSafe(hot["d"]) & (docs["h"] == hot["g"]))
    met = met.select("doc_id", "h", "evidence", "lns", F.split("text", "\n").alias("all"))
    met = met.select("doc_id", "h", "evidence", F.explode(F.transform("lns", lambda i: F.struct(i.alias("ln"), F.get("all", i).alias("line")))).alias("x"))
    met = met.select("doc_id", "h", F.col("x.ln").alias("ln"), "evidence", _masked(F.col("x.line")).alias("masked"))
    return written(met.withColumn("shape", F.md5("masked"))).dropDuplicates(["doc_id", "h", "ln"])


def _bands(tokens: Column, depth: int, similar: float) -> Column:
    """A key of each band of the tokens after the first ``depth`` ones: one more than tokens may differ."""
    n = F.size(tokens)
    count = F.greatest(F.lit(1), F.least(n - F.ceil(similar * n - 1e-9).cast("int") + 1, n - depth))
    cut = lambda i: (F.greatest(F.lit(0), n - depth) * i / count).cast("int")
    lead = F.array_join(F.slice(tokens, 1, depth), " ")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(n, lead, i, F.array_join(F.slice(tokens, depth + 1 + cut(i), cut(i + 1) - cut(i)), " ")))


def templates(lines: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS) -> DataFrame:
    """shape, template: the line shapes of each template (the shape of its seed) that recurs, from candidate_lines()."""
    tokens = _tokens(F.col("masked"))
    shapes = written(lines.groupBy("shape").agg(F.count("*").alias("n"), F.first("masked").alias("masked")))
    banded = written(shapes.select("shape", "n", F.explode(_bands(tokens, depth, similar)).alias("band")))
    seeds = written(banded.groupBy("band").agg(F.min(F.struct(-F.col("n"), "shape")).getField("shape").alias("template"), F.count("*").alias("held")))
    pairs = join_counted(banded.select("shape", "band"), seeds, "band", "held").select("shape", "template").distinct()
    pairs = written(pairs.join(shapes.select("shape", "masked"), "shape"))
    held = pairs.groupBy("template").agg(F.count("*").alias("held")).join(shapes.select(F.col("shape").alias("template"), F.col("masked").alias("seed")), "template")
    pairs = join_counted(pairs, written(held), "template", "held")
    equal = F.size(F.filter(F.zip_with(tokens, _tokens(F.col("seed")), lambda a, b: a == b), lambda x: x))
    pairs = written(pairs.where((F.col("masked") == F.col("seed")) | (equal >= similar * F.size(tokens) - 1e-9)).select("shape", "template"))
    docs = lines.where("evidence").select("shape", "doc_id", "h").distinct()
    # a shape has a template for each band at most
    of = pairs.groupBy("shape").agg(F.collect_set("template").alias("all")).join(docs.groupBy("shape").agg(F.count("*").alias("held")), "shape")
    docs = join_counted(docs, written(of), "shape", "held").select(F.explode("all").alias("template"), "doc_id", "h").distinct()
    recurring = docs.groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    held = pairs.groupBy("template").agg(F.count("*").alias("held"))
    return join_counted(pairs, written(recurring.select("template").join(held, "template")), "template", "held")


def generalised(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """template, pattern, shapes: each template with its variable fields as ``<*>``, from candidate_lines() and templates()."""
    shapes = shapes.join(lines.select("shape", "masked").distinct(), "shape")
    words = shapes.select("template", F.posexplode(_tokens(F.col("masked"))).alias("at", "token"))
    words = words.groupBy("template", "at").agg(F.when(F.min("token") == F.max("token"), F.min("token")).otherwise(F.lit(FIELD)).alias("token"), F.count("*").alias("n"))
    return words.groupBy("template").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("pattern"), F.max("n").alias("shapes"))


def dropped_lines(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS, own: float = OWN) -> DataFrame:
    """drop_id, drop_key (xxhash64 of the text) and the array drop_lines of every document that loses lines."""
    docs = _keyed(plain(docs, doc_id="long", text="string"))
    lines = candidate_lines(docs, depth, min_docs, own)
    shapes = templates(lines, depth, similar, min_docs).select("shape").distinct().join(lines.groupBy("shape").agg(F.count("*").alias("held")), "shape")
    drop = join_counted(lines, written(shapes), "shape", "held").groupBy("doc_id", "h").agg(F.collect_set("ln").alias("drop_lines"))
    return drop.select(F.col("doc_id").alias("drop_id"), F.col("h").alias("drop_key"), "drop_lines")


def _joined(docs: DataFrame, drop: DataFrame, *columns: str) -> DataFrame:
    """columns of docs with text as it stays, n_lines and n_dropped; no name of docs can clash with one of ours."""
    lines = F.split(docs["text"], "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop["drop_lines"], i)), "\n")
    met = docs.join(drop, docs["doc_id"].eqNullSafe(drop["drop_id"]) & (F.xxhash64(docs["text"]) == drop["drop_key"]), "left")
    text = F.when(drop["drop_lines"].isNull(), docs["text"]).otherwise(kept).alias("text")
    n_lines = F.when(docs["text"].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    return met.select(*[text if c == "text" else docs[f"`{c}`"] for c in columns], n_lines, F.coalesce(F.size(drop["drop_lines"]), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text without lines of recurring templates, n_lines, n_dropped of every document.

    docs: doc_id, text (other columns are ignored). Lines end at line feeds; blank lines are no
    templates and stay. Null text stays null with no lines, empty text has one blank line. Rows with
    equal doc_id and text count as one document and each come back. Ties between frequent lines go to
    the least in byte order. An empty table gives no rows. how: as for dropped_lines().
    """
    docs = plain(docs, doc_id="long", text="string")
    return _joined(docs, dropped_lines(docs, **how), "doc_id", "text")


def clean(docs: DataFrame, **how) -> DataFrame:
    """All rows and columns of docs (their names unlike one another), their text without lines of recurring templates."""
    found = _joined(docs, dropped_lines(docs, **how), *docs.columns)
    return found.toDF(*docs.columns, *(f"{len(docs.columns)}{k}" for k in "ab")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


#: Rows of query() over the table or subquery {docs}.
SQL = """
WITH k AS (SELECT DISTINCT doc_id, text FROM {docs}),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM k),
m AS (SELECT *, regexp_replace(trim(line, ' ' || chr(9) || chr(13)), '[^ \t]*[0-9][^ \t]*', '<*>', 'g') AS masked FROM l),
t AS (SELECT *, regexp_split_to_array(masked, '[ \t]+') AS tok FROM m WHERE masked <> ''),
s AS (SELECT len(tok) AS n, array_to_string(tok[1:3], ' ') AS lead, count(DISTINCT (doc_id, text)) > 1 AS shared FROM t GROUP BY 1, 2),
e AS (SELECT t.doc_id, t.text, t.ln, t.line, t.masked, t.tok, s.n, s.lead,
             sum(CASE WHEN s.shared THEN length(t.masked) ELSE 0 END) OVER w / sum(length(t.masked)) OVER w <= 0.5 AS evidence
      FROM t JOIN s ON len(t.tok) = s.n AND array_to_string(t.tok[1:3], ' ') = s.lead WINDOW w AS (PARTITION BY t.doc_id, t.text)),
leaf AS (SELECT n, lead FROM e WHERE evidence GROUP BY n, lead HAVING count(DISTINCT (doc_id, text)) >= 5),
c AS (SELECT e.* FROM e SEMI JOIN leaf ON e.n = leaf.n AND e.lead = leaf.lead),
shape AS (SELECT masked, n, lead, any_value(tok) AS tok, count(*) AS freq, greatest(1, least(n - ceil(0.8 * n)::BIGINT + 1, n - 3)) AS m FROM c GROUP BY masked, n, lead),
band AS (SELECT masked, n, lead, freq, tok, b, array_to_string(tok[4 + (greatest(0, n - 3) * b) // m : 3 + (greatest(0, n - 3) * (b + 1)) // m], ' ') AS part
         FROM (SELECT *, unnest(range(m)) AS b FROM shape)),
seed AS (SELECT n, lead, b, part, masked AS template, tok AS seed_tok FROM band QUALIFY row_number() OVER (PARTITION BY n, lead, b, part ORDER BY freq DESC, md5(masked)) = 1),
pair AS (SELECT DISTINCT masked, template FROM band JOIN seed USING (n, lead, b, part)
         WHERE masked = template OR len(list_filter(range(1, band.n + 1), lambda i: tok[i] = seed_tok[i])) >= 0.8 * band.n),
rec AS (SELECT template FROM c JOIN pair USING (masked) WHERE evidence GROUP BY template HAVING count(DISTINCT (doc_id, text)) >= 5),
gone AS (SELECT doc_id, text, ln FROM c WHERE masked IN (SELECT masked FROM pair WHERE template IN (SELECT template FROM rec))),
kept AS (SELECT l.doc_id, l.text, coalesce(string_agg(CASE WHEN gone.ln IS NULL THEN line END, chr(10) ORDER BY l.ln), '') AS clean,
                count(*) AS n_lines, count(gone.ln) AS n_dropped
         FROM l LEFT JOIN gone ON l.doc_id IS NOT DISTINCT FROM gone.doc_id AND l.text = gone.text AND l.ln = gone.ln GROUP BY l.doc_id, l.text)
SELECT d.doc_id, kept.clean AS text, coalesce(kept.n_lines, 0) AS n_lines, coalesce(kept.n_dropped, 0) AS n_dropped
FROM {docs} d LEFT JOIN kept ON d.doc_id IS NOT DISTINCT FROM kept.doc_id AND d.text = kept.text
"""
ORACLE_SQL = SQL.format(docs="documents")
