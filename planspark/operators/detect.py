"""Devices from the text of plans: anchors by type, families beside them, counts by page, and the way a sheet is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .spatial import nearest_by_place

#: The way that sheets of each kind are read.
ROUTES = {"device_list": "schedule", "quantity_matrix": "matrix", "tr_summary": "tr_schedule", "label_stamp": "labels"}


def is_family_code(token: Column | str, families: Column | str) -> Column:
    """A token with a digit whose leading capitals are one of the families."""
    t = S.norm(token)
    return t.rlike("[0-9]") & F.array_contains(F.col(families) if isinstance(families, str) else families, S.lead_capitals(t))


def type_catalog(types: DataFrame) -> DataFrame:
    """One row a type: type, type_id, mode (exact or regex), anchor, pattern, families and radius from the JSON of their settings.

    types: type_id, name, detection_config (JSON text). Types without an anchor are left out; where two have one name the later id wins.
    """
    schema = "anchor string, anchor_mode string, uin_pattern string, families array<string>, fam_radius double, type string"
    rows = types.withColumn("c", F.from_json("detection_config", schema)).where("c.anchor is not null and c.anchor <> ''")
    rows = rows.select(F.coalesce("c.type", "name").alias("type"), "type_id", F.when(F.col("c.anchor_mode") == "regex", "regex").otherwise("exact").alias("mode"), S.norm(F.col("c.anchor")).alias("anchor"), F.coalesce("c.uin_pattern", "c.anchor").alias("pattern"), F.col("c.uin_pattern").isNotNull().alias("strict"), F.coalesce("c.families", F.array().cast("array<string>")).alias("families"), F.coalesce("c.fam_radius", F.lit(0.04)).alias("radius"))
    rest = [c for c in rows.columns if c != "type"]
    return rows.groupBy("type").agg(F.max_by(F.struct(*rest), "type_id").alias("x")).select("type", "x.*")


def matched(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """items with type, uin and flag for each type whose anchor they match: exact texts by an equal join, patterns one by one.

    items: page_id, seq, str, x, y. Of types with a pattern of their own, texts that only begin with the anchor come out flagged
    ``prefix_only`` and are no devices. Types are a project's settings, some tens of rows; their patterns go to the tasks as one array.
    """
    text = items.withColumn("text", S.norm("str")).where("text <> ''")
    exact = text.join(catalog.where("mode = 'exact'").select("type", F.col("anchor").alias("text")), "text").withColumns({"uin": F.lit(None).cast("string"), "flag": F.lit(None).cast("string")})
    patterns = catalog.where("mode = 'regex'").agg(F.collect_list(F.struct("type", "pattern", "strict", "anchor")).alias("ps")).withColumn("one", F.lit(1))
    words = text.select("text").distinct().withColumn("one", F.lit(1))  # patterns are tried on different texts, not on all
    hits = words.join(F.broadcast(patterns), "one").withColumn("p", F.explode("ps"))
    full = F.rlike("text", F.col("p.pattern"))
    hits = hits.withColumn("flag", F.when(~full & F.col("p.strict") & F.startswith("text", F.col("p.anchor")), "prefix_only")).where(full | F.col("flag").isNotNull()).select("text", "p.type", "flag")
    by_pattern = text.join(hits.select("text", "type", "flag"), "text").withColumn("uin", F.when(F.col("flag").isNull(), F.col("text")))
    return exact.select(*items.columns, "text", "type", "uin", "flag").unionByName(by_pattern.select(*items.columns, "text", "type", "uin", "flag"))


def detected(items: DataFrame, catalog: DataFrame, radius: float) -> DataFrame:
    """page_id, seq, type, uin, x, y, families, codes of every device of every type; each family code goes to the nearest anchor of its type.

    radius: the largest radius of a type. A code at an anchor of the same text is that anchor.
    """
    anchors = matched(items, catalog).where("flag is null").select("page_id", "seq", "type", "uin", "text", "x", "y")
    coded = items.withColumn("text", S.norm("str")).where(F.col("text").rlike("^[A-Z]+.*[0-9]")).withColumn("family", S.lead_capitals("text"))
    wanted = catalog.select("type", F.col("radius").alias("reach"), F.explode("families").alias("family")).distinct()
    codes = coded.join(wanted, "family").select("page_id", "type", F.col("seq").alias("code_seq"), F.col("text").alias("code"), "reach", "x", "y")
    target = anchors.select("page_id", "type", "seq", F.col("text").alias("anchor_text"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    met = nearest_by_place(codes, target, radius, ["page_id", "type"], ["code_seq", "page_id", "type"], "seq", strict=True)
    same = (F.col("code") == F.col("anchor_text")) & (F.col("dist") < 1e-6)
    held = met.where((F.col("dist") < F.col("reach")) & ~same & (F.col("code") != F.col("anchor_text"))).groupBy("page_id", "type", "seq").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    out = anchors.join(held, ["page_id", "type", "seq"], "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    return out.withColumn("families", F.array_distinct(F.transform("codes", S.lead_capitals))).drop("text")


def anchor_counts(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """page_id, anchors: texts of each page that some type's anchor matches, each once."""
    hits = matched(items, catalog).where("flag is null").select("page_id", "seq").distinct()
    return hits.groupBy("page_id").agg(F.count("*").alias("anchors"))


def sheet_route(tables: DataFrame, pages: DataFrame, least: int = 1) -> DataFrame:
    """page_id, archetype, route, table_id: the best table of each page; without one, pages with anchors are stamped by labels, others unknown.

    tables: page_id, table_id, archetype, score (table_archetype). pages: page_id, anchors.
    """
    known = tables.where("archetype <> 'unknown'").groupBy("page_id").agg(F.min(F.struct(-F.col("score"), "table_id", "archetype")).alias("b"))
    rows = pages.join(known, "page_id", "left")
    kind = F.coalesce("b.archetype", F.when(F.coalesce("anchors", F.lit(0)) >= least, "label_stamp")).alias("archetype")
    routes = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    rows = rows.select("page_id", F.coalesce(kind, F.lit("unknown")).alias("archetype"), F.col("b.table_id").alias("table_id"))
    return rows.select("page_id", "archetype", F.coalesce(routes[F.col("archetype")], F.lit("review")).alias("route"), "table_id")


def reading_route(pages: DataFrame) -> DataFrame:
    """page_id, archetype, source: seeded rows come first, then settings, then a stored route, then what the sheet looks like.

    pages: page_id, seeded (rows), has_config, stored, derived.
    """
    source = F.when(F.col("seeded") > 0, "seeded_rows").when(F.col("has_config"), "config").when(F.col("stored").isNotNull(), "stored").otherwise("derived")
    kind = F.when(source.isin("seeded_rows", "config"), "device_list").when(source == "stored", F.col("stored")).otherwise(F.coalesce("derived", F.lit("unknown")))
    return pages.select("page_id", kind.alias("archetype"), source.alias("source"))


def rows_of_matrix(types: DataFrame, aliases: DataFrame) -> DataFrame:
    """page_id, type, nth: a row without a number for each device that a matrix counts, under the name its type goes by."""
    named = types.join(aliases, "type", "left").select("page_id", F.coalesce("canonical", "type").alias("type"), F.col("type").alias("matrix_type"), "quantity").where("quantity > 0")
    return named.select("page_id", "type", "matrix_type", F.explode(F.sequence(F.lit(1).cast("bigint"), "quantity")).alias("nth"))


def all_devices(found: DataFrame, manual: DataFrame) -> DataFrame:
    """Detected and manual devices as one; columns that one of them lacks are null."""
    return found.withColumn("origin", F.lit("detected")).unionByName(manual.withColumn("origin", F.lit("manual")), allowMissingColumns=True)


def merged_sources(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sources, families, codes: what all pieces of evidence of a device name, each once and in order."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return evidence.groupBy(*keys).agg(union("sources"), union("families"), union("codes"))
