"""Bill of materials and labour from device instances, and pricing of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .spatial import spread

NO_LABEL = "__default__"


def last_wins(dim: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """One row a key: the one that comes last. Counted as max_by, so each key is combined before the shuffle."""
    rest = [c for c in dim.columns if c != key]
    return dim.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("x")).select(key, "x.*")


def component_key(c: Column) -> Column:
    """Identity of a component: its catalog number, else maker, name and model."""
    pn = F.trim(F.coalesce(c["part_number"], F.lit("")))
    free = F.concat_ws("\x01", *[F.lower(F.trim(F.coalesce(c[k], F.lit("")))) for k in ("manufacturer", "part_name", "model")])
    return F.when(pn != "", F.concat(F.lit("pn:"), pn)).otherwise(free)


def expand(instances: DataFrame, types: DataFrame) -> DataFrame:
    """One row per instance, family and component of its type's assembly; families without one keep a row.

    instances: instance_id, device_type_id, raw_labels, total_ft. types: device_type_id, name, assembly
    (map of family to components). gap is 'unmodeled' or 'missing_distance' where a family has no
    component or a per-foot component no length; such rows have no quantity.
    """
    rows = instances.select("instance_id", "device_type_id", "total_ft", F.posexplode(S.families("raw_labels")).alias("nth", "family"))
    rows = rows.join(types.select("device_type_id", "name", "assembly"), "device_type_id", "left")
    rows = rows.select("instance_id", "device_type_id", "name", "nth", "family", "total_ft", F.posexplode_outer(F.col("assembly")[F.col("family")]).alias("line", "c"))
    per_ft = F.coalesce(F.col("c.per_run_ft"), F.lit(False))
    gap = F.when(F.col("c").isNull(), "unmodeled").when(per_ft & F.col("total_ft").isNull(), "missing_distance")
    qty = F.coalesce(F.col("c.qty"), F.lit(1.0)) * F.when(per_ft, F.col("total_ft")).otherwise(1.0)
    return rows.withColumn("gap", gap).withColumn("qty", F.when(gap.isNull(), qty)).withColumn("key", F.when(F.col("c").isNotNull(), component_key(F.col("c"))))


def totals(expanded: DataFrame, order: Column | None = None) -> DataFrame:
    """Quantity of each component; its description is the first contributing line's."""
    order = F.struct("instance_id", "nth", "line") if order is None else order
    return expanded.where("gap is null").groupBy("key").agg(F.sum("qty").alias("qty"), F.min_by("c", order).alias("c")).select("key", "qty", "c.part_number", "c.part_name", "c.manufacturer", "c.model")


def project_totals(instances: DataFrame, types: DataFrame) -> DataFrame:
    """The rows of totals(expand(instances, types)): instances are counted and their feet summed, as decimals in any order, by type and family first."""
    rows = instances.select("instance_id", "device_type_id", "total_ft", F.posexplode(S.families("raw_labels")).alias("nth", "family"))
    at = F.struct("instance_id", "nth")
    sums = rows.groupBy("device_type_id", "family").agg(F.count("*").alias("n"), F.sum(F.col("total_ft").cast("decimal(18,4)")).alias("ft"), F.min(at).alias("first"), F.min(F.when(F.col("total_ft").isNotNull(), at)).alias("first_measured"))
    lines = sums.join(types.select("device_type_id", "assembly"), "device_type_id").select("n", "ft", "first", "first_measured", F.posexplode(F.col("assembly")[F.col("family")]).alias("line", "c"))
    per_ft = F.coalesce(F.col("c.per_run_ft"), F.lit(False))
    lines = lines.where(~per_ft | F.col("first_measured").isNotNull()).withColumn("qty", F.coalesce(F.col("c.qty"), F.lit(1.0)).cast("decimal(10,4)") * F.when(per_ft, F.col("ft")).otherwise(F.col("n")))
    order = F.struct(F.when(per_ft, F.col("first_measured")).otherwise(F.col("first")), "line")
    return lines.groupBy(component_key(F.col("c")).alias("key")).agg(F.sum("qty").cast("double").alias("qty"), F.min_by("c", order).alias("c")).select("key", "qty", "c.part_number", "c.part_name", "c.manufacturer", "c.model")


def gaps(expanded: DataFrame) -> DataFrame:
    """How many instances each type and family leave unmodelled or unmeasured."""
    flagged = expanded.where("gap is not null").groupBy("gap", "device_type_id", "family", "instance_id").agg(F.max("name").alias("name"))
    return flagged.groupBy("gap", "device_type_id", "family").agg(F.max("name").alias("name"), F.count("*").alias("instances"))


def coverage(instances: DataFrame, expanded: DataFrame) -> DataFrame:
    """Instances in all, expanded to a line at least, and flagged with a gap."""
    state = expanded.groupBy("instance_id").agg(F.bool_or(F.col("gap").isNull()).alias("expanded"), F.bool_or(F.col("gap").isNotNull()).alias("flagged"))
    rows = instances.select("instance_id").join(state, "instance_id", "left")
    return rows.agg(F.count("*").alias("total_instances"), F.count_if("expanded").alias("expanded_instances"), F.count_if("flagged").alias("flagged_instances"))


def price(components: DataFrame, catalog: DataFrame) -> DataFrame:
    """Components with unit and line prices; unpriced ones keep null and say why, never zero.

    catalog: part_number, cost_unit, sale_unit, active, seq; the last row of a number holds.
    """
    parts = last_wins(catalog.withColumn("part_number", F.trim("part_number")), "part_number")
    found = components.withColumn("pn", F.when(F.trim("part_number") != "", F.trim("part_number")))
    found = found.join(parts.select(F.col("part_number").alias("pn"), "cost_unit", "sale_unit", "active", F.lit(True).alias("listed")), "pn", "left")
    reason = F.when(F.col("pn").isNull(), "no_part_number").when(F.col("listed").isNull(), "not_in_catalog").when(~F.coalesce("active", F.lit(True)), "inactive")
    out = found.withColumn("reason", reason)
    for k in ("cost", "sale"):
        out = out.withColumn(f"{k}_unit", F.when(reason.isNull(), F.col(f"{k}_unit"))).withColumn(f"line_{k}", S.round_up(F.col(f"{k}_unit") * F.coalesce("qty", F.lit(0.0)), 2))
    return out.drop("pn", "listed", "active")


def labour(instances: DataFrame, types: DataFrame) -> DataFrame:
    """Hours of each task of each instance; tasks by the foot need a length above zero.

    types: device_type_id, labor (map of family to tasks). Instances without labels use the default
    family; families without tasks give nothing.
    """
    fams = S.families("raw_labels")
    kinds = F.when(F.size(fams) > 0, fams).otherwise(F.array(F.lit(NO_LABEL)))
    rows = instances.select("instance_id", "device_type_id", "total_ft", F.explode(kinds).alias("family"))
    rows = rows.join(spread(types.select("device_type_id", "labor")), "device_type_id").select("instance_id", "device_type_id", "family", "total_ft", F.explode(F.col("labor")[F.col("family")]).alias("t"))
    qty = F.when(F.col("t.qty") > 0, F.col("t.qty")).otherwise(1.0)
    measured = F.col("total_ft") > 0
    feet = F.when(F.coalesce(F.col("t.per_run_ft"), F.lit(False)), F.when(measured, F.col("total_ft"))).otherwise(1.0)
    hours = S.round_up(F.coalesce(F.col("t.hrs"), F.lit(0.0)) * qty * feet + F.coalesce(F.col("t.setup_hrs"), F.lit(0.0)), 3)
    return rows.select("instance_id", "device_type_id", "family", F.trim("t.task_name").alias("task"), hours.alias("hours"), hours.isNull().alias("missing_distance"))


def price_items(items: DataFrame, lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Unit cost and labour minutes of each item from its assembly lines; partial where a part has no price.

    items: item_key. lines: item_key, part_number, qty, waste. parts: part_number, unit_cost, labor_min, seq.
    """
    dim = last_wins(parts.withColumn("part_number", F.trim("part_number")), "part_number").withColumn("listed", F.lit(True))
    detail = lines.withColumn("part_number", F.trim("part_number")).join(dim, "part_number", "left")
    times = F.col("qty") * S.missing_as("waste", 1.0)
    why = F.when(F.col("listed").isNull(), F.concat("part_number", F.lit(" (not in catalog)"))).when(F.col("unit_cost").isNull(), F.concat("part_number", F.lit(" (no price)")))
    sums = detail.groupBy("item_key").agg(
        F.sum(F.col("unit_cost") * times).alias("cost"), F.sum(F.col("labor_min") * times).alias("labor"), F.bool_and(F.col("labor_min").isNotNull()).alias("labor_known"),
        F.array_sort(F.collect_list(why)).alias("missing"),
    )
    out = items.select("item_key").join(sums, "item_key", "left")
    status = F.when(F.col("missing").isNull(), "none").when(F.size("missing") > 0, "partial").otherwise("priced")
    return out.select("item_key", status.alias("status"), F.when(status == "priced", S.round_up("cost", 2)).alias("unit_cost"), F.when(F.col("labor_known"), S.round_up("labor", 2)).alias("labor_min"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def parts_list(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Orderable quantity of each part over all items, and how many items use it."""
    rows = items.select("item_key", F.col("qty").alias("item_qty")).join(lines, "item_key")
    total = F.sum(F.col("item_qty") * F.col("qty") * S.missing_as("waste", 1.0))
    return rows.groupBy(F.trim("part_number").alias("part_number")).agg(S.round_up(total, 2).alias("qty"), F.count("*").alias("uses"))


def match_templates(devices: DataFrame, templates: DataFrame) -> DataFrame:
    """Devices with the template whose label set equals theirs, whatever the order; unmatched ones keep null."""

    def key(c: str) -> Column:
        return F.array_join(F.array_sort(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.upper(F.trim(x)))), "|")

    return devices.withColumn("label_key", key("labels")).join(templates.withColumn("label_key", key("labels")).drop("labels"), "label_key", "left")


def box_round(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of qty by keys, and the boxes that hold it (box_qty a box)."""
    return rows.groupBy(*keys).agg(F.sum("qty").alias("qty"), F.max("box_qty").alias("box_qty")).withColumn("boxes", F.ceil(F.col("qty") / F.col("box_qty")))


def extended(rows: DataFrame, rate: float) -> DataFrame:
    """Sell price, labour money and extended columns; nulls stay null."""
    sell = F.col("unit_cost") / (1 - F.col("margin"))
    pay = F.col("labor_min") / 60 * rate
    return rows.withColumns({"sell_unit": S.round_up(sell, 4), "labor_unit": S.round_up(pay, 4), "ext_cost": S.round_up(F.col("qty") * F.col("unit_cost"), 2), "ext_sell": S.round_up(F.col("qty") * sell, 2), "ext_labor": S.round_up(F.col("qty") * pay, 2)})


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in natural order of their names."""
    return df.orderBy(*[S.natural_key(c) for c in columns])


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
