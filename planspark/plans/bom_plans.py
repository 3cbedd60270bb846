"""BOM, labour, pricing and roll-up queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bom, rollup
from ..sources import imports, sinks

#: Families of the stand-in device types; events of other types have no assembly.
FAMILIES = ["CL", "VI", "PU"]


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# stand-ins: an event is a device instance, its user a device type, parts make assemblies and the catalog


def instances(spark: SparkSession, sf: str) -> DataFrame:
    two = F.upper(F.substring("event_type", 1, 2))
    labels = F.array(F.concat(two, F.pmod("event_id", F.lit(3)).cast("string")), F.when(F.col("event_id") % 7 == 0, "180").otherwise(F.concat(two, F.lit("9"))))
    return t(spark, sf, "events").select(F.col("event_id").alias("instance_id"), F.col("user_id").alias("device_type_id"), labels.alias("raw_labels"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("total_ft"))


INSTANCES = """inst AS (SELECT event_id AS instance_id, user_id AS device_type_id, CASE WHEN event_id % 5 <> 0 THEN value END AS total_ft,
  list_distinct([upper(substr(event_type, 1, 2)), CASE WHEN event_id % 7 = 0 THEN '180' ELSE upper(substr(event_type, 1, 2)) END]) AS fams FROM events),
fam AS (SELECT instance_id, device_type_id, total_ft, unnest(fams) AS family FROM inst)"""


def types(spark: SparkSession, sf: str) -> DataFrame:
    def comp(number, qty, per_ft):
        return F.struct(number.alias("part_number"), F.col("p_name").alias("part_name"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("model"), qty.cast("double").alias("qty"), F.lit(per_ft).alias("per_run_ft"))

    def task(name, hrs, setup, per_ft):
        return F.struct(F.lit(name).alias("task_name"), hrs.cast("double").alias("hrs"), F.lit(setup).alias("setup_hrs"), F.lit(None).cast("double").alias("qty"), F.lit(per_ft).alias("per_run_ft"))

    size = F.col("p_size")
    assembly = F.create_map(*[x for f in FAMILIES for x in (F.lit(f), F.array(comp(F.concat("p_brand", F.lit(f"-{f}")), size % 3 + 1, False), comp(F.concat(F.lit("CABLE-"), "p_type"), F.lit(1.5), True)))])
    labor = F.create_map(*[x for f in FAMILIES for x in (F.lit(f), F.array(task("mount", size * 0.25, 0.5, False), task("pull", F.lit(0.125), 0.25, True)))])
    return t(spark, sf, "part").select(F.col("p_partkey").alias("device_type_id"), F.col("p_name").alias("name"), assembly.alias("assembly"), labor.alias("labor"))


COMPONENTS = """fams AS (SELECT unnest(['CL', 'VI', 'PU']) AS family),
comp AS (SELECT p_partkey AS device_type_id, family, p_brand || '-' || family AS part_number, (p_size % 3 + 1)::DOUBLE AS q, FALSE AS per_ft FROM part, fams
  UNION ALL SELECT p_partkey, family, 'CABLE-' || p_type, 1.5, TRUE FROM part, fams),
line AS (SELECT fam.*, comp.part_number, comp.per_ft, comp.part_number IS NULL AS unmodeled, coalesce(comp.per_ft AND fam.total_ft IS NULL, FALSE) AS far, q * CASE WHEN per_ft THEN total_ft ELSE 1 END AS qty
  FROM fam LEFT JOIN comp USING (device_type_id, family))"""


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part")
    rows = parts.withColumn("family", F.explode(F.array(*map(F.lit, FAMILIES))))
    rows = rows.select(F.concat("p_brand", F.lit("-"), "family").alias("part_number"), "p_retailprice", "p_size", "p_partkey")
    cables = parts.where("p_type <> 'ECONOMY'").select(F.concat(F.lit("CABLE-"), "p_type").alias("part_number"), "p_retailprice", "p_size", "p_partkey")
    return rows.unionByName(cables).select("part_number", F.col("p_retailprice").alias("cost_unit"), (F.col("p_retailprice") * 2).alias("sale_unit"), (F.col("p_size") % 5 != 0).alias("active"), F.col("p_partkey").alias("seq"))


CATALOG = """cat AS (SELECT part_number, arg_max(p_retailprice, p_partkey) AS cost_unit, arg_max(p_size % 5 <> 0, p_partkey) AS active FROM (
  SELECT p_brand || '-' || family AS part_number, p_retailprice, p_size, p_partkey FROM part, fams UNION ALL SELECT 'CABLE-' || p_type, p_retailprice, p_size, p_partkey FROM part WHERE p_type <> 'ECONOMY') GROUP BY part_number)"""


def q4(spark, sf):
    priced = bom.price(bom.project_totals(instances(spark, sf), types(spark, sf)), catalog(spark, sf))
    return priced.select("part_number", S.round_up("qty", 2).alias("qty"), "cost_unit", F.col("line_cost"), "line_sale", "reason")


Q4 = f"""WITH {INSTANCES}, {COMPONENTS}, {CATALOG}, tot AS (SELECT part_number, sum(qty::DECIMAL(24,6))::DOUBLE AS qty FROM line WHERE NOT unmodeled AND NOT far GROUP BY part_number)
SELECT tot.part_number, floor(qty * 100 + 0.5) / 100 AS qty, CASE WHEN active THEN cost_unit END AS cost_unit, CASE WHEN active THEN floor(cost_unit * qty * 100 + 0.5) / 100 END AS line_cost,
  CASE WHEN active THEN floor(cost_unit * 2 * qty * 100 + 0.5) / 100 END AS line_sale, CASE WHEN cost_unit IS NULL THEN 'not_in_catalog' WHEN NOT active THEN 'inactive' END AS reason FROM tot LEFT JOIN cat USING (part_number)"""


def bom_totals(spark, sf):
    got = bom.price(bom.project_totals(instances(spark, sf), types(spark, sf)), catalog(spark, sf))
    return got.agg(S.round_up(F.sum("line_cost"), 0).alias("cost_total"), S.round_up(F.sum("line_sale"), 0).alias("sale_total"), F.count("reason").alias("unresolved"))


BOM_TOTALS = f"WITH priced AS ({Q4}) SELECT floor(sum(line_cost) + 0.5) AS cost_total, floor(sum(line_sale) + 0.5) AS sale_total, count(reason) AS unresolved FROM priced"


def bom_gaps(spark, sf):
    return bom.gaps(bom.expand(instances(spark, sf), types(spark, sf))).select("gap", "device_type_id", "family", "instances")


BOM_GAPS = f"""WITH {INSTANCES}, {COMPONENTS} SELECT CASE WHEN unmodeled THEN 'unmodeled' ELSE 'missing_distance' END AS gap, device_type_id, family, count(DISTINCT instance_id) AS instances FROM line WHERE unmodeled OR far GROUP BY ALL"""


def bom_coverage(spark, sf):
    inst = instances(spark, sf)
    return bom.coverage(inst, bom.expand(inst, types(spark, sf)))


BOM_COVERAGE = f"""WITH {INSTANCES}, {COMPONENTS} SELECT (SELECT count(*) FROM inst) AS total_instances, count(DISTINCT CASE WHEN NOT unmodeled AND NOT far THEN instance_id END) AS expanded_instances,
  count(DISTINCT CASE WHEN unmodeled OR far THEN instance_id END) AS flagged_instances FROM line"""


def labor_hours(spark, sf):
    got = bom.labour(instances(spark, sf), types(spark, sf))
    return got.groupBy("task").agg(S.round_up(F.sum("hours"), 1).alias("hours"), F.count_if("missing_distance").alias("missing"), F.count("*").alias("n"))


LABOR = f"""WITH {INSTANCES}, fams AS (SELECT unnest(['CL', 'VI', 'PU']) AS family), l AS (SELECT fam.*, p_size FROM fam JOIN fams USING (family) JOIN part ON p_partkey = device_type_id),
h AS (SELECT 'mount' AS task, floor((p_size * 0.25 + 0.5) * 1000 + 0.5) / 1000 AS hours FROM l UNION ALL SELECT 'pull', CASE WHEN total_ft > 0 THEN floor((0.125 * total_ft + 0.25) * 1000 + 0.5) / 1000 END FROM l)
SELECT task, floor(sum(hours) * 10 + 0.5) / 10 AS hours, count(*) - count(hours) AS missing, count(*) AS n FROM h GROUP BY task"""


# stand-ins: brands are items, their parts assembly lines


def items(spark, sf):
    return t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("item_key")).agg(F.sum("l_quantity").alias("qty"))


def lines(spark, sf):
    return t(spark, sf, "part").select(F.col("p_brand").alias("item_key"), F.concat(F.lit(" P"), F.col("p_partkey").cast("string")).alias("part_number"), (F.col("p_size") % 4 + 1.0).alias("qty"), F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(1.5).alias("waste"))


def priced_parts(spark, sf):
    return t(spark, sf, "part").where("p_partkey % 70 <> 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("part_number"), F.when(F.col("p_size") % 11 != 0, F.col("p_retailprice")).alias("unit_cost"), F.when(F.col("p_size") % 13 != 0, F.col("p_size").cast("double")).alias("labor_min"), F.col("p_partkey").alias("seq"))


ITEMS = """items AS (SELECT p_brand AS item_key, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
lines AS (SELECT p_brand AS item_key, 'P' || p_partkey AS part_number, p_size % 4 + 1.0::DOUBLE AS qty, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 1.5 END::DOUBLE AS waste FROM part),
parts AS (SELECT 'P' || p_partkey AS part_number, CASE WHEN p_size % 11 <> 0 THEN p_retailprice END AS unit_cost, CASE WHEN p_size % 13 <> 0 THEN p_size::DOUBLE END AS labor_min FROM part WHERE p_partkey % 70 <> 0)"""


def item_prices(spark, sf):
    got = bom.price_items(items(spark, sf), lines(spark, sf), priced_parts(spark, sf))
    return got.select("item_key", "status", S.round_up("unit_cost", 1).alias("unit_cost"), S.round_up("labor_min", 1).alias("labor_min"), F.array_join("missing", "; ").alias("missing"))


ITEM_PRICES = f"""WITH {ITEMS}, d AS (SELECT lines.*, unit_cost, labor_min, CASE WHEN parts.part_number IS NULL THEN lines.part_number || ' (not in catalog)' WHEN unit_cost IS NULL THEN lines.part_number || ' (no price)' END AS why FROM lines LEFT JOIN parts USING (part_number)),
g AS (SELECT item_key, sum(unit_cost * qty * waste) AS c, sum(labor_min * qty * waste) AS l, count(*) = count(labor_min) AS known, count(why) AS n, coalesce(string_agg(why, '; ' ORDER BY why), '') AS missing FROM d GROUP BY item_key)
SELECT items.item_key, CASE WHEN n IS NULL THEN 'none' WHEN n > 0 THEN 'partial' ELSE 'priced' END AS status, CASE WHEN n = 0 THEN floor(c * 10 + 0.5) / 10 END AS unit_cost, CASE WHEN known THEN floor(l * 10 + 0.5) / 10 END AS labor_min, coalesce(missing, '') AS missing FROM items LEFT JOIN g USING (item_key)"""


def orderable(spark, sf):
    return bom.parts_list(items(spark, sf), lines(spark, sf))


ORDERABLE = f"WITH {ITEMS} SELECT part_number, floor(sum(items.qty * lines.qty * waste) * 100 + 0.5) / 100 AS qty, count(*) AS uses FROM lines JOIN items USING (item_key) GROUP BY part_number"


def extended_prices(spark, sf):
    rows = priced_parts(spark, sf).select("part_number", (F.col("seq") % 9 + 1.0).alias("qty"), "unit_cost", "labor_min", F.lit(0.25).alias("margin"))
    return bom.extended(rows, 90.0).select("part_number", "sell_unit", "ext_cost", "ext_labor")


EXTENDED = """SELECT 'P' || p_partkey AS part_number, floor(c / 0.75 * 10000 + 0.5) / 10000 AS sell_unit, floor(c * q * 100 + 0.5) / 100 AS ext_cost, floor(q * (l / 60 * 90) * 100 + 0.5) / 100 AS ext_labor FROM (
  SELECT p_partkey, p_partkey % 9 + 1.0::DOUBLE AS q, CASE WHEN p_size % 11 <> 0 THEN p_retailprice END AS c, CASE WHEN p_size % 13 <> 0 THEN p_size::DOUBLE END AS l FROM part WHERE p_partkey % 70 <> 0)"""


def template_match(spark, sf):
    parts = t(spark, sf, "part")
    devices = parts.select(F.col("p_partkey").alias("id"), F.array("p_type", F.lower("p_brand")).alias("labels"))
    templates = parts.where("p_partkey % 5 <> 0").groupBy("p_brand", "p_type").agg(F.min("p_size").alias("size")).select(F.array(F.upper("p_brand"), "p_type").alias("labels"), "size")
    return bom.match_templates(devices, templates).select("id", "label_key", F.col("size").cast("long").alias("size"))


TEMPLATE_MATCH = """WITH tpl AS (SELECT upper(p_brand) AS b, p_type AS ty, min(p_size) AS size FROM part WHERE p_partkey % 5 <> 0 GROUP BY ALL)
SELECT p_partkey AS id, CASE WHEN upper(p_brand) < p_type THEN upper(p_brand) || '|' || p_type ELSE p_type || '|' || upper(p_brand) END AS label_key, size::BIGINT AS size FROM part LEFT JOIN tpl ON b = upper(p_brand) AND ty = p_type"""


def boxes(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("demarc"), F.col("l_returnflag").alias("part"), F.col("l_quantity").alias("qty"), F.lit(24.0).alias("box_qty"))
    return bom.box_round(rows, ["demarc", "part"]).select("demarc", "part", "qty", F.col("boxes").cast("long").alias("boxes"))


BOXES = "SELECT l_suppkey AS demarc, l_returnflag AS part, sum(l_quantity) AS qty, ceil(sum(l_quantity) / 24)::BIGINT AS boxes FROM lineitem GROUP BY ALL"


def import_rejects(spark, sf):
    rows = t(spark, sf, "part").select(F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") % 97 == 0, " ").otherwise(F.concat(F.lit("N"), (F.col("p_partkey") % 500).cast("string"))).alias("part_number"), F.when(F.col("p_size") == 7, "abc").otherwise(F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(".50"))).alias("unit_cost"), F.when(F.col("p_size") == 9, "-1").alias("labor_min"))
    ok, bad = imports.import_parts(rows)
    return bad.select(F.col("row").cast("long"), "part_number", "error").unionByName(ok.select(F.col("row").cast("long"), "part_number", F.format_string("ok %.2f", "unit_cost").alias("error")))


IMPORT_REJECTS = """WITH r AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 97 = 0 THEN '' ELSE 'N' || (p_partkey % 500) END AS part_number, p_size FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY part_number ORDER BY row) AS k FROM r)
SELECT row, part_number, CASE WHEN part_number = '' THEN 'part number missing' WHEN p_size = 7 THEN 'unit cost is no amount' WHEN p_size = 9 THEN 'labor is no number' WHEN k > 1 THEN 'part number repeated' ELSE 'ok ' || p_size || '.50' END AS error FROM n"""


def template_export(spark, sf):
    its = items(spark, sf).select("item_key", F.concat(F.lit("item "), "item_key").alias("item"))
    return sinks.import_template(its, lines(spark, sf).where("item_key <> 'Brand#2'").withColumn("waste", S.missing_as("waste", 1.0))).select("item_key", "item", F.trim("part_number").alias("part_number"), "qty", "waste")


TEMPLATE_EXPORT = f"WITH {ITEMS} SELECT item_key, 'item ' || item_key AS item, part_number, coalesce(l.qty, 1.0) AS qty, coalesce(waste, 1.0) AS waste FROM items LEFT JOIN (SELECT * FROM lines WHERE item_key <> 'Brand#2') l USING (item_key)"


def catalog_view(spark, sf):
    parts = t(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_retailprice").alias("cost_unit"))
    margins = t(spark, sf, "part").where("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("category")).agg((F.min(F.length("p_type")) / 32).alias("margin"))
    return sinks.parts_priced(parts, margins).select("p_partkey", F.floor(F.col("sale_unit") * 100 + 0.5).alias("sale_cents"))


CATALOG_VIEW = "SELECT p_partkey, floor(round(p_retailprice / (1 - CASE WHEN p_type <> 'PROMO' THEN length(p_type) / 32 ELSE 0 END), 4) * 100 + 0.5)::BIGINT AS sale_cents FROM part"


# stand-ins: line items are devices, orders their pages, suppliers rooms


def facts(spark, sf):
    pages = t(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "P", "detail").otherwise("plan").alias("role"), (F.col("o_custkey") % 11 == 0).alias("is_duplicate"), F.col("o_orderpriority").alias("level"))
    kinds = t(spark, sf, "part").where("p_size <> 50").select(F.col("p_partkey").alias("device_type_id"), F.col("p_type").alias("name"))
    rows = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("device_type_id"), F.lit(None).cast("string").alias("level"), F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("TR-"), F.col("l_suppkey").cast("string"))).alias("tr_name"),
        F.when(F.col("l_quantity") > 3, F.floor("l_extendedprice") + 0.5).alias("route_ft"), F.when(F.col("l_returnflag") == "A", "straight").when(F.col("l_returnflag") == "N", "right_angle").otherwise("none").alias("route_method"), F.lit(1.25).alias("route_multiplier"),
        (F.col("l_extendedprice") > 60000).alias("tia_flag"), (F.col("l_discount") == 0).alias("excluded"), F.when(F.col("l_linestatus") == "F", "manual").otherwise("extracted").alias("source"), F.lit(295.0 * 200).alias("tia_limit_ft"),
    )
    return rollup.device_facts(rows, pages, kinds)


FACTS = """f AS (SELECT o_orderpriority AS level, coalesce(CASE WHEN p_size <> 50 THEN p_type END, 'Unknown type') AS type, CASE WHEN l_suppkey % 9 <> 0 THEN 'TR-' || l_suppkey ELSE '—' END AS tr_name, l_orderkey AS page_id,
  CASE WHEN l_quantity > 3 THEN floor(l_extendedprice) + 0.5 END AS route_ft, CASE l_returnflag WHEN 'A' THEN 'straight@1.25' WHEN 'N' THEN 'right_angle@1.25' END AS mode, l_extendedprice > 60000 AS tia, l_discount = 0 AS excluded, l_linestatus = 'F' AS manual
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'P' AND o_custkey % 11 <> 0)"""


def q3(spark, sf):
    return rollup.review(facts(spark, sf)).select("grouping", "level", "type", "tr_name", "page_id", "mode", "devices", "excluded", "cable_ft", "no_length", "tia", "manual")


Q3 = f"""WITH {FACTS} SELECT CASE WHEN type IS NOT NULL THEN 'level_type' WHEN level IS NOT NULL THEN 'level' WHEN tr_name IS NOT NULL THEN 'room' WHEN page_id IS NOT NULL THEN 'page' WHEN mode IS NOT NULL THEN 'mode' ELSE 'total' END AS grouping, level, type, tr_name, page_id, mode,
  count(*) FILTER (NOT excluded) AS devices, count(*) FILTER (excluded) AS excluded, coalesce(sum(route_ft) FILTER (NOT excluded), 0) AS cable_ft, count(*) FILTER (NOT excluded AND route_ft IS NULL) AS no_length, count(*) FILTER (NOT excluded AND tia) AS tia, count(*) FILTER (NOT excluded AND manual) AS manual
  FROM f GROUP BY GROUPING SETS ((level, type), (level), (tr_name), (page_id), (mode), ()) HAVING NOT (grouping(mode) = 0 AND mode IS NULL)"""


def level_pivot(spark, sf):
    return rollup.counts_by_level(facts(spark, sf), ["ECONOMY", "STANDARD", "PROMO", "Unknown type"]).select("level", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c.lower().replace(" ", "_")) for c in ("ECONOMY", "STANDARD", "PROMO", "Unknown type")])


LEVEL_PIVOT = f"""WITH {FACTS} SELECT level, count(*) FILTER (type = 'ECONOMY') AS economy, count(*) FILTER (type = 'STANDARD') AS standard, count(*) FILTER (type = 'PROMO') AS promo, count(*) FILTER (type = 'Unknown type') AS unknown_type FROM f WHERE NOT excluded GROUP BY level"""


def tia_list(spark, sf):
    return rollup.over_limit(facts(spark, sf)).groupBy("tr_name").agg(F.count("*").alias("devices"), F.max("tia_reason").alias("reason"))


TIA_LIST = f"""WITH {FACTS} SELECT tr_name, count(*) AS devices, max(printf('%.1f', route_ft) || 'ft exceeds 59000ft TIA limit') AS reason FROM f WHERE route_ft > 59000 GROUP BY tr_name"""


def q10(spark, sf):
    ev = t(spark, sf, "events")
    calls = ev.select((F.col("user_id") % 7).alias("org_id"), (F.col("user_id") % 13).alias("project_id"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("page_id"), F.col("event_type").alias("pass"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.floor(F.col("value") * 100).alias("input_tokens"), F.floor("value").alias("output_tokens"), (F.col("event_id") % 50).alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_write_tokens"), F.lit(0.5).alias("cost_usd"), (F.col("event_id") % 10 != 0).alias("ok"), F.col("ts").alias("created_at"))
    prices = t(spark, sf, "region").where("r_regionkey in (0, 1)").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("model"), (F.col("r_regionkey") * 2.0 + 3).alias("input_per_mtok"), (F.col("r_regionkey") + 15.0).alias("output_per_mtok"))
    out = rollup.usage(calls, prices)
    return out.select("grouping", "org_id", F.col("pass"), "project_id", F.col("day").cast("string").alias("day"), "page_id", "calls", "failed", "input_tokens", "output_tokens", "cost_logged", S.round_up("cost_now", 4).alias("cost_now"), "unpriced_calls")


Q10 = """WITH c AS (SELECT user_id % 7 AS org_id, event_type AS pass, user_id % 13 AS project_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 4 <> 0 THEN user_id END AS page_id, event_id % 10 <> 0 AS ok, floor(value * 100)::BIGINT AS i, floor(value)::BIGINT AS o, event_id % 50 AS r, event_id % 3 AS m FROM events),
n AS (SELECT *, CASE WHEN m < 2 THEN floor((i * (m * 2.0 + 3) + o * (m + 15.0) + r * (m * 2.0 + 3) * 0.1) / 1e6 * 1e6 + 0.5) / 1e6 ELSE 0 END AS cost FROM c)
SELECT CASE WHEN org_id IS NOT NULL THEN 'org_id' WHEN pass IS NOT NULL THEN 'pass' WHEN project_id IS NOT NULL THEN 'project_id' WHEN day IS NOT NULL THEN 'day' WHEN page_id IS NOT NULL THEN 'page_id' ELSE 'total' END AS grouping, org_id, pass, project_id, day, page_id, count(*) AS calls, count(*) FILTER (NOT ok) AS failed,
  sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, count(*) * 0.5::DOUBLE AS cost_logged, floor(sum(cost) * 10000 + 0.5) / 10000 AS cost_now, count(*) FILTER (m = 2) AS unpriced_calls
  FROM n GROUP BY GROUPING SETS ((), (org_id), (pass), (project_id), (day), (page_id)) HAVING NOT (grouping(page_id) = 0 AND page_id IS NULL)"""


def even_split(spark, sf):
    rooms = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", (F.col("s_suppkey") % 97 + 3).alias("panels"), (F.col("n_nationkey") % 4).alias("racks"))
    return rollup.split_even(rooms, "panels", "racks").select("s_name", F.col("share").cast("long").alias("share"), F.col("part").cast("long").alias("part"))


EVEN_SPLIT = "WITH r AS (SELECT s_name, s_suppkey % 97 + 3 AS p, s_nationkey % 4 AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey), x AS (SELECT s_name, p, n, unnest(range(1, n + 1)) AS share FROM r) SELECT s_name, share, (p // n + CASE WHEN share <= p % n THEN 1 ELSE 0 END)::BIGINT AS part FROM x"

PLANS = {
    "q4_bom_expand_price": (q4, Q4), "bom_price_totals": (bom_totals, BOM_TOTALS), "bom_gaps": (bom_gaps, BOM_GAPS), "bom_coverage": (bom_coverage, BOM_COVERAGE), "labor_hours": (labor_hours, LABOR),
    "item_prices": (item_prices, ITEM_PRICES), "orderable_parts": (orderable, ORDERABLE), "extended_prices": (extended_prices, EXTENDED), "template_match": (template_match, TEMPLATE_MATCH), "box_rounding": (boxes, BOXES),
    "import_rejects": (import_rejects, IMPORT_REJECTS), "import_template": (template_export, TEMPLATE_EXPORT), "catalog_view": (catalog_view, CATALOG_VIEW),
    "q3_review_rollup": (q3, Q3), "level_type_pivot": (level_pivot, LEVEL_PIVOT), "tia_violations": (tia_list, TIA_LIST), "q10_usage_report": (q10, Q10), "even_split": (even_split, EVEN_SPLIT),
}
