"""Glyphs: small parts to their body, measures of shape, arms by angle, and the kind of lens they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shapes import nearest_piece_of_all

#: Bins of the outline by angle, bins it is smoothed over, and how far a lobe stands out.
BINS, SMOOTH, SPIKE = 72, 3, 1.6
#: Share of the radius beyond which a part is an arm, gap between arms and how uneven they may stand (degrees).
OUTER, ARM_GAP, UNEVEN = 0.4, 40.0, 25.0
#: How drawn out a single lens is, and the flag of an unsure count.
LONG_BODY, CHECK_LENSES = 2.2, "verify_lens_count"
BODY_AREA = 2e-5


def grouped_parts(parts: DataFrame, body_area: float = BODY_AREA) -> DataFrame:
    """page_id, part, body: bodies are the parts over ``body_area``; every other part goes to the body whose middle one of its vertices is nearest.

    parts: page_id, part, area, points (array of x, y). The first body wins ties. Parts of pages without a body are left out; those
    without a place go to the first body. Bodies are looked for outward, once for each place that has vertices.
    """
    middle = lambda c: F.aggregate(F.transform("points", lambda p: p[c]), F.lit(0.0), lambda a, x: a + x) / F.size("points")
    bodies = parts.where(F.col("area") > body_area).select("page_id", F.col("part").alias("body"), middle("x").alias("cx"), middle("y").alias("cy"))
    small = parts.where(F.col("area") <= body_area)
    corners = small.select("page_id", "part", F.explode_outer(F.array_distinct("points")).alias("p")).select("page_id", "part", "p.x", "p.y")
    spots = bodies.groupBy("page_id", F.col("cx").alias("ax"), F.col("cy").alias("ay")).agg(F.min("body").alias("body")).withColumns({"bx": F.col("ax"), "by": F.col("ay")})
    found = nearest_piece_of_all(corners.select("page_id", "x", "y").distinct(), spots, ["page_id"], ["page_id", "x", "y"], "body").select("page_id", "x", "y", "dist", "body")
    held = corners.join(found, ["page_id", "x", "y"], "left").groupBy("page_id", "part").agg(F.min(F.when(F.col("body").isNotNull(), F.struct("dist", "body"))).alias("m"))
    near = held.join(bodies.groupBy("page_id").agg(F.min("body").alias("first")), "page_id").select("page_id", "part", F.coalesce("m.body", "first").alias("body"))
    return bodies.select("page_id", F.col("body").alias("part"), "body").unionByName(near)


def distance_clusters(items: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """items (keys, item, d) with cluster and size: runs of distances without a gap; the largest is 1, of equal ones the nearer."""
    w = Window.partitionBy(*keys).orderBy("d", "item")
    rows = items.withColumn("_run", F.sum(F.when(F.col("d") - F.lag("d").over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = rows.groupBy(*keys, "_run").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("cluster", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size"), "_run")))
    return rows.join(sizes, [*keys, "_run"]).drop("_run")


def long_over_wide(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, aspect: extent along the main axis over the one across it, from the variances; 1 where the glyph has no width."""
    got = vertices.groupBy(*keys).agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    half = (F.col("xx") + F.col("yy")) / 2
    root = F.sqrt(F.greatest(F.lit(0.0), half * half - (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))))
    return got.select(*keys, F.when((half + root > 0) & (half - root > 0), F.sqrt((half + root) / (half - root))).otherwise(1.0).alias("aspect"))


def outline(vertices: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """keys, bin, radius: the farthest point of the glyph's edges in each bin of angles around the mean of its vertices, gaps filled around the circle.

    vertices: keys, part, closed, seq, x, y. Edges are sampled at half a bin of the glyph's diagonal.
    """
    glyph = Window.partitionBy(*keys)
    rows = vertices.withColumns({"cx": F.avg("x").over(glyph), "cy": F.avg("y").over(glyph), "diag": F.hypot(F.max("x").over(glyph) - F.min("x").over(glyph), F.max("y").over(glyph) - F.min("y").over(glyph))})
    part = Window.partitionBy(*keys, "part")
    order, n = part.orderBy("seq"), F.count("*").over(part)
    close = F.when(F.col("closed") & (n > 2), 1)
    ends = {c: F.coalesce(F.lead(c).over(order), F.when(close == 1, F.first(c).over(order))) for c in ("x", "y")}
    rows = rows.withColumns({"ex": ends["x"], "ey": ends["y"], "_n": n}).where("ex is not null or _n = 1")
    rows = rows.withColumns({"ex": F.coalesce("ex", "x"), "ey": F.coalesce("ey", "y")})
    step = F.greatest(F.col("diag") / (bins * 2), F.lit(1e-9))
    count = F.least(F.lit(256), F.greatest(F.lit(2), F.ceil(F.hypot(F.col("ex") - F.col("x"), F.col("ey") - F.col("y")) / step))).cast("int")
    rows = rows.withColumn("_c", count).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_c"))))
    dx = F.col("x") + (F.col("ex") - F.col("x")) * F.col("_k") / F.col("_c") - F.col("cx")
    dy = F.col("y") + (F.col("ey") - F.col("y")) * F.col("_k") / F.col("_c") - F.col("cy")
    turn = F.atan2(dy, dx)
    at = F.least(F.lit(bins - 1), F.floor(F.when(turn < 0, turn + 2 * 3.141592653589793).otherwise(turn) / (2 * 3.141592653589793) * bins)).cast("int")
    seen = rows.select(*keys, at.alias("bin"), F.hypot(dx, dy).alias("r")).groupBy(*keys, "bin").agg(F.max("r").alias("r"))
    every = seen.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(seen, [*keys, "bin"], "left")
    # the circle once more on both sides, so gaps over its seam are filled as well
    ring = full.withColumn("at", F.explode(F.array(F.col("bin") - bins, F.col("bin"), F.col("bin") + bins)))
    w = Window.partitionBy(*keys).orderBy("at")
    mark = F.when(F.col("r").isNotNull(), F.struct("at", "r"))
    ring = ring.withColumns({"lo": F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "hi": F.first(mark, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    a, b = F.col("at") - F.col("lo.at"), F.col("hi.at") - F.col("at")
    filled = F.coalesce("r", F.col("lo.r") + (F.col("hi.r") - F.col("lo.r")) * (a / (a + b)))
    return ring.where(F.col("at") == F.col("bin")).select(*keys, "bin", filled.alias("radius"))


def outline_measures(rim: DataFrame, keys: list[str], smooth: int = SMOOTH, spike: float = SPIKE) -> DataFrame:
    """keys, lobes, spikiness: runs around the circle where the smoothed outline is over ``spike`` medians, and its largest value in medians. rim: outline()."""
    bins = rim.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "radius"))), lambda x: x["radius"]).alias("e"))
    half, n = smooth // 2, F.size("e")
    mean = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(F.lit(-half), F.lit(half)), F.lit(0.0), lambda acc, k: acc + F.get("e", F.pmod(i + k, n))) / (2 * half + 1))
    rows = bins.withColumn("e", mean)
    rows = rows.withColumn("s", F.array_sort(F.filter("e", lambda v: v > 0)))
    m = F.size("s")
    middle = F.when(m % 2 == 1, F.get("s", F.floor(m / 2).cast("int"))).otherwise((F.get("s", (m / 2 - 1).cast("int")) + F.get("s", (m / 2).cast("int"))) / 2)
    rows = rows.withColumn("med", F.coalesce(F.when(m > 0, middle), F.lit(1e-9)))
    over = F.transform("e", lambda v: v / F.col("med") > spike)
    rows = rows.withColumn("o", over)
    starts = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("o", i) & ~F.get("o", F.pmod(i - 1, n))))
    lobes = F.when(F.forall("o", lambda x: x), 1).otherwise(starts)
    return rows.select(*keys, lobes.alias("lobes"), (F.greatest(F.array_max("e"), F.lit(1e-9)) / F.col("med")).alias("spikiness"))


def arms(vertices: DataFrame, keys: list[str], outer: float = OUTER, gap: float = ARM_GAP, uneven: float = UNEVEN) -> DataFrame:
    """keys, arms, evenness, confident: parts outside the hub by the angle of their middles, one arm where no gap parts them, the circle closed.

    evenness is the largest difference of a gap between arms from even spacing. Glyphs of one part have no arms.
    """
    rows = vertices.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "part"))).where("_n >= 2")
    glyph = Window.partitionBy(*keys)
    rows = rows.withColumns({"cx": F.avg("x").over(glyph), "cy": F.avg("y").over(glyph)})
    rows = rows.withColumn("_r", F.greatest(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).over(glyph), F.lit(1e-9)))
    part = rows.groupBy(*keys, "part").agg(F.avg("x").alias("px"), F.avg("y").alias("py"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("_r").alias("r"))
    part = part.withColumn("_parts", F.count("*").over(glyph))
    dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    out = part.where((F.col("_parts") >= 2) & (F.hypot(dx, dy) > outer * F.col("r"))).withColumn("a", (F.degrees(F.atan2(dy, dx)) + 360) % 360)
    w = Window.partitionBy(*keys).orderBy("a", "part")
    out = out.withColumn("run", F.sum(F.when(F.col("a") - F.lag("a").over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = out.groupBy(*keys, "run").agg(F.min("a").alias("first"), F.max("a").alias("last"))
    got = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cl"))
    n = F.size("cl")
    # the last and the first are one arm if no gap parts them over the seam
    seam = (n > 1) & (F.get("cl", F.lit(0))["first"] + 360 - F.element_at("cl", -1)["last"] <= gap)
    joined = F.struct(F.element_at("cl", -1)["first"].alias("first"), F.get("cl", F.lit(0))["last"].alias("last"))
    got = got.withColumn("cl", F.when(seam, F.concat(F.array(joined), F.slice("cl", 2, F.greatest(n - 2, F.lit(0))))).otherwise(F.col("cl")))
    got = got.withColumn("mid", F.transform("cl", lambda c: (c["first"] + c["last"]) / 2)).withColumn("arms", F.size("mid"))
    k = F.col("arms")
    gaps = F.transform("mid", lambda m, i: F.abs(F.pmod(F.get("mid", F.pmod(i + 1, k)) - m + 360, F.lit(360.0)) - 360 / k))
    got = got.withColumn("evenness", F.when(k > 1, F.array_max(gaps)).otherwise(0.0)).select(*keys, "arms", "evenness")
    every = vertices.select(*keys).distinct().join(got, keys, "left")
    return every.select(*keys, F.coalesce("arms", F.lit(0)).alias("arms"), F.coalesce("evenness", F.lit(360.0)).alias("evenness"), (F.coalesce("arms", F.lit(0)) >= 1).alias("_some")).withColumn("confident", F.col("_some") & (F.col("evenness") <= uneven)).drop("_some")


def signatures(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """keys with lobes, spikiness, aspect, arms, evenness, confident, parts, area_ratio and fill_ratio of each glyph.

    vertices: keys, part, closed, filled, seq, x, y. Glyphs under three vertices have no shape and are left out.
    """
    whole = vertices.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n >= 3").drop("_n")
    order = Window.partitionBy(*keys, "part").orderBy("seq")
    nx, ny = (F.coalesce(F.lead(c).over(order), F.first(c).over(order)) for c in ("x", "y"))
    area = whole.withColumn("_z", F.col("x") * ny - F.col("y") * nx).groupBy(*keys, "part").agg((F.abs(F.sum("_z")) / 2).alias("area"), F.first("filled").alias("filled"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = F.greatest((F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0")), F.lit(1e-9))
    area = area.groupBy(*keys).agg(F.count("*").alias("parts"), F.least(F.lit(1.0), F.sum("area") / box).alias("area_ratio"), (F.count_if("filled") / F.count("*")).alias("fill_ratio"))
    out = outline_measures(outline(whole, keys), keys)
    for df in (long_over_wide(whole, keys), arms(whole, keys), area):
        out = out.join(df, keys)
    return out


def lens_class(aspect: Column, arms_: Column, confident: Column) -> Column:
    """class and flag: drawn out is one lens, four even arms are four, anything else three and to be looked at."""
    kind = F.when(aspect > LONG_BODY, "1-lens").when(confident & (arms_ == 4), "4-lens").otherwise("3-lens")
    return F.struct(kind.alias("lens"), F.when(kind == "3-lens", CHECK_LENSES).alias("flag"))


def named_lenses(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows (aspect, arms, confident, match: a prototype's type or null) with type, confidence, flag and via.

    tokens: lens, token (one a lens class). A matched prototype names the glyph but does not make an unsure count sure; a glyph
    without a match takes the token of its class, or the class itself.
    """
    x = rows.withColumn("_l", lens_class(F.col("aspect"), F.col("arms"), F.col("confident"))).select(*rows.columns, "_l.lens", "_l.flag").join(F.broadcast(tokens), "lens", "left")
    return x.withColumns({"type": F.coalesce("match", "token", "lens"), "confidence": F.when(F.col("flag").isNotNull(), "low").otherwise("high"), "via": F.when(F.col("match").isNotNull(), "prototype").otherwise("rule")}).drop("token")


def gated(blobs: DataFrame, ringed: DataFrame, crossed: DataFrame, ring: bool = True, line: bool = False) -> DataFrame:
    """blobs (page_id, blob) that the verifiers asked for have found: a ring around them, a line through them, or both."""
    out = blobs
    if ring:
        out = out.join(ringed.select("page_id", "blob").distinct(), ["page_id", "blob"], "left_semi")
    return out.join(crossed.select("page_id", "blob").distinct(), ["page_id", "blob"], "left_semi") if line else out
