"""Image measures and exact pixel operations over (image_id, y, x, g), in DataFrame operations.

Images meet on image_id with their own neighbours only; every window and group is one image's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variance(x: Column) -> Column:
    """Population variance of integers from their exact sums, so that it does not depend on how rows are dealt."""
    n, s, q = F.count(x).cast("double"), F.sum(x).cast("double"), F.sum(x.cast("long") * x).cast("double")
    return (n * q - s * s) / (n * n)


def contrast(g: Column) -> Column:
    return F.least(F.sqrt(variance(g)) / 80, F.lit(1.0))


def brightness(g: Column) -> Column:
    m = F.avg(g)
    return F.when(m < 120, m / 120).when(m > 200, F.greatest(F.lit(0.0), 1 - (m - 200) / 55)).otherwise(1.0)


def _lot(pixels: DataFrame) -> DataFrame:
    """Each image as a row: height, width, and its values in order."""
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "g"))), lambda s: s["g"]).alias("v"))


def _mirrored(i: Column, n: Column) -> Column:
    """Index within 0 to n - 1, mirrored at the edges without repeating them."""
    return F.when(n == 1, F.lit(0)).when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)


def _clamped(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(i, n - 1))


def _near(edge, dy: int, dx: int) -> Column:
    return F.get(F.col("v"), edge(F.col("y") + dy, F.col("h")) * F.col("w") + edge(F.col("x") + dx, F.col("w")))


def _exploded(lot: DataFrame) -> DataFrame:
    return lot.select("*", F.posexplode("v").alias("i", "g")).withColumns({"y": F.floor(F.col("i") / F.col("w")).cast("int"), "x": F.col("i") % F.col("w")})


def sharpness(pixels: DataFrame) -> DataFrame:
    """(image_id, sharpness): variance of the Laplacian over 1000, at most 1; edges are mirrored."""
    p = _exploded(_lot(pixels))
    lap = _near(_mirrored, -1, 0) + _near(_mirrored, 1, 0) + _near(_mirrored, 0, -1) + _near(_mirrored, 0, 1) - 4 * F.col("g")
    return p.select("image_id", lap.alias("lap")).groupBy("image_id").agg(variance(F.col("lap")).alias("laplacian")).withColumn("sharpness", F.least(F.col("laplacian") / 1000, F.lit(1.0)))


def noise(pixels: DataFrame) -> DataFrame:
    """(image_id, noise): mean distance from the 5 by 5 median over 20, at most 1; edges are repeated."""
    p = _exploded(_lot(pixels))
    window = F.array_sort(F.array(*[_near(_clamped, dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)]))
    return p.select("image_id", F.abs(F.col("g") - F.get(window, F.lit(12))).alias("d")).groupBy("image_id").agg(F.least(F.avg("d") / 20, F.lit(1.0)).alias("noise"))


def quality(pixels: DataFrame) -> DataFrame:
    """(image_id, contrast, brightness, sharpness, noise, overall)."""
    base = pixels.groupBy("image_id").agg(contrast(F.col("g")).alias("contrast"), brightness(F.col("g")).alias("brightness"))
    both = base.join(sharpness(pixels).drop("laplacian"), "image_id").join(noise(pixels), "image_id")
    return both.withColumn("overall", 0.3 * F.col("contrast") + 0.2 * F.col("brightness") + 0.3 * F.col("sharpness") + 0.2 * (1 - F.col("noise")))


def improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, improvement): weighted relative gain of contrast (standard deviation) and Laplacian variance, plus
    0.5, within [0, 1]; 0.5 where it can't be told."""
    measure = lambda p, s: p.groupBy("image_id").agg(F.sqrt(variance(F.col("g"))).alias(f"c{s}")).join(sharpness(p).select("image_id", F.col("laplacian").alias(f"l{s}")), "image_id")
    j = measure(before, 0).join(measure(after, 1), "image_id", "left")
    gain = lambda a, b: (F.col(b) - F.col(a)) / F.greatest(F.col(a), F.lit(1.0))
    value = 0.6 * gain("c0", "c1") + 0.4 * gain("l0", "l1") + 0.5
    return j.select("image_id", F.coalesce(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)).alias("improvement"))


def gamma(pixels: DataFrame, value: float = 1.2) -> DataFrame:
    """g by the gamma table, truncated to a byte."""
    return pixels.withColumn("g", F.floor(F.pow(F.col("g") / 255.0, F.lit(1.0 / value)) * 255).cast("int"))


def rotated(pixels: DataFrame, angle: int) -> DataFrame:
    """Turned clockwise by 90, 180 or 270 degrees, exactly."""
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    j = pixels.join(size, "image_id")
    y, x, h, w = (F.col(c) for c in "yxhw")
    to = {0: (y, x), 90: (x, h - 1 - y), 180: (h - 1 - y, w - 1 - x), 270: (w - 1 - x, y)}[angle % 360]
    return j.select("image_id", to[0].alias("y"), to[1].alias("x"), "g")


def cropped(pixels: DataFrame, left: Column, top: Column, width: Column, height: Column) -> DataFrame:
    """The pixels of a box, counted from its corner."""
    y, x = F.col("y"), F.col("x")
    return pixels.where((x >= left) & (x < left + width) & (y >= top) & (y < top + height)).withColumns({"y": y - top, "x": x - left})


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "g").agg(F.count(F.lit(1)).alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold): the value that separates an image's histogram best; the smallest on a tie. At most 256
    rows per image take part."""
    h = histogram(pixels)
    run = Window.partitionBy("image_id").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    s = h.select("image_id", "g", F.sum("n").over(run).alias("n0"), F.sum(F.col("n") * F.col("g")).over(run).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("g")).over(whole).alias("s"))
    # n0 n1 (mean0 - mean1)^2 in integers up to one division, so that equal values are equal
    d = F.col("s0") * F.col("n") - F.col("s") * F.col("n0")
    between = F.coalesce(F.try_divide(d.cast("double") * d.cast("double"), F.col("n0").cast("double") * (F.col("n") - F.col("n0")).cast("double")), F.lit(0.0))
    return s.withColumn("b", between).groupBy("image_id").agg(F.max_by("g", F.struct("b", -F.col("g"))).alias("threshold"))


def binarized(pixels: DataFrame) -> DataFrame:
    return pixels.join(otsu(pixels), "image_id").select("image_id", "y", "x", F.when(F.col("g") > F.col("threshold"), 255).otherwise(0).alias("g"))


def equalized(pixels: DataFrame) -> DataFrame:
    """Histogram equalisation: the cumulative share over the smallest value's, scaled to a byte, halves to even."""
    h = histogram(pixels)
    run = Window.partitionBy("image_id").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    c = h.select("image_id", "g", F.sum("n").over(run).alias("cdf"), F.sum("n").over(whole).alias("n")).withColumn("low", F.min("cdf").over(whole))
    to = F.coalesce(F.bround(F.try_divide((F.col("cdf") - F.col("low")) * 255.0, F.col("n") - F.col("low"))), F.col("g").cast("double")).cast("int")
    return pixels.join(c.select("image_id", "g", to.alias("to")), ["image_id", "g"]).select("image_id", "y", "x", F.col("to").alias("g"))


def ink_columns(pixels: DataFrame, dark: int = 128) -> DataFrame:
    """(image_id, x, ink): dark pixels per column."""
    return pixels.groupBy("image_id", "x").agg(F.count_if(F.col("g") < dark).alias("ink"))


def moving_average(profile: DataFrame, value: str = "ink") -> DataFrame:
    """value as a moving mean over k = n // 50 columns within [5, 20]; zero beyond the edges, always over k."""
    whole = Window.partitionBy("image_id")
    p = profile.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("k", F.greatest(F.lit(5), F.least(F.lit(20), F.floor(F.col("n") / 50))))
    lot = p.groupBy("image_id", "n", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v")))), lambda s: s["v"]).alias("v"))
    e = lot.select("image_id", "n", "k", "v", F.posexplode("v").alias("x", "own"))
    lo, hi = F.greatest(F.col("x") - F.floor(F.col("k") / 2), F.lit(0)), F.least(F.col("x") + F.floor((F.col("k") - 1) / 2), F.col("n") - 1)
    part = F.slice("v", (lo + 1).cast("int"), (hi - lo + 1).cast("int"))
    return e.select("image_id", "x", "n", (F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b) / F.col("k")).alias("smooth"))


def column_count(pixels: DataFrame) -> DataFrame:
    """(image_id, columns): runs, between valleys of the smoothed ink profile, that are wider than a tenth; at least 1."""
    s = moving_average(ink_columns(pixels))
    whole, run = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("x")
    v = s.withColumn("valley", F.col("smooth") < 0.3 * F.avg("smooth").over(whole))
    v = v.withColumn("island", F.sum(F.col("valley").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    wide = v.where("not valley").groupBy("image_id", "island", "n").agg(F.count(F.lit(1)).alias("width")).where(F.col("width") > F.floor(F.col("n") / 10))
    ids = pixels.select("image_id").distinct()
    return ids.join(wide.groupBy("image_id").agg(F.count(F.lit(1)).alias("c")), "image_id", "left").select("image_id", F.greatest(F.coalesce("c", F.lit(1)), F.lit(1)).alias("columns"))


def edge_vote(lines: DataFrame, extent: Column, most: int = 200) -> DataFrame:
    """(page_id, angle) from a page's first lines (pos from 0): centre of the fullest of 36 bins of the lines' angles (degrees, -90 to 90), each line counted
    int(10 |rho| / extent) times; the first bin on a tie, 0 without a vote."""
    folded = F.when(F.col("deg") > 90, F.col("deg") - 180).otherwise(F.col("deg"))
    bins = F.least(F.floor((folded + 90) / 5), F.lit(35))
    w = F.floor(F.abs(F.col("rho")) * 10 / extent)
    votes = lines.select("page_id", bins.alias("bin"), F.when(F.col("pos") < most, w).otherwise(0).alias("w")).groupBy("page_id", "bin").agg(F.sum("w").alias("w"))
    best = votes.groupBy("page_id").agg(F.max_by("bin", F.struct("w", -F.col("bin"))).alias("bin"), F.sum("w").alias("all"))
    return best.select("page_id", F.when(F.col("all") > 0, F.col("bin") * 5 - 87.5).otherwise(0.0).alias("angle"))


def skew(lines: DataFrame) -> DataFrame:
    """(page_id, angle, confidence, n): median of the angles within 45 degrees of the horizontal; confidence falls with
    their spread and rises for clear skews; pages without such a line have 0, 0."""
    a = lines.select("page_id", (F.col("deg") - 90).alias("a")).groupBy("page_id").agg(
        F.median(F.when(F.abs("a") < 45, F.col("a"))).alias("m"), F.stddev_pop(F.when(F.abs("a") < 45, F.col("a"))).alias("s"), F.count_if(F.abs("a") < 45).alias("n")
    )
    base = F.least(F.greatest(1 - F.col("s") / 10, F.lit(0.0)), F.lit(1.0))
    conf = F.least(base + F.when(F.abs("m") > 1, 0.1).otherwise(0.0), F.lit(1.0))
    return a.select("page_id", F.coalesce("m", F.lit(0.0)).alias("angle"), F.coalesce(conf, F.lit(0.0)).alias("confidence"), "n")


def text_orientation(parts: DataFrame, most: int = 100) -> DataFrame:
    """(page_id, angle): area-weighted mean of the angles, folded to 45 degrees, of a page's first parts of usable size
    (area over 50 to under 20000, sides over 0.1 to under 10); 0 without one. parts: page_id, pos, area, w, h, deg."""
    side = F.try_divide(F.col("w"), F.col("h"))
    ok = F.coalesce((F.col("area") > 50) & (F.col("area") < 20000) & (side > 0.1) & (side < 10), F.lit(False))
    nth = F.sum(ok.cast("int")).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    used = F.when(ok & (F.col("nth") <= most), F.col("area"))
    fold = F.when(F.col("deg") > 45, F.col("deg") - 90).when(F.col("deg") < -45, F.col("deg") + 90).otherwise(F.col("deg"))
    return parts.withColumn("nth", nth).groupBy("page_id").agg(F.coalesce(F.try_divide(F.sum(fold * used), F.sum(used)), F.lit(0.0)).alias("angle"))


def handwriting(parts: DataFrame) -> DataFrame:
    """(page_id, score, handwritten) from parts of area over 20 to under 5000 (area, perimeter, w, h): irregular outlines
    and varied sides speak for it; 0 without such a part."""
    ok = (F.col("area") > 20) & (F.col("area") < 5000) & (F.col("perimeter") > 0)
    ratio = F.when((F.col("w") > 0) & (F.col("h") > 0), F.col("w") / F.col("h"))
    each = parts.groupBy("page_id").agg(F.avg(F.when(ok, 1 - 4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter")))).alias("irr"), F.avg(F.when(ok, F.coalesce(F.least(ratio, 1 / ratio), F.lit(0.0)))).alias("var"))
    score = F.least(F.greatest(0.7 * F.col("irr") + 0.3 * (1 - F.col("var")), F.lit(0.0)), F.lit(1.0))
    return each.select("page_id", F.when(F.col("irr").isNull(), 0.0).otherwise(score).alias("score"), F.coalesce(F.col("irr").isNotNull() & (score > 0.3), F.lit(False)).alias("handwritten"))


def resized(width: Column, height: Column, most: int = 4096) -> tuple[Column, Column]:
    """Size of an image after it is brought within most pixels, its aspect kept and sizes truncated."""
    factor = F.lit(float(most)) / F.greatest(width, height)
    over = F.greatest(width, height) > most
    return F.when(over, (width * factor).cast("int")).otherwise(width), F.when(over, (height * factor).cast("int")).otherwise(height)
