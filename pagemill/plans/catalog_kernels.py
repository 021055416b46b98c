"""Registered queries: image kernels pixel by pixel, where they are exact, with DuckDB SQL for the same pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels
from ..sources import tables as S
from .adapter_sql import sql
from .registry import query


def images(spark, sf_dir):
    """image_id, height, width, data: every image of the pixel table as bytes in row order."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "g")))
    lot = S.pixels(spark, sf_dir).groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.transform(ordered, lambda s: F.lpad(F.hex(s["g"]), 2, "0")).alias("v"))
    return lot.select("image_id", "height", "width", F.unhex(F.array_join("v", "")).alias("data"))


def pixel_rows(done):
    """(image_id, y, x, g) of images."""
    at = done.select("image_id", "width", "data", F.explode(F.sequence(F.lit(0), F.length("data") - 1)).alias("i"))
    g = F.conv(F.hex(F.substring("data", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    return at.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), g.alias("g"))


def applied(spark, sf_dir, action: str):
    return pixel_rows(kernels.apply_actions(images(spark, sf_dir).withColumn("actions", F.array(F.lit(action)))))


OTSU = """h AS (SELECT image_id, g, count(*) AS n FROM pixels GROUP BY ALL), s AS (SELECT image_id, g, sum(n) OVER a AS n0, sum(n * g) OVER a AS s0, sum(n) OVER b AS n, sum(n * g) OVER b AS s FROM h WINDOW a AS (PARTITION BY image_id ORDER BY g), b AS (PARTITION BY image_id)),
o AS (SELECT image_id, arg_max(g, (CASE WHEN n0 = n THEN 0.0 ELSE (s0 * n - s * n0)::DOUBLE * (s0 * n - s * n0)::DOUBLE / (n0::DOUBLE * (n - n0)::DOUBLE) END, -g)) AS threshold FROM s GROUP BY image_id)"""


@query(sql("pixels", select="").rstrip() + ",\n" + OTSU + " SELECT image_id, y, x, CASE WHEN g > threshold THEN 255 ELSE 0 END AS g FROM pixels JOIN o USING (image_id)")
def kernel_binarize(spark, sf_dir):
    return applied(spark, sf_dir, "binarize")


@query(sql("pixels", select="").rstrip() + """, h AS (SELECT image_id, g, count(*) AS n FROM pixels GROUP BY ALL), c AS (SELECT image_id, g, sum(n) OVER (PARTITION BY image_id ORDER BY g) AS cdf, sum(n) OVER (PARTITION BY image_id) AS n FROM h), l AS (SELECT *, min(cdf) OVER (PARTITION BY image_id) AS low FROM c)
SELECT image_id, y, x, CASE WHEN n = low THEN g ELSE round_even((cdf - low) * 255::DOUBLE / (n - low), 0)::INT END AS g FROM pixels JOIN l USING (image_id, g)""")
def kernel_equalize(spark, sf_dir):
    return applied(spark, sf_dir, "histogram_equalization")


@query(sql("pixels", select="SELECT image_id, y, x, floor(pow(g / 255::DOUBLE, 1::DOUBLE / 1.2::DOUBLE) * 255)::INT AS g FROM pixels"))
def kernel_gamma(spark, sf_dir):
    return applied(spark, sf_dir, "gamma_correction")


@query(sql("pixels", select="SELECT image_id, x AS y, 7 - y AS x, g FROM pixels"))
def kernel_quarter_turn(spark, sf_dir):
    return applied(spark, sf_dir, "rotate_90_cw")


@query(sql("pixels", select="SELECT image_id, 7 - y AS y, 7 - x AS x, g FROM pixels"))
def kernel_half_turn(spark, sf_dir):
    return applied(spark, sf_dir, "rotate_180")


@query(sql("pixels", select="SELECT image_id, y, x, g FROM pixels"))
def kernel_perspective(spark, sf_dir):
    """Straightening is declared and leaves a page as it is."""
    return applied(spark, sf_dir, "straighten_perspective")


NEAR = """p AS (SELECT p.image_id, p.y, p.x, any_value(p.g) AS g, {f} AS v FROM pixels p, range(-1, 2) a(dy), range(-1, 2) b(dx) JOIN pixels q ON q.image_id = p.image_id AND q.y = {y} AND q.x = {x} GROUP BY p.image_id, p.y, p.x)"""


@query(sql("pixels", select="").rstrip() + ", " + NEAR.format(f="median(q.g)", y="greatest(0, least(7, p.y + dy))", x="greatest(0, least(7, p.x + dx))") + " SELECT image_id, y, x, v::INT AS g FROM p")
def kernel_median(spark, sf_dir):
    return applied(spark, sf_dir, "denoise")


MIRROR = "7 - abs(7 - abs(p.{c} + d{c}))"


@query(sql("pixels", select="").rstrip() + ", " + NEAR.format(f="sum(q.g)", y=MIRROR.format(c="y"), x=MIRROR.format(c="x")) + " SELECT image_id, y, x, greatest(0, least(255, round_even(0.3::DOUBLE * g + 0.7::DOUBLE * greatest(0, least(255, 10 * g - v)), 0)))::INT AS g FROM p")
def kernel_sharpen(spark, sf_dir):
    return applied(spark, sf_dir, "sharpen")


@query(sql("pixels", select="").rstrip() + """, w AS (SELECT p.image_id, p.y, p.x, any_value(p.g) AS g, sum(q.g * exp(-(dy * dy + dx * dx) / (2 * 2.0::DOUBLE * 2.0::DOUBLE))) / sum(exp(-(dy * dy + dx * dx) / (2 * 2.0::DOUBLE * 2.0::DOUBLE))) AS m
FROM pixels p, range(-5, 6) a(dy), range(-5, 6) b(dx) JOIN pixels q ON q.image_id = p.image_id AND q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx)) GROUP BY p.image_id, p.y, p.x)
SELECT image_id, y, x, CASE WHEN g > m - 2 THEN 255 ELSE 0 END AS g FROM w""")
def kernel_adaptive(spark, sf_dir):
    return applied(spark, sf_dir, "adaptive_threshold")


@query(sql("pixels", select="SELECT image_id, count(*) = 64 AS whole, TRUE AS success, 'deskew,crop_margins' AS applied FROM pixels GROUP BY image_id"))
def kernel_small_pages(spark, sf_dir):
    """On pages smaller than a margin, and without a line of a hundred pixels, cropping and deskewing change nothing."""
    own = images(spark, sf_dir)
    done = kernels.apply_actions(own.withColumn("actions", F.array(F.lit("deskew"), F.lit("crop_margins"))))
    j = done.join(own.select("image_id", F.col("data").alias("before")), "image_id")
    return j.select("image_id", (F.col("data") == F.col("before")).alias("whole"), "success", F.array_join("applied", ",").alias("applied"))
