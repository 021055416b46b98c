"""License scans: ordered signature rules behind a keyword gate, in DataFrame operations only.

A text is first searched for the gates (single words); only texts with one are split into words, and only the words
around a gate are tried against that gate's rules, whose table is small and broadcast. A detection is an interval of
words. One that lies within another is suppressed; of equal intervals the rule that comes first stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, without
from .license_rules import BASE, REACH, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rules that are broadcast; a longer list is left to the join that Spark chooses.
BROADCAST_RULES = 10_000


def _words_in(match):
    m = F.btrim(match)
    return F.when(m == "", 0).otherwise(F.length(m) - F.length(F.translate(m, " ", "")) + 1)


def scan(docs: DataFrame, text_col: str = "text", rules=RULES, base=BASE) -> DataFrame:
    """One row per row of docs: its columns but the text, and n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest of their starts
    (words from 0; null without one). labels adds the surviving detections' labels to the base ones; score is n / (n + 1)
    for the longest surviving detection's n words, 0 without one. Nulls: a null text counts as empty (no words, no
    labels, score 0); null ids are carried. Repeated rows are scanned each; an empty table gives an empty result. Columns
    of docs that have an output's name give way to it.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "__row", "__words")
    table = [(i, *r, False) for i, r in enumerate(rules)] + [(len(rules) + i, *r, True) for i, r in enumerate(base)]
    gates = sorted({r[3] for r in table})
    rest = [f"`{c}`" for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    gated = F.rlike(text, F.lit(r"(?i)(?<![0-9A-Za-z])(?:" + "|".join(gates) + ")"))
    words = F.split(F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), " ")
    rows = docs.select(*rest, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(gated, words).alias("__words"), F.monotonically_increasing_id().alias("__row"))
    rows = stored(rows, "scanned")
    w, n = F.col("__words"), F.size("__words")
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, i).isin(gates))
    hits = F.transform(at, lambda i: F.struct(
        i.alias("at"), F.get(w, i).alias("gate"),
        F.array_join(F.transform(F.slice(w, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))), lambda x: F.concat(x, F.lit(" "))), "").alias("left"),
        F.array_join(F.transform(F.slice(w, i + 2, REACH), lambda x: F.concat(F.lit(" "), x)), "").alias("right"),
    ))
    found = rows.where("__words is not null").select("__row", F.explode(hits).alias("h")).select("__row", "h.*")
    listed = spark.createDataFrame(table, "rank int, label string, before string, gate string, after string, base boolean")
    if len(table) <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    tried = found.join(listed, "gate").where(F.rlike("left", F.col("before")) & F.rlike("right", F.col("after")))
    lo = F.col("at") - _words_in(F.expr("regexp_extract(left, before, 0)"))
    hi = F.col("at") + 1 + _words_in(F.expr("regexp_extract(right, after, 0)"))
    spans = tried.select("__row", "rank", "label", "base", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    ahead = Window.partitionBy("__row", "base").orderBy("lo", F.desc("hi"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    kept = spans.withColumn("cover", F.max("hi").over(ahead)).where(F.col("base") | F.col("cover").isNull() | (F.col("cover") < F.col("hi")))
    size = (F.col("hi") - F.col("lo")).cast("double")
    each = kept.groupBy("__row").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("lo"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("lo"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(~F.col("base"), size / (size + 1))).alias("score"),
    )
    out = rows.drop("__words").join(each, "__row", "left")
    return out.select(*rest, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
