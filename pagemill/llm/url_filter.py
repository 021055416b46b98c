"""URL filters by a Bloom filter cascade: exact membership of listed keys over the corpus's own keys, without joins.

A rule's key is its host and path, joined ("com/en/"). A url's possible keys are each suffix of its host (whole labels)
with each beginning of its path that is as long as some rule's path; the distinct ones of the corpus are the universe.
Level 1 holds the listed keys. The universe's other keys that pass it are level 2's; the listed keys that pass level 2
are level 3's, and so on until a level lets nothing wrong pass. A key's membership is then whether the first level that
rejects it is even. Only keys that pass a level wrongly are ever counted; filters are bytes of 7 bits each, sized
beforehand, that go with the plan. A list that needs a level over MOST_BITS is looked up exactly by a join instead.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, without

#: host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Bits of one filter at most (9.6 MB), which bounds what a plan carries: some four million listed keys.
MOST_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule for this url could have; lengths: those of the rules' paths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat(h, p)))))


class Level:
    """One Bloom filter: its bits, 7 to a byte, so that a byte is a character that ascii() reads."""

    def __init__(self, seed: int, bits: int, hashes: int):
        self.seed, self.bits, self.hashes, self.held = seed, bits, hashes, b""

    def places(self, key: Column) -> list[Column]:
        a, b = (F.pmod(F.xxhash64(F.lit(2 * self.seed + k), key), F.lit(self.bits)) for k in (0, 1))
        return [F.pmod(a + b * F.lit(i), F.lit(self.bits)) for i in range(self.hashes)]

    def build(self, keys: DataFrame) -> Level:
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("p"))
        rows = at.groupBy(F.expr("p div 56").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 56 as int))")).alias("x")).toArrow()
        words = np.zeros(-(-self.bits // 56), np.int64)
        words[rows.column("w").to_numpy()] = rows.column("x").to_numpy()  # at most bits / 56 rows
        self.held = (words[:, None] >> np.arange(0, 56, 7) & 127).astype(np.uint8).tobytes()
        return self

    def passes(self, key: Column) -> Column:
        held, out = F.lit(self.held), F.lit(True)
        for p in self.places(key):
            byte = F.ascii(F.substring(held, (F.floor(p / 7) + 1).cast("int"), F.lit(1)).cast("string"))
            out = out & (F.getbit(byte, (p % 7).cast("int")) == 1)
        return out


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))


def _rate(n: int, size: int) -> float:
    """Of the first level: about as many wrong keys pass as are listed."""
    return min(0.5, max(1, n) / max(1, size) * math.sqrt(0.5))


def cascade(listed: DataFrame, universe: DataFrame, size: int) -> list[Level] | None:
    """Levels for listed(key) over universe(key), which may hold listed keys and repeats; size: about how many keys it
    has, which only sets the first level's bits. Keys outside the universe may be judged wrongly. None if a level would
    be over MOST_BITS. Nulls are no keys; no listed key gives no level, and nothing is a member."""
    inside = stored(listed.where("key is not null").distinct(), "listed")
    n, levels, rest = inside.count(), [], None
    rate = _rate(n, size)
    while n:
        bits = _bits(n, rate)
        if bits > MOST_BITS:
            return None
        level = Level(len(levels), bits, max(1, round(-math.log2(rate)))).build(inside)
        levels.append(level)
        if rest is None:  # the only level that the whole universe passes through: rejected keys are not shuffled
            rest = universe.where(level.passes(F.col("key"))).distinct().join(inside, "key", "left_anti")
        else:
            rest = rest.where(level.passes(F.col("key")))
        rest = stored(rest, "passed")
        inside, rest, n, rate = rest, inside, rest.count(), 0.5
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """True for listed keys, false for the universe's others: an odd number of levels passed."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def judged(pages: DataFrame, url_col: str = "url", rules=RULES, default: str = "allow") -> DataFrame:
    """The columns of pages, and host, path, rule (the longest fitting rule's host and path, else null), verdict.

    Of rules of one length the one with the longer host wins. Nulls: a null url, or one without "://", has empty host
    and path, and no rule with a path fits it. Repeated rows stay. An empty table, and an empty list of rules, give the
    default for every row. Of rules with one key the verdict `block` wins. Columns of pages that have an output's name
    give way to it.
    """
    spark = pages.sparkSession
    pages = without(pages, *({"host", "path", "rule", "verdict"} - {url_col.lower()}))
    lengths = sorted({len(p) for _, p, _ in rules})
    if not rules:
        return pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col)), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    listed = stored(spark.createDataFrame([(h + p, v) for h, p, v in rules], "key string, verdict string").groupBy("key").agg(F.max("verdict").alias("verdict")), "rules")
    keys = pages.select(F.explode(keys_of(host_of(F.col(url_col)), path_of(F.col(url_col)), lengths)).alias("key"))
    size = keys.agg(F.approx_count_distinct("key")).first()[0]
    levels = cascade(listed.select("key"), keys, size)
    allowed = cascade(listed.where("verdict = 'allow'").select("key"), listed.select("key"), len(rules))
    out = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    rank = lambda k: F.struct(F.length(k).alias("n"), F.instr(F.concat(k, F.lit("/")), "/").alias("h"), k.alias("key"))
    if levels is None or allowed is None:
        return _joined(out, listed, lengths, rank, default)
    hits = F.filter(keys_of(F.col("host"), F.col("path"), lengths), lambda k: member(levels, k))
    out = out.withColumn("rule", F.array_max(F.transform(hits, rank))["key"])
    return out.withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default)).when(member(allowed, F.col("rule")), F.lit("allow")).otherwise(F.lit("block")))


def _joined(out: DataFrame, listed: DataFrame, lengths: list[int], rank, default: str) -> DataFrame:
    """The same answers for lists beyond what filters hold: possible keys of the different (host, path) meet the list."""
    places = stored(out.select("host", "path").distinct(), "places")
    met = places.select("host", "path", F.explode(keys_of(F.col("host"), F.col("path"), lengths)).alias("key")).join(listed, "key")
    best = met.groupBy("host", "path").agg(F.max(F.struct(rank(F.col("key")).alias("r"), "verdict")).alias("b")).select(F.col("host").alias("h_"), F.col("path").alias("p_"), F.col("b.r.key").alias("rule"), F.col("b.verdict").alias("v"))
    out = out.join(stored(best, "best"), (F.col("host") == F.col("h_")) & (F.col("path") == F.col("p_")), "left")
    return out.withColumn("verdict", F.coalesce("v", F.lit(default))).drop("h_", "p_", "v")
