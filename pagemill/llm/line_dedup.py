"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A run holds, bucketed and sorted by the 128-bit hash of a line's key, the state of keys as of its batch: in how many
documents so far, and the largest of their ids. Documents come in batches. A batch's own keys are merge-joined with the
runs so far, newest first: a key that no run holds is a first sighting, another's state is carried on. The batch's run
has the new states; older rows of its keys are stale, and a merge-anti-join with the newer run takes them out wherever
runs come together: when as many runs of one level as the fan-out are compacted to one of the next, and at the end. So a
key's newest row is its answer and nothing is added up again. Joins read buckets in their order: old runs are neither
moved nor sorted. Runs hold hashes and two numbers, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, dropped, setting, stored, without

BLANK, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY, ROW = ["h1", "h2"], ["__t1", "__t2", "__id"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


#: Lets a scan of buckets of one file each tell its order, so that merge joins need no sort.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Runs:
    """The levelled store of runs (h1, h2, docs, top), each bucketed and sorted by its hash."""

    def __init__(self, buckets: int, fan_out: int = 2):
        self.buckets, self.fan_out, self.levels = buckets, fan_out, []

    def newest_first(self) -> list[DataFrame]:
        return [r for level in self.levels for r in reversed(level)]

    def add(self, lines: DataFrame) -> None:
        """Take in lines(h1, h2, id) of a batch whose documents are in no other batch."""
        own = lines.distinct().groupBy(*KEY).agg(F.count("id").alias("docs"), F.max("id").alias("top"))
        own = bucketed(own, "run", KEY, self.buckets)
        runs = self.newest_first()
        if runs:
            with setting(own.sparkSession, ORDERED, "true"):
                run = bucketed(carried(own, runs), "run", KEY, self.buckets)
            dropped(own)
            own = run
        self._push(own, 0)

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            olds, self.levels[level] = self.levels[level], []
            with setting(run.sparkSession, ORDERED, "true"):
                merged = bucketed(current(olds[::-1]).repartition(self.buckets, *KEY), "run", KEY, self.buckets)
            for r in olds:
                dropped(r)
            self._push(merged, level + 1)

    def states(self) -> DataFrame:
        """(h1, h2, docs, top) of every key, once."""
        return current(self.newest_first())


def carried(own: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """own's keys with their new states; runs: newest first."""
    out = own
    for i, r in enumerate(runs):
        out = out.join(r.select(*KEY, F.col("docs").alias(f"docs{i}"), F.col("top").alias(f"top{i}")).hint("merge"), KEY, "left")
    before, top = (F.coalesce(*[F.col(f"{c}{i}") for i in range(len(runs))]) for c in ("docs", "top"))
    return out.select(*KEY, (F.col("docs") + F.coalesce(before, F.lit(0))).alias("docs"), F.greatest("top", top).alias("top"))


def current(runs: list[DataFrame]) -> DataFrame:
    """Rows of runs, newest first, that no newer run's row of the same key makes stale."""
    out = runs[0]
    for i, r in enumerate(runs[1:], 1):
        for newer in runs[:i]:
            r = r.join(newer.select(*KEY).hint("merge"), KEY, "left_anti")
        out = out.unionByName(r)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """The columns of docs, the text less its dropped lines, and n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least min_chars code
    points in at least min_docs documents lose their lines except in the largest id holding them, where all stay.
    Nulls: a null text counts as one empty line and becomes the empty text; a row without id counts as no document and
    keeps no line of such a key. Rows that share an id count as one document. If every line goes, the text is empty. An
    empty table gives an empty result. Columns of docs that have an output's name give way to it.
    """
    docs = without(docs, "n_lines", "n_dropped", "__pos", "__gone", *ROW)
    # a row is known by its id and its text's hashes: rows that share both lose the same lines, and nothing has to be
    # written to keep a row's number
    rows = docs.withColumn(text_col, F.coalesce(text_col, F.lit(""))).withColumns({"__t1": F.xxhash64(text_col), "__t2": F.xxhash64(F.lit(1), F.col(text_col)), "__id": F.col(id_col)})
    lines = rows.select(*ROW, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    keyed = lines.select(*ROW, "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("__id"), F.lit(batches)).cast("int").alias("batch"))
    hashed = stored(hashed, "lines", by="batch")
    runs = Runs(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), fan_out)
    for b in range(batches):
        runs.add(hashed.where(F.col("batch") == b).select(*KEY, F.col("__id").alias("id")))
    # written, so that the join deals out both sides anew and Spark can split the tasks of a line that very many hold
    with setting(docs.sparkSession, ORDERED, "true"):
        going = stored(runs.states().where(F.col("docs") >= min_docs).select(*KEY, "top"), "going")
    for r in runs.newest_first():
        dropped(r)
    gone = hashed.join(going, KEY).where(~F.col("__id").eqNullSafe(F.col("top")))
    places = gone.groupBy(*ROW).agg(F.collect_set("pos").alias("__gone")).toDF(*(f"{c}_" for c in ROW), "__gone")  # at most the lines of one document
    same = F.col("__t1").eqNullSafe(F.col("__t1_")) & F.col("__t2").eqNullSafe(F.col("__t2_")) & F.col("__id").eqNullSafe(F.col("__id_"))
    out = rows.join(places, same, "left")
    split = F.split(text_col, "\n", -1)
    parts = F.array(F.struct(split.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone")).alias("kept")))
    rebuilt = F.transform(parts, lambda s: F.array_join(F.transform(s["kept"], lambda i: F.get(s["lines"], i)), "\n"))[0]
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(rebuilt)
    counted = (F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1).cast("long")
    names = [F.col(f"`{c}`") if c != text_col else text.alias(text_col) for c in docs.columns]
    return out.select(*names, counted.alias("n_lines"), F.coalesce(F.size("__gone").cast("long"), F.lit(0).cast("long")).alias("n_dropped"))
