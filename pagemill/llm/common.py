"""What the operators of this subpackage share: reading, shared tables, packing of arrays."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import place, shared_dir

#: Rows in one Arrow batch; texts can be long, so a batch of Spark's default 10,000 rows could outgrow a worker.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that a Python worker's memory has a bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """key is value within the block only."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and return it as read from there: lineage is cut, lost executors cost nothing.

    by: a column of few values by which the table is partitioned, so that readers of one value skip the others.
    """
    spark = df.sparkSession
    path = place(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for dropped()
    return out


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Like stored(), dealt into buckets by keys, each sorted by them: joins on keys of two such tables move and sort
    nothing."""
    spark = df.sparkSession
    table = f"pagemill_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    out = spark.table(table)
    out._stored_at, out._table = path, table
    return out


def dropped(df: DataFrame) -> None:
    """Delete what stored() or bucketed() wrote; only for tables that no later plan reads."""
    spark, path = df.sparkSession, df._stored_at
    if hasattr(df, "_table"):
        spark.sql(f"DROP TABLE {df._table}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns (in any case) that an operator is about to add: its own outputs win over clashing inputs."""
    gone = {n.lower() for n in names}
    return df.select(*[f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in gone])


def varints(values: np.ndarray) -> bytes:
    """LEB128 of non-negative integers below 2**28."""
    v = values.astype(np.uint32)
    size = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    first = end - size
    for k in range(4):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[first[has] + k] = ((v[has] >> np.uint32(7 * k)) & np.uint32(127)).astype(np.uint8) | more
    return out.tobytes()


def unvarints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.uint32)
    for k in range(4):
        at = first + k
        has = at <= last
        out[has] |= (b[at[has]] & np.uint32(127)).astype(np.uint32) << np.uint32(7 * k)
    return out
