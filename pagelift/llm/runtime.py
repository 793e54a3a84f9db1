"""What the operators of this subpackage share: tables in the shared folder, size-checked joins, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows of ids or groups that are broadcast: 8 to 60 bytes a row, so a few tens of MB at most.
BROADCAST_ROWS = 200_000
#: Most ids (one 64-bit integer a row) that are broadcast: some 30 MB.
BROADCAST_IDS = 1_000_000
#: Text bytes that a Python worker handles at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder is taken in local mode, in which one machine is all there is; on a
    cluster that is an error, since no machine sees another's temporary folder.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{key} must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="pagelift-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagelift/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of a bounded number of rows and bytes for the Python stages that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it has fewer partitions than there are cores (one small file), as the work is in the maps."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // per_partition))


def semi_join(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is among ids (distinct, n_ids rows): broadcast up to BROADCAST_IDS, shuffled beyond."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, "left_semi")


def null_safe(col: Column) -> Column:
    """A long with null as the least number, so that a join by equality finds it."""
    return F.coalesce(col.cast("long"), F.lit(-(2**63)).cast("long"))


def without(df: DataFrame, keys: dict[str, Column], gone: DataFrame, twice: DataFrame | None = None) -> DataFrame:
    """Rows of df without those whose keys are in gone; of rows with keys in twice one stays. All columns are kept.

    keys: names (that df doesn't have) of the expressions over df that tell rows apart; they are never null. Both
    tables are worked out once, and broadcast only after a count.
    """
    names = list(keys)
    rows = df.withColumns(keys)

    def sized(ids: DataFrame, name: str) -> tuple[DataFrame, int]:
        ids = materialize(ids.select(*names).distinct(), name)
        n = ids.count()
        return (F.broadcast(ids) if n <= BROADCAST_ROWS else ids), n

    gone, n_gone = sized(gone, "gone")
    twice, n_twice = (None, 0) if twice is None else sized(twice, "twice")
    if n_gone:
        rows = rows.join(gone, names, "left_anti")
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not n_twice:
        return rows.select(*columns)
    one = rows.join(twice, names, "left_semi").groupBy(*names).agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
    return rows.join(twice, names, "left_anti").select(*columns).unionByName(one)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows left-joined to groups, of which there is one for each key; size: its column with the rows of a group, total:
    all rows, so that the sizes add up to no more.

    A group of over a thousandth of all rows is joined by broadcast (there are at most a thousand), so that no task
    gets all rows of a frequent key; the others are shuffled.
    """
    limit = max(1000, total // 1000)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    rest = groups.filter(F.col(size) <= limit)
    return rows.join(hot, keys, "inner").unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, "left"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has at most limit bytes in a text or binary column, or a single row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers are used again from stage to stage, and would keep
    what they had at their peak beside a JVM that keeps its heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries do not have it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: int | None = None) -> DataFrame:
    """mapInArrow with f on each batch, or on slices of bounded size if text is the place of the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in [batch] if text is None else slices(batch, text):
                if part.num_rows and (out := f(part)) is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def attach_sized(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, n_groups: int) -> DataFrame:
    """As attach; up to BROADCAST_ROWS groups are broadcast whole, so that rows are not shuffled."""
    return rows.join(F.broadcast(groups), keys, "left") if n_groups <= BROADCAST_ROWS else attach(rows, groups, keys, size, total)


#: Rows of a running sum that one task sorts.
RUNNING_ROWS = 200_000


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with a column of the sum up to and with each row, for each of sums; order tells all rows apart.

    Rows are dealt by ranges of the order and written, so that ranges stay what they are; a task sums its own range, to
    which the sum of the ranges before it is added (one row a range). No task gets all rows.
    """
    n = partitions_for(df.count(), RUNNING_ROWS)
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id()), name)
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy("range_").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    each = each.select("range_", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums))
    own = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumns({k: F.sum(c).over(own) for k, c in sums.items()}).join(F.broadcast(each), "range_")
    return rows.withColumns({k: F.col(k) + F.col(f"{k}_before") for k in sums}).drop("range_", *(f"{k}_before" for k in sums))
