"""Plumbing that the operators of this subpackage share: cutting lineage, and joins that stand skew."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..plans.store import shared_dir

#: A table of at most this many rows and bytes may be broadcast; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: A group is hot when it holds more than 1/HOT_PARTS of all rows, so there are fewer than HOT_PARTS hot groups.
HOT_PARTS = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The tables whose rows take work enough to be dealt anew where their files make fewer tasks than there are cores.
LARGE = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in LARGE and df.rdd.getNumPartitions() < cores else df


#: The tables that cut() wrote since the scopes that are open began, innermost last.
_scopes: list[list[DataFrame]] = []


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: lost executors cost no more than a task."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more; once deleted, a table is no scope's."""
    gone = {df.cut_path for df in tables}
    for scope in _scopes:
        scope[:] = [df for df in scope if df.cut_path not in gone]
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """Tables cut within are deleted at its end, but for those given to the function that it yields, which pass to the scope around it, if any."""
    _scopes.append([])
    kept: list[DataFrame] = []
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        made, paths = _scopes.pop(), {df.cut_path for df in kept}
        discard(*[df for df in made if df.cut_path not in paths])
        if _scopes:
            _scopes[-1].extend(df for df in made if df.cut_path in paths)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing needs any more; it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of so many rows, so that what a worker makes of them at a time stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def spread_of(groups: DataFrame, weight: str, total: int) -> DataFrame:
    """Of groups (keys and weight, the number of rows with the keys) the hot ones, with __parts: over how many places to spread their rows.

    A place gets at most total / HOT_PARTS rows, so there are fewer than HOT_PARTS hot groups, and fewer than
    2 * HOT_PARTS places. The result has the keys and __parts only, and may be broadcast.
    """
    parts = F.ceil(F.col(weight) * HOT_PARTS / F.lit(total)).cast("int")
    return cut(groups.filter(F.col(weight) * HOT_PARTS > F.lit(total)).select(*[c for c in groups.columns if c != weight], parts.alias("__parts")))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """rows left-joined with groups, which have a key once; hot: what spread_of found of the keys among rows.

    Rows of a hot key are dealt to its places, to each of which its group is copied, so none gathers in one task.
    Rows with a null in their key match nothing and are dealt over all tasks.
    """
    row = F.xxhash64(F.monotonically_increasing_id())
    place = F.when(F.col("__parts").isNotNull(), F.pmod(row, F.col("__parts"))).otherwise(F.lit(0))
    null = F.lit(False)
    for k in keys:
        null |= F.col(k).isNull()
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__place", F.when(null, -1 - F.pmod(row, F.lit(1_000_003))).otherwise(place).cast("bigint")).drop("__parts")
    copied = groups.join(F.broadcast(hot), keys, "left").withColumn("__place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__parts", F.lit(1)).cast("bigint") - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__place"], "left").drop("__place")


def _width(kind: DataType, value: Column) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(0))
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return F.greatest(F.size(value), F.lit(0)) * 8 + 16
    return F.lit(8)


def fits(df: DataFrame, times: int = 1) -> bool:
    """Whether df, cut before, may be broadcast: its rows (to times BROADCAST_ROWS) and bytes are counted."""
    width = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0))
    rows, bytes_ = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    return rows <= BROADCAST_ROWS * times and bytes_ <= BROADCAST_BYTES


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int | None = None) -> DataFrame:
    """rows left-joined with groups (one row per key, cut before; weight: how many rows have the key).

    Few groups are broadcast; otherwise hot keys are spread, see spread_join. total: how many rows there are; if
    unknown they are counted, and only where they are spread.
    """
    if fits(groups):
        return rows.join(F.broadcast(groups), keys, "left")
    total = max(1, rows.count()) if total is None else total
    added = [c for c in groups.columns if c not in keys]
    return spread_join(rows, groups, keys, spread_of(groups.select(*keys, weight), weight, total)).select(*rows.columns, *added)


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows left-joined with groups (one row per key), both cut before; as attach, but the weights are counted here, and only where they are needed."""
    if fits(groups):
        return rows.join(F.broadcast(groups), keys, "left")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    return spread_join(rows, groups, keys, spread_of(sizes, "__n", max(1, rows.count())))


def only_ids(rows: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """rows whose key is in ids (or, left_anti, isn't); ids was cut before, has no key twice, and is broadcast if it fits."""
    return rows.join(F.broadcast(ids) if fits(ids, 10) else ids, key, how)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs with each row as one struct, `row`, beside columns of our own: no name in docs can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by its id and text, never null; rows equal in both are one."""
    parts = [F.isnull(doc_id), doc_id, F.isnull(text), text]
    return F.struct(F.xxhash64(*parts).alias("k1"), F.xxhash64(*reversed(parts), F.lit("second")).alias("k2"))


def keep_where(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[str], bool]], rows: int = 256) -> DataFrame:
    """The rows of docs, all columns, whose text passes: judge() is called once in a task and gives the test. A null text is empty.

    Each row is judged where it lies, so nothing is shuffled and rows that share an id, or have none, don't share a fate.
    """
    at = docs.columns.index(text_col)

    def kept(batches):
        passes = judge()
        for b in slices(batches, rows):
            yield b.filter(pa.array([passes(t.as_py() or "") for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
