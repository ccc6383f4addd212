"""Tables written once and read again, in the folder that driver and executors share, and joins that stand skew."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has more than 1/HOT_PARTS of all rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all is in one JVM, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lexirun-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows joined with other on key; rows, written before, may have any number of rows with one key, other has few.

    The rows of a hot key are dealt to several places, to each of which its rows of other are copied.
    """
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") * HOT_PARTS > total)
    hot = written(hot.select(key, F.ceil(F.col("__n") * HOT_PARTS / F.lit(max(1, total))).cast("int").alias("__parts")))
    place = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts")), F.lit(0)).cast("bigint")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__place", place).drop("__parts")
    places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__parts", F.lit(1)).cast("bigint") - 1))
    copied = other.join(F.broadcast(hot), key, "left").withColumn("__place", places).drop("__parts")
    return dealt.join(copied, [key, "__place"]).drop("__place")
