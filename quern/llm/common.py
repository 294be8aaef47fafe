"""What the operators share: shared-folder tables, row numbers, prefix sums, clashing names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words as the contracts define them: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Paths of the tables cut so far. Whoever is done with them calls remove_tables(); the rest go when the driver's JVM ends.
_TABLES: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master may fall back on a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
        named = sc.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This ends the lineage, so a lost executor costs a re-read and never a
    recomputation, and later readers prune columns. An action.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quern-{uuid.uuid4().hex}"
    store, place = _store(spark, path)
    store.deleteOnExit(place)
    _TABLES.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def tables() -> int:
    """How many tables this process has cut and not removed: a mark for ``remove_tables``."""
    return len(_TABLES)


def remove_tables(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Remove the tables cut between two marks. Results that read them must have been written."""
    done = _TABLES[since:upto]
    del _TABLES[since:upto]
    for path in done:
        store, place = _store(spark, path)
        store.delete(place, True)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add dense row numbers from 0 in the given order without a one-partition sort. An action.

    One range exchange of ``df`` (project it narrow first), then a prefix sum
    over one count per partition: that small side is bounded by the number of
    shuffle partitions, so it may be broadcast at any input size.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_start")


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def prefix_sums(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """Add, for each new name, the sum of the named column up to and with each row, in a total order. An action.

    Like ``number_rows``: one range exchange and a side of a row per partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(starts), "_part")
    for k, c in sums.items():
        out = out.withColumn(k, F.sum(c).over(upto) + F.col(f"_b_{k}"))
    return out.drop("_part", "_at", *[f"_b_{k}" for k in sums])


def added(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with new columns, which are computed from the names of ``docs``.

    A column of ``docs`` that has the name of a new one keeps its values under
    that name with ``_input`` behind it (as often as it takes to be unique).
    """
    kept = []
    for c in docs.columns:
        name = c
        while name in columns or (name != c and name in docs.columns):
            name += "_input"
        kept.append(F.col(f"`{c}`").alias(name))
    return docs.select(*kept, *[v.alias(k) for k, v in columns.items()])


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Only ``row``, a struct of all columns of ``docs``, and new columns, computed from the names of ``docs``: no names can clash. ``select("row.*")`` undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names made of the given ones that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out
