"""Stored history: trades in monthly partitions that are merged by id, their manifest, deletion, and the retention of archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_DELETED = 1000


def month_of(closed_at: Column) -> Column:
    """The partition of a trade: its month in UTC, or "unknown"."""
    return F.coalesce(F.date_format(closed_at, "yyyy-MM"), F.lit("unknown"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both with new rows in place of old ones of the same id; rows without an id or a date are dropped. Adds month."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).where("id is not null and closed_at is not null")
    last = Window.partitionBy("id").orderBy(F.desc("_new"), F.desc("closed_at"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new").withColumn("month", month_of(F.col("closed_at")))


def upsert(spark: SparkSession, path: str, new: DataFrame) -> list[str]:
    """Merge into the table at the path, which need not exist; only months that the new rows, or the old rows of their ids, are in are written. Returns these."""
    new = new.where("id is not null and closed_at is not null").withColumn("month", month_of(F.col("closed_at")))
    try:
        old = spark.read.schema(new.schema).parquet(path)
        moved = old.join(new.select("id"), "id", "left_semi").select("month")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old, moved = new.limit(0), new.limit(0).select("month")
    months = sorted(r[0] for r in new.select("month").unionAll(moved).distinct().collect())  # at most one a month of the history
    if not months:
        return []
    touched = merged(old.where(F.col("month").isin(months)).drop("month"), new.drop("month"))
    _overwrite(touched, path, months, spark)
    return months


def _overwrite(rows: DataFrame, path: str, months: list[str], spark: SparkSession) -> None:
    """The partitions are written aside first, for the rows come from the table itself."""
    aside = f"{path.rstrip('/')}.next"
    rows.repartition("month").sortWithinPartitions("month", "closed_at", "id").write.mode("overwrite").partitionBy("month").parquet(aside)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for m in months:
        part = f"month={m}"
        fs.mkdirs(fs_path(path))
        fs.delete(fs_path(f"{path}/{part}"), True)
        if fs.exists(fs_path(f"{aside}/{part}")):
            fs.rename(fs_path(f"{aside}/{part}"), fs_path(f"{path}/{part}"))
    fs.delete(fs_path(aside), True)


def delete(spark: SparkSession, path: str, ids: list[int]) -> int:
    """Delete trades by their ids, at most MOST_DELETED at a time; returns how many there were."""
    if len(ids) > MOST_DELETED:
        raise ValueError(f"at most {MOST_DELETED} ids")
    old = spark.read.parquet(path)
    gone = old.where(F.col("id").isin(ids)).groupBy("month").count().collect()
    if gone:
        months = [r["month"] for r in gone]
        _overwrite(old.where(F.col("month").isin(months) & ~F.col("id").isin(ids)), path, months, spark)
    return sum(r["count"] for r in gone)


def manifest(trades: DataFrame) -> DataFrame:
    """Records, first and last date of each month, and of all as month "total"; bytes of the files where the table is one of files."""
    aggs = [F.count(F.lit(1)).alias("records"), F.min("closed_at").alias("first_closed_at"), F.max("closed_at").alias("last_closed_at")]
    return trades.groupBy("month").agg(*aggs).unionByName(trades.agg(*aggs).withColumn("month", F.lit("total")).where("records > 0"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of the files of each month."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "month=([^/]+)", 1).alias("month")).agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))


def retained(archives: DataFrame, keep: int, most_bytes: int) -> DataFrame:
    """archives (log, path, at, size): whether each is kept. The newest of a log are kept while their number and bytes allow; one that is too large is passed over, and older, smaller ones may still be kept."""
    a = archives.groupBy("log").agg(F.sort_array(F.collect_list(F.struct("at", "path", "size")), asc=False).alias("files"))
    state = F.aggregate(
        "files", F.struct(F.lit(0).cast("bigint").alias("bytes"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("kept")),
        lambda acc, f: F.struct(*(lambda ok: [F.when(ok, acc["bytes"] + f["size"]).otherwise(acc["bytes"]).alias("bytes"), F.when(ok, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.concat(acc["kept"], F.array(ok)).alias("kept")])((acc["n"] < keep) & (acc["bytes"] + f["size"] <= most_bytes))),
        lambda acc: acc["kept"],
    )
    return a.select("log", F.inline(F.arrays_zip(F.col("files"), state.alias("kept")))).select("log", "files.path", "files.at", "files.size", "kept")
