"""The audit log: JSON lines by day, plain or gzip, and where its old days are compacted to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, actor string, action string, page_id string, detail string"


def append(events: DataFrame, folder: str) -> None:
    """Events added to the files of their days."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(folder)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All events with their day; reads of some days touch the files of these days only."""
    return spark.read.schema(f"{SCHEMA}, day date").json(folder)


def history(events: DataFrame, page_id: str | None = None, actor: str | None = None, since: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, filtered by what is given."""
    for column, value in (("page_id", page_id), ("actor", actor)):
        events = events if value is None else events.filter(F.col(column) == value)
    events = events if since is None else events.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    return events.orderBy(F.desc("ts"), "page_id", "action").limit(limit)


def _archive(spark: SparkSession, target: str) -> DataFrame | None:
    """The compacted events, each with the name of the log's file that it came from; None if there are none yet."""
    files = _files(spark, target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return spark.read.schema(f"{SCHEMA}, file string, day date, batch string").json(target) if files.exists(path) and len(files.listStatus(path)) else None


def _files(spark: SparkSession, folder: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder).select("*", F.col("_metadata.file_name").alias("file"))


def compact(spark: SparkSession, folder: str, target: str, before: str) -> int:
    """Moves the events of the days before a date to target, gzipped; gives the number of days of which any were moved.

    What a day's files hold is written aside, then put into target by one rename, as a batch of its own beside earlier
    ones, and only then the files go. An archived event names the file that it came from, so after a failure between the
    last two steps its file counts as moved: read_all passes it over, and the next run deletes it. Events that come late
    for a day that was compacted before make another batch of it.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files, moved = _files(spark, folder), 0
    log = _named(spark, folder).filter(F.col("day") < F.lit(before).cast("date")).select(F.col("day").cast("string").alias("day"), "file").distinct()
    archive = _archive(spark, target)
    done = set() if archive is None else {tuple(r) for r in log.join(archive.select(F.col("day").cast("string").alias("day"), "file").distinct(), ["day", "file"], "left_semi").collect()}
    by_day: dict[str, list[str]] = {}
    for day, file in log.collect():  # names of files alone
        if (day, file) in done:
            files.delete(path(f"{folder}/day={day}/{file}"), False)
        else:
            by_day.setdefault(day, []).append(file)
    for day, names in sorted(by_day.items()):
        batch = uuid.uuid4().hex
        rows = _named(spark, folder).filter(F.col("day") == F.lit(day).cast("date")).filter(F.col("file").isin(names)).drop("day")
        rows.write.option("compression", "gzip").json(f"{target}/_staged/{batch}")
        files.mkdirs(path(f"{target}/day={day}"))
        if not files.rename(path(f"{target}/_staged/{batch}"), path(f"{target}/day={day}/batch={batch}")):
            raise OSError(f"day {day} could not be put into {target}")
        for name in names:
            files.delete(path(f"{folder}/day={day}/{name}"), False)
        moved += 1
    return moved


def read_all(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """The events of a log and of its compacted days, each once."""
    archive = _archive(spark, target)
    if archive is None:
        return scan(spark, folder)
    taken = archive.select("day", "file").distinct()
    return _named(spark, folder).join(taken, ["day", "file"], "left_anti").drop("file").unionByName(archive.drop("file", "batch"))


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a stream."""
    return spark.readStream.schema(f"{SCHEMA}, day date").json(folder)
