"""Incremental table profile: the daily counts and reading statistics of a growing readings table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.functions.calendar import DAY, epoch_seconds
from panelworks.scale import scratch_path


def read_file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def daily_profile(
    stream: DataFrame,
    ts: str,
    value: str,
    groups: Sequence[str],
    watermark: str | None = "2 days",
    window: str = "1 day",
) -> DataFrame:
    """Rows, range and sum of readings per day and group; works on streams and on static tables.

    Wall-clock time is taken for UTC, in which windows are cut at midnight, so the session time zone does not matter.
    """
    timed = stream.withColumn("_time", F.timestamp_seconds(epoch_seconds(F.col(ts))))
    if stream.isStreaming and watermark:
        timed = timed.withWatermark("_time", watermark)
    return (
        timed.groupBy(F.window("_time", window).alias("_window"), *groups)
        .agg(
            F.count("*").alias("row_count"),
            F.min(value).alias("reading_min"),
            F.max(value).alias("reading_max"),
            F.sum(value).alias("reading_sum"),
        )
        .select(F.date_from_unix_date(F.floor(F.unix_seconds("_window.start") / DAY).cast("int")).alias("date"), *groups, "row_count", "reading_min", "reading_max", "reading_sum")
    )


def write_in_order(rows: DataFrame, ts: str, slices: int, label: str) -> Iterator[str]:
    """Write rows into a folder, one time slice after the other; the folder is given after each slice, for a stream to read.

    A slice is as many files as the shuffle has partitions, each a range of times.
    """
    folder = scratch_path(rows.sparkSession, label)
    second = epoch_seconds(F.col(ts))
    first, last = rows.agg(F.min(second), F.max(second)).first()
    if first is None:
        rows.write.parquet(folder)
        yield folder
        return
    step = (last - first) // slices + 1
    for start in range(first, last + 1, step):
        part = rows.filter((second >= start) & (second < start + step))
        part.repartitionByRange(ts).write.mode("append").parquet(folder)
        yield folder


def run_to_table(stream: DataFrame, label: str, mode: str = "append", folder: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Drain the available input and return the result so far; a run with the ``folder`` of an earlier one goes on there.

    In append mode each batch is written to its own folder named by its number, so a repeated batch overwrites itself and the
    result is exactly once. In update mode there is one current table with a row of each of ``keys``: a batch is merged into
    the version before it and written as the version of its own number, so a repeated batch makes the same version again.
    Readers take the newest finished version; all but the one before it are removed.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number:012d}")

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = [v for v in _versions(session, folder) if v < number]
        rows = batch
        if earlier:
            old = session.read.schema(stream.schema).parquet(_version(folder, earlier[-1]))
            same = [old[k].eqNullSafe(batch[k]) for k in keys]
            rows = old.join(batch, same, "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(_version(folder, number))
        for version in earlier[:-1]:
            _files(session, folder)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(_version(folder, version)), True)

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(merge if mode == "update" else keep)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if mode == "update":
        versions = _versions(spark, folder)
        return spark.read.schema(stream.schema).parquet(_version(folder, versions[-1])) if versions else spark.createDataFrame([], stream.schema)
    files, path = _files(spark, f"{folder}/rows")
    if not files.exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _version(folder: str, number: int) -> str:
    return f"{folder}/current/version={number:012d}"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions of a current table, in order."""
    files, path = _files(spark, f"{folder}/current")
    if not files.exists(path):
        return []
    numbers = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(path)]
    jvm = spark.sparkContext._jvm
    return sorted(n for n in numbers if files.exists(jvm.org.apache.hadoop.fs.Path(f"{_version(folder, n)}/_SUCCESS")))
