"""Readers and writers for the raw tables, the split tables and JSON summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

READINGS_SCHEMA = "building_id int, meter int, timestamp timestamp_ntz, meter_reading double"
BUILDINGS_SCHEMA = (
    "site_id int, building_id int, primary_use string, square_feet int, year_built double, floor_count double"
)
WEATHER_SCHEMA = (
    "site_id int, timestamp timestamp_ntz, air_temperature double, cloud_coverage double, dew_temperature double, "
    "precip_depth_1_hr double, sea_level_pressure double, wind_direction double, wind_speed double"
)


def read_csv_table(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema; only the wanted columns are parsed."""
    table = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return table.select(*columns) if columns else table


def read_raw_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings, weather and buildings from their CSV files."""
    return (
        read_csv_table(spark, f"{folder}/train.csv", READINGS_SCHEMA),
        read_csv_table(spark, f"{folder}/weather_train.csv", WEATHER_SCHEMA),
        read_csv_table(spark, f"{folder}/building_metadata.csv", BUILDINGS_SCHEMA),
    )


def assert_same_columns(expected: DataFrame, other: DataFrame, name: str) -> None:
    """Raise unless a split has exactly the columns of the training split, in the same order."""
    if expected.columns != other.columns:
        odd = sorted(set(expected.columns) ^ set(other.columns))
        raise ValueError(f"{name} split columns differ from the train split columns: {odd or other.columns}")


def read_splits(
    spark: SparkSession,
    train: str,
    valid: str,
    test: str,
    ts: str = "timestamp",
    target: str = "meter_reading",
    file_format: str = "csv",
) -> DataFrame:
    """Three split tables as one, with a ``split`` column, after the column check.

    Timestamp and target are cast; the order of columns is target first, then the features.
    """
    splits = {}
    for name, path in {"train": train, "valid": valid, "test": test}.items():
        reader = spark.read.option("header", True) if file_format == "csv" else spark.read
        table = reader.format(file_format).load(path)
        if splits:
            assert_same_columns(splits["train"], table, name)
        splits[name] = table
    features = [c for c in splits["train"].columns if c not in (ts, target)]
    typed = [
        table.select(
            F.col(ts).cast("timestamp_ntz").alias(ts),
            F.col(target).cast("double").alias(target),
            *[F.col(c).cast("double").alias(c) for c in features],
            F.lit(name).alias("split"),
        )
        for name, table in splits.items()
    ]
    return typed[0].unionByName(typed[1]).unionByName(typed[2])


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("split",), file_format: str = "parquet"
) -> None:
    """Replace a table, one folder per split, so that later reads prune whole splits."""
    writer = df.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    columns = [c for c in partition_by if c in df.columns]
    (writer.partitionBy(*columns) if columns else writer).save(path)


def reload_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a snapshot and read it back."""
    write_table(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_json(df: DataFrame, path: str) -> None:
    """Write a summary table as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_json_summary(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """Read a JSON summary; a missing file gives an empty table."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def sample_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(*order).limit(n)


def column_list(df: DataFrame) -> DataFrame:
    """Column names and types, without touching the data."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")
