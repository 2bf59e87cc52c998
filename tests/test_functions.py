"""Scalar expressions, screening, splits and scaling against fixed cases."""

import datetime as dt
import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelworks.functions import bins, calendar, scaling
from panelworks.operators import enrich, screening, splits, summaries
from panelworks.plans.preparation import prepare_splits
from panelworks.sources import tables

READINGS = "building_id int, meter int, timestamp timestamp_ntz, meter_reading double"


def hours(n, building=100, meter=1, start=0):
    return [(building, meter, f"2016-01-{1 + h // 24:02d} {h % 24:02d}:00:00", float(h + 1)) for h in range(start, start + n)]


def frame(spark, rows, schema="building_id int, meter int, timestamp string, meter_reading double"):
    return spark.createDataFrame(rows, schema).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def test_calendar_uses_iso_week_and_monday_zero(spark):
    row = frame(spark, hours(1)).select(*[c.alias(n) for n, c in calendar.calendar_columns(F.col("timestamp")).items()]).first()
    assert row["day_week"] == 4 and row["weekofyear_datetime"] == 53 and row["week_month_datetime"] == 1


def test_epoch_seconds_ignore_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:15' AS t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        seconds, hour = df.select(calendar.epoch_seconds(F.col("t")), calendar.floor_hour(F.col("t")).cast("string")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seconds == 1711852215 and hour == "2024-03-31 02:00:00"


def test_bins(spark):
    df = spark.createDataFrame([(0.0, 0.29), (359.9, 0.3), (-1.0, 33.0), (None, None)], "d double, s double")
    rows = df.select(bins.compass_sector(F.col("d")), bins.beaufort_number(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (15, 1), (0, 12), (None, None)]


def test_scaling_identities(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (250.0,)], "y double")
    low, high = F.lit(0.5), F.lit(4.0)
    back = scaling.inverse_log_minmax(scaling.minmax(F.log1p("y"), low, high), low, high)
    for row in df.select("y", back.alias("b")).collect():
        assert row["b"] == pytest.approx(row["y"])
    assert df.select(scaling.minmax(F.col("y"), low, F.lit(0.5))).first()[0] == 0.0
    row = df.select(scaling.inverse_log_minmax(F.lit(1.0), F.lit(0.0), F.lit(math.log(10)))).first()
    assert row[0] == pytest.approx(9.0)


def test_tolerant_cast_and_zscore(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(scaling.to_number(F.col("v"))).collect()] == [1.5, None, None, None]
    zero = df.select(scaling.zscore(scaling.to_number(F.col("v")), F.lit(1.0), F.lit(0.5))).collect()
    assert [r[0] for r in zero] == [1.0, 0.0, 0.0, 0.0]


def test_hard_threshold_includes_the_threshold(spark):
    df = spark.createDataFrame([(0.2, 0.49), (0.4, 0.5), (0.6, 0.9)], "p double, z double")
    assert [r[0] for r in df.select(scaling.hard_threshold(F.col("p"), F.col("z"))).collect()] == [0.2, 0.0, 0.0]


def test_gates_do_not_overflow(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double")
    rows = df.select(scaling.sigmoid(F.col("x")), scaling.softplus(F.col("x"))).collect()
    assert [r[0] for r in rows] == pytest.approx([0.0, 0.5, 1.0])
    assert [r[1] for r in rows] == pytest.approx([0.0, math.log(2), 800.0])


def test_screening_keeps_null_ids_and_drops_null_meters(spark):
    rows = [(1, 0), (803, 0), (None, 0), (1, None), (1, 2)]
    df = spark.createDataFrame(rows, "building_id int, meter int")
    kept = screening.keep_entities(df, 0, screening.EXCLUDED_BUILDING_IDS).collect()
    assert sorted((r[0] for r in kept), key=str) == [1, None]
    report = screening.screening_report(df, 0, screening.EXCLUDED_BUILDING_IDS).first()
    assert (report["total_rows"], report["kept_rows"], report["removed_rows"], report["kept_percent"]) == (5, 2, 3, 40.0)


def test_screen_split_and_scale(spark):
    rows = hours(10) + hours(1, 200, 0) + hours(1, 803, 1)
    df = frame(spark, rows).filter("meter = 1")
    prepared = prepare_splits(df, screening.EXCLUDED_BUILDING_IDS)
    counts = {r["split"]: r["n"] for r in prepared.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": 8, "valid": 1, "test": 1}
    assert prepared.filter("building_id = 803").count() == 0
    row = prepared.filter("split = 'valid'").first()
    assert row["target_min"] == pytest.approx(0.693147, abs=1e-6)
    assert row["target_max"] == pytest.approx(2.197225, abs=1e-6)
    assert row["meter_reading"] == pytest.approx(1.070050, abs=1e-6)


def test_split_errors(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        splits.time_split(frame(spark, hours(10)), "timestamp", ratios=(0.5, 0.1, 0.1))
    with pytest.raises(ValueError, match="empty"):
        splits.time_split(frame(spark, hours(2)), "timestamp")
    with pytest.raises(ValueError, match="distinct timestamps"):
        splits.time_blocks(frame(spark, hours(5)), "timestamp")


@pytest.mark.parametrize("bad, word", [(None, "missing"), (-1.0, "negative")])
def test_target_check(spark, bad, word):
    with pytest.raises(ValueError, match=word):
        splits.check_target(spark.createDataFrame([(1.0,), (bad,)], "meter_reading double"), "meter_reading")


def test_parameters_come_from_training_rows_only(spark):
    df = splits.time_split(frame(spark, hours(40)), "timestamp")
    changed = df.withColumn("meter_reading", F.when(F.col("split") == "train", F.col("meter_reading")).otherwise(9999.0))
    for fit in (lambda d: splits.fit_target_range(d, "meter_reading"), lambda d: splits.fit_scaler(d, ["meter_reading"]),
                lambda d: splits.fit_imputed_scaler(d, ["meter_reading"])):
        assert fit(df).collect() == fit(changed).collect()


def test_scaler_defaults(spark):
    df = spark.createDataFrame([("train", 5.0, None), ("train", 5.0, None)], "split string, a double, b double")
    values = splits.scaler_values(splits.fit_scaler(df, ["a", "b"]))
    assert values == {"a": (5.0, 1.0), "b": (0.0, 1.0)}


def test_label_codes_agree_on_both_paths(spark):
    df = spark.createDataFrame([(chr(97 + i % 7) * (1 + i % 3),) for i in range(60)] + [(None,)], "v string")
    short = {r["v"]: r["code"] for r in enrich.value_codes(df, "v").collect()}
    long = {r["v"]: r["code"] for r in enrich.value_codes(df, "v", row_limit=3).collect()}
    assert short == long == {v: i for i, v in enumerate(sorted(short))}
    coded = enrich.encode_labels(df, "v")
    assert coded.columns == ["v"] and coded.filter("v IS NULL").count() == 1


def test_missing_flags_only_for_columns_with_gaps(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 2.0, None)], "a int, b double, c string")
    assert enrich.missing_flags(df).columns == ["a", "b", "c", "b_missing", "c_missing"]


def test_named_flags_are_there_without_gaps(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None)], "a int, b double, c string")
    flagged = enrich.missing_flags(df, always=["b"])
    assert flagged.columns == ["a", "b", "c", "b_missing", "c_missing"]
    assert [r["b_missing"] for r in flagged.collect()] == [0, 0]


def test_queries_name_their_flags_where_nothing_is_missing(spark, tmp_path):
    from panelworks.catalogue import all_queries

    customers = [(k, f"c{k}", k % 2, 10.0 + k, "AB"[k % 2]) for k in range(4)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(hours=i // 4), i % 4, "view", 1.0 + i % 7, '{"k": %d}' % (i % 90)) for i in range(160)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    table = all_queries()["feature_table"](spark, str(tmp_path))
    assert {tuple(r) for r in table.select("square_feet_missing", "age_missing", "beaufort_scale_missing").collect()} == {(0, 0, 0)}
    assert all_queries()["ridge_forecast"](spark, str(tmp_path)).count() == 3
    assert all_queries()["best_penalty"](spark, str(tmp_path)).count() == 1


def test_exact_median_selects_in_a_large_group(spark):
    df = spark.range(50_001).select((F.col("id") % 3 == 0).alias("hot"), (F.pmod(F.col("id") * 7919, F.lit(50_021))).cast("double").alias("v"))
    want = {r["hot"]: r["m"] for r in df.groupBy("hot").agg(F.median("v").alias("m")).collect()}
    for most, ranges in ((100_000, 4096), (200, 64), (1, 2)):
        assert {r["hot"]: r["median"] for r in summaries.exact_median(df, "v", ["hot"], most, ranges).collect()} == want
    ties = spark.range(5000).select(F.lit(4.0).alias("v"))
    assert summaries.exact_median(ties, "v", most=100).first()["median"] == 4.0


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [1.0] * 30 + [9.0] * 30, [1.0] * 31 + [9.0] * 30, [-1e308, 1e308, 5.0, 5.0], [0.0, 1e-300, 2e-300, 1e300], [3.0, 1.0, 2.0] * 50 + [1e9]])
def test_exact_median_of_awkward_values(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert summaries.exact_median(df, "v", most=2, ranges=4).first()["median"] == pytest.approx(statistics.median(values))


def test_median_of_many_distinct_values_near_the_middle(spark):
    # A million distinct values in a thousandth of the range; no window is without a partition, and none gets a large group.
    df = spark.range(1_000_001).select((F.lit(0.5) + F.col("id") / 1e9).alias("v")).union(spark.range(2).select(F.col("id").cast("double")))
    found = summaries.exact_median(df, "v")
    assert found.first()["median"] == pytest.approx(0.5 + 500_000 / 1e9, abs=1e-12)
    assert summaries.exact_median(df.filter("v > 5"), "v").count() == 0


def test_gap_intervals_and_the_panel_they_make(spark):
    rng = random.Random(4)
    hours = sorted(rng.sample(range(400), 150))
    rows = [(m, b, h) for m in (0, 1) for b in range(6) for h in hours if h % (m + 2) and rng.random() < 0.2 * b]
    at = lambda h: dt.datetime(2016, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([(m, b, at(h), 1.0) for m, b, h in rows], "meter int, building_id int, timestamp timestamp_ntz, meter_reading double")
    nodes = spark.createDataFrame([(m, b) for m in (0, 1) for b in (0, 1, 2, 5, 9)], "meter int, building_id int")
    want, missing = set(), set()
    for m in (0, 1):
        times = sorted({h for k, _, h in rows if k == m})
        for b in (0, 1, 2, 5, 9):
            own = {h for k, c, h in rows if (k, c) == (m, b)}
            for gone, stretch in itertools.groupby(times, lambda h: h not in own):
                stretch = list(stretch)
                if gone:
                    want.add((m, b, at(stretch[0]), at(stretch[-1]), len(stretch)))
                    missing |= {(m, b, at(h)) for h in stretch}
    found = enrich.gap_intervals(df, nodes, keys=["meter"], slice_days=3).collect()
    assert {(r["meter"], r["building_id"], r["first_missing"], r["last_missing"], r["cells"]) for r in found} == want and len(found) == len(want)
    panel = enrich.complete_panel(df, nodes, keys=["meter"], slice_days=3)
    assert {(r["meter"], r["building_id"], r["timestamp"]) for r in panel.filter("not observed").collect()} == missing
    assert panel.filter("observed").count() == sum(b in (0, 1, 2, 5, 9) for _, b, _ in rows)


def test_type_narrowing(spark):
    df = spark.createDataFrame([(1, 70_000, -200, 1.5)], "a bigint, b bigint, c bigint, d double")
    assert [t for _, t in screening.narrow_types(df).dtypes] == ["tinyint", "int", "smallint", "float"]


def test_split_reader_checks_columns(spark, tmp_path):
    full = frame(spark, hours(2)).withColumn("feature", F.lit(1.0))
    for name in ("train", "valid", "test"):
        tables.write_table(full.drop("feature") if name == "bad" else full, f"{tmp_path}/{name}", (), "csv")
    tables.write_table(full.drop("feature"), f"{tmp_path}/bad", (), "csv")
    rows = tables.read_splits(spark, f"{tmp_path}/train", f"{tmp_path}/valid", f"{tmp_path}/test")
    assert rows.columns == ["timestamp", "meter_reading", "building_id", "meter", "feature", "split"]
    assert rows.count() == 6 and rows.schema["timestamp"].dataType.simpleString() == "timestamp_ntz"
    with pytest.raises(ValueError, match="valid split columns"):
        tables.read_splits(spark, f"{tmp_path}/train", f"{tmp_path}/bad", f"{tmp_path}/test")


def test_json_summary_of_a_missing_file_is_empty(spark, tmp_path):
    assert tables.read_json_summary(spark, f"{tmp_path}/none.json", "a int").count() == 0


def test_raw_csv_tables(spark, tmp_path):
    (tmp_path / "train.csv").write_text("building_id,meter,timestamp,meter_reading\n1,0,2016-01-01 00:00:00,2.5\n")
    (tmp_path / "weather_train.csv").write_text(
        "site_id,timestamp,air_temperature,cloud_coverage,dew_temperature,precip_depth_1_hr,sea_level_pressure,"
        "wind_direction,wind_speed\n0,2016-01-01 00:00:00,1.0,,2.0,,1000.0,90.0,3.5\n"
    )
    (tmp_path / "building_metadata.csv").write_text(
        "site_id,building_id,primary_use,square_feet,year_built,floor_count\n0,1,Education,100,2000,\n"
    )
    readings, weather, buildings = tables.read_raw_tables(spark, str(tmp_path))
    assert readings.first()["meter_reading"] == 2.5
    assert weather.first()["cloud_coverage"] is None and buildings.first()["floor_count"] is None
