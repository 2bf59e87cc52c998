"""Shared pieces of the SQL oracles."""

from __future__ import annotations

READINGS = """readings AS (
  SELECT user_id AS building_id, event_type AS meter, date_trunc('hour', ts) AS timestamp, sum(value) AS meter_reading
  FROM events GROUP BY 1, 2, 3)"""

BUILDINGS = """buildings AS (
  SELECT c_custkey AS building_id, c_nationkey AS site_id, c_mktsegment AS primary_use,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS square_feet,
    CASE WHEN c_acctbal >= 0 THEN 1900 + c_custkey % 100 END AS year_built,
    1 + c_custkey % 12 AS floor_count
  FROM customer)"""

WEATHER = """weather AS (
  SELECT c_nationkey AS site_id, date_trunc('hour', ts) AS timestamp,
    avg(CAST(json_extract_string(props, '$.k') AS INTEGER)) * 3.6 AS wind_direction, avg(value) / 5 AS wind_speed
  FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'view' GROUP BY 1, 2)"""

METER_HOURS = """meter_hours AS (
  SELECT event_type AS meter, date_trunc('hour', ts) AS timestamp, sum(value) AS meter_reading
  FROM events GROUP BY 1, 2)"""

SUPPLIER_READINGS = """supplier_readings AS (
  SELECT l_suppkey AS building_id, l_returnflag AS meter, l_shipdate AS timestamp, l_quantity AS meter_reading
  FROM lineitem)"""

SUPPLIER_DAYS = """supplier_days AS (
  SELECT l_suppkey AS building_id, l_shipdate AS timestamp, sum(l_quantity) AS meter_reading
  FROM lineitem GROUP BY 1, 2)"""

ZERO_INFLATED = """zero_inflated AS (
  SELECT l_suppkey AS building_id, l_returnflag AS meter, l_linestatus AS part, l_shipdate AS timestamp,
    l_tax AS actual, l_discount AS predicted, 1 - l_quantity / 50 AS zero_probability,
    (25 - l_quantity) / 10 AS zero_logit, l_linenumber <= 5 AS observed
  FROM lineitem)"""


def split_of(source: str, keys: list[str], name: str = "prepared") -> str:
    """CTEs that add ``split`` to a source, cutting its distinct timestamps per key."""
    ks = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    count_part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    join = f"JOIN {name}_cuts USING ({', '.join(keys)})" if keys else f"CROSS JOIN {name}_cuts"
    return f"""{name}_placed AS (
  SELECT {ks}timestamp, row_number() OVER ({part}ORDER BY timestamp) - 1 AS place, count(*) OVER ({count_part}) AS n
  FROM (SELECT DISTINCT {ks}timestamp FROM {source})),
{name}_cuts AS (
  SELECT {ks}max(CASE WHEN place = round_even(n * 0.8, 0) THEN timestamp END) AS valid_start,
    max(CASE WHEN place = round_even(n * 0.9, 0) THEN timestamp END) AS test_start
  FROM {name}_placed {group}),
{name} AS (
  SELECT s.*, CASE WHEN timestamp < valid_start THEN 'train' WHEN timestamp < test_start THEN 'valid' ELSE 'test' END AS split
  FROM {source} s {join})"""


def ranges_of(source: str, keys: list[str], name: str = "ranges") -> str:
    """CTE with the training range of the log target."""
    ks = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""{name} AS (
  SELECT {ks}min(ln(1 + meter_reading)) AS target_min, max(ln(1 + meter_reading)) AS target_max
  FROM {source} WHERE split = 'train' {group})"""


def runs_of(source: str, keys: list[str], step: str = "1 hour", name: str = "runs") -> str:
    """CTEs that number the contiguous runs of each series."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    ks = "".join(f"{k}, " for k in keys)
    return f"""{name}_gaps AS (
  SELECT *, lag(timestamp) OVER ({part}ORDER BY timestamp) AS previous_ts FROM {source}),
{name}_numbered AS (
  SELECT *, coalesce(timestamp - previous_ts <> INTERVAL '{step}', false) AS is_gap,
    sum(CASE WHEN timestamp - previous_ts <> INTERVAL '{step}' THEN 1 ELSE 0 END)
      OVER ({part}ORDER BY timestamp) AS segment
  FROM {name}_gaps),
{name} AS (
  SELECT * REPLACE (CAST(segment AS BIGINT) AS segment),
    min(timestamp) OVER (PARTITION BY {ks}segment) AS run_start,
    row_number() OVER (PARTITION BY {ks}segment ORDER BY timestamp) - 1 AS run_position
  FROM {name}_numbered)"""


def with_(*parts: str) -> str:
    """A statement from CTEs and, last, its body."""
    *ctes, body = parts
    return f"WITH {', '.join(ctes)}\n{body}"


METRIC_COLUMNS = """round(sse / n, 6) AS mse, round(sae / n, 6) AS mae, round(sqrt(sse / n), 6) AS rmse,
  round(CASE WHEN yy - y * y / n <= 0 THEN 0 ELSE 1 - sse / (yy - y * y / n) END, 6) AS r2,
  round(smape_sum / n * 100, 6) AS smape, round(sqrt(sle / n), 6) AS rmsle, n AS evaluated_row_count"""


def sums_of(actual: str, predicted: str) -> str:
    """Select list with the mergeable error sums."""
    y, p = actual, predicted
    return f"""count(*) AS n, sum(({p} - {y}) * ({p} - {y})) AS sse, sum(abs({p} - {y})) AS sae,
  sum(CASE WHEN abs({y}) + abs({p}) = 0 THEN 0 ELSE 2 * abs({p} - {y}) / (abs({y}) + abs({p})) END) AS smape_sum,
  sum((ln(1 + greatest({p}, 0)) - ln(1 + greatest({y}, 0))) * (ln(1 + greatest({p}, 0)) - ln(1 + greatest({y}, 0)))) AS sle,
  sum({y}) AS y, sum({y} * {y}) AS yy"""


def metrics_of(source: str, actual: str, predicted: str, groups: list[str]) -> str:
    """Full statement body with the metrics per group."""
    gs = "".join(f"{g}, " for g in groups)
    group = f"GROUP BY {', '.join(groups)}" if groups else ""
    return f"SELECT {gs}{METRIC_COLUMNS} FROM (SELECT {gs}{sums_of(actual, predicted)} FROM {source} {group})"
