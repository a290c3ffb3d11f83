"""Telemetry, trajectories and corner cards derived from the general tables.

Each is one SQL text that both engines read; only the epoch and JSON functions differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"US": "unix_micros(to_utc_timestamp(ts, 'UTC'))", "K": "get_json_object(props, '$.k')"}
DUCKDB = {"US": "epoch_us(ts)", "K": "json_extract_string(props, '$.k')"}

TEL = """
SELECT event_id, CAST(user_id % 12 AS INT) AS lap, us / 1e6 AS t_s, value AS v,
  (k - 50e0) / 1e2 AS longitudinal_acc_g,
  ROW_NUMBER() OVER (PARTITION BY user_id % 12 ORDER BY ts, event_id) AS rn,
  COUNT(*) OVER (PARTITION BY user_id % 12) AS n
FROM (SELECT *, CAST(<US> AS DOUBLE) AS us, CAST(<K> AS DOUBLE) AS k FROM {events}) e
"""
XY = """
SELECT *, ROUND((3e2 + 9e1 * SIN(5e0 * th)) * COS(th), 6) AS x, ROUND((3e2 + 9e1 * SIN(5e0 * th)) * SIN(th), 6) AS y
FROM (SELECT *, 6.283185307179586e0 * rn / n AS th FROM {tel}) q
"""
#: Sessions that differ: clocks of their own, every third without a sensor, readings missing, tracks of 5 to 8 lobes.
TIMED = """
SELECT event_id, lap, rn, n, v, rn * (1e0 + lap % 4) / 64e0 AS t_s,
  CASE WHEN lap % 3 > 0 AND event_id % 97 > 0 THEN longitudinal_acc_g END AS longitudinal_acc_g
FROM {tel}
"""
SHAPED = """
SELECT event_id, lap, rn, ROUND((3e2 + 9e1 * SIN((5e0 + lap % 4) * th)) * COS(th), 6) AS x, ROUND((3e2 + 9e1 * SIN((5e0 + lap % 4) * th)) * SIN(th), 6) AS y
FROM (SELECT *, 6.283185307179586e0 * rn / n AS th FROM {tel}) q
"""
CARDS = """
SELECT CAST(l_suppkey AS INT) AS lap, l_linenumber AS turn, 1e2 * l_linenumber AS s_apex,
  CASE WHEN MOD(l_suppkey, 10) = 9 THEN NULL
       ELSE 1e2 * l_linenumber - 2e0 * MEDIAN(CASE WHEN l_linestatus = 'O' THEN l_quantity END) END AS s_brake_onset,
  MEDIAN(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS Ventry,
  8e-1 * MEDIAN(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS Vmin,
  MEDIAN(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS Vexit,
  -9.81e0 * 7e0 * MEDIAN(CASE WHEN l_tax <= 3e-2 THEN l_discount END) AS a_long_peak
FROM {lineitem} GROUP BY l_suppkey, l_linenumber
"""


def _text(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace(f"<{k}>", v)
    return sql


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_text(TEL, SPARK), events=_read(spark, sf_dir, "events"))


def xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(XY, tel=tel(spark, sf_dir))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TIMED, tel=tel(spark, sf_dir))


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SHAPED, tel=tel(spark, sf_dir))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CARDS, lineitem=_read(spark, sf_dir, "lineitem"))


#: The same as common table expressions of the other engine.
CTES = (
    f"tel AS ({_text(TEL, DUCKDB).replace('{events}', 'events')}), "
    f"xy AS ({XY.replace('{tel}', 'tel')}), timed AS ({TIMED.replace('{tel}', 'tel')}), shaped AS ({SHAPED.replace('{tel}', 'tel')}), cards AS ({CARDS.replace('{lineitem}', 'lineitem')})"
)
