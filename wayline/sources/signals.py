"""The signal view: trips made from the `events` table, for running every operator on given tables.

A trip is a user's events in time order; 30 days stand for 72 seconds. The view is one shuffle by trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows further apart count as a gap in this view.
GAP_S = 5.0


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    w = Window.partitionBy("trip_key").orderBy("us", "event_id")
    d = e.select(F.col("user_id").alias("trip_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    d = d.withColumns({"i": F.row_number().over(w) - 1, "t": (F.col("us") - F.min("us").over(Window.partitionBy("trip_key"))) / F.lit(3.6e10)})
    k, i = F.col("k"), F.col("i")
    return d.select(
        "trip_key", "i", "t", "k", "event_type", "value",
        (F.col("value") / 10.0).alias("speed"), (k * F.lit(3.6)).alias("heading_deg"), ((k - 50) / F.lit(100.0)).alias("gyro_z"),
        (F.lit(52.4) + k * F.lit(1e-4) + i * F.lit(1e-5)).alias("lat"), (F.lit(-1.5) + F.col("value") * 1e-5).alias("lon"),
        (F.col("event_type") != "error").alias("gnss_valid"),
        ((k - 50) / F.lit(25.0)).alias("acc_x"), ((k * 7 % 100 - 50) / F.lit(25.0)).alias("acc_y"), (F.lit(9.81) + (k * 13 % 100 - 50) / F.lit(50.0)).alias("acc_z"),
        ((k * 3 % 100 - 50) / F.lit(200.0)).alias("roll"), ((k * 11 % 100 - 50) / F.lit(200.0)).alias("pitch"),
    )


#: The same view for DuckDB, as the start of a WITH clause.
SQL = """with ev as (select user_id as trip_key, epoch_us(ts) as us, event_id, event_type, value, cast(json_extract_string(props, '$.k') as integer) as k from events),
nu as (select *, row_number() over (partition by trip_key order by us, event_id) - 1 as i, (us - min(us) over (partition by trip_key)) / 3.6e10::double as t from ev),
sig as (select trip_key, i, t, k, event_type, value, value / 10.0::double as speed, k * 3.6::double as heading_deg, (k - 50) / 100.0::double as gyro_z,
 52.4::double + k * 1e-4::double + i * 1e-5::double as lat, -1.5::double + value * 1e-5::double as lon, event_type <> 'error' as gnss_valid,
 (k - 50) / 25.0::double as acc_x, (k * 7 % 100 - 50) / 25.0::double as acc_y, 9.81::double + (k * 13 % 100 - 50) / 50.0::double as acc_z,
 (k * 3 % 100 - 50) / 200.0::double as roll, (k * 11 % 100 - 50) / 200.0::double as pitch from nu)
"""
