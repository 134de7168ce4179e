"""Streaming forms."""

from pyspark.sql import functions as F

from registry import query
from strandline.session import new_folder
from strandline.streaming import daily, intake

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("j1_scene_intake", """select scene_id, min(event_id) event_id from scenes group by 1""")
def _(t):
    # Two deliveries that overlap, taken in one after the other.
    inbox, table, check = (new_folder(t.spark, n) for n in ("inbox", "taken", "intake"))
    scenes = t.scenes().select("scene_id", "event_id", "event_type")
    schema = "scene_id string, event_id bigint, event_type string"
    first = scenes.groupBy("scene_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))
    first.where("event_type <> 'click'").select("scene_id", "event_id", "event_type").repartition(2).write.parquet(inbox)
    intake.take_in(intake.scene_stream(t.spark, inbox, schema, files_per_batch=1), table, check)
    scenes.repartition(2).write.mode("append").parquet(inbox)
    intake.take_in(intake.scene_stream(t.spark, inbox, schema), table, check)
    return t.spark.read.parquet(table).select("scene_id", "event_id")


@query("j2_streamed_daily_means", """select event_type, ts::date::varchar "day", round(avg(value), 7) mean, count(value) n from events
    where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1, 2""")
def _(t):
    table, check = new_folder(t.spark, "days"), new_folder(t.spark, "daycheck")
    stream = t.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    daily.write_closed_days(daily.daily_windows(stream, ["event_type"]), table, check)
    return t.spark.read.parquet(table).select("event_type", F.col("day").cast("string").alias("day"), F.round("mean", 7).alias("mean"), "n")


@query("j2_daily_means_of_table", """select event_type, ts::date::varchar "day", round(avg(value), 7) mean, count(value) n from events group by 1, 2""")
def _(t):
    days = daily.daily_windows(t.raw("events"), ["event_type"])
    return days.select("event_type", F.col("day").cast("string").alias("day"), F.round("mean", 7).alias("mean"), "n")
