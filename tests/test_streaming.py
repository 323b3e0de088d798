"""Streaming sessions agree with the batch gap rule."""
import tempfile

from pyspark.sql import functions as F

from panelflow.operators import ordered as O
from panelflow.operators import timeseries as W
from panelflow.streaming.sessions import sessionize_stream, start_sessions_query


def test_stream_sessions_match_batch(spark):
    base = tempfile.mkdtemp(prefix="pf-stream-")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    ev.write.mode("overwrite").parquet(f"{base}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{base}/in")
    q = start_sessions_query(stream, "user_id", "ts", 30.0, sink="memory", query_name="pf_sessions",
                             checkpoint=f"{base}/ckpt", available_now=True)
    q.awaitTermination(120)
    got = spark.sql("SELECT user_id, n_obs FROM pf_sessions")
    batch = sessionize_stream(ev, "user_id", "ts", 30.0).select("user_id", "n_obs")
    # rows of the last open session per person are held back by the watermark
    assert got.exceptAll(batch).count() == 0
    dense = ev.select(F.col("user_id").alias("ID"), (F.unix_micros("ts") / 1e6).alias("t"),
                      F.col("event_id").alias("seq"))
    s = W.sessionize(O.single_chunk(dense), "ID", "t", "seq", 30.0)
    n_batch = s.select("ID", "session").distinct().count()
    assert batch.count() == n_batch
