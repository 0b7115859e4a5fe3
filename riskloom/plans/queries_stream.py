"""Registered queries: Structured Streaming jobs run with ``availableNow``.

Inputs are the derived tables written as time-ordered file chunks in the
shared scratch folder; outputs are read back from the sink folders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import models as MD
from riskloom.operators.keystate import KeyState
from riskloom.plans import training as TR
from riskloom.plans.catalog import query, r6
from riskloom.plans.oracle import sql
from riskloom.session import cut_lineage, scratch_path
from riskloom.sources import fixtures as X
from riskloom.streaming import jobs as J

N_CHUNKS = 8
N_REQUEST_CHUNKS = 3


@query("stream_velocity")
def stream_velocity(spark, d):
    """Per-device running count and 1h trailing count from a stateful stream
    (state per device and day, expired by timers); equals the batch windows
    on in-order input."""
    t = X.commerce_txn(spark, d)
    src, files = J.write_ordered_chunks(t, scratch_path(spark, "velocity-src"), "purchase_time", N_CHUNKS)
    out, ckpt = J.scratch(spark, "velocity")
    streamed = J.run_stream_velocity(J.stream_velocity(spark, src, t.schema, max_files=files), out, ckpt)
    nulls = t.where(F.col("device_id").isNull()).select(
        "txn_id", "device_id", F.lit(None).cast("bigint").alias("device_usage_count"),
        F.lit(None).cast("bigint").alias("device_freq_1h"), F.lit(0).alias("is_late"))
    return streamed.unionByName(nulls)


sql("stream_velocity", """
select txn_id, device_id,
  case when device_id is null then null else
    row_number() over (partition by device_id order by purchase_time, txn_id) end as device_usage_count,
  case when device_id is null then null else
    count(user_id) over (partition by device_id order by purchase_time
                         range between interval '3599999999 microseconds' preceding and current row)
    - count(user_id) over (partition by device_id, purchase_time)
    + count(user_id) over (partition by device_id, purchase_time order by txn_id
                           rows between unbounded preceding and current row) end as device_freq_1h,
  0 as is_late
from commerce_txn""", "commerce_txn")


@query("stream_alert_windows")
def stream_alert_windows(spark, d):
    """Scored rows streamed by event time; risk-band counts per 1-hour window
    with a 1-hour watermark (update mode, idempotent per-batch sink)."""
    li = X.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("txn_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("event_time"))
    sc = X.scores(spark, d).join(li, "txn_id")
    src, files = J.write_ordered_chunks(sc, scratch_path(spark, "alerts-src"), "event_time", N_CHUNKS)
    stream = spark.readStream.schema(sc.schema).option("maxFilesPerTrigger", files).parquet(src)
    scored = MD.score_details(stream, 0.5, include_details=True)
    out, ckpt = J.scratch(spark, "alerts")
    J.run_foreach_batch(J.alert_windows(scored, "event_time"), J.idempotent_batch_writer(out), ckpt,
                        mode="update")
    return J.latest_per_key(spark.read.parquet(out), ["window_start", "window_end", "risk_level"])


sql("stream_alert_windows", """
select date_trunc('hour', l_shipdate) as window_start, date_trunc('hour', l_shipdate) + interval 1 hour
         as window_end, risk_level, count(*) as n
from (select s.*, l.l_shipdate,
        case when fraud_probability < 0.3 then 'low' when fraud_probability < 0.6 then 'medium'
             when fraud_probability < 0.8 then 'high' else 'critical' end as risk_level
      from scores s join (select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as txn_id,
                                 l_shipdate from lineitem) l on s.txn_id = l.txn_id)
group by 1, 2, 3""", "scores")


@query("stream_alert_windows_sliding")
def stream_alert_windows_sliding(spark, d):
    """Sliding variant: 1-hour windows every 10 minutes (each row in 6 windows)."""
    li = X.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("txn_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("event_time"))
    sc = X.scores(spark, d).join(li, "txn_id")
    src, files = J.write_ordered_chunks(sc, scratch_path(spark, "slide-src"), "event_time", N_CHUNKS)
    stream = spark.readStream.schema(sc.schema).option("maxFilesPerTrigger", files).parquet(src)
    scored = MD.score_details(stream, 0.5, include_details=True)
    out, ckpt = J.scratch(spark, "slide")
    J.run_foreach_batch(J.alert_windows(scored, "event_time", slide="10 minutes"),
                        J.idempotent_batch_writer(out), ckpt, mode="update")
    return J.latest_per_key(spark.read.parquet(out), ["window_start", "window_end", "risk_level"])


sql("stream_alert_windows_sliding", """
select window_start, window_start + interval 1 hour as window_end, risk_level, count(*) as n
from (select time_bucket(interval 10 minute, l_shipdate) - to_minutes(10 * k) as window_start, risk_level
      from (select s.*, l.l_shipdate,
              case when fraud_probability < 0.3 then 'low' when fraud_probability < 0.6 then 'medium'
                   when fraud_probability < 0.8 then 'high' else 'critical' end as risk_level
            from scores s join (select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)
                                       as txn_id, l_shipdate from lineitem) l on s.txn_id = l.txn_id),
           (select unnest(range(6)) as k))
group by 1, 2, 3""", "scores")


@query("stream_score")
def stream_score(spark, d):
    """Raw request rows of the last week arrive as files; every micro-batch is
    scored by the whole scorer against the saved per-key state (begun with all
    rows before) and then joins that state, so counts come from everything the
    stream has seen, not from the batch alone."""
    past, new = TR.last_week(spark, d)
    state = KeyState(spark, scratch_path(spark, "stream-state"))
    state.merge(cut_lineage(past, "past"))
    src, files = J.write_ordered_chunks(new, scratch_path(spark, "score-src"), "purchase_time", N_REQUEST_CHUNKS)
    out, ckpt = J.scratch(spark, "score")
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", files).parquet(src)
    J.run_foreach_batch(stream, J.score_writer(TR.raw_scorer(spark, d, "random_forest"), out, state.path), ckpt)
    return r6(spark.read.parquet(out))
