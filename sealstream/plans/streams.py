"""Registered queries: the stream operators over the events table, run to completion."""

from pyspark.sql import functions as F

from sealstream.operators import merkle as M
from sealstream.operators import producer as S
from sealstream.operators.plan import own_folder
from sealstream.plans import admission as Q
from sealstream.plans import ledger as G
from sealstream.plans import telemetry as T
from sealstream.plans.registry import query
from sealstream.streaming import jobs as J
from sealstream.streaming import stateful as ST


def paths(spark):
    root = own_folder(spark, "stream")
    return f"{root}/out", f"{root}/checkpoint"


def event_stream(spark, sf):
    return T.from_events(J.read_stream(spark, sf, "events.parquet"))


@query("t01_replay_stream", f"{Q.RW} SELECT dev_id, arrival_seq, fc, reason FROM rpl")
def t01(spark, sf):
    return J.run_available(ST.admit_replay_stream(event_stream(spark, sf)), *paths(spark))


FIRST = "fst AS (SELECT ledger_id, key, arg_min(digest, seq) AS d, min(seq) AS o FROM req GROUP BY ALL)"


@query("t03_idempotency_stream", f"{G.Q.WITH}, {G.IDEM[:G.IDEM.index("fst AS")]} {FIRST} {G.IDEMQ}")
def t03(spark, sf):
    out = ST.admit_idempotent_stream(G.requests(event_stream(spark, sf)))
    return J.run_available(out, *paths(spark)).select("seq", "outcome")


@query("t03_admission_stream", f"""WITH RECURSIVE {T.EV}, {T.REC}, {G.ASK.replace("c_custkey * 3 AS key", "'none' AS key").replace("FROM customer)", "FROM customer WHERE false)")},
  {G.STEP.replace('FROM rec)', 'FROM rec SEMI JOIN acc USING (ledger_id, event_id))')}, {G.ADMITTED} {G.ANSWER}""")
def t03b(spark, sf):
    out = ST.admit_requests_stream(G.asked(event_stream(spark, sf)), G.POL, G.ORIGIN)
    return G.with_text(J.run_available(out, *paths(spark))).select("seq", "outcome", "segment_number", "sealed", "revision")


@query("t06_producer_stream", f"WITH RECURSIVE {T.EV}, {T.REC}, {G.STEP} SELECT event_id, seg AS segment_number, ledger_id FROM st WHERE i > 0")
def t06(spark, sf):
    rec = T.records(event_stream(spark, sf)).select(
        "ledger_id", F.col("event_id").alias("seq"), "t_ms", F.octet_length("record").alias("size"))
    out = ST.produce_segments_stream(S.as_events(rec), G.POL, G.ORIGIN)
    return J.run_available(out, *paths(spark)).select(F.col("seq").alias("event_id"), "segment_number", "ledger_id")


@query("t10_daily_stream", f"{G.Q.RWITH}, {G.BLK} SELECT site_id, day, merkle_root, count FROM blk")
def t10(spark, sf):
    out, checkpoint = paths(spark)
    rec = T.records(event_stream(spark, sf)).select("site_id", "day", M.leaf_hash_v1("record").alias("leaf"))
    J.commit_days(rec, out, checkpoint)
    return spark.read.parquet(f"{out}/blocks").select(
        "site_id", F.col("day").cast("string").alias("day"), "merkle_root", "count")
