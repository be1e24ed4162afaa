"""Registered queries: leaves, Merkle roots, batches, blocks, days and segments."""

from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.operators import merkle as M
from sealstream.plans import telemetry as T
from sealstream.plans.registry import query

WITH = f"WITH {T.EV}, {T.REC}"
RWITH = f"WITH RECURSIVE {T.EV}, {T.REC}"
LEAF1 = "l1 AS (SELECT site_id, day, event_id, sha256(unhex(record_hex)) AS leaf FROM rec)"
LEAF2 = "l2 AS (SELECT site_id, day, event_id, sha256(unhex('00') || unhex(record_hex)) AS leaf FROM rec)"


def leaves(spark, sf, version):
    rec = T.records(T.events(spark, sf))
    h = M.leaf_hash_v1("record") if version == 1 else M.leaf_hash_v2("record")
    return rec.select("site_id", "day", "event_id", h.alias("leaf"))


@query("c01_leaf_v1", f"{WITH}, {LEAF1} SELECT event_id, leaf FROM l1")
def c01(spark, sf):
    return leaves(spark, sf, 1).select("event_id", C.hex_lower("leaf").alias("leaf"))


@query("c02_leaf_v2", f"{WITH}, {LEAF2} SELECT event_id, leaf FROM l2")
def c02(spark, sf):
    return leaves(spark, sf, 2).select("event_id", C.hex_lower("leaf").alias("leaf"))


@query("c04_merkle_v1", f"{RWITH}, {LEAF1}, {T.duck_roots('r', 'l1', 'site_id, day', 1)} SELECT * FROM r")
def c04(spark, sf):
    return M.merkle_root_v1(leaves(spark, sf, 1), ["site_id", "day"]).select(
        "site_id", "day", "leaf_count", C.hex_lower("root").alias("root"))


@query("c05_merkle_v2", f"{RWITH}, {LEAF2}, {T.duck_roots('r', 'l2', 'site_id, day', 2)} SELECT * FROM r")
def c05(spark, sf):
    return M.merkle_root_v2(leaves(spark, sf, 2), ["site_id", "day"]).select(
        "site_id", "day", "leaf_count", C.hex_lower("root").alias("root"))
