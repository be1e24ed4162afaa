"""Hashes that stop and go on, and segment chains built from them."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sealstream.functions import codecs as K
from sealstream.functions import sha256 as S
from sealstream.functions import values as V
from sealstream.operators import ledger as L


@pytest.mark.parametrize("library", [True, False])
def test_saved_hash_goes_on(monkeypatch, library):
    if not library:
        monkeypatch.setattr(S, "_update", None)
    rnd = random.Random(1)
    for size in (0, 1, 55, 56, 63, 64, 65, 119, 120, 128, 5000):
        data = os.urandom(size)
        cut, stop = sorted((rnd.randint(0, size), rnd.randint(0, size)))
        own = S.Sha256()
        own.update(data[:cut])
        own.update(data[cut:stop])
        state, rest, length = own.saved()
        assert len(state) == 32 and len(rest) < 64 and length == stop
        assert S.finished(state, rest, length, data[stop:]) == hashlib.sha256(data).digest()
        assert own.digest() == hashlib.sha256(data[:stop]).digest()


def parts_of(spark, ledgers):
    rows, whole = [], {}
    for ledger, sizes in ledgers.items():
        for number, size in enumerate(sizes):
            bodies = [os.urandom(size) for _ in range(number % 4 + 1)]
            whole[ledger, number] = b"".join(bodies)
            for k, body in enumerate(bodies):
                rows.append((ledger, number, k - 1 if k + 1 < len(bodies) else 1 << 40, bytearray(body), k + 1 == len(bodies)))
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "ledger_id string, segment_number long, part long, bytes binary, last boolean"), whole


def test_chain_equals_the_artifacts_hashed_whole(spark):
    parts, whole = parts_of(spark, {"a": [0, 10, 63, 64, 65, 100_000, 7], "b": [1], "c": [200] * 60})
    got = {(r.ledger_id, r.segment_number): (r.prev_segment_sha256, r.artifact_sha256, r.artifact_size)
           for r in L.chain_segments(parts.repartition(5)).collect()}
    end, prev = K.to_cbor("commitment_profile_id") + K.to_cbor(V.PROFILE_V2), None
    for (ledger, number), body in sorted(whole.items()):
        prev = V.ZERO_SHA256 if number == 0 else prev
        raw = body + K.to_cbor(prev) + end
        assert got.pop((ledger, number)) == (prev, hashlib.sha256(raw).hexdigest(), len(raw))
        prev = hashlib.sha256(raw).hexdigest()
    assert not got


def test_a_ledger_is_hashed_in_many_tasks(spark):
    parts, _ = parts_of(spark, {"a": [50] * 80})
    states = L.segment_states(parts).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        assert states.select("task").distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert states.agg(F.max(F.length("rest") + F.length("state"))).first()[0] < 96
    assert L.chain_segments(parts.limit(0)).count() == 0
