"""Idempotent admission: requests with a key are admitted once, and later ones get the stored outcome back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.operators.plan import merged, previous_row, running_totals, salted_join, staged
from sealstream.operators.producer import Policy, assign_segments

KEYS = ["ledger_id", "key"]
OUTCOME = ["segment_number", "sealed", "revision"]


def lookup_outcomes(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests (ledger_id, key, digest, seq) with the outcome stored for their key: ``replay`` of it if the digest is the same, else
    ``conflict``, which returns nothing; ``absent`` where none is stored. ``stored``: KEYS, digest, OUTCOME, one row per key.
    A key's requests are spread over tasks, however many they are."""
    known = stored.select(*KEYS, F.col("digest").alias("_d"), *[F.col(c).alias(f"_{c}") for c in OUTCOME])
    found = salted_join(requests, known, KEYS, ["seq"])
    same = F.col("_d") == F.col("digest")
    return found.select(*requests.columns, F.when(F.col("_d").isNull(), "absent").when(same, "replay").otherwise("conflict").alias("outcome"),
                        *[F.when(same, F.col(f"_{c}")).alias(c) for c in OUTCOME])


def _with_outcomes(placed: DataFrame, stored: DataFrame) -> DataFrame:
    """Admitted requests (segment_number, limit_reason) with what is stored for them: segment numbers go on after those stored for the
    ledger, each admission is a revision, and the segments sealed by it are those from the one open before."""
    highest = F.greatest("segment_number", F.array_max("sealed"))
    base = stored.groupBy("ledger_id").agg((F.max(highest) + 1).alias("_first"), F.max("revision").alias("_last"))
    ranked = running_totals(placed, ["ledger_id"], "seq", {"_rank": F.lit(1)})
    ranked = previous_row(ranked, ["ledger_id"], "seq", ["segment_number", "limit_reason"])
    opened = F.coalesce(F.col("prev_segment_number") + F.col("prev_limit_reason").isNotNull().cast("bigint"), F.lit(0))
    ranked = ranked.join(base, "ledger_id", "left").withColumns({
        "_first": F.coalesce("_first", F.lit(0)), "_from": opened, "_number": F.col("segment_number")})
    until = F.col("_number") - F.col("limit_reason").isNull().cast("bigint")
    none = F.array().cast("array<bigint>")
    return ranked.select(
        *KEYS, "seq", "digest", (F.col("_number") + F.col("_first")).alias("segment_number"),
        F.when(until >= F.col("_from"), F.sequence(F.col("_from") + F.col("_first"), until + F.col("_first"))).otherwise(none).alias("sealed"),
        (F.col("_rank") + F.coalesce("_last", F.lit(0))).alias("revision"))


def admit_requests(requests: DataFrame, stored: DataFrame, policy: Policy, origin_ms: int = 0, **chunks) -> DataFrame:
    """Outcome of every request (ledger_id, seq, key, digest, t_ms, size, record_error): KEYS, seq, outcome, segment_number, sealed, revision.

    In the order of ``seq`` per ledger: a bad key is refused (``invalid_key``); a key that is known gives ``replay`` of the stored outcome, with
    its segment number, sealed numbers and revision, or ``conflict`` if the digest differs, whatever the record is; then
    a record that is not canonical is refused (``invalid_record``), and one before its interval too (``clock_discontinuity``). Only an
    admitted request (``new``) occupies its key. ``stored`` (KEYS, digest, OUTCOME) holds outcomes of before; the batch
    opens a new interval at ``origin_ms``, as after a recovery, and segment numbers and revisions go on after the stored ones.

    Which request of a key is the first that is admitted depends on the others of its ledger by the clock alone. So all first requests
    are placed at once; keys whose attempts were all refused try their next request, and requests after an
    admitted one are taken back, until nothing changes. Each round is right for a longer beginning of every ledger; without clocks
    that run back there are two.
    """
    good = C.idempotency_key_ok("key")
    asked = staged(requests.select("ledger_id", F.col("seq").cast("bigint").alias("seq"), "key", "digest", "t_ms", "size", "record_error")
                   .withColumn("_ok", F.coalesce(good, F.lit(False))))
    looked = staged(lookup_outcomes(asked.filter("_ok").drop("_ok"), stored))
    rest = looked.filter("outcome = 'absent'").drop("outcome", *OUTCOME)
    valid = rest.filter("record_error IS NULL")
    first = F.min(F.struct("seq", "digest", "t_ms", "size")).alias("_r")
    tried = staged(valid.groupBy(*KEYS).agg(first).select(*KEYS, "_r.*"))
    while True:
        out = assign_segments(tried, policy, origin_ms, **chunks).select(
            "ledger_id", "seq", "segment_number", "limit_reason", (F.col("outcome") == "ok").alias("_in"))
        placed = staged(tried.join(merged(out), ["ledger_id", "seq"]))
        per_key = staged(placed.groupBy(*KEYS).agg(F.min(F.when(F.col("_in"), F.col("seq"))).alias("_first"), F.max("seq").alias("_last")))
        failed = per_key.filter("_first IS NULL").select(*KEYS, "_last")
        failed = F.broadcast(failed) if failed.count() <= 10_000 else merged(failed)
        more = staged(valid.join(failed, KEYS).filter("seq > _last").groupBy(*KEYS).agg(first).select(*KEYS, "_r.*"))
        kept = placed.join(merged(per_key), KEYS).filter("_first IS NULL OR seq <= _first").select(*tried.columns)
        if more.isEmpty() and per_key.filter("_first < _last").isEmpty():
            break
        tried = staged(kept.unionByName(more))
    admitted = staged(_with_outcomes(placed.filter("_in"), stored))
    own = admitted.select(*KEYS, F.col("seq").alias("_at"), F.col("digest").alias("_d"), *[F.col(c).alias(f"_{c}") for c in OUTCOME])
    met = salted_join(rest, own, KEYS, ["seq"])
    late, same = F.col("seq") > F.col("_at"), F.col("_d") == F.col("digest")
    outcome = (F.when(F.col("seq") == F.col("_at"), "new").when(late & same, "replay").when(late, "conflict")
               .when(F.col("record_error").isNotNull(), "invalid_record").otherwise("clock_discontinuity"))
    met = met.withColumn("outcome", outcome)
    met = met.select(*KEYS, "seq", "outcome", *[F.when(F.col("outcome").isin("new", "replay"), F.col(f"_{c}")).alias(c) for c in OUTCOME])
    known = looked.filter("outcome <> 'absent'").select(*KEYS, "seq", "outcome", *OUTCOME)
    nothing = [F.lit(None).cast(met.schema[c].dataType).alias(c) for c in OUTCOME]
    refused = asked.filter("NOT _ok").select(*KEYS, "seq", F.lit("invalid_key").alias("outcome"), *nothing)
    return met.unionByName(known).unionByName(refused)
