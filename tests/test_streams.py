import json

import pandas as pd
import pytest

from sealstream.operators import producer as S
from sealstream.operators import replay as R
from sealstream.plans import telemetry as T
from sealstream.sources import tables as ST
from sealstream.streaming import jobs as J
from sealstream.streaming import stateful as X

SF = "/root/testdata/sf0.001"


@pytest.fixture
def split_events(spark, tmp_path):
    """The events table as four files in arrival order, one per micro-batch."""
    import os
    df = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        part = str(tmp_path / "in" / f"p{i}")
        df.filter(f"event_id div 250 = {i}" if i < 3 else "event_id >= 750").coalesce(1).write.parquet(part)
        for f in os.listdir(part):
            if f.endswith(".parquet"):
                target = tmp_path / "in" / f"{i}.parquet"
                os.link(os.path.join(part, f), target)
                os.utime(target, (1000 + i, 1000 + i))
    return str(tmp_path / "in")


def stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/0.parquet").schema
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
           .option("pathGlobFilter", "[0-3].parquet").parquet(folder))
    return T.from_events(raw)


def test_replay_batches_equal_one_batch(spark, split_events, tmp_path):
    out = J.run_available(X.admit_replay_stream(stream(spark, split_events)), str(tmp_path / "o"), str(tmp_path / "c"))
    want = {r.arrival_seq: r.reason for r in R.admit_replay(T.events(spark, SF)).collect()}
    assert {r.arrival_seq: r.reason for r in out.collect()} == want


def test_replay_restores_snapshots(spark, split_events, tmp_path):
    first = R.admit_replay(T.events(spark, SF).filter("event_id < 500"))
    state = R.restore_replay(R.snapshot_replay(first)).filter("error is null").select("dev_id", "highest", "seen")
    rest = stream(spark, split_events).filter("event_id >= 500")
    out = J.run_available(X.admit_replay_stream(rest, initial=state), str(tmp_path / "o"), str(tmp_path / "c"))
    want = {r.arrival_seq: r.reason for r in R.admit_replay(T.events(spark, SF)).collect() if r.arrival_seq >= 500}
    assert {r.arrival_seq: r.reason for r in out.collect()} == want


def test_producer_batches_equal_one_batch(spark, split_events, tmp_path):
    policy = S.Policy(3 * 3600000, record_limit=7, size_limit_bytes=260)

    def events(df):
        return S.as_events(df.selectExpr("ledger_id", "event_id AS seq", "t_ms", "30 AS size"))
    out = J.run_available(X.produce_segments_stream(events(stream(spark, split_events)), policy, None),
                          str(tmp_path / "o"), str(tmp_path / "c"))
    batch = S.produce_segments(events(T.events(spark, SF)), policy, None)
    key = lambda r: (r.seq, r.segment_number, [tuple(s) for s in r.sealed])
    assert sorted(map(key, out.collect())) == sorted(map(key, batch.collect()))


def test_sealed_sink_shows_whole_transitions(spark, split_events, tmp_path):
    from sealstream.sources.sinks import read_sealed
    rec = S.as_events(stream(spark, split_events).selectExpr("ledger_id", "event_id AS seq", "t_ms", "30 AS size"))
    J.sealed_sink(X.produce_segments_stream(rec, S.Policy(3600000), None), str(tmp_path / "s"), str(tmp_path / "c"))
    assert read_sealed(spark, str(tmp_path / "s"), "records").count() == T.events(spark, SF).count()


def test_device_and_audit_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"_meta": {"v": 1}, "7": {"salt8": "AA==", "ck_up": None}, "123456": {}, "8": {}}))
    rows = {r.dev_id: r.salt8 for r in ST.read_device_table(spark, str(tmp_path / "d.json")).collect()}
    assert rows == {7: "AA==", 8: None}
    good = json.dumps({"device_id": "d", "fc": 1, "reason": "duplicate", "observed_at_utc": "t", "frame_sha256": "0" * 64, "source": "replay"})
    (tmp_path / "a.ndjson").write_text(f"{good}\n\n  \n{{bad\n")
    got = ST.read_rejection_audit(spark, str(tmp_path / "a.ndjson")).orderBy("line_number").collect()
    assert [(r.line_number, r.reason) for r in got] == [(1, "duplicate"), (4, None)]
    (tmp_path / "f.ndjson").write_text('{"a":1}\n{"b":2}\n')
    assert [r.raw for r in ST.read_frames(spark, str(tmp_path / "f.ndjson")).orderBy("arrival_seq").collect()] == ['{"a":1}', '{"b":2}']


def test_large_audit_files_are_read_by_many_tasks(spark, tmp_path):
    lines = [json.dumps({"device_id": str(k), "fc": k, "reason": "duplicate", "observed_at_utc": "t", "frame_sha256": "0" * 64,
                         "source": "replay"}) if k % 7 else "" for k in range(4000)]
    lines[1234] = "{damaged"
    (tmp_path / "a.ndjson").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.ndjson").write_text(lines[1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = ST.numbered_lines(spark, str(tmp_path)).collect()
        got = ST.read_rejection_audit(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path / "a.ndjson")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.line_number: r.line for r in rows if r.file.endswith("a.ndjson")} == {k + 1: t for k, t in enumerate(lines)}
    assert [r.line_number for r in got if r.reason is None] == [1235]
    assert {(r.line_number, r.fc) for r in got if r.file.endswith("a.ndjson") and r.fc} == {
        (k + 1, k) for k in range(4000) if k % 7 and k != 1234}
    assert [(r.line_number, r.fc) for r in got if r.file.endswith("b.ndjson")] == [(1, 1)]


def one_by_one(requests, stored, policy):
    """Admission told request by request: outcome, segment number, sealed numbers and revision of each."""
    out, ledgers = {}, {}
    known = {(s[0], s[1]): s[2:] for s in stored}
    for ledger, seq, key, digest, t, size, wrong in sorted(requests, key=lambda r: r[1]):
        if ledger not in ledgers:
            own = [s for (lid, _), s in known.items() if lid == ledger]
            first = max((max([s[1], *s[2]]) for s in own), default=-1) + 1
            ledgers[ledger] = [S.Tiling(policy, 0, number=first), max((s[3] for s in own), default=0)]
        state = ledgers[ledger]
        if not key or len(key) > 255 or "\t" in key:
            got = ("invalid_key", None, None, None)
        elif (ledger, key) in known:
            d, *rest = known[ledger, key]
            got = ("replay", *rest) if d == digest else ("conflict", None, None, None)
        elif wrong:
            got = ("invalid_record", None, None, None)
        else:
            import numpy as np
            number, _, _, closed = state[0].place(np.array([t]), np.array([size]))
            if number[0] < 0:
                got = ("clock_discontinuity", None, None, None)
            else:
                state[1] += 1
                got = ("new", int(number[0]), [int(f) + k for _, f, n, *_ in closed for k in range(n)], state[1])
                known[ledger, key] = (digest, *got[1:])
        out[ledger, seq] = got
    return out


@pytest.mark.parametrize("policy", [S.Policy(100, 3), S.Policy(250, 5, 64, "emit")])
def test_admission_with_stored_outcomes(spark, tmp_path, policy):
    """Clocks that run back, refused records whose key stays free, replays and conflicts; one batch, and a stream of several."""
    import random

    from sealstream.operators.outcomes import admit_requests
    rnd = random.Random(3)
    rows, t = [], 0
    for seq in range(300):
        t += rnd.choice([0, 1, 20, 99, 130]) if seq % 40 else -260
        rows.append((rnd.choice("ab"), seq, rnd.choice(["", "bad\tkey", *[f"k{n}" for n in range(60)]]), rnd.choice(["d", "d", "e"]), t,
                     rnd.choice([8, 16, 40]), rnd.choice([None, None, None, "not canonical"])))
    stored = [("a", "k1", "d", 4, [3, 4], 9), ("a", "k2", "e", 6, [], 11), ("c", "k1", "d", 0, [0], 1)]
    schema = "ledger_id string, seq long, key string, digest string, t_ms long, size long, record_error string"
    df = spark.createDataFrame(rows, schema)
    old = spark.createDataFrame(stored, "ledger_id string, key string, digest string, segment_number long, sealed array<long>, revision long")
    see = lambda out: {(r.ledger_id, r.seq): (r.outcome, r.segment_number, r.sealed, r.revision) for r in out.collect()}
    assert see(admit_requests(df, old, policy)) == one_by_one(rows, stored, policy)
    for part in range(3):
        df.filter(f"seq div 100 = {part}").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = J.run_available(X.admit_requests_stream(frames, policy), str(tmp_path / "o"), str(tmp_path / "c"))
    assert see(got) == one_by_one(rows, [], policy)


def test_an_idle_ledger_seals_by_the_clock(spark, tmp_path):
    rows = [("idle", 0, 10, 8), ("idle", 1, 60, 8), ("busy", 0, 20, 8), ("busy", 1, 120, 8)]
    schema = "ledger_id string, seq long, t_ms long, size long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    policy = S.Policy(100)
    frames = S.as_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    live = X.produce_segments_stream(frames, policy, 0, idle_close=True)  # a live stream: it does not end by itself
    running = live.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            running.awaitTermination(1)
            if (tmp_path / "o/_spark_metadata").exists() and spark.read.schema(live.schema).parquet(str(tmp_path / "o")).filter(
                    "outcome = 'timer'").count() == 2:
                break
    finally:
        running.stop()
    out = spark.read.schema(live.schema).parquet(str(tmp_path / "o"))
    got = {(r.ledger_id, r.segment_number, r.close_reason, r.records, r.opened_at) for r in S.sealed_segments(out).collect()}
    later = [(ledger, 9, 10**6, 8) for ledger in ("idle", "busy")]  # in a batch a later event closes what is open
    late = S.produce_segments(S.as_events(spark.createDataFrame(rows + later, schema)), policy, 0)
    want = {(r.ledger_id, r.segment_number, r.close_reason, r.records, r.opened_at) for r in S.sealed_segments(late).collect()}
    assert got == want == {("idle", 0, "interval", 2, 0), ("busy", 0, "interval", 1, 0), ("busy", 1, "interval", 1, 100)}
    assert [r.outcome for r in out.filter("seq IS NULL").collect()] == ["timer", "timer"]


def test_joins_of_derived_rows_are_not_broadcast(spark):
    """Sizes estimated from files say nothing of digests and exploded rows, so these joins sort whatever the estimate is."""
    from sealstream.operators import evidence as E
    from sealstream.operators.plan import salted_join
    a = spark.createDataFrame([(1, 7, "aa"), (2, 8, "bb")], "anchor_id bigint, height bigint, message string")
    h = spark.createDataFrame([(7, "aa"), (9, "cc")], "height bigint, merkle_root string")
    proofs = spark.createDataFrame([(1, True, [], [7], ["aa"])], "anchor_id bigint, has_proof boolean, pending_uris array<string>, heights array<bigint>, messages array<string>")
    headers = spark.createDataFrame([(7, bytes(80))], "height bigint, header binary")
    made = [E.uncovered_heights(a, h), E.derive_anchor_state(proofs, headers), salted_join(a, h, ["height"], ["anchor_id"])]
    for df in made:
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert {(r["height"], r["problem"]) for r in made[0].collect()} == {(8, "uncovered")}
    assert made[1].first()["state"] == "bitcoin-attested-structure"
    assert sorted((r["anchor_id"], r["merkle_root"]) for r in made[2].collect()) == [(1, "aa"), (2, None)]


class Stored:
    """A value or map state that counts its reads."""

    def __init__(self):
        self.held, self.reads = {}, 0

    exists = lambda self: None in self.held
    get = lambda self: self.held[None]

    def update(self, value):
        self.held[None] = value

    def getValue(self, key):
        self.reads += 1
        return self.held.get(key)

    def containsKey(self, key):
        self.reads += 1
        return key in self.held

    def updateValue(self, key, value):
        self.held[key] = value


def started(processor):
    made = {}
    make = lambda name, *a: made.setdefault(name, Stored())
    processor.init(type("Handle", (), {"getValueState": staticmethod(make), "getMapState": staticmethod(make)}))
    return made


def test_large_ledgers_go_in_slices(monkeypatch):
    """Outcomes do not depend on the slices, no slice is longer than the limit, and a key's outcome is read once a slice."""
    n = 3000
    rows = pd.DataFrame({"ledger_id": "a", "seq": range(n), "key": [f"k{i // 4}" for i in range(n)], "digest": [str(i % 3) for i in range(n)],
                         "t_ms": [(i * 37) % 20011 + i for i in range(n)], "size": 10, "key_ok": [i % 101 > 0 for i in range(n)],
                         "record_error": [None if i % 23 else "bad" for i in range(n)]})
    events = rows.assign(kind="record", continuity=None, reason=None, policy=None)
    mixed = lambda df: [p.copy() for _, p in df.sample(frac=1, random_state=5).groupby(df["seq"] % 7)]
    policy, seen = X.Policy(1000, record_limit=40), {}
    for limit in (65536, 256):
        monkeypatch.setattr(X, "SLICE", limit, raising=False)
        admit, produce = X.AdmissionProcessor(policy, 0, None), X.ProducerProcessor(policy, 0, None)
        store, _ = started(admit), started(produce)
        out = [list(admit.handleInputRows(("a",), iter(mixed(rows)), None)), list(produce.handleInputRows(("a",), iter(mixed(events)), None))]
        assert all(len(part) <= limit for parts in out for part in parts)
        assert store["outcomes"].reads <= n // 4 + 1 + n // limit + 1
        seen[limit] = [pd.concat(parts, ignore_index=True) for parts in out]
    for whole, cut in zip(seen[65536], seen[256]):
        pd.testing.assert_frame_equal(whole, cut)
    assert set(seen[256][0]["outcome"]) == {"new", "replay", "conflict", "invalid_key", "invalid_record", "clock_discontinuity"}


class Counted(Stored):
    """A state that counts all its calls."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def getValue(self, key):
        self.calls += 1
        return super().getValue(key)

    def updateValue(self, key, value):
        self.calls += 1
        super().updateValue(key, value)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def counted(processor):
    made = {}
    make = lambda name, *a: made.setdefault(name, Counted())
    processor.init(type("Handle", (), {"getValueState": staticmethod(make), "getMapState": staticmethod(make)}))
    return made["outcomes"]


@pytest.mark.parametrize("sizes", [(6000,), (10, 3000, 1, 2989), (500,) * 12])
def test_new_keys_share_calls_to_the_store(sizes):
    """Outcomes are those of a reading one by one whatever the micro-batches are; a call to the store is for many keys."""
    n = 6000
    rows = pd.DataFrame({"seq": range(n), "key": [None if i % 97 == 0 else f"k{i * 7919 % 4001}" for i in range(n)],
                         "digest": [None if i % 11 == 0 else str(i // 3 % 2) for i in range(n)], "t_ms": [(i * 37) % 20011 + i for i in range(n)],
                         "size": 10, "key_ok": [i % 97 > 0 for i in range(n)], "record_error": [None if i % 23 else "bad" for i in range(n)]})
    policy = S.Policy(1000, record_limit=40)
    admit = X.AdmissionProcessor(policy, 0, None)
    store, at, got = counted(admit), 0, {}
    for size in sizes:
        for part in admit.handleInputRows(("a",), iter([rows[at:at + size]]), None):
            for r in part.astype(object).where(part.notna(), None).itertuples(index=False):
                got["a", r.seq] = (r.outcome, r.segment_number, r.sealed, r.revision)
        at += size
    plain = rows.assign(key=rows["key"].where(rows["key_ok"], "")).itertuples(index=False)
    want = one_by_one([("a", r.seq, r.key, r.digest, r.t_ms, r.size, None if r.record_error is None else "bad") for r in plain], [], policy)
    assert got == want and {o[0] for o in got.values()} == {"new", "replay", "conflict", "invalid_key", "invalid_record", "clock_discontinuity"}
    assert store.calls < n / 4
    assert max(len(json.loads(v[0])[0]) for v in store.held.values()) < 4 * X.BUCKET


def test_stored_outcomes_expire_one_by_one():
    """Keys that share a value of the state end by their own time."""
    def ask(key, now):
        row = pd.DataFrame({"seq": [now], "key": [key], "digest": ["d"], "t_ms": [now], "size": [1], "key_ok": [True], "record_error": [None]})
        return [part["outcome"][0] for part in admit.handleInputRows(("a",), iter([row]), Clock(now))]
    admit = X.AdmissionProcessor(S.Policy(10), 0, 100)
    counted(admit)
    assert [ask(k, now) for k, now in (("a", 0), ("b", 60), ("a", 99), ("a", 100), ("b", 159), ("b", 160), ("a", 161))] == [
        ["new"], ["new"], ["replay"], ["new"], ["replay"], ["new"], ["replay"]]


def test_place_one_is_place_of_one_record():
    for policy in (S.Policy(100), S.Policy(100, 3), S.Policy(250, 5, 64, "emit")):
        one, many, t = S.Tiling(policy, 50), S.Tiling(policy, 50), 0
        for k in range(400):
            t += (k * 7 % 5) * 40 if k % 30 else -230
            first = one.number
            number, _, _, closed = many.place(X.np.array([t]), X.np.array([k % 9 * 5]))
            assert one.place_one(t, k % 9 * 5) == number[0]
            assert list(range(first, one.number)) == [f + i for _, f, c, *_ in closed for i in range(c)] and one == many
