import pytest

from sealstream.operators import producer as S

POLICY = "struct<interval_ms:bigint,record_limit:bigint,size_limit_bytes:bigint,empty_mode:string>"
SCHEMA = f"ledger_id string, seq long, kind string, t_ms long, size long, continuity string, reason string, policy {POLICY}"


def event(seq, t, kind="record", size=16, continuity="a", reason=None, policy=None):
    return ("L", seq, kind, t, size, continuity, reason, policy)


def run(spark, events, policy, origin=0):
    df = spark.createDataFrame(events, SCHEMA)
    out = S.produce_segments(df, policy, origin, "a")
    rows = sorted(out.collect(), key=lambda r: r.seq)
    sealed = [(s["first"], s.segments, s.reason, s.records, s.opened_at) for r in rows for s in r.sealed]
    return [(r.outcome, r.segment_number) for r in rows], sealed


def test_exact_boundary(spark):
    got, sealed = run(spark, [event(0, 0), event(1, 100)], S.Policy(100))
    assert got == [("ok", 0), ("ok", 1)] and sealed == [(0, 1, "interval", 1, 0)]


def test_suppress_skips_empty_intervals(spark):
    got, sealed = run(spark, [event(0, 350), event(1, 399), event(2, 400)], S.Policy(100))
    assert got == [("ok", 0), ("ok", 0), ("ok", 1)] and sealed == [(0, 1, "interval", 2, 300)]


def test_emit_seals_empty_intervals(spark):
    got, sealed = run(spark, [event(0, 250)], S.Policy(100, empty_mode="emit"))
    assert got == [("ok", 2)] and sealed == [(0, 2, "interval", 0, 0)]
    df = spark.createDataFrame([event(0, 250)], SCHEMA)
    rows = S.sealed_segments(S.produce_segments(df, S.Policy(100, empty_mode="emit"), 0, "a")).collect()
    assert sorted(r.segment_number for r in rows) == [0, 1]


def test_record_limit(spark):
    got, sealed = run(spark, [event(0, 10), event(1, 20), event(2, 119), event(3, 120)], S.Policy(100, record_limit=2))
    assert got == [("ok", 0), ("ok", 0), ("ok", 1), ("ok", 2)]
    assert sealed == [(0, 1, "record_limit", 2, 0), (1, 1, "interval", 1, 20)]


def test_size_beats_record(spark):
    _, sealed = run(spark, [event(0, 1), event(1, 2)], S.Policy(100, record_limit=2, size_limit_bytes=32))
    assert sealed == [(0, 1, "size_limit", 2, 0)]


def test_policy_updates(spark):
    new, bad = (50, None, None, "suppress"), (0, None, None, "suppress")
    got, _ = run(spark, [event(0, 10), event(1, 20, "policy_now", policy=bad), event(2, 30, "policy", policy=(9, -1, None, "emit"))], S.Policy(100))
    assert [o for o, _ in got] == ["ok", "invalid_policy", "invalid_policy"]
    with pytest.raises(ValueError):
        S.assign_segments(spark.range(0), S.Policy(0))
    got, sealed = run(spark, [event(0, 10), event(1, 20, "policy_now", policy=new), event(2, 69), event(3, 70)], S.Policy(100))
    assert sealed == [(0, 1, "reconfigure", 1, 0), (1, 1, "interval", 1, 20)]
    assert got[2:] == [("ok", 1), ("ok", 2)]
    # A later policy rules from the next interval on.
    got, sealed = run(spark, [event(0, 10), event(1, 20, "policy", policy=new), event(2, 120), event(3, 150)], S.Policy(100))
    assert sealed == [(0, 1, "interval", 1, 0), (1, 1, "interval", 1, 100)]


def test_continuity_needs_recovery(spark):
    events = [event(0, 10), event(1, 20, continuity="b"), event(2, 5, "recover", continuity="b"), event(3, 30, continuity="b"),
              event(4, 2, continuity="b")]
    got, sealed = run(spark, events, S.Policy(100))
    assert got == [("ok", 0), ("clock_discontinuity", None), ("ok", None), ("ok", 1), ("clock_discontinuity", None)]
    assert sealed == [(0, 1, "recovery", 1, 0)]


def test_close(spark):
    _, sealed = run(spark, [event(0, 10), event(1, 20, "close", reason="shutdown"), event(2, 30, "close", reason="manual")], S.Policy(100))
    assert sealed == [(0, 1, "shutdown", 1, 0)]


def test_precedence(spark):
    names = ["manual", "interval", "record_limit", "size_limit", "reconfigure", "shutdown", "recovery"]
    for i in range(2, 8):
        df = spark.createDataFrame([(1, n) for n in names[:i]], "g int, reason string")
        assert S.top_close_reason(df, ["g"]).first().close_reason == names[i - 1]


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_record_limit_in_parallel_equals_fold(spark, limit):
    df = spark.range(0, 500).selectExpr("concat('L', id % 2) ledger_id", "id seq", "0L t_ms", "10L size")
    fold = S.produce_segments(S.as_events(df), S.Policy(10, record_limit=limit))
    a = {r.seq: r.segment_number for r in fold.collect()}
    b = {r.seq: r.segment_number for r in S.close_on_record_limit(df, limit).collect()}
    assert a == b


def test_idempotency(spark):
    req = spark.createDataFrame([("L", "k", "d1", 1), ("L", "k", "d1", 2), ("L", "k", "d2", 3), ("L", "s", "x", 4), ("L", "s", "y", 5)],
                                "ledger_id string, key string, digest string, seq long")
    old = spark.createDataFrame([("L", "s", "x")], "ledger_id string, key string, digest string")
    got = {r.seq: r.outcome for r in S.match_idempotency(req, old).collect()}
    assert got == {1: "new", 2: "replay", 3: "conflict", 4: "replay", 5: "conflict"}


def by_event(events, policy, origin):
    """Closure told record by record: (number, opening, limit reason) or None for a refused one; and the closed segments."""
    opened, number, held, volume, out, segments = origin, 0, 0, 0, [], []
    for t, size in events:
        if t < opened:
            out.append(None)
            continue
        while t >= opened + policy.interval_ms:
            if held or policy.empty_mode == "emit":
                segments.append((number, held, opened, "interval"))
                number += 1
            opened, held, volume = opened + policy.interval_ms, 0, 0
        held, volume = held + 1, volume + size
        why = ("size_limit" if policy.size_limit_bytes and volume >= policy.size_limit_bytes else
               "record_limit" if policy.record_limit and held >= policy.record_limit else None)
        out.append((number, opened, why))
        if why:
            segments.append((number, held, opened, why))
            opened, number, held, volume = t, number + 1, 0, 0
    return out, segments


POLICIES = (S.Policy(100), S.Policy(100, record_limit=3), S.Policy(1000, size_limit_bytes=48), S.Policy(1, record_limit=1),
            S.Policy(250, 5, 64, "emit"), S.Policy(100, empty_mode="emit"), S.Policy(10**9, 4, 64))


@pytest.mark.parametrize("seed", range(3))
def test_place_equals_record_by_record(seed, monkeypatch):
    """Ties, gaps, every limit, clocks that run back by a little and before the origin, and any cut into batches."""
    import random

    import numpy as np
    rnd = random.Random(seed)
    events, t = [], -300
    for _ in range(2500):
        t += rnd.choice([0, 0, 1, 3, 10, 99, 100, 101, 350, -1, -60, -400])
        events.append((t, rnd.choice([1, 8, 16, 40])))
    monkeypatch.setattr(S, "WINDOW", 64)
    for policy in POLICIES:
        want, closed = by_event(events, policy, 0)
        for cut in (1, 7, 10_000):
            state, got, segments = S.Tiling(policy, 0), [], []
            for k in range(0, len(events), cut):
                times, sizes = (np.array(x, np.int64) for x in zip(*events[k:k + cut]))
                number, opened, reason, closures = state.place(times, sizes)
                got += [None if n < 0 else (n, o, r) for n, o, r in zip(number.tolist(), opened.tolist(), reason)]
                segments += [c[1:] for c in closures]
            assert got == want
            each = [(first + k, records, opened + k * policy.interval_ms, why)
                    for first, count, why, records, opened in segments for k in range(count)]
            assert each == closed


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_refused_rows_do_not_depend_on_batches(spark, batch):
    rows = [("L", k, t, 8) for k, t in enumerate([0, 100, 50, -5, 120, 260, 130])]
    df = spark.createDataFrame(rows, "ledger_id string, seq long, t_ms long, size long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        fast = {r.seq: (r.segment_number, r.outcome) for r in S.assign_segments(df, S.Policy(1000, record_limit=2)).collect()}
        slow = {r.seq: (r.segment_number, r.outcome) for r in S.produce_segments(S.as_events(df), S.Policy(1000, record_limit=2)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    no = (None, "clock_discontinuity")
    assert fast == slow == {0: (0, "ok"), 1: (0, "ok"), 2: no, 3: no, 4: (1, "ok"), 5: (1, "ok"), 6: no}


def test_records_before_the_origin(spark):
    df = spark.createDataFrame([("L", 0, -1, 8), ("L", 1, 5, 8), ("L", 2, 250, 8)], "ledger_id string, seq long, t_ms long, size long")
    assert [r.event for r in S.clock_discontinuities(df, 100).selectExpr("seq AS event").collect()] == [0]
    emitted = S.number_segments_emit(df, 100).orderBy("segment_number").collect()
    assert [(r.segment_number, r.records) for r in emitted] == [(0, 1), (1, 0), (2, 1)]


@pytest.mark.parametrize("jump", [1, 30])
def test_restart_map_equals_the_fold(jump):
    """Every restart before the chunk leads where reading on from it leads."""
    import random

    import numpy as np
    rnd = random.Random(jump)
    for policy in (S.Policy(100, 3), S.Policy(1000, None, 48), S.Policy(250, 5, 64, "emit"), S.Policy(10**9, 4, 64), S.Policy(50, 40)):
        t = np.cumsum([rnd.choice([0, 0, 1, 3, 10, 99, 100, -1, -60]) * jump for _ in range(400)]).astype(np.int64) + 500
        size = np.array([rnd.choice([1, 8, 16, 40]) for _ in t], np.int64)
        before = 60
        found = S.restart_map(policy, t, size, before)
        for j in range(before):
            reason = S.Tiling(policy, int(t[j])).place(t[j + 1:], size[j + 1:])[2]
            restarts = [j + 1 + int(k) for k in np.flatnonzero(reason != None)]  # noqa: E711
            if any(k < before for k in restarts):
                continue  # not the last one before the chunk
            assert found[j] == (restarts[-1] if restarts else j)


@pytest.mark.parametrize("policy", [p for p in POLICIES if p.record_limit or p.size_limit_bytes][1:4])
def test_long_ledgers_in_chunks_equal_record_by_record(spark, policy):
    import random
    rnd = random.Random(5)
    rows, want = [], {}
    for ledger, n in (("long", 1500), ("short", 90), ("sparse", 700)):
        events, t = [], -300
        for _ in range(n):
            t += rnd.choice([0, 0, 1, 3, 10, 99, 100, 101, 350, -1, -60, -400]) if ledger != "sparse" else 5000
            events.append((t, rnd.choice([1, 8, 16, 40]) if ledger != "sparse" else 1))
        for k, (got, (t, size)) in enumerate(zip(by_event(events, policy, 0)[0], events)):
            rows.append((ledger, 7 * k + 3, t, size))
            want[ledger, 7 * k + 3] = (None, None, None) if got is None else got
    df = spark.createDataFrame(rows, "ledger_id string, seq long, t_ms long, size long")
    got = S.assign_segments(df.repartition(4), policy, 0, span=200, back=50).collect()
    assert {(r.ledger_id, r.seq): (r.segment_number, r.opened_at, r.limit_reason) for r in got} == want
    assert all((r.outcome == "ok") == (r.segment_number is not None) for r in got)


def test_a_long_ledger_is_many_tasks(spark):
    df = spark.range(4000).selectExpr("'L' ledger_id", "id seq", "id * 10 t_ms", "16L size")
    chunked, rest = S._assign_in_chunks(df, S.Policy(10**6, 7), 0, 200, 50)
    assert rest.count() == 0 and chunked.count() == 4000
    assert [r.n for r in chunked.groupBy("segment_number").agg({"seq": "count"}).toDF("s", "n").filter("s < 571").select("n").distinct().collect()] == [7]
