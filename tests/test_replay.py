import random

import pytest

from sealstream.operators import replay as R


def brute(rows, window, highest=None, seen=()):
    seen, out = set(seen), {}
    for seq, fc in rows:
        if highest is None:
            out[seq], highest, seen = None, fc, {fc}
        elif fc in seen:
            out[seq] = "duplicate"
        elif abs(fc - highest) > window:
            out[seq] = "out_of_window"
        else:
            out[seq] = None
            if fc > highest:
                highest, seen = fc, {s for s in seen if s >= fc - window}
            seen.add(fc)
    return out, highest, seen


def traffic(seed, n=5000):
    rnd = random.Random(seed)
    rows, at = [], 100
    for i in range(n):
        at += rnd.choice([0, 1, 1, 2])
        jump = rnd.choice([0] * 30 + [70, -70, 9, -9, 4000])
        rows.append((rnd.choice([1] * 5 + [2, 3]), i * 13, max(0, at + rnd.randint(-5, 5) + jump)))
    return rows


def per_device(rows):
    out = {}
    for dev, seq, fc in rows:
        out.setdefault(dev, []).append((seq, fc))
    return out


@pytest.mark.parametrize("chunk", [7, 64, 100000])
def test_equals_sequential(spark, chunk):
    rows = traffic(1)
    df = spark.createDataFrame(rows, "dev_id long, arrival_seq long, fc long").repartition(6)
    got = {r.arrival_seq: r.reason for r in R.admit_replay(df, 8, chunk=chunk).collect()}
    want = {}
    for dev, seq in per_device(rows).items():
        want.update(brute(seq, 8)[0])
    assert got == want


def test_hostile_counters(spark):
    """Counters far apart make every summary as long as its chunk; results stay exact."""
    rnd = random.Random(5)
    rows = [(1, i, rnd.randrange(2**32) if i % 3 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "dev_id long, arrival_seq long, fc long")
    got = {r.arrival_seq: r.reason for r in R.admit_replay(df, 64, chunk=50).collect()}
    assert got == brute([(s, f) for _, s, f in rows], 64)[0]


def test_snapshot_restore(spark):
    rows = traffic(9)
    df = spark.createDataFrame(rows, "dev_id long, arrival_seq long, fc long")
    cut = rows[len(rows) // 2][1]
    first = R.admit_replay(df.filter(f"arrival_seq < {cut}"), 8, chunk=32)
    state = R.restore_replay(R.snapshot_replay(first, 8)).filter("error is null")
    second = R.admit_replay(df.filter(f"arrival_seq >= {cut}"), 8, chunk=32, initial=state)
    got = {r.arrival_seq: r.reason for r in first.unionByName(second).collect()}
    after = {r.dev_id: (r.highest, set(r.seen)) for r in R.snapshot_replay(second, 8, initial=state).collect()}
    for dev, seq in per_device(rows).items():
        want, highest, seen = brute(seq, 8)
        assert {s: got[s] for s in want} == want
        assert after[dev] == (highest, seen)


def test_published_sequences(spark):
    # Accepts and prunes; rejects.
    a = spark.createDataFrame([(1, i, fc) for i, fc in enumerate([2, 3, 4, 5])], "dev_id long, arrival_seq long, fc long")
    one = spark.createDataFrame([(1, 1, [1])], "dev_id long, highest long, seen array<long>")
    d = R.admit_replay(a, 3, initial=one)
    assert d.filter("reason is not null").count() == 0
    assert R.snapshot_replay(d, 3, initial=one).first().seen == [2, 3, 4, 5]
    b = spark.createDataFrame([(1, 0, 10), (1, 1, 5), (1, 2, 20)], "dev_id long, arrival_seq long, fc long")
    ten = spark.createDataFrame([(1, 10, [10])], "dev_id long, highest long, seen array<long>")
    got = [r.reason for r in R.admit_replay(b, 4, initial=ten).orderBy("arrival_seq").collect()]
    assert got == ["duplicate", "out_of_window", "out_of_window"]


def test_broken_snapshots(spark):
    rows = [(1, 1, 4, 10, [6, 10]), (2, 2, 4, 10, [10]), (3, 1, 0, 10, [10]), (4, 1, 4, 10, [5]),
            (5, 1, 4, 10, [11]), (6, 1, 4, None, [1]), (7, 1, 4, None, [])]
    df = spark.createDataFrame(rows, "dev_id int, version int, window_size int, highest long, seen array<long>")
    got = {r.dev_id for r in R.restore_replay(df).filter("error is null").collect()}
    assert got == {1, 7}
