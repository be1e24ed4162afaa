"""Segment closure: which records each ledger's segments hold and why they close.

Between two closures that restart the clock (a limit reached, a control), intervals tile time from the point of the
restart: a record's interval is a division, and it is refused if it lies before the latest interval reached. With an
interval alone, or a record limit alone, closure is therefore arithmetic and fully parallel. With mixed limits each restart
depends on the one before; a long ledger is cut into chunks whose maps from restart to restart are chained. Controls
go through a ledger once in arrival order, over arrays of (time, size). Hashing stays parallel in all cases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealstream.functions import values as V
from sealstream.operators.plan import count_up, running_max_before, running_totals, staged

WINDOW = 4096  # records looked at together


@dataclass
class Policy:
    interval_ms: int
    record_limit: int | None = None
    size_limit_bytes: int | None = None
    empty_mode: str = "suppress"

    def valid(self) -> bool:
        limits = [n for n in (self.interval_ms, self.record_limit, self.size_limit_bytes) if n is not None]
        return self.interval_ms is not None and min(limits) > 0 and self.empty_mode in ("suppress", "emit")

    @classmethod
    def of(cls, row: dict) -> Policy:
        numbers = [None if (n := row.get(k)) is None or pd.isna(n) else int(n)
                   for k in ("interval_ms", "record_limit", "size_limit_bytes")]
        return cls(*numbers, row.get("empty_mode") or "suppress")


@dataclass
class Tiling:
    """Intervals of one ledger since the last restart, up to the record before."""

    policy: Policy
    origin: int  # time of the restart
    reached: int = 0  # latest interval with a record or a control, counted from the restart
    number: int = 0  # segment number of that interval
    records: int = 0
    size: int = 0
    then: Policy | None = None  # policy from the next interval on
    continuity: str | None = None

    def begins(self, interval: int) -> int:
        return self.origin + interval * self.policy.interval_ms

    def closed(self, interval: int) -> list[tuple]:
        """Segments (first, count, reason, records, opened at) that end when ``interval`` is reached; it becomes the latest."""
        out, skipped = [], interval - self.reached
        if skipped and self.records:
            out.append((self.number, 1, "interval", self.records, self.begins(self.reached)))
            self.number, self.reached, skipped = self.number + 1, self.reached + 1, skipped - 1
        if skipped and self.policy.empty_mode == "emit":
            out.append((self.number, skipped, "interval", 0, self.begins(self.reached)))
            self.number += skipped
        if out or interval != self.reached:
            self.reached, self.records, self.size = interval, 0, 0
        return out

    def restart(self, at: int, reason: str, policy: Policy | None = None) -> list[tuple]:
        """Ends the latest interval at a point of time; the next ones are counted from there."""
        out = []
        if self.records or self.policy.empty_mode == "emit":
            out.append((self.number, 1, reason, self.records, self.begins(self.reached)))
            self.number += 1
        self.policy, self.then = policy or self.then or self.policy, None
        self.origin, self.reached, self.records, self.size = at, 0, 0, 0
        return out

    def elapse(self, now: int) -> list[tuple]:
        """Interval closures up to a time that is not before the latest interval."""
        out = []
        if self.then is not None and now >= self.begins(self.reached + 1):
            boundary = self.begins(self.reached + 1)
            out += self.restart(boundary, "interval")
        return out + self.closed((now - self.origin) // self.policy.interval_ms)

    def _one_by_one(self, t: list[int], size: list[int], at: int, number, opened, reason, closures: list[tuple]) -> int:
        """``place`` for records that close segments after a few; returns how many of them did."""
        p, closed = self.policy, 0
        every, most, bytes_ = p.interval_ms, p.record_limit or float("inf"), p.size_limit_bytes or float("inf")
        for k, (now, n) in enumerate(zip(t, size), at):
            interval = (now - self.origin) // every
            if interval != self.reached:
                if interval < self.reached:
                    continue
                closures += [(k, *c) for c in self.closed(interval)]
            self.records += 1
            self.size += n
            number[k], opened[k] = self.number, self.begins(interval)
            if self.size >= bytes_ or self.records >= most:
                reason[k] = "size_limit" if self.size >= bytes_ else "record_limit"
                closures += [(k, *c) for c in self.restart(now, reason[k])]
                closed += 1
        return closed

    def place_one(self, now: int, n: int) -> int:
        """``place`` of a record where no other policy waits: its segment number or -1. Segments from the number before to that after are closed."""
        interval = (now - self.origin) // self.policy.interval_ms
        if interval < self.reached:
            return -1
        if interval != self.reached:
            self.closed(interval)
        self.records, self.size, number = self.records + 1, self.size + n, self.number
        p = self.policy
        if p.size_limit_bytes and self.size >= p.size_limit_bytes:
            self.restart(now, "size_limit")
        elif p.record_limit and self.records >= p.record_limit:
            self.restart(now, "record_limit")
        return number

    def place(self, t: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """Segment number (-1: refused), opening and limit reason of records in arrival order, and the segments closed, each
        after the index of the record that closed it."""
        n, at = len(t), 0
        number, opened, reason = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, None, object)
        closures: list[tuple] = []
        limited, often = self.policy.record_limit or self.policy.size_limit_bytes, True
        while at < n:
            if limited and often and self.then is None:  # short segments: arrays would cost more than they save
                stop = min(n, at + 512)
                often = 16 * self._one_by_one(t[at:stop].tolist(), size[at:stop].tolist(), at, number, opened, reason, closures) >= stop - at
                at = stop
                continue
            if self.then is not None and t[at] >= self.begins(self.reached + 1):
                closures += [(at, *c) for c in self.elapse(int(t[at]))]
            p, part = self.policy, slice(at, min(n, at + WINDOW))
            interval = (t[part] - self.origin) // p.interval_ms
            latest = np.maximum.accumulate(np.concatenate([[self.reached], interval]))
            good = interval >= latest[:-1]
            if self.then is not None and (late := good & (interval > self.reached)).any():
                interval, good = interval[:late.argmax()], good[:late.argmax()]  # another policy rules from there on
            stop = len(good)
            where = np.flatnonzero(good)
            tiles = interval[where]
            fresh = np.concatenate([[True], tiles[1:] != tiles[:-1]]) if len(tiles) else np.empty(0, bool)
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(tiles)), 0))
            here = tiles == self.reached
            count = np.arange(len(tiles)) - head + 1 + np.where(here, self.records, 0)
            total = np.cumsum(size[part][where])
            before = np.concatenate([[0], total])[head]
            volume = total - before + np.where(here, self.size, 0)
            by_size = volume >= p.size_limit_bytes if p.size_limit_bytes else np.zeros(len(tiles), bool)
            full = by_size | (count >= p.record_limit if p.record_limit else np.zeros(len(tiles), bool))
            used = int(full.argmax()) + 1 if full.any() else len(tiles)
            if full.any():
                stop = int(where[used - 1]) + 1
            for k in np.flatnonzero(fresh[:used]):
                if k:
                    self.records, self.size = int(count[k - 1]), int(volume[k - 1])
                closures += [(at + int(where[k]), *c) for c in self.closed(int(tiles[k]))]
                until = min(used, int(np.searchsorted(head, k, side="right")))
                number[at + where[k:until]], opened[at + where[k:until]] = self.number, self.begins(int(tiles[k]))
            if used:
                self.records, self.size = int(count[used - 1]), int(volume[used - 1])
            if full.any():
                last = at + stop - 1
                reason[last] = "size_limit" if by_size[used - 1] else "record_limit"
                closures += [(last, *c) for c in self.restart(int(t[last]), reason[last])]
                often = used < 64
            at += stop
        return number, opened, reason, closures

    def control(self, kind: str, now: int, reason: str | None, continuity: str | None, policy: Policy | None) -> tuple:
        """A control event: (outcome, segments closed)."""
        if kind == "recover":
            out = self.restart(now, "recovery")
        elif now < self.begins(self.reached) or continuity != self.continuity:
            return "clock_discontinuity", []
        elif policy is not None and not policy.valid():
            return "invalid_policy", []
        elif kind == "policy":
            self.then = policy
            return "ok", []
        else:
            out = self.restart(now, "reconfigure" if kind == "policy_now" else reason, policy if kind == "policy_now" else None)
        self.continuity = continuity
        return "ok", out


EVENT_COLUMNS = ["ledger_id", "seq", "kind", "t_ms", "size", "continuity", "reason", "policy"]
SEALED = "array<struct<first:bigint,segments:bigint,reason:string,records:bigint,opened_at:bigint>>"
OUTCOME = f"ledger_id string, seq bigint, outcome string, segment_number bigint, sealed {SEALED}"


def segment_outcomes(state: Tiling, pdf: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of one ledger's events in order: runs of records that share a continuity go through together."""
    out = pd.DataFrame({"ledger_id": pdf["ledger_id"].to_numpy(), "seq": pdf["seq"].to_numpy(), "outcome": "ok"})
    number, sealed = np.full(len(pdf), -1, np.int64), [[] for _ in range(len(pdf))]
    t, size = pdf["t_ms"].to_numpy(np.int64), pdf["size"].fillna(0).to_numpy(np.int64)
    outcome = np.full(len(pdf), "ok", object)
    is_record = (pdf["kind"] == "record").to_numpy()
    marks = [None if pd.isna(c) else c for c in pdf["continuity"]]
    edges = [0, *(k for k in range(1, len(pdf)) if not (is_record[k] and is_record[k - 1] and marks[k] == marks[k - 1])), len(pdf)]
    for a, b in zip(edges, edges[1:]):
        if not is_record[a]:
            row = pdf.iloc[a]
            policy = None if row["policy"] is None else Policy.of(dict(row["policy"]))
            outcome[a], closed = state.control(row["kind"], int(t[a]), row["reason"], marks[a], policy)
            sealed[a] += closed
        elif marks[a] != state.continuity:
            outcome[a:b] = "clock_discontinuity"
        else:
            number[a:b], _, _, closures = state.place(t[a:b], size[a:b])
            outcome[a:b][number[a:b] < 0] = "clock_discontinuity"
            for k, *segment in closures:
                sealed[a + k].append(tuple(segment))
    out["outcome"] = outcome
    out["segment_number"] = pd.array(np.where(number < 0, 0, number), dtype="Int64")
    out.loc[number < 0, "segment_number"] = pd.NA
    names = ("first", "segments", "reason", "records", "opened_at")
    out["sealed"] = [[dict(zip(names, segment)) for segment in cell] for cell in sealed]
    return out


def as_events(records: DataFrame) -> DataFrame:
    """Plain records (ledger_id, seq, t_ms, size) as event rows."""
    policy = "struct<interval_ms:bigint,record_limit:bigint,size_limit_bytes:bigint,empty_mode:string>"
    return records.select(
        "ledger_id", F.col("seq").cast("bigint").alias("seq"), F.lit("record").alias("kind"), "t_ms",
        F.col("size").cast("bigint").alias("size"), F.lit(None).cast("string").alias("continuity"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast(policy).alias("policy"))


def _checked(policy: Policy) -> Policy:
    if not policy.valid():
        raise ValueError(f"not a policy: {policy}")
    return policy


def produce_segments(events: DataFrame, policy: Policy, origin_ms: int | None = 0,
                     continuity: str | None = None) -> DataFrame:
    """Outcome per event, in ``seq`` order per ledger, with the segments closed by it.

    Events are records and controls (see EVENT_COLUMNS). A record before the latest interval, or of another clock
    continuity, is refused as ``clock_discontinuity`` until a ``recover`` event; a control with a bad policy is refused as
    ``invalid_policy``. Each partition is read once, sorted; only the tiling of one ledger is held.
    """
    _checked(policy)

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in it:
            for ledger, part in pdf.groupby("ledger_id", sort=False):
                if ledger != current:
                    start = int(part["t_ms"].iloc[0]) if origin_ms is None else origin_ms
                    current, state = ledger, Tiling(policy, start, continuity=continuity)
                yield segment_outcomes(state, part)

    ordered = (events.select(*EVENT_COLUMNS).repartition("ledger_id")
               .sortWithinPartitions("ledger_id", "seq"))
    return ordered.mapInPandas(fold, OUTCOME)


RECORDS = "ledger_id string, seq bigint, segment_number bigint, opened_at bigint, limit_reason string, outcome string"


def _placed_batch(state: Tiling, ledger, seq, t: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Rows of RECORDS for records of one ledger in arrival order."""
    number, opened, reason, _ = state.place(t, size)
    bad = number < 0
    return pa.RecordBatch.from_arrays(
        [ledger, seq, pa.array(number, mask=bad), pa.array(opened, mask=bad), pa.array(reason, pa.string()),
         pa.array(np.where(bad, "clock_discontinuity", "ok"))],
        names=["ledger_id", "seq", "segment_number", "opened_at", "limit_reason", "outcome"])


def _assign_in_order(slim: DataFrame, policy: Policy, origin_ms: int) -> DataFrame:
    """Ledgers read one by one, each as a stream of three numbers per record."""
    def fold(it):
        current, state = None, None
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            t, size = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)] if len(ids) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if ids[a] != current:
                    current, state = ids[a], Tiling(policy, origin_ms)
                yield _placed_batch(state, batch.column(0)[a:b], batch.column(1)[a:b], t[a:b], size[a:b])

    ordered = slim.repartition("ledger_id").sortWithinPartitions("ledger_id", "seq")
    return ordered.mapInArrow(fold, RECORDS)


def restart_map(policy: Policy, t: np.ndarray, size: np.ndarray, before: int) -> dict[int, int]:
    """Where each possible state at record ``before`` leads: last restart before that record -> last restart among all records.

    A restart at a record (its limit reached) fixes all that follows, so a state is named by its last restart. Every record
    before ``before`` may be one; states that meet in one restart go on as one. All states take each record together.
    """
    size_limit, record_limit = policy.size_limit_bytes or (1 << 62), policy.record_limit or (1 << 62)
    origin, reached, records, volume = (np.zeros(before + 1, np.int64) for _ in range(4))
    last = np.zeros(before + 1, np.int64)  # the restart a state stands for
    count, entry, moved = 0, None, {}
    for k in range(len(t)):
        if k == before:
            entry = last[:count].copy()
        if count:
            o, r, n, v = origin[:count], reached[:count], records[:count], volume[:count]
            interval = (t[k] - o) // policy.interval_ms
            good, fresh = interval >= r, interval > r
            n[fresh], v[fresh] = 0, 0
            np.maximum(r, interval, out=r)
            n += good
            v += np.where(good, size[k], 0)
            full = good & ((n >= record_limit) | (v >= size_limit))
            if full.any():
                if k >= before:
                    moved[k] = last[:count][full].tolist()  # these go on as a restart at k
                kept = np.flatnonzero(~full)
                for x in (origin, reached, records, volume, last):
                    x[:len(kept)] = x[kept]
                count = len(kept)
                if k >= before:
                    origin[count], reached[count], records[count], volume[count], last[count] = t[k], 0, 0, 0, k
                    count += 1
        if k < before:
            origin[count], reached[count], records[count], volume[count], last[count] = t[k], 0, 0, 0, k
            count += 1
        elif count == 1:  # all states have met
            _, _, reason, _ = (state := Tiling(policy, int(origin[0]), int(reached[0]), 0, int(records[0]), int(volume[0]))).place(
                t[k + 1:], size[k + 1:])
            later = np.flatnonzero(reason != None)  # noqa: E711
            if len(later):
                moved[k + 1 + int(later[-1])] = [int(last[0])]
            break
    entry = last[:count].copy() if entry is None else entry
    ends: dict[int, int] = {}
    for k in sorted(moved, reverse=True):
        for j in moved[k]:
            ends[j] = ends.get(k, k)
    return {int(j): ends.get(int(j), int(j)) for j in entry}


def _assign_in_chunks(slim: DataFrame, policy: Policy, origin_ms: int, span: int, back: int) -> tuple[DataFrame, DataFrame]:
    """(records of RECORDS, ledgers left over) of ledgers cut into chunks of ``span`` records.

    Each chunk also sees the ``back`` records before it, and tells for every restart among these that may be the last one before the chunk
    which restart is the last one in it (``restart_map``). These short maps are chained per ledger; then all chunks are placed
    at once, each from its restart. A ledger with a chunk that no restart precedes within ``back`` records is left over.
    """
    numbered = running_totals(slim, ["ledger_id"], "seq", {"position": F.lit(1)}).withColumn("position", F.col("position") - 1)
    chunk = F.expr(f"position div {span}")
    ahead = F.when(F.expr(f"position % {span} >= {span - back}"), F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    dealt = staged(numbered.withColumn("chunk", F.explode(ahead)))
    # the last records of a ledger may lead into a chunk without records of its own
    has = dealt.filter(f"position div {span} = chunk").select("ledger_id", "chunk").distinct()
    dealt = dealt.join(has, ["ledger_id", "chunk"], "left_semi")

    def arrays(rows: pa.Table):
        order = np.argsort(rows["position"].to_numpy(), kind="stable")
        return [rows[c].to_numpy()[order] for c in ("position", "t_ms", "size")], rows["chunk"][0].as_py(), order

    def mapped(rows: pa.Table) -> pa.Table:
        (position, t, size), number, _ = arrays(rows)
        if number == 0:
            reason = Tiling(policy, origin_ms).place(t, size)[2]
            later = np.flatnonzero(reason != None)  # noqa: E711
            found = {-1: int(position[later[-1]]) if len(later) else -1}
        else:
            first = int(np.searchsorted(position, number * span))
            found = {int(position[j]): int(position[k]) for j, k in restart_map(policy, t, size, first).items()}
        return pa.table({"ledger_id": rows["ledger_id"].slice(0, 1).combine_chunks().take(pa.array([0] * len(found))),
                         "chunk": pa.array([number] * len(found), pa.int64()), "entry": pa.array(list(found), pa.int64()),
                         "exit": pa.array(list(found.values()), pa.int64())})

    maps = dealt.groupBy("ledger_id", "chunk").applyInArrow(mapped, "ledger_id string, chunk bigint, entry bigint, exit bigint")

    def chained(it):
        ledger, number, at, stepped = None, None, None, True
        for batch in it:
            out: list[tuple] = []
            for lid, k, entry, leads in zip(*(c.to_pylist() for c in batch.columns)):
                if (lid, k) != (ledger, number):
                    if not stepped:  # no map for the state: the rest of the ledger is unknown
                        out.append((ledger, number, None))
                        at = None
                    if lid != ledger:
                        at = -1
                    ledger, number, stepped = lid, k, False
                    before = at
                if not stepped and entry == before and before is not None:
                    out.append((lid, k, before))
                    at, stepped = leads, True
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int64()))], ["ledger_id", "chunk", "entry"])
        if not stepped:
            yield pa.RecordBatch.from_arrays([pa.array([ledger]), pa.array([number], pa.int64()), pa.array([None], pa.int64())],
                                             ["ledger_id", "chunk", "entry"])

    entries = staged(maps.repartition("ledger_id").sortWithinPartitions("ledger_id", "chunk", "entry").mapInArrow(
        chained, "ledger_id string, chunk bigint, entry bigint"))
    rest = entries.filter("entry IS NULL").select("ledger_id").distinct()
    known = entries.join(rest, "ledger_id", "left_anti")

    def placed(rows: pa.Table) -> pa.Table:
        (position, t, size), number, order = arrays(rows)
        entry = rows["entry"][0].as_py()
        first = int(np.searchsorted(position, number * span))
        if number == 0:
            state = Tiling(policy, origin_ms)
        else:
            j = int(np.searchsorted(position, entry))
            state = Tiling(policy, int(t[j]))
            state.place(t[j + 1:first], size[j + 1:first])
            state.number = 0
        own = rows.take(pa.array(order[first:]))
        out = pa.Table.from_batches([_placed_batch(state, own["ledger_id"].combine_chunks(), own["seq"].combine_chunks(),
                                                   t[first:], size[first:])])
        end = pa.table({c: pa.array([v], out.schema.field(c).type) for c, v in (
            ("ledger_id", own["ledger_id"][0].as_py()), ("seq", None), ("segment_number", state.number), ("opened_at", None),
            ("limit_reason", None), ("outcome", "end"))})
        both = pa.concat_tables([out, end])
        return both.append_column("chunk", pa.array([number] * both.num_rows, pa.int64()))

    done = staged(dealt.join(known, ["ledger_id", "chunk"]).groupBy("ledger_id", "chunk").applyInArrow(
        placed, RECORDS + ", chunk bigint"))
    before = Window.partitionBy("ledger_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = done.filter("outcome = 'end'").select(
        "ledger_id", "chunk", F.coalesce(F.sum("segment_number").over(before), F.lit(0)).alias("_first"))
    out = done.filter("outcome <> 'end'").join(ends, ["ledger_id", "chunk"])
    return out.withColumn("segment_number", F.col("segment_number") + F.col("_first")).select(
        "ledger_id", "seq", "segment_number", "opened_at", "limit_reason", "outcome"), rest


def assign_segments(records: DataFrame, policy: Policy, origin_ms: int = 0, span: int = 65536, back: int = 4096) -> DataFrame:
    """Segments of plain records (ledger_id, seq, t_ms, size) under mixed limits: number, ``opened_at`` of their interval,
    ``limit_reason`` on a record that closed its segment, and ``outcome``.

    Same rules as produce_segments without controls: a record before the latest interval is refused, with
    no segment number, whatever Arrow batch it is in. Only three numbers per record pass through.

    A ledger of more than ``span`` records is cut into chunks that are worked on at once, see ``_assign_in_chunks``; ``back`` is how many
    records without a limit reached may lie between two chunks' states. Where limits are reached more rarely than that, the
    ledger is read in order, with the same result.
    """
    _checked(policy)
    slim = records.selectExpr("ledger_id", "cast(seq as bigint) seq", "cast(t_ms as bigint) t_ms",
                              "cast(size as bigint) size")
    limited = policy.record_limit is not None or policy.size_limit_bytes is not None
    sizes = staged(slim.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("n"))) if limited else None
    if not limited or (long := sizes.filter(F.col("n") > span)).isEmpty():
        return _assign_in_order(slim, policy, origin_ms)
    many = slim.join(long.select("ledger_id"), "ledger_id", "left_semi")
    chunked, rest = _assign_in_chunks(many, policy, origin_ms, span, min(back, span))
    ordered = sizes.filter(F.col("n") <= span).select("ledger_id").unionByName(rest)
    return _assign_in_order(slim.join(ordered, "ledger_id", "left_semi"), policy, origin_ms).unionByName(chunked)


def segments_of(assigned: DataFrame) -> DataFrame:
    """One row per occupied segment: records, opened_at, close_reason (NULL while open)."""
    segs = assigned.filter("segment_number IS NOT NULL").groupBy("ledger_id", "segment_number").agg(
        F.count(F.lit(1)).alias("records"), F.min("opened_at").alias("opened_at"),
        F.max("limit_reason").alias("_r"))
    last = segs.groupBy("ledger_id").agg(F.max("segment_number").alias("_last"))
    return segs.join(last, "ledger_id").select(
        "ledger_id", "segment_number", "records", "opened_at",
        F.coalesce("_r", F.when(F.col("segment_number") < F.col("_last"), "interval")).alias("close_reason"))


def sealed_segments(outcomes: DataFrame) -> DataFrame:
    """One row per sealed segment: number, reason, records, opened_at."""
    runs = outcomes.select("ledger_id", F.inline("sealed"))
    return count_up(runs, F.col("first"), F.col("first") + F.col("segments") - 1, "segment_number").select(
        "ledger_id", "segment_number", F.col("reason").alias("close_reason"), "records", "opened_at")


def close_intervals(records: DataFrame, interval_ms: int, origin_ms: int = 0) -> DataFrame:
    """Pure interval closure: a record exactly on a boundary belongs to the next interval. Intervals before the
    origin have negative numbers; ``clock_discontinuities`` refuses their records."""
    since = f"(cast(t_ms as bigint) - {origin_ms})"
    return records.withColumn("interval_no", F.expr(f"({since} - pmod({since}, {interval_ms}L)) div {interval_ms}"))


def _occupied(records: DataFrame, interval_ms: int, origin_ms: int) -> DataFrame:
    """Intervals with records. Records before the origin are refused; others that ``clock_discontinuities`` finds are to be
    taken out before."""
    placed = close_intervals(records, interval_ms, origin_ms).filter("interval_no >= 0")
    return (placed.groupBy("ledger_id", "interval_no")
            .agg(F.count(F.lit(1)).alias("records")))


def number_segments_suppress(records: DataFrame, interval_ms: int, origin_ms: int = 0) -> DataFrame:
    """Contiguous numbers over occupied intervals; empty ones consume none."""
    w = Window.partitionBy("ledger_id").orderBy("interval_no")
    return _occupied(records, interval_ms, origin_ms).select(
        "ledger_id", "interval_no", (F.row_number().over(w) - 1).cast("bigint").alias("segment_number"),
        "records", F.when(F.lead("interval_no").over(w).isNull(), "shutdown").otherwise("interval")
        .alias("close_reason"))


def number_segments_emit(records: DataFrame, interval_ms: int, origin_ms: int = 0) -> DataFrame:
    """One segment per elapsed interval, empty ones with 0 records."""
    occupied = _occupied(records, interval_ms, origin_ms)
    last = occupied.groupBy("ledger_id").agg(F.max("interval_no").alias("last"))
    every = count_up(last, F.lit(0).cast("bigint"), F.col("last"), "interval_no")
    return every.join(occupied, ["ledger_id", "interval_no"], "left").select(
        "ledger_id", "interval_no", F.col("interval_no").alias("segment_number"),
        F.coalesce("records", F.lit(0)).alias("records"),
        F.when(F.col("interval_no") == F.col("last"), "shutdown").otherwise("interval").alias("close_reason"))


def empty_intervals(segments: DataFrame) -> DataFrame:
    """Segments that an emitting policy seals without records."""
    return segments.filter("records = 0")


def close_on_record_limit(records: DataFrame, limit: int) -> DataFrame:
    """Record limit alone: segment of each record by its position, in parallel."""
    numbered = running_totals(records, ["ledger_id"], "seq", {"position": F.lit(1)})
    return numbered.withColumn("segment_number", F.expr(f"(position - 1) div {limit}"))


def interval_counters(records: DataFrame, interval_ms: int, origin_ms: int = 0) -> DataFrame:
    """Running record and byte counters of each record's interval."""
    placed = close_intervals(records, interval_ms, origin_ms)
    return running_totals(placed, ["ledger_id", "interval_no"], "seq",
                          {"record_count": F.lit(1), "byte_count": F.col("size")})


def clock_discontinuities(records: DataFrame, interval_ms: int, origin_ms: int = 0) -> DataFrame:
    """Records that lie before the opening of the interval their ledger has reached (refused until recovery). ``open_interval``
    is that interval; a time that runs back inside it is no discontinuity."""
    placed = close_intervals(records, interval_ms, origin_ms)
    seen = running_max_before(placed, ["ledger_id"], "seq", "interval_no", "_open")
    return seen.withColumn("open_interval", F.greatest(F.lit(0).cast("bigint"), F.coalesce("_open", F.lit(0)))).drop(
        "_open").filter("interval_no < open_interval")


def assign_late(records: DataFrame, interval_ms: int, origin_ms: int = 0) -> DataFrame:
    """A late reading joins the interval open at its arrival; ``lateness_ms`` tells how late."""
    return close_intervals(records, interval_ms, origin_ms).withColumn(
        "lateness_ms", F.col("t_ms") - F.col("reading_ms"))


def precedence(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("int")
    for rank, name in V.CLOSE_REASONS:
        out = F.when(col == name, F.lit(rank)).otherwise(out)
    return out


def top_close_reason(candidates: DataFrame, group: list[str], reason: str = "reason") -> DataFrame:
    """Close reason with the highest precedence per group."""
    return candidates.groupBy(*group).agg(F.max_by(reason, precedence(reason)).alias("close_reason"))


def match_idempotency(requests: DataFrame, stored: DataFrame, order: str = "seq") -> DataFrame:
    """Requests (ledger_id, key, digest) against stored outcomes and each other.

    ``outcome``: ``new`` (first of its key), ``replay`` (same digest as the first),
    ``conflict`` (other digest). The first request of a key is found by a combined minimum.
    """
    keys = ["ledger_id", "key"]
    known = stored.select(*keys, F.col("digest").alias("_d"), F.lit(-1).cast("bigint").alias("_o"))
    asked = requests.select(*keys, F.col("digest").alias("_d"), F.col(order).cast("bigint").alias("_o"))
    # The partial minimum runs before the shuffle; a key used by a third of all requests
    # reaches the join as one row.
    first = known.unionByName(asked).groupBy(*keys).agg(
        F.min(F.struct("_o", "_d")).alias("_first"))
    joined = requests.join(first, keys)
    return joined.withColumn(
        "outcome", F.when(F.col("_first._o") == F.col(order), "new")
        .when(F.col("_first._d") == F.col("digest"), "replay").otherwise("conflict")).drop("_first")
