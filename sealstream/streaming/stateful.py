"""Stateful stream operators: replay windows, idempotent admission, segment closure.

State is a few values per key in the RocksDB store. Within a micro-batch the rows of a key
are put in arrival order; a micro-batch is at least one file, so ledgers hold its rows as Arrow columns and go through them in slices.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sealstream.functions import columns as C
from sealstream.functions import values as V
from sealstream.operators.producer import EVENT_COLUMNS, OUTCOME, Policy, Tiling, segment_outcomes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ordered(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


SLICE = 65536  # rows of a ledger taken together


def _slices(rows: Iterator[pd.DataFrame], by: str, columns: list[str]) -> Iterator[pd.DataFrame]:
    """``_ordered`` in slices: the rows of a key lie in Arrow columns, without the key, and few at a time are Python objects."""
    held = pa.concat_tables([pa.Table.from_pandas(part[columns], preserve_index=False) for part in rows], promote_options="permissive")
    order = np.argsort(held[by].to_numpy(), kind="stable")
    for at in range(0, len(order), SLICE):
        yield held.take(order[at:at + SLICE]).to_pandas()


class ReplayProcessor(StatefulProcessor):
    """Replay window of one device: highest admitted counter and the counters seen in reach."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "highest bigint, seen array<bigint>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((int(initialState["highest"].iloc[0]), [int(x) for x in initialState["seen"].iloc[0]]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        highest, seen = (known[0], set(known[1])) if known else (None, set())
        out = []
        for dev, seq, fc in _ordered(rows, "arrival_seq")[["dev_id", "arrival_seq", "fc"]].itertuples(index=False):
            reason = None
            if highest is not None and fc in seen:
                reason = "duplicate"
            elif highest is not None and abs(fc - highest) > self.window:
                reason = "out_of_window"
            else:
                seen.add(int(fc))
                if highest is None or fc > highest:
                    highest = int(fc)
                    seen = {s for s in seen if s >= highest - self.window}
            out.append((dev, seq, fc, reason))
        self.state.update((highest, sorted(seen)))
        yield pd.DataFrame(out, columns=["dev_id", "arrival_seq", "fc", "reason"])

    def close(self) -> None:
        pass


def admit_replay_stream(frames: DataFrame, window: int = V.REPLAY_WINDOW,
                        initial: DataFrame | None = None) -> DataFrame:
    """Streaming form of admit_replay; ``initial`` (dev_id, highest, seen) restores snapshots."""
    use_state_store(frames.sparkSession)
    keyed = frames.selectExpr("cast(dev_id as bigint) dev_id", "cast(arrival_seq as bigint) arrival_seq",
                              "cast(fc as bigint) fc").groupBy("dev_id")
    state = None if initial is None else initial.selectExpr(
        "cast(dev_id as bigint) dev_id", "cast(highest as bigint) highest", "seen").groupBy("dev_id")
    return keyed.transformWithStateInPandas(
        ReplayProcessor(window), "dev_id bigint, arrival_seq bigint, fc bigint, reason string",
        "Append", "None", state)


class IdempotencyProcessor(StatefulProcessor):
    """First digest per (ledger, key); later requests replay or conflict."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "digest string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get()[0] if self.first.exists() else None
        out = []
        for ledger, name, seq, digest in _ordered(rows, "seq")[["ledger_id", "key", "seq", "digest"]].itertuples(index=False):
            outcome = "new" if known is None else "replay" if digest == known else "conflict"
            if known is None:
                known = digest
                self.first.update((digest,))
            out.append((ledger, name, seq, outcome))
        yield pd.DataFrame(out, columns=["ledger_id", "key", "seq", "outcome"])

    def close(self) -> None:
        pass


def admit_idempotent_stream(requests: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    use_state_store(requests.sparkSession)
    return requests.select("ledger_id", "key", "seq", "digest").groupBy("ledger_id", "key").transformWithStateInPandas(
        IdempotencyProcessor(ttl_ms), "ledger_id string, key string, seq bigint, outcome string", "Append",
        "None" if ttl_ms is None else "ProcessingTime")


def _saved(tiling: Tiling) -> str:
    return json.dumps(asdict(tiling))


def _restored(text: str) -> Tiling:
    raw = json.loads(text)
    return Tiling(**raw | {k: Policy(**raw[k]) if raw[k] else None for k in ("policy", "then")})


BUCKET = 64  # outcomes of keys that share a value of the state
ENTRY = ("key", "digest", "segment_number", "first", "sealed", "revision", "expires")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Linear hashing: with one bucket more, only one of the others gives keys to it."""
    bits = max(buckets - 1, 0).bit_length()
    low = hashes & ((1 << bits) - 1)
    return np.where(low < buckets, low, low - (1 << bits >> 1))


def _hashes(names: pa.Array) -> np.ndarray:
    parts = [np.array([zlib.crc32(k.encode()) for k in names[at:at + SLICE].to_pylist()], np.int64) for at in range(0, len(names), SLICE)]
    return np.concatenate([np.empty(0, np.int64), *parts])


class StoredOutcomes:
    """Outcomes of a ledger's keys in a map state. A call to the store costs far more than the few bytes of an outcome, so those of about
    ``BUCKET`` keys lie together, as lists by ENTRY, and buckets are added as keys are. An outcome that has expired is left out."""

    def __init__(self, state, kept: int, buckets: int, now: int | None):
        self.state, self.kept, self.buckets, self.now = state, kept, buckets, now

    def _read(self, bucket: int) -> list[list]:
        found = self.state.getValue((int(bucket),))
        entries = json.loads(found[0]) if found else [[] for _ in ENTRY]
        if self.now is not None and any(at <= self.now for at in entries[-1]):
            entries = [list(c) for c in zip(*(e for e in zip(*entries) if e[-1] > self.now))] or [[] for _ in ENTRY]
        return entries

    def _write(self, bucket: int, entries: list[list]) -> None:
        self.state.updateValue((int(bucket),), (json.dumps(entries, separators=(",", ":")),))

    def known(self, names: pa.Array) -> Iterator[tuple[int, tuple]]:
        """(index, entry) of those names that are stored; a slice of the names is looked up at a time, bucket after bucket."""
        if not self.kept:
            return
        bucket = _bucket(_hashes(names), self.buckets)
        order = np.argsort(bucket, kind="stable")
        for at in range(0, len(order), SLICE):
            here = order[at:at + SLICE]
            place = dict(zip(names.take(pa.array(here)).to_pylist(), here.tolist()))
            for b in np.unique(bucket[here]):
                for entry in zip(*self._read(b)):
                    if entry[0] in place:
                        yield place[entry[0]], entry

    def _grow(self, buckets: int) -> None:
        old, self.buckets = self.buckets, buckets
        for b in np.unique(_bucket(np.arange(old, buckets), old)) if self.kept else ():
            entries = self._read(b)
            to = _bucket(np.array([zlib.crc32(k.encode()) for k in entries[0]], np.int64), buckets)
            for target in {int(b), *to.tolist()}:
                kept = np.flatnonzero(to == target).tolist()
                self._write(target, [[c[k] for k in kept] for c in entries])

    def add(self, names: pa.Array, digests: pa.Array, numbers: list[np.ndarray], expires: int | None) -> None:
        """Outcomes of keys that are not stored: segment number, first and count of the sealed ones, revision."""
        had = self.kept
        self._grow(max(self.buckets, -(-(had + len(names)) // BUCKET)))
        bucket = _bucket(_hashes(names), self.buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order)) if len(order) else []
        at = 0
        while at < len(order):
            stop = int(ends[min(np.searchsorted(ends, at + SLICE), len(ends) - 1)])  # whole buckets
            here = order[at:stop]
            columns = [c.take(pa.array(here)).to_pylist() for c in (names, digests)] + [c[here].tolist() for c in numbers]
            cuts = [0, *(np.flatnonzero(np.diff(bucket[here])) + 1).tolist(), len(here)]
            for a, b in zip(cuts, cuts[1:]):
                own = [c[a:b] for c in columns] + [[expires] * (b - a)]
                self._write(bucket[here[a]], [x + y for x, y in zip(self._read(bucket[here[a]]), own)] if had else own)
            at = stop
        self.kept += len(names)


class AdmissionProcessor(StatefulProcessor):
    """One ledger: its open interval and revision as one value, and the outcomes of its keys as a map beside it, see ``StoredOutcomes``.

    The rows of a micro-batch are held as numbers, keys and digests by their place among the different ones. Stored outcomes are looked up
    before and new ones written after all rows are decided; both go through each bucket once.
    """

    def __init__(self, policy: Policy, origin_ms: int, ttl_ms: int | None):
        self.policy, self.origin, self.ttl_ms = policy, origin_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "ledger string, revision bigint, kept bigint, buckets bigint")
        self.outcomes = handle.getMapState("outcomes", "bucket bigint", "entries string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, revision, kept, buckets = self.state.get() if self.state.exists() else (None, 0, 0, 1)
        tiling = _restored(text) if text else Tiling(self.policy, self.origin)
        now = None if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        stored = StoredOutcomes(self.outcomes, kept, buckets, now)
        asked = self._asked(rows)
        (names, code), (digests, digest) = asked["key"], asked["digest"]
        # Per key: place of the admitted row (-1: in an earlier batch), digest, and what is stored for it.
        n = len(code)
        at, same, what = np.full(len(names) + 1, n, np.int64), np.full(len(names) + 1, -2, np.int64), np.zeros((4, len(names) + 1), np.int64)
        earlier = list(stored.known(names))
        if earlier:
            where = pc.index_in(pa.array([e[1] for _, e in earlier], digests.type), value_set=digests).fill_null(-2).to_numpy()
            index = np.array([k for k, _ in earlier])
            same[index] = np.where([e[1] is None for _, e in earlier], -1, where)
            at[index], what[:, index] = -1, np.array([e[2:6] for _, e in earlier], np.int64).T
            del earlier
        order = np.argsort(asked["seq"].to_numpy(), kind="stable")
        for start in range(0, n, SLICE):
            here = order[start:start + SLICE]
            revision = self._admit(tiling, revision, start, code[here], digest[here], *(asked[c][here] for c in ("t_ms", "size", "key_ok", "wrong")),
                                   at, same, what)
            yield self._outcomes(key[0], asked["seq"].take(pa.array(here)), names, start, code[here], digest[here], asked["key_ok"][here],
                                 asked["wrong"][here], at, same, what)
        fresh = np.flatnonzero((at[:-1] >= 0) & (at[:-1] < n))
        stored.add(names.take(pa.array(fresh)), digests.take(pa.array(same[fresh], mask=same[fresh] < 0)), [w[fresh] for w in what],
                   None if now is None else now + self.ttl_ms)
        self.state.update((_saved(tiling), revision, stored.kept, stored.buckets))

    def _asked(self, rows: Iterator[pd.DataFrame]) -> dict:
        """Columns of all rows; ``key`` and ``digest`` as (different texts, place among them or -1)."""
        texts, numbers = ("key", "digest"), ("seq", "t_ms", "size")
        parts = [pa.table({c: pa.array(part[c], pa.large_string(), from_pandas=True).dictionary_encode() for c in texts}
                          | {c: pa.array(part[c], pa.int64(), from_pandas=True) for c in numbers}
                          | {"key_ok": part["key_ok"].to_numpy(bool), "wrong": part["record_error"].notna().to_numpy()}) for part in rows]
        held = pa.concat_tables(parts).unify_dictionaries().combine_chunks()
        del parts
        out = {c: held[c].to_numpy() for c in ("key_ok", "wrong")} | {c: held[c].combine_chunks() for c in numbers}
        empty = out["t_ms"].is_null().to_numpy(zero_copy_only=False) | out["size"].is_null().to_numpy(zero_copy_only=False)
        out |= {c: np.ma.array(out[c].fill_null(0).to_numpy(), mask=empty) if empty.any() else out[c].to_numpy() for c in ("t_ms", "size")}
        for c in texts:
            coded = held[c].combine_chunks()
            out[c] = coded.dictionary, coded.indices.fill_null(-1).to_numpy()
        return out

    @staticmethod
    def _admit(tiling: Tiling, revision: int, start: int, code, digest, t, size, key_ok, wrong, at, same, what) -> int:
        """Notes of the next rows which are admitted: the first of their key with a good record that the clock does not refuse."""
        tried = np.flatnonzero(key_ok & ~wrong & (at[code] > start))
        met, rows, made = set(), [], []
        for k, name, now, n in zip(tried.tolist(), code[tried].tolist(), t[tried].tolist(), size[tried].tolist()):
            if name not in met:
                if now is None or n is None:
                    raise ValueError("a record without time or size")
                first = tiling.number
                number = tiling.place_one(now, n)
                if number >= 0:
                    revision += 1
                    met.add(name)
                    rows.append(k)
                    made.append((number, first, tiling.number - first, revision))
        if rows:
            names = code[rows]
            at[names], same[names], what[:, names] = start + np.array(rows), digest[rows], np.array(made, np.int64).T
        return revision

    @staticmethod
    def _outcomes(ledger: str, seq: pa.Array, names: pa.Array, start: int, code, digest, key_ok, wrong, at, same, what) -> pd.DataFrame:
        place, first = np.arange(start, start + len(code)), np.where(key_ok, at[code], -1)
        equal = same[code] == digest
        outcome = np.select([~key_ok, first == place, (first < place) & equal, first < place, wrong],
                            ["invalid_key", "new", "replay", "conflict", "invalid_record"], "clock_discontinuity").astype(object)
        shown = key_ok & ((first == place) | ((first < place) & equal))
        number, opened, count, own = what[:, code]
        sealed = [list(range(a, a + c)) if yes else None for a, c, yes in zip(opened.tolist(), count.tolist(), shown.tolist())]
        return pd.DataFrame({"ledger_id": pd.Series([ledger] * len(code), dtype=object), "key": names.take(pa.array(code, mask=code < 0)).to_pandas(),
                             "seq": seq.to_pandas(), "outcome": outcome, "segment_number": pd.arrays.IntegerArray(number, ~shown),
                             "sealed": pd.Series(sealed, dtype=object), "revision": pd.arrays.IntegerArray(own, ~shown)})

    def close(self) -> None:
        pass


def admit_requests_stream(requests: DataFrame, policy: Policy, origin_ms: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """Streaming form of ``outcomes.admit_requests`` without earlier outcomes: same rules and columns. Outcomes stay in the state for ``ttl_ms``."""
    use_state_store(requests.sparkSession)
    rows = requests.select("ledger_id", "seq", "key", "digest", F.col("t_ms").cast("bigint").alias("t_ms"), F.col("size").cast("bigint").alias("size"),
                           F.coalesce(C.idempotency_key_ok("key"), F.lit(False)).alias("key_ok"), "record_error")
    schema = ("ledger_id string, key string, seq bigint, outcome string, segment_number bigint, sealed array<bigint>, revision bigint")
    return rows.groupBy("ledger_id").transformWithStateInPandas(
        AdmissionProcessor(policy, origin_ms, ttl_ms), schema, "Append", "None" if ttl_ms is None else "ProcessingTime")


class ProducerProcessor(StatefulProcessor):
    """Open interval of one ledger, kept as one JSON value. With ``idle_close`` a timer stands at the end of the interval."""

    def __init__(self, policy: Policy, origin_ms: int | None, continuity: str | None, idle_close: bool = False):
        self.policy, self.origin, self.continuity, self.idle_close = policy, origin_ms, continuity, idle_close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "ledger string")

    def _load(self, first_ms: int) -> Tiling:
        if not self.state.exists():
            return Tiling(self.policy, first_ms if self.origin is None else self.origin, continuity=self.continuity)
        return _restored(self.state.get()[0])

    def _keep(self, tiling: Tiling) -> None:
        self.state.update((_saved(tiling),))
        if self.idle_close and (tiling.records or tiling.policy.empty_mode == "emit"):
            self.handle.registerTimer(tiling.begins(tiling.reached + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tiling = None
        for pdf in _slices(rows, "seq", [c for c in EVENT_COLUMNS if c != "ledger_id"]):
            tiling = tiling or self._load(int(pdf["t_ms"].iloc[0]))
            yield segment_outcomes(tiling, pdf.assign(ledger_id=key[0]))
        self._keep(tiling)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes the interval that has ended, unless an event has closed it before."""
        now, tiling = expiredTimerInfo.getExpiryTimeInMs(), _restored(self.state.get()[0])
        closed = tiling.elapse(now) if now >= tiling.begins(tiling.reached + 1) else []
        if closed:
            self._keep(tiling)
            names = ("first", "segments", "reason", "records", "opened_at")
            yield pd.DataFrame({"ledger_id": [key[0]], "seq": pd.array([pd.NA], dtype="Int64"), "outcome": ["timer"],
                                "segment_number": pd.array([pd.NA], dtype="Int64"), "sealed": [[dict(zip(names, c)) for c in closed]]})

    def close(self) -> None:
        pass


def produce_segments_stream(events: DataFrame, policy: Policy, origin_ms: int | None = 0,
                            continuity: str | None = None, idle_close: bool = False) -> DataFrame:
    """Streaming form of produce_segments. Intervals close when the next event of the ledger
    arrives, like the admitting call does; a ``close`` control ends an idle ledger.

    With ``idle_close`` the clock closes the interval of an idle ledger too: a row without ``seq`` and with the outcome ``timer`` has the
    segments sealed. That is for live streams, whose times are those of the clock; old events read again would find their intervals closed.
    """
    use_state_store(events.sparkSession)
    return events.select(*EVENT_COLUMNS).groupBy("ledger_id").transformWithStateInPandas(
        ProducerProcessor(policy, origin_ms, continuity, idle_close), OUTCOME, "Append", "ProcessingTime" if idle_close else "None")
