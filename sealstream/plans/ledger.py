"""Registered queries: blocks, days, batches, segments, closure and idempotency."""

from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.functions import values as V
from sealstream.operators import ledger as L
from sealstream.operators import merkle as M
from sealstream.operators import outcomes as N
from sealstream.operators import producer as S
from sealstream.operators.plan import dealt, own_folder, staged
from sealstream.plans import commitment as Q
from sealstream.plans import telemetry as T
from sealstream.plans.registry import query
from sealstream.sources.artifacts import scan_files
from sealstream.sources.sinks import write_day_artifacts

ORIGIN = T.FIRST_HOUR * 3600000
INTERVAL = 6 * 3600000
BATCH = 10


@query("c03_sorted_leaves", f"""{Q.WITH}, {Q.LEAF1} SELECT site_id, day, leaf, count(*) AS copies,
  min(i) AS position FROM (SELECT site_id, day, leaf, row_number() OVER (PARTITION BY site_id, day ORDER BY leaf) - 1 AS i FROM l1) GROUP BY ALL""")
def c03(spark, sf):
    return L.block_leaves(Q.leaves(spark, sf, 1))


def order_leaves(spark, sf):
    """Line items as leaves, one group per order; sums of equal line numbers repeat."""
    li = T.table(spark, sf, "lineitem")
    return li.select("l_orderkey", M.leaf_hash_v1(C.text_bytes(F.concat_ws(
        "|", "l_partkey", "l_suppkey", "l_linenumber"))).alias("leaf"))


OL = "ol AS (SELECT l_orderkey, sha256(l_partkey || '|' || l_suppkey || '|' || l_linenumber) AS leaf FROM lineitem)"


@query("w01_leaf_positions", f"""WITH {OL} SELECT l_orderkey, leaf, min(i) AS position FROM (SELECT *, row_number()
  OVER (PARTITION BY l_orderkey ORDER BY leaf) - 1 AS i FROM ol) GROUP BY ALL""")
def w01(spark, sf):
    return M.sort_leaves(order_leaves(spark, sf), ["l_orderkey"]).select(
        "l_orderkey", C.hex_lower("leaf").alias("leaf"), F.col("start").alias("position"))


@query("u02_order_roots", f"WITH RECURSIVE {OL}, {T.duck_roots('r', 'ol', 'l_orderkey', 1)} SELECT * FROM r")
def u02(spark, sf):
    return M.merkle_root_v1(order_leaves(spark, sf), ["l_orderkey"]).select(
        "l_orderkey", "leaf_count", C.hex_lower("root").alias("root"))


@query("u06_table_root", f"WITH RECURSIVE {OL}, o1 AS (SELECT 1 AS batch, leaf FROM ol), {T.duck_roots('r', 'o1', 'batch', 2)} SELECT leaf_count, root FROM r")
def u06(spark, sf):
    one = order_leaves(spark, sf).select(F.lit(1).alias("batch"), "leaf")
    return M.merkle_root_v2(one, ["batch"]).select("leaf_count", C.hex_lower("root").alias("root"))


# Frames of an order, three to a batch, in the order of their leaves.
@query("u06_batch_objects", f"""WITH RECURSIVE fr AS (SELECT l_orderkey, l_partkey || '|' || l_suppkey || '|' || l_linenumber AS frame FROM lineitem),
  pl AS (SELECT *, sha256('\\x00'::BLOB || encode(frame)) AS leaf FROM fr), ps AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY leaf, frame) - 1) // 3 AS batch_number FROM pl),
  {T.duck_roots('r', 'ps', 'l_orderkey, batch_number', 2)} SELECT l_orderkey, batch_number, leaf_count AS count, root AS merkle_root, frames
  FROM r JOIN (SELECT l_orderkey, batch_number, string_agg(frame, ',' ORDER BY leaf, frame) AS frames FROM ps GROUP BY ALL) USING (l_orderkey, batch_number)""")
def u06b(spark, sf):
    frames = T.table(spark, sf, "lineitem").select("l_orderkey", C.text_bytes(F.concat_ws(
        "|", "l_partkey", "l_suppkey", "l_linenumber")).alias("frame"))
    objects = L.batch_objects(frames, ["l_orderkey"], 3)
    return objects.withColumn("frames", F.array_join(F.transform("frames", lambda f: F.decode(f, "UTF-8")), ","))


BLK = f"""{Q.LEAF1}, {T.duck_roots('r', 'l1', 'site_id, day', 1)},
 blk AS (SELECT CAST(1 AS BIGINT) AS version, site_id, day, site_id || '-' || day || '-00' AS batch_id, root AS merkle_root, leaf_count AS count FROM r)"""


@query("c08_block_headers", f"{Q.RWITH}, {BLK} SELECT * FROM blk")
def c08(spark, sf):
    return T.big(L.build_block_headers(Q.leaves(spark, sf, 1)))


DAYS = """dys AS (SELECT CAST(1 AS BIGINT) AS version, site_id, day AS date, lag(merkle_root, 1, repeat('0', 64)) OVER (PARTITION BY site_id ORDER BY day)
  AS prev_day_root, batch_id, count, merkle_root AS day_root FROM blk)"""


@query("c09_day_records", f"{Q.RWITH}, {BLK}, {DAYS} SELECT * FROM dys")
def c09(spark, sf):
    return T.big(L.build_day_records(L.build_block_headers(Q.leaves(spark, sf, 1))))


@query("j08_day_links", f"{Q.RWITH}, {BLK}, {DAYS} SELECT site_id, date AS day, prev_day_root FROM dys")
def j08(spark, sf):
    return L.link_days(L.build_block_headers(Q.leaves(spark, sf, 1))).select("site_id", "day", "prev_day_root")


def key(name):
    return T.duck_text(f"'{name}'")


DAY_HEX = f"""'A6' || {key('date')} || {T.duck_text('date')} || {key('batches')} || '81A7' || {key('day')} || {T.duck_text('date')} ||
 {key('count')} || {T.duck_head(0, 'count')} || {key('site_id')} || {T.duck_text('site_id')} || {key('version')} || '01' || {key('batch_id')} ||
 {T.duck_text('batch_id')} || {key('leaf_hashes')} || {T.duck_head(4, 'count')} || leaves || {key('merkle_root')} || {T.duck_text('day_root')} ||
 {key('site_id')} || {T.duck_text('site_id')} || {key('version')} || '01' || {key('day_root')} || {T.duck_text('day_root')} ||
 {key('prev_day_root')} || {T.duck_text('prev_day_root')}"""


DAY_FILES = f"""lv AS (SELECT site_id, day, string_agg('7840' || hex(encode(leaf)), '' ORDER BY leaf) AS leaves, string_agg('"' || leaf || '"', ',' ORDER BY leaf) AS quoted
  FROM l1 GROUP BY ALL), art AS (SELECT d.site_id, day, {DAY_HEX.replace('site_id', 'd.site_id').replace(chr(39) + 'd.site_id' + chr(39), chr(39) + 'site_id' + chr(39))} AS h, '{{"batch_id":"' || batch_id || '","count":' || count ||
   ',"day":"' || day || '","leaf_hashes":[' || quoted || '],"merkle_root":"' || day_root || '","site_id":"' || d.site_id || '","version":1}}' AS block, d.*
  FROM dys d JOIN lv ON d.site_id = lv.site_id AND d.date = lv.day),
  file AS (SELECT site_id || '/blocks/' || day || '-00.block.json' AS path, hex(encode(block)) AS h FROM art
   UNION ALL SELECT site_id || '/day/' || day || '.json', hex(encode('{{"batches":[' || block || '],"date":"' || day || '","day_root":"' || day_root ||
    '","prev_day_root":"' || prev_day_root || '","site_id":"' || site_id || '","version":1}}')) FROM art
   UNION ALL SELECT site_id || '/day/' || day || '.cbor', h FROM art
   UNION ALL SELECT site_id || '/day/' || day || '.cbor.sha256', hex(encode(sha256(unhex(h)) || '  ' || day || '.cbor' || chr(10))) FROM art)"""


@query("s09_day_artifacts", f"""{Q.RWITH}, {BLK}, {DAYS}, {DAY_FILES} SELECT path, sha256(unhex(h)) AS sha256, length(h) // 2 AS size FROM file""")
def s09(spark, sf):
    """Files of every day, written and read back."""
    root = own_folder(spark, "days")
    write_day_artifacts(Q.leaves(spark, sf, 1), root)
    back = scan_files(spark, root)
    return back.select(F.concat("bundle", F.lit("/"), "path").alias("path"), "sha256", F.octet_length("content").cast("bigint").alias("size"))


# Segments of the interval policy: 6 hours, 10 records per batch, empty ones suppressed.
SEGS = f"""iv AS (SELECT *, (t_ms - {ORIGIN}) // {INTERVAL} AS interval_no FROM rec),
 num AS (SELECT ledger_id, interval_no, row_number() OVER (PARTITION BY ledger_id ORDER BY interval_no) - 1 AS segment_number,
  count(*) AS records, CASE WHEN lead(interval_no) OVER (PARTITION BY ledger_id ORDER BY interval_no) IS NULL THEN 'shutdown' ELSE 'interval' END
  AS close_reason FROM iv GROUP BY ledger_id, interval_no),
 sl AS (SELECT iv.ledger_id, iv.site_id, segment_number, sha256(unhex('00') || unhex(record_hex)) AS leaf,
  row_number() OVER (PARTITION BY iv.ledger_id, segment_number ORDER BY sha256(unhex('00') || unhex(record_hex))) - 1 AS pos
  FROM iv JOIN num USING (ledger_id, interval_no)),
 bl AS (SELECT ledger_id, segment_number, pos // {BATCH} AS batch_number, leaf FROM sl)"""
SROOT = T.duck_roots("sr", "sl", "ledger_id, segment_number", 2)
BROOT = T.duck_roots("br", "bl", "ledger_id, segment_number, batch_number", 2)


def records(spark, sf):
    return record_columns(T.events(spark, sf))


def record_columns(ev):
    return T.records(ev).select(
        "ledger_id", "site_id", F.col("event_id").alias("seq"), "t_ms", "record",
        F.octet_length("record").alias("size"), "event_id", "day")


def written_records(spark, sf):
    """``records``, encoded once: in tasks of about 131,072 events, however few row groups the table has, and written."""
    ev = dealt(T.table(spark, sf, "events"), ["event_id", "ts"], 1 << 17)
    return staged(record_columns(T.from_events(ev)))


def sealed(spark, sf, stage=False, rec=None):
    rec = records(spark, sf) if rec is None else rec
    numbers = S.number_segments_suppress(rec, INTERVAL, ORIGIN)
    placed = S.close_intervals(rec, INTERVAL, ORIGIN).join(numbers, ["ledger_id", "interval_no"])
    sites = rec.groupBy("ledger_id").agg(F.min("site_id").alias("site_id"))
    segs = numbers.join(sites, "ledger_id").select(
        "ledger_id", "segment_number", "site_id", "close_reason", F.lit(INTERVAL).cast("bigint").alias("interval_ms"),
        F.lit(BATCH).alias("batch_record_limit"), F.lit(None).cast("bigint").alias("record_limit"),
        F.lit(None).cast("bigint").alias("size_limit_bytes"), F.lit("suppress").alias("empty_mode"))
    return L.seal(placed, segs, BATCH, stage)


@query("c06_batches", f"""{Q.RWITH}, {SEGS}, {BROOT}, ls AS (SELECT ledger_id, segment_number, batch_number, string_agg(leaf, ',' ORDER BY leaf) AS leaves
  FROM bl GROUP BY ALL) SELECT ledger_id, segment_number, batch_number, leaf_count AS count, root AS merkle_root, leaves
  FROM br JOIN ls USING (ledger_id, segment_number, batch_number)""")
def c06(spark, sf):
    _, batches = sealed(spark, sf)
    return batches.select("ledger_id", "segment_number", "batch_number", "count", "merkle_root",
                          F.array_join("leaf_hashes", ",").alias("leaves"))


@query("w03_number_suppress", f"{Q.WITH}, {SEGS} SELECT * FROM num")
def w03(spark, sf):
    return S.number_segments_suppress(records(spark, sf), INTERVAL, ORIGIN)


EMIT = """lst AS (SELECT ledger_id, max(interval_no) AS last FROM iv GROUP BY 1), emt AS (SELECT ledger_id, i AS segment_number,
  (SELECT count(*) FROM iv WHERE iv.ledger_id = e.ledger_id AND iv.interval_no = e.i) AS records,
  CASE WHEN i = last THEN 'shutdown' ELSE 'interval' END AS close_reason FROM (SELECT ledger_id, last, unnest(range(last + 1)) AS i FROM lst) e)"""
HOURLY = SEGS.replace(f"// {INTERVAL}", "// 600000")


@query("w04_number_emit", f"{Q.WITH}, {HOURLY}, {EMIT} SELECT * FROM emt")
def w04(spark, sf):
    return S.number_segments_emit(records(spark, sf), 600000, ORIGIN).drop("interval_no")


@query("t07_empty_intervals", f"{Q.WITH}, {HOURLY}, {EMIT} SELECT ledger_id, count(*) AS empties FROM emt WHERE records = 0 GROUP BY 1")
def t07(spark, sf):
    return S.empty_intervals(S.number_segments_emit(records(spark, sf), 600000, ORIGIN)).groupBy(
        "ledger_id").agg(F.count(F.lit(1)).alias("empties"))


@query("t04_intervals", f"{Q.WITH}, {SEGS} SELECT event_id, interval_no, (t_ms - {ORIGIN}) % {INTERVAL} = 0 AS on_boundary FROM iv")
def t04(spark, sf):
    return S.close_intervals(records(spark, sf), INTERVAL, ORIGIN).select(
        "event_id", "interval_no", ((F.col("t_ms") - ORIGIN) % INTERVAL == 0).alias("on_boundary"))


SEG_HEX = f"""'AA' || {key('batches')} || {T.duck_head(4, 'nb')} || bats || {key('site_id')} || {T.duck_text('site_id')} || {key('version')} || '02' ||
 {key('ledger_id')} || {T.duck_text('ledger_id')} || {key('close_reason')} || {T.duck_text('close_reason')} || {key('segment_root')} ||
 {T.duck_text('segment_root')} || {key('closure_policy')} || 'A6' || {key('version')} || '01' || {key('empty_mode')} || {key('suppress')} ||
 {key('interval_ms')} || {T.duck_head(0, str(INTERVAL))} || {key('record_limit')} || 'F6' || {key('size_limit_bytes')} || 'F6' ||
 {key('batch_record_limit')} || {T.duck_head(0, str(BATCH))} || {key('segment_number')} || {T.duck_head(0, 'segment_number')} || {key('prev_segment_sha256')}"""
BAT_HEX = f"""'A8' || {key('count')} || {T.duck_head(0, 'cnt')} || {key('site_id')} || {T.duck_text('site_id')} || {key('version')} || '02' ||
 {key('ledger_id')} || {T.duck_text('ledger_id')} || {key('leaf_hashes')} || {T.duck_head(4, 'cnt')} || leaves || {key('merkle_root')} ||
 {T.duck_text('root')} || {key('batch_number')} || {T.duck_head(0, 'batch_number')} || {key('segment_number')} || {T.duck_head(0, 'segment_number')}"""
CHAIN = f"""ls AS (SELECT ledger_id, segment_number, batch_number, string_agg('7840' || hex(encode(leaf)), '' ORDER BY leaf) AS leaves FROM bl GROUP BY ALL),
 sit AS (SELECT ledger_id, min(site_id) AS site_id FROM ev GROUP BY 1),
 bb AS (SELECT ledger_id, segment_number, batch_number, {BAT_HEX} AS b FROM (SELECT *, leaf_count AS cnt FROM br JOIN ls USING (ledger_id, segment_number, batch_number)
  JOIN sit USING (ledger_id))),
 bs AS (SELECT ledger_id, segment_number, count(*) AS nb, string_agg(b, '' ORDER BY batch_number) AS bats FROM bb GROUP BY ALL),
 sg AS (SELECT ledger_id, segment_number, {SEG_HEX} AS h FROM (SELECT *, root AS segment_root FROM num JOIN bs USING (ledger_id, segment_number)
  JOIN sr USING (ledger_id, segment_number) JOIN sit USING (ledger_id))),
 fin AS (SELECT {key('commitment_profile_id')} || {key(V.PROFILE_V2)} AS tail),
 chn AS (SELECT ledger_id, segment_number, repeat('0', 64) AS prev, sha256(unhex(h || '7840' || hex(encode(repeat('0', 64))) || tail)) AS sha, length(h) FROM sg, fin
   WHERE segment_number = 0
  UNION ALL SELECT s.ledger_id, s.segment_number, c.sha, sha256(unhex(s.h || '7840' || hex(encode(c.sha)) || tail)), length(s.h)
   FROM chn c JOIN sg s ON s.ledger_id = c.ledger_id AND s.segment_number = c.segment_number + 1, fin)"""
CW = f"{Q.RWITH}, {SEGS}, {SROOT}, {BROOT}, {CHAIN}"


def chained(spark, sf, rec=None):
    """(segments, batches, parts, chain); records and the sealed tables are written once, as a ledger does."""
    rec = written_records(spark, sf) if rec is None else rec
    segs, batches = (staged(df) for df in sealed(spark, sf, stage=True, rec=rec))
    parts = L.segment_parts(segs, batches)
    return segs, batches, parts, L.chain_segments(parts)


@query("c11_segment_chain", f"{CW} SELECT ledger_id, segment_number, prev AS prev_segment_sha256, sha AS artifact_sha256 FROM chn")
def c11(spark, sf):
    return chained(spark, sf)[3].drop("artifact_size")


@query("c10_segment_bytes", f"{CW} SELECT c.ledger_id, c.segment_number, length(h) // 2 + 66 + (SELECT length(tail) // 2 FROM fin) AS size, sha AS sha256 FROM chn c JOIN sg USING (ledger_id, segment_number)")
def c10(spark, sf):
    _, _, parts, chain = chained(spark, sf)
    art = L.segment_artifacts(parts, chain)
    return T.big(art.select("ledger_id", "segment_number", F.octet_length("artifact_cbor").alias("size"),
                            C.sha256_hex("artifact_cbor").alias("sha256")))


@query("c12_inclusion_proofs", f"""{Q.RWITH}, {Q.LEAF2}, {T.duck_roots('r', 'l2', 'site_id, day', 2)}, u AS (SELECT site_id, day, leaf,
  min(i) AS position FROM (SELECT *, row_number() OVER (PARTITION BY site_id, day ORDER BY leaf) - 1 AS i FROM l2) GROUP BY ALL)
  SELECT site_id, day, leaf, position, root FROM u JOIN r USING (site_id, day)""")
def c12(spark, sf):
    """Every proof is folded back to a root, which must equal the group's root."""
    proofs = M.inclusion_proofs(Q.leaves(spark, sf, 2), ["site_id", "day"], 2)
    return proofs.select("site_id", "day", C.hex_lower("leaf").alias("leaf"), "position",
                         C.hex_lower(M.fold_proof(2)).alias("root"))


POL = S.Policy(interval_ms=3 * 3600000, record_limit=7, size_limit_bytes=260)
STEP = f"""oo AS (SELECT ledger_id, t_ms, length(record_hex) // 2 AS size, event_id, row_number() OVER (PARTITION BY ledger_id ORDER BY event_id) AS i FROM rec),
 st AS (SELECT ledger_id, CAST(0 AS BIGINT) AS i, CAST({ORIGIN} AS BIGINT) AS opened, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS num,
   CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS seg, CAST(NULL AS VARCHAR) AS closed FROM (SELECT DISTINCT ledger_id FROM oo)
  UNION ALL SELECT ledger_id, i, CASE WHEN lim IS NULL THEN o2 ELSE t_ms END, CASE WHEN lim IS NULL THEN n2 + 1 ELSE 0 END,
   CASE WHEN lim IS NULL THEN b2 + size ELSE 0 END, CASE WHEN lim IS NULL THEN num2 ELSE num2 + 1 END, event_id, num2, lim
  FROM (SELECT *, CASE WHEN b2 + size >= 260 THEN 'size_limit' WHEN n2 + 1 >= 7 THEN 'record_limit' END AS lim FROM (
   SELECT o.*, s.opened + ((o.t_ms - s.opened) // 10800000) * 10800000 AS o2,
    CASE WHEN o.t_ms - s.opened >= 10800000 THEN 0 ELSE s.n END AS n2, CASE WHEN o.t_ms - s.opened >= 10800000 THEN 0 ELSE s.b END AS b2,
    CASE WHEN o.t_ms - s.opened >= 10800000 AND s.n > 0 THEN s.num + 1 ELSE s.num END AS num2
   FROM st s JOIN oo o ON o.ledger_id = s.ledger_id AND o.i = s.i + 1)))"""


def assigned(spark, sf):
    return S.assign_segments(records(spark, sf), POL, ORIGIN)


@query("t06_producer", f"""WITH RECURSIVE {T.EV}, {T.REC}, {STEP} SELECT event_id, seg AS segment_number, ledger_id, closed AS limit_reason FROM st WHERE i > 0""")
def t06(spark, sf):
    return assigned(spark, sf).select(F.col("seq").alias("event_id"), "segment_number", "ledger_id", "limit_reason")


@query("t06_control_events", f"WITH RECURSIVE {T.EV}, {T.REC}, {STEP} SELECT event_id, seg AS segment_number, ledger_id FROM st WHERE i > 0")
def t06c(spark, sf):
    return S.produce_segments(S.as_events(records(spark, sf)), POL, ORIGIN).select(
        F.col("seq").alias("event_id"), "segment_number", "ledger_id")


@query("t05_limit_closes", f"""WITH RECURSIVE {T.EV}, {T.REC}, {STEP}, g AS (SELECT ledger_id, seg, max(closed) AS c FROM st WHERE i > 0 GROUP BY ALL),
  m AS (SELECT ledger_id, max(seg) AS m FROM g GROUP BY 1) SELECT ledger_id, CASE WHEN c IS NULL AND seg < m THEN 'interval' ELSE c END AS close_reason, count(*) AS segments
  FROM g JOIN m USING (ledger_id) GROUP BY ALL""")
def t05(spark, sf):
    return S.segments_of(assigned(spark, sf)).groupBy("ledger_id", "close_reason").agg(F.count(F.lit(1)).alias("segments"))


@query("t05_record_limit", f"{Q.WITH} SELECT event_id, (row_number() OVER (PARTITION BY ledger_id ORDER BY event_id) - 1) // 25 AS segment_number FROM ev")
def t05b(spark, sf):
    return S.close_on_record_limit(records(spark, sf), 25).select("event_id", "segment_number")


@query("a08_interval_counters", f"""{Q.WITH}, {SEGS} SELECT event_id, count(*) OVER w AS record_count, CAST(sum(length(record_hex) // 2) OVER w AS BIGINT) AS byte_count
  FROM iv WINDOW w AS (PARTITION BY ledger_id, interval_no ORDER BY event_id)""")
def a08(spark, sf):
    return S.interval_counters(records(spark, sf), INTERVAL, ORIGIN).select("event_id", "record_count", "byte_count")


@query("t08_clock_discontinuity", f"""{Q.WITH}, tk AS (SELECT ledger_id, event_id, CAST(floor((t_ms - CASE WHEN event_id % 97 = 0 THEN 7200000
    WHEN event_id % 89 = 0 THEN 100000000000 WHEN event_id % 5 = 0 THEN 60000 ELSE 0 END - {ORIGIN}) / {INTERVAL}) AS BIGINT) AS interval_no FROM ev)
  SELECT event_id, interval_no, greatest(0, coalesce(hb, 0)) AS open_interval FROM (SELECT *, max(interval_no) OVER (PARTITION BY ledger_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hb FROM tk) WHERE interval_no < greatest(0, coalesce(hb, 0))""")
def t08(spark, sf):
    """Clocks run back by two hours, by three years (before the origin), and by a minute, which mostly stays inside the interval."""
    back = (F.when(F.col("event_id") % 97 == 0, 7200000).when(F.col("event_id") % 89 == 0, 100000000000)
            .when(F.col("event_id") % 5 == 0, 60000).otherwise(0))
    moved = records(spark, sf).withColumn("t_ms", F.col("t_ms") - back)
    return S.clock_discontinuities(moved, INTERVAL, ORIGIN).select("event_id", "interval_no", "open_interval")


@query("t09_late_records", f"""{Q.WITH} SELECT event_id, (t_ms - {ORIGIN}) // {INTERVAL} AS interval_no, CAST(CASE WHEN event_id % 5 = 0 THEN 30000000 ELSE 0 END AS BIGINT) AS lateness_ms FROM ev""")
def t09(spark, sf):
    rec = records(spark, sf).withColumn("reading_ms", F.expr("t_ms - CASE WHEN event_id % 5 = 0 THEN 30000000 ELSE 0 END"))
    return S.assign_late(rec, INTERVAL, ORIGIN).select("event_id", "interval_no", "lateness_ms")


@query("t10_daily_batches", f"{Q.WITH} SELECT site_id, day, count(*) AS facts, min(fc) AS first_fc FROM ev GROUP BY ALL")
def t10(spark, sf):
    from sealstream.operators.analytics import daily_batches
    return daily_batches(T.events(spark, sf)).groupBy("site_id", "day").agg(
        F.count(F.lit(1)).alias("facts"), F.min("fc").alias("first_fc"))


@query("a07_top_close_reason", """SELECT o_custkey, arg_max(r, k) AS close_reason FROM (SELECT o_custkey,
  CASE o_orderkey % 7 WHEN 0 THEN 'manual' WHEN 1 THEN 'interval' WHEN 2 THEN 'record_limit' WHEN 3 THEN 'size_limit' WHEN 4 THEN 'reconfigure'
  WHEN 5 THEN 'shutdown' ELSE 'recovery' END AS r, o_orderkey % 7 AS k FROM orders) GROUP BY 1""")
def a07(spark, sf):
    names = F.array(*[F.lit(n) for _, n in V.CLOSE_REASONS])
    o = T.table(spark, sf, "orders").select("o_custkey", names[(F.col("o_orderkey") % 7).cast("int")].alias("reason"))
    return S.top_close_reason(o, ["o_custkey"])


# Every reading is a request; the customers are the outcomes stored before.
IDEM = """req AS (SELECT event_id AS seq, ledger_id, 'k' || (event_id % 400) AS key, sha256('' || (event_id // 800 % 3)) AS digest FROM ev),
 sto AS (SELECT md5('site-' || (c_custkey % 4)) AS ledger_id, 'k' || (c_custkey % 1600) AS key, min(sha256('' || (c_custkey // 800 % 3))) AS digest,
   max(c_custkey) AS segment_number, [max(c_custkey) - 1, max(c_custkey)] AS sealed, max(c_custkey) * 2 AS revision FROM customer GROUP BY ALL),
 fst AS (SELECT ledger_id, key, arg_min(digest, o) AS d, min(o) AS o FROM (SELECT ledger_id, key, digest, -1 AS o FROM sto
   UNION ALL SELECT ledger_id, key, digest, seq FROM req) GROUP BY ALL)"""


def requests(ev):
    return ev.selectExpr("event_id AS seq", "ledger_id", "concat('k', event_id % 400) AS key",
                         "sha2(cast(event_id div 800 % 3 as string), 256) AS digest")


def stored_outcomes(spark, sf):
    rows = T.table(spark, sf, "customer").selectExpr(
        "md5(cast(concat('site-', c_custkey % 4) as binary)) AS ledger_id", "concat('k', c_custkey % 1600) AS key",
        "sha2(cast(c_custkey div 800 % 3 as string), 256) AS digest", "c_custkey")
    return rows.groupBy("ledger_id", "key").agg(F.min("digest").alias("digest"), F.max("c_custkey").alias("segment_number")).selectExpr(
        "*", "array(segment_number - 1, segment_number) AS sealed", "segment_number * 2 AS revision")


def with_text(df):
    return df.withColumn("sealed", F.array_join(F.transform("sealed", lambda n: n.cast("string")), ","))


@query("j04_idempotency", f"""{Q.WITH}, {IDEM} SELECT seq, CASE WHEN s.key IS NULL THEN 'absent' WHEN s.digest = r.digest THEN 'replay' ELSE 'conflict' END AS outcome,
  CASE WHEN s.digest = r.digest THEN segment_number END AS segment_number, CASE WHEN s.digest = r.digest THEN array_to_string(sealed, ',') END AS sealed,
  CASE WHEN s.digest = r.digest THEN revision END AS revision FROM req r LEFT JOIN sto s USING (ledger_id, key)""")
def j04(spark, sf):
    found = N.lookup_outcomes(requests(T.events(spark, sf)), stored_outcomes(spark, sf))
    return with_text(found).select("seq", "outcome", "segment_number", "sealed", "revision")


IDEMQ = """SELECT seq, CASE WHEN f.o = seq THEN 'new' WHEN f.d = r.digest THEN 'replay' ELSE 'conflict' END AS outcome
  FROM req r JOIN fst f USING (ledger_id, key)"""


@query("j04_first_of_key", f"{Q.WITH}, {IDEM} {IDEMQ}")
def j04b(spark, sf):
    return S.match_idempotency(requests(T.events(spark, sf)), stored_outcomes(spark, sf).select("ledger_id", "key", "digest")).select("seq", "outcome")


# Four readings in a row share a key, under two digests; every 23rd record is not canonical.
ASK = """req AS (SELECT event_id AS seq, ledger_id, CASE WHEN event_id % 101 = 0 THEN '' ELSE 'k' || event_id // 4 END AS key, sha256('' || event_id % 3 // 2) AS digest,
  event_id % 23 = 0 AS wrong FROM ev), sto AS (SELECT md5('site-' || (c_custkey % 4)) AS ledger_id, 'k' || c_custkey * 3 AS key, sha256('0') AS digest,
  c_custkey AS segment_number, c_custkey - 1 || ',' || c_custkey AS sealed, c_custkey * 2 AS revision FROM customer),
 bas AS (SELECT ledger_id, max(segment_number) + 1 AS n0, max(revision) AS r0 FROM sto GROUP BY 1),
 acc AS (SELECT ledger_id, key, min(seq) AS event_id, arg_min(digest, seq) AS digest FROM req ANTI JOIN sto USING (ledger_id, key) WHERE NOT wrong AND key <> '' GROUP BY ALL)"""
ADMITTED = """num AS (SELECT st.ledger_id, acc.key, event_id, digest, seg, closed, row_number() OVER w AS rk,
   coalesce(lag(seg + CASE WHEN closed IS NULL THEN 0 ELSE 1 END) OVER w, 0) AS from_no FROM st JOIN acc USING (ledger_id, event_id) WHERE i > 0
   WINDOW w AS (PARTITION BY st.ledger_id ORDER BY event_id)),
 own AS (SELECT n.ledger_id, key, event_id, digest, seg + coalesce(n0, 0) AS segment_number, rk + coalesce(r0, 0) AS revision,
   array_to_string(list_transform(range(from_no, seg + CASE WHEN closed IS NULL THEN 0 ELSE 1 END), lambda x: x + coalesce(n0, 0)), ',') AS sealed FROM num n LEFT JOIN bas USING (ledger_id)),
 ans AS (SELECT r.seq, CASE WHEN r.key = '' THEN 'invalid_key' WHEN s.key IS NOT NULL THEN CASE WHEN s.digest = r.digest THEN 'replay' ELSE 'conflict' END
   WHEN o.event_id = r.seq THEN 'new' WHEN o.event_id < r.seq THEN CASE WHEN o.digest = r.digest THEN 'replay' ELSE 'conflict' END ELSE 'invalid_record' END AS outcome,
   coalesce(s.segment_number, o.segment_number) AS segment_number, coalesce(s.sealed, o.sealed) AS sealed, coalesce(s.revision, o.revision) AS revision
  FROM req r LEFT JOIN sto s ON s.ledger_id = r.ledger_id AND s.key = r.key LEFT JOIN own o ON o.ledger_id = r.ledger_id AND o.key = r.key)"""
ANSWER = """SELECT seq, outcome, CASE WHEN outcome IN ('new', 'replay') THEN segment_number END AS segment_number,
  CASE WHEN outcome IN ('new', 'replay') THEN sealed END AS sealed, CASE WHEN outcome IN ('new', 'replay') THEN revision END AS revision FROM ans"""


def asked(ev):
    return T.records(ev).selectExpr(
        "ledger_id", "event_id AS seq", "CASE WHEN event_id % 101 = 0 THEN '' ELSE concat('k', event_id div 4) END AS key",
        "sha2(cast(event_id % 3 div 2 as string), 256) AS digest", "t_ms", "octet_length(record) AS size",
        "CASE WHEN event_id % 23 = 0 THEN 'not canonical' END AS record_error")


@query("t03_idempotent_admission", f"""WITH RECURSIVE {T.EV}, {T.REC}, {ASK}, {STEP.replace('FROM rec)', 'FROM rec SEMI JOIN acc USING (ledger_id, event_id))')},
  {ADMITTED} {ANSWER}""")
def t03(spark, sf):
    """Requests with stored outcomes: replays give back segment number, sealed numbers and revision; refused records leave their key free."""
    stored = T.table(spark, sf, "customer").selectExpr(
        "md5(cast(concat('site-', c_custkey % 4) as binary)) AS ledger_id", "concat('k', c_custkey * 3) AS key", "sha2('0', 256) AS digest",
        "c_custkey AS segment_number", "array(c_custkey - 1, c_custkey) AS sealed", "c_custkey * 2 AS revision")
    out = N.admit_requests(asked(T.events(spark, sf)), stored, POL, ORIGIN)
    return with_text(out).select("seq", "outcome", "segment_number", "sealed", "revision")
