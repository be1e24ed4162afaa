"""Registered queries: files, references, sets, links, anchors and certificates."""

import hashlib

from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.functions import values as V
from sealstream.functions.tokens import decode_tokens
from sealstream.operators import evidence as E
from sealstream.operators import ledger as L
from sealstream.operators import merkle as M
from sealstream.operators.plan import dealt, merged
from sealstream.plans import ledger as G
from sealstream.plans import responses as R
from sealstream.plans import scalars as X
from sealstream.plans import telemetry as T
from sealstream.plans.registry import query


def page_files(spark, sf):
    p = T.table(spark, sf, "pages").select(
        (F.col("page_id") % 20).alias("bundle"), F.concat(F.lit("day/"), "page_id", F.lit(".cbor")).alias("path"),
        "page_id", C.text_bytes("html").alias("content"))
    return E.artifact_digests(p)


PF = "pf AS (SELECT page_id, page_id % 20 AS bundle, 'day/' || page_id || '.cbor' AS path, sha256(html) AS sha256 FROM pages)"


@query("c14_artifact_digests", f"WITH {PF} SELECT path, sha256, sha256 || '  ' || page_id || '.cbor' || chr(10) AS sidecar FROM pf")
def c14(spark, sf):
    return page_files(spark, sf).select("path", "sha256", "sidecar")


def damaged(col="sha256"):
    return (F.when(F.col("page_id") % 7 == 1, F.upper(col)).when(F.col("page_id") % 7 == 2, F.sha2("path", 256))
            .otherwise(F.col(col)))


@query("j05_match_artifacts", f"""WITH {PF} SELECT path, CASE page_id % 7 WHEN 1 THEN 'bad_digest' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'missing' ELSE 'ok' END AS status FROM pf""")
def j05(spark, sf):
    files = page_files(spark, sf)
    refs = files.withColumn("sha256", damaged()).select("bundle", "path", "sha256")
    return E.match_artifacts(refs, files.filter("page_id % 7 <> 3")).select("path", "status")


@query("j06_checksum_coverage", f"""WITH {PF} SELECT CASE WHEN page_id % 7 = 1 THEN upper(sha256) || '  ' || path ELSE path END AS path,
  CASE page_id % 7 WHEN 1 THEN 'malformed' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'stale' WHEN 4 THEN 'missing' WHEN 5 THEN 'duplicate' ELSE 'ok' END AS status FROM pf
  UNION ALL SELECT path, 'missing' FROM pf WHERE page_id % 7 = 1""")
def j06(spark, sf):
    files = page_files(spark, sf)
    line = F.concat(damaged(), F.lit("  "), "path")
    lines = files.filter("page_id % 7 <> 4").select("bundle", F.explode(F.array_repeat(
        line, F.expr("CASE WHEN page_id % 7 = 5 THEN 2 ELSE 1 END"))).alias("line"))
    return E.checksum_coverage(lines, files.filter("page_id % 7 <> 3")).select("path", "status")


@query("l02_first_artifact", f"WITH {PF} SELECT bundle, min(path) AS path, arg_min(sha256, path) AS sha256 FROM pf GROUP BY 1")
def l02(spark, sf):
    return E.first_artifact(page_files(spark, sf).select("bundle", "path", "sha256"), ["bundle"])


@query("l01_ordered_artifacts", f"WITH {PF} SELECT bundle, path, sha256 FROM pf ORDER BY 1, 2")
def l01(spark, sf):
    return E.deterministic_order(page_files(spark, sf).select("bundle", "path", "sha256"), ["bundle", "path"])


@query("s13_index_upsert", """WITH o AS (SELECT o_clerk AS site, strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_orderkey) AS k FROM
  (SELECT *, 'site-' || o_custkey % 10 AS o_clerk FROM orders) GROUP BY ALL), new AS (SELECT * FROM o WHERE k % 2 = 0 OR k % 3 = 0), old AS (SELECT site, day, -k AS k FROM o WHERE k % 3 <> 0)
  SELECT * FROM (SELECT * FROM old WHERE (site, day) NOT IN (SELECT (site, day) FROM new) UNION ALL SELECT * FROM new) ORDER BY site || ':' || day""")
def s13(spark, sf):
    """Every entry is in the index, in the export, or in both."""
    o = T.table(spark, sf, "orders").groupBy(
        F.concat(F.lit("site-"), F.col("o_custkey") % 10).alias("site"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day")).agg(F.max("o_orderkey").alias("k"))
    return E.upsert_index(o.filter("k % 3 <> 0").withColumn("k", -F.col("k")), o.filter("k % 2 = 0 OR k % 3 = 0"))


@query("v22_schema_refs", """SELECT 'urn:p:' || page_id AS schema_id, 'urn:p:' || (page_id * 3) || '#/x' AS ref FROM pages p
  WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id = p.page_id * 3)""")
def v22(spark, sf):
    p = T.table(spark, sf, "pages")
    body = F.concat(F.lit('{"$id":"urn:p:'), "page_id", F.lit('","a":{"$ref":"#/local"},"b":[{"$ref" : "urn:p:'),
                    F.col("page_id") * 3, F.lit('#/x"},{"$ref":"https://json-schema.org/draft"}],"t":'),
                    F.to_json(F.struct("html")), F.lit("}"))
    s = p.select(F.concat(F.lit("urn:p:"), "page_id").alias("schema_id"), body.alias("body"))
    return E.unresolved_schema_refs(s).select("schema_id", "ref")


# --- multisets over the leaves of orders ---

@query("x01_multiset_diff", """WITH a AS (SELECT l_partkey % 50 AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem), b AS (SELECT l_partkey % 50 AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 1000 > 0),
  ca AS (SELECT k, n, count(*) AS c FROM a GROUP BY ALL), cb AS (SELECT k, n, count(*) AS c FROM b GROUP BY ALL)
  SELECT coalesce(ca.k, cb.k) AS k, coalesce(ca.n, cb.n) AS n, coalesce(ca.c, 0) AS left_copies, coalesce(cb.c, 0) AS right_copies
  FROM ca FULL JOIN cb ON ca.k = cb.k AND ca.n = cb.n WHERE coalesce(ca.c, 0) <> coalesce(cb.c, 0)""")
def x01(spark, sf):
    li = T.table(spark, sf, "lineitem")
    cols = [(F.col("l_partkey") % 50).alias("k"), F.col("l_linenumber").cast("bigint").alias("n")]
    return E.multiset_diff(li.select(*cols), li.filter("l_orderkey % 1000 > 0").select(*cols))


@query("c13_leaf_multisets", """SELECT l_orderkey, CAST(count(*) FILTER (l_orderkey % 5 = 0 AND l_linenumber = m) AS BIGINT) AS differing, NOT (l_orderkey % 5 = 0) AS equal
  FROM (SELECT l_orderkey, l_linenumber, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey""")
def c13(spark, sf):
    # Tasks of a bounded number of rows: the join sorts them and the counts hold them in hash maps.
    li = dealt(T.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("leaf")), ["l_orderkey", "leaf"], 1 << 20)
    first = li.groupBy("l_orderkey").agg(F.min("leaf").alias("leaf")).filter("l_orderkey % 5 = 0")
    return T.big(E.compare_leaf_multisets(li, li.join(first, ["l_orderkey", "leaf"], "left_anti"), ["l_orderkey"]))


@query("x02_set_diff", """SELECT DISTINCT o_custkey AS k, 'missing' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0)
  UNION ALL SELECT c_custkey, 'stale' FROM customer WHERE c_custkey % 10 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def x02(spark, sf):
    return E.set_diff(T.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")),
                      T.table(spark, sf, "customer").filter("c_custkey % 10 > 0").select(F.col("c_custkey").alias("k")))


@query("x04_subset_violations", """SELECT o_orderkey, (o_orderkey % 7) || ',' || (o_orderkey % 7 + 2) AS outside FROM orders WHERE o_orderkey % 7 > 4
  UNION ALL SELECT o_orderkey, '' || (o_orderkey % 7 + 2) FROM orders WHERE o_orderkey % 7 IN (3, 4)""")
def x04(spark, sf):
    k = (F.col("o_orderkey") % 7).cast("int")
    o = T.table(spark, sf, "orders").select("o_orderkey", F.array(k, k + 2).alias("small"),
                                            F.sequence(F.lit(0), F.lit(4)).alias("big"))
    return E.subset_violations(o, "small", "big").select("o_orderkey", F.array_join("outside", ",").alias("outside"))


@query("w02_unsorted_pairs", """WITH w AS (SELECT l_orderkey, l_partkey < lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS bad FROM lineitem)
  SELECT l_orderkey, coalesce(bool_or(bad), false) AS unsorted FROM w GROUP BY 1""")
def w02(spark, sf):
    from sealstream.operators.segments import adjacent_unsorted
    li = T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    return adjacent_unsorted(li, ["l_orderkey"], "l_partkey", "pos")


# --- sealed segments as rows ---

def chain_rows(spark, sf):
    segs, _, _, chain = G.chained(spark, sf)
    return segs.join(chain, L.SEG).withColumn("segment_number", F.col("segment_number").cast("bigint"))


@query("j07_segment_links", f"""{G.CW} SELECT ledger_id, segment_number, CASE WHEN segment_number = 0 THEN 'epoch' WHEN segment_number % 10 = 4 THEN 'undisclosed'
  WHEN segment_number % 10 = 7 THEN 'broken' ELSE 'linked' END AS link FROM chn WHERE segment_number % 10 <> 3""")
def j07(spark, sf):
    s = chain_rows(spark, sf).filter("segment_number % 10 <> 3").withColumn(
        "prev_segment_sha256", F.when(F.col("segment_number") % 10 == 7, F.sha2("prev_segment_sha256", 256))
        .otherwise(F.col("prev_segment_sha256")))
    return E.check_segment_links(s).select("ledger_id", "segment_number", "link")


@query("j09_batch_projections", f"""{G.Q.RWITH}, {G.SEGS}, {G.BROOT} SELECT ledger_id, '' || segment_number AS segment_number, '' || batch_number AS batch_number,
  CASE WHEN segment_number % 5 = 1 AND batch_number = 0 THEN 'mismatch' WHEN segment_number % 5 = 2 AND batch_number = 0 THEN 'not_disclosed' ELSE 'ok' END AS status FROM br""")
def j09(spark, sf):
    _, b = G.sealed(spark, sf)
    b = b.withColumn("site_id", F.lit("s"))
    cut = (F.col("segment_number") % 5 == 2) & (F.col("batch_number") == 0)
    p = b.filter(~cut).withColumn("count", F.when(
        (F.col("segment_number") % 5 == 1) & (F.col("batch_number") == 0), F.col("count") + 1).otherwise(F.col("count")))
    return E.match_batch_projections(p, b)


STATUS = "CASE WHEN segment_number % 4 = 3 THEN 'verified' ELSE 'pending' END"


@query("s15_pending_segments", f"{G.CW} SELECT ledger_id, segment_number, sha AS artifact_sha256 FROM chn WHERE segment_number % 4 <> 3 ORDER BY 1, 2")
def s15(spark, sf):
    s = chain_rows(spark, sf).withColumn("tsa_status", F.expr(STATUS))
    return E.pending_segments(s).select("ledger_id", "segment_number", "artifact_sha256")


@query("j14_attach_proofs", f"""{G.CW} SELECT ledger_id, segment_number, CASE WHEN segment_number % 4 = 3 OR segment_number % 3 = 1 THEN 'verified' ELSE 'pending' END AS tsa_status,
  CASE WHEN segment_number % 4 <> 3 AND segment_number % 3 = 1 THEN 'r' || segment_number END AS tsa_response FROM chn""")
def j14(spark, sf):
    s = chain_rows(spark, sf).withColumn("tsa_status", F.expr(STATUS)).select(*L.SEG, "artifact_sha256", "tsa_status")
    sha = F.when(F.col("segment_number") % 3 == 2, F.sha2("artifact_sha256", 256)).otherwise(F.col("artifact_sha256"))
    r = s.filter("segment_number % 3 > 0").select(
        *L.SEG, sha.alias("artifact_sha256"), F.concat(F.lit("r"), "segment_number").alias("response"),
        F.col("segment_number").alias("seq"))
    updated, _ = E.attach_proofs(s, r)
    return updated.select(*L.SEG, "tsa_status", "tsa_response")


# --- headers and anchors ---

@query("j11_uncovered_heights", f"""WITH {T.EV}, {X.HDR} SELECT event_id AS height, CASE WHEN event_id % 10 = 0 THEN 'uncovered' ELSE 'root_mismatch' END AS problem FROM hdr
  WHERE event_id % 10 = 0 OR event_id % 10 = 5""")
def j11(spark, sf):
    h = X.headers(spark, sf).withColumn("merkle_root", C.hex_lower(C.reverse_bytes(F.substring("header", 37, 32))))
    msg = F.when(F.col("event_id") % 10 == 5, F.sha2("merkle_root", 256)).otherwise(
        C.hex_lower(F.substring("header", 37, 32)))
    heights = h.select(F.col("event_id").alias("anchor_id"), "height", msg.alias("message"))
    return E.uncovered_heights(heights, h.filter("event_id % 10 <> 0")).select("height", "problem")


RCP = """rc AS (SELECT o_custkey AS anchor_id, o_orderkey AS seq, (o_orderkey // 2) % 4 AS r, o_orderkey % 3 AS h,
  lag((o_orderkey // 2) % 4) OVER w AS pr, lag(o_orderkey % 3) OVER w AS ph FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


def receipts(spark, sf):
    names = F.array(*[F.lit(n) for n, r in V.ANCHOR_STATES if r >= 0])
    return T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("anchor_id"), F.col("o_orderkey").alias("seq"),
        names[F.expr("cast((o_orderkey div 2) % 4 as int)")].alias("state"),
        F.expr("slice(array(10, 20, 30), 1, cast(o_orderkey % 3 as int))").alias("heights"))


@query("w06_state_regressions", f"WITH {RCP} SELECT anchor_id, seq, CASE WHEN h < ph THEN 'heights' ELSE 'state' END AS problem FROM rc WHERE h < ph OR r < pr")
def w06(spark, sf):
    return E.state_regressions(receipts(spark, sf)).select("anchor_id", "seq", "problem")


@query("t11_advance_anchors", f"""WITH {RCP}, a AS (SELECT *, lag(seq) OVER (PARTITION BY anchor_id ORDER BY seq) AS ps FROM rc)
  SELECT anchor_id || '/' || seq AS anchor_id, CASE WHEN pr IS NULL THEN 'created' WHEN pr = 3 THEN 'final' WHEN h < ph OR r < pr THEN 'refused'
  WHEN h = ph AND r = pr THEN 'unchanged' ELSE 'changed' END AS action, CASE WHEN pr IS NULL OR (pr <> 3 AND NOT (h < ph OR r < pr) AND NOT (h = ph AND r = pr)) THEN seq ELSE ps END AS observed_at FROM a""")
def t11(spark, sf):
    """Every receipt as an observation of the state its predecessor left: each pair is an anchor of its own."""
    from pyspark.sql import Window
    r = receipts(spark, sf).withColumn("next", F.lead("seq").over(Window.partitionBy("anchor_id").orderBy("seq")))
    r = r.withColumns({"pending": F.lit("p"), "proof_sha256": F.lit("x"), "observed_at": F.col("seq")})
    pair = lambda seq: F.concat("anchor_id", F.lit("/"), seq)
    return E.advance_anchors(r.filter("next IS NOT NULL").withColumn("anchor_id", pair("next")),
                             r.withColumn("anchor_id", pair("seq"))).select("anchor_id", "action", "observed_at")


@query("v20_anchor_state", f"""WITH {T.EV}, {X.HDR}, p AS (SELECT event_id, event_id % 7 AS m FROM ev), ok AS (SELECT event_id FROM hsh WHERE block_hash <= target)
  SELECT event_id AS anchor_id, CASE WHEN m = 0 THEN 'stationary' WHEN m = 1 THEN 'calendar-pending' WHEN m = 2 THEN 'failed'
  WHEN event_id % 11 <> 0 AND event_id IN (SELECT event_id FROM ok) AND (m <> 3 OR event_id + 1 IN (SELECT event_id FROM ok)) THEN 'bitcoin-header-quorum-verified'
  ELSE 'bitcoin-attested-structure' END AS state FROM p""")
def v20(spark, sf):
    """Proofs of one and of two heights; one in eleven attests to a message that is not the header's root."""
    h = X.headers(spark, sf)
    e, m = F.col("event_id"), F.col("event_id") % 7
    root = C.hex_lower(F.substring("header", 37, 32))
    after = h.select((F.col("height") - 1).alias("event_id"), root.alias("next_root"))
    own = F.when(e % 11 == 0, F.sha2(root, 256)).otherwise(root)
    p = h.join(merged(after), "event_id", "left").select(
        e.alias("anchor_id"), (m > 0).alias("has_proof"),
        F.when(m == 1, F.array(F.lit("https://calendar"))).otherwise(F.array().cast("array<string>")).alias("pending_uris"),
        F.when(m < 3, F.array().cast("array<bigint>")).when(m == 3, F.array(e, e + 1)).otherwise(F.array(e)).alias("heights"),
        F.when(m < 3, F.array().cast("array<string>")).when(m == 3, F.array(own, F.coalesce("next_root", F.lit("none"))))
        .otherwise(F.array(own)).alias("messages"))
    return E.derive_anchor_state(p, h).select("anchor_id", "state")


@query("t12_cadence_policy", """WITH i AS (SELECT o_custkey AS pod_id, o_orderkey AS seq, o_orderkey // 3 + CASE WHEN o_orderkey % 5 = 0 THEN -4000 ELSE 0 END AS epoch, o_orderstatus AS s FROM orders),
  m AS (SELECT *, max(epoch) OVER (PARTITION BY pod_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM i)
  SELECT pod_id, seq, CASE WHEN epoch <= mx THEN 'rejected' WHEN EXISTS (SELECT 1 FROM i a WHERE a.pod_id = m.pod_id AND a.epoch = m.epoch AND a.s = 'F') THEN 'applied' ELSE 'issued' END AS state FROM m""")
def t12(spark, sf):
    o = T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pod_id"), F.col("o_orderkey").alias("seq"),
        F.expr("o_orderkey div 3 + CASE WHEN o_orderkey % 5 = 0 THEN -4000 ELSE 0 END").alias("epoch"),
        F.when(F.col("o_orderstatus") == "F", "applied").otherwise("pending").alias("status"))
    return E.cadence_policy_state(o.drop("status"), o.drop("seq")).select("pod_id", "seq", "state")


# --- certificates: customers as certificates, nations and regions as issuers ---

@query("j12_revocations", """WITH c AS (SELECT c_custkey AS cert_id, c_nationkey AS issuer, c_custkey % 97 AS serial, c_custkey % 1000 AS t FROM customer),
  l AS (SELECT n_nationkey AS list_id, n_nationkey - CASE WHEN n_nationkey = 24 THEN 1 ELSE 0 END AS issuer, n_nationkey * 4 AS a, CASE WHEN n_nationkey % 9 = 5 THEN NULL ELSE 900 END AS b FROM nation),
  k AS (SELECT issuer, count(*) AS n, min(list_id) AS list_id, arg_min(a, list_id) AS a, max(CASE WHEN b IS NULL THEN NULL ELSE b END) AS b FROM l GROUP BY 1),
  e AS (SELECT s_nationkey AS list_id, s_suppkey % 97 AS serial, min(s_suppkey * 7 % 500) AS r FROM supplier GROUP BY ALL)
  SELECT cert_id, CASE WHEN coalesce(n, 0) <> 1 THEN 'list_count' WHEN a > t THEN 'not_yet_valid' WHEN b IS NULL THEN 'no_next_update' WHEN b <= t THEN 'expired_list'
  WHEN r <= t THEN 'revoked' END AS error FROM c LEFT JOIN k USING (issuer) LEFT JOIN e ON e.list_id = k.list_id AND e.serial = c.serial""")
def j12(spark, sf):
    certs = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cert_id"), F.col("c_nationkey").alias("issuer"),
        (F.col("c_custkey") % 97).alias("serial"), (F.col("c_custkey") % 1000).alias("gen_time"))
    n = F.col("n_nationkey")
    lists = T.table(spark, sf, "nation").select(
        n.alias("list_id"), (n - F.when(n == 24, 1).otherwise(0)).alias("issuer"), (n * 4).alias("this_update"),
        F.when(n % 9 != 5, 900).alias("next_update"))
    revoked = T.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("list_id"), (F.col("s_suppkey") % 97).alias("serial"),
        (F.col("s_suppkey") * 7 % 500).alias("revoked_at"))
    return E.applicable_revocations(certs, lists, revoked).select("cert_id", "error")


@query("j13_cert_paths", """WITH RECURSIVE i AS (SELECT 'p' || p_partkey AS subject, 'p' || (p_partkey // 2) AS issuer FROM part UNION ALL SELECT 'p' || p_partkey, 'x' FROM part WHERE p_partkey % 37 = 0),
  a AS (SELECT 'p0' AS subject), st AS (SELECT subject, count(*) AS n, max(anc) AS anc, min(issuer) AS nxt FROM (SELECT subject, issuer, 0 AS anc FROM i WHERE subject <> 'p0' UNION ALL SELECT subject, NULL, 1 FROM a) GROUP BY 1),
  w AS (SELECT s_suppkey AS cert_id, 'p' || s_suppkey * 3 AS cur, CAST(NULL AS VARCHAR) AS state, 0 AS length FROM supplier
   UNION ALL SELECT cert_id, nxt, CASE WHEN coalesce(n, 0) <> 1 THEN 'ambiguous' WHEN anc = 1 THEN 'anchored' END, length + 1 FROM w LEFT JOIN st ON subject = cur WHERE state IS NULL AND length < 8)
  SELECT cert_id, coalesce(max(state), 'too_deep') AS state, CAST(max(length) AS BIGINT) AS length FROM w GROUP BY 1""")
def j13(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey")
    name = F.concat(F.lit("p"), "p_partkey")
    inter = p.select(name.alias("subject"), F.concat(F.lit("p"), F.expr("p_partkey div 2")).alias("issuer")).unionByName(
        p.filter("p_partkey % 37 = 0").select(name.alias("subject"), F.lit("x").alias("issuer")))
    # The trust anchor is the root of the part numbers, derived from the table itself.
    anchors = inter.select("issuer").filter("issuer = 'p0'").distinct().withColumnRenamed("issuer", "subject")
    signers = T.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("cert_id"), F.concat(F.lit("p"), F.col("s_suppkey") * 3).alias("issuer"))
    return T.big(E.walk_cert_paths(signers, inter.filter("subject <> 'p0'"), anchors).select("cert_id", "state", "length"))


@query("j13_path_revocations", """WITH RECURSIVE i AS (SELECT 'p' || p_partkey AS subject, 'p' || (p_partkey // 2) AS issuer, p_partkey % 97 AS serial FROM part WHERE p_partkey > 0),
  st AS (SELECT subject, issuer, serial, 0 AS anc FROM i UNION ALL SELECT 'p0', NULL, NULL, 1),
  w AS (SELECT s_suppkey AS cert_id, 0 AS place, 'p' || s_suppkey * 3 AS cur, s_suppkey % 97 AS serial FROM supplier
   UNION ALL SELECT cert_id, place + 1, st.issuer, st.serial FROM w JOIN st ON subject = cur WHERE anc = 0 AND place < 8),
  l AS (SELECT DISTINCT cur AS issuer FROM w), k AS (SELECT issuer, CAST(substr(issuer, 2) AS BIGINT) AS n FROM l),
  e AS (SELECT cert_id, place, CASE WHEN n % 29 = 3 THEN 'list_count' WHEN n % 31 = 4 THEN 'list_kind' WHEN n % 37 = 5 THEN 'expired_list' WHEN (serial + n) % 41 = 6 THEN 'revoked' END AS error
   FROM w JOIN k ON issuer = cur), f AS (SELECT cert_id, min(place) AS error_at, arg_min(error, place) AS error FROM e WHERE error IS NOT NULL GROUP BY 1),
  s AS (SELECT cert_id, max(place) AS top, arg_max(cur, place) AS last FROM w GROUP BY 1)
  SELECT s.cert_id, CASE WHEN last = 'p0' AND top < 8 THEN 'anchored' WHEN top >= 8 THEN 'too_deep' ELSE 'ambiguous' END AS state,
   error, error_at FROM s LEFT JOIN f USING (cert_id)""")
def j13_path(spark, sf):
    """Parts as a tree of intermediates, suppliers as signers; some issuers lack a full, current list, some serials are revoked."""
    p = T.table(spark, sf, "part").select("p_partkey").filter("p_partkey > 0")
    name = F.concat(F.lit("p"), "p_partkey")
    inter = p.select(name.alias("subject"), F.concat(F.lit("p"), F.expr("p_partkey div 2")).alias("issuer"),
                     (F.col("p_partkey") % 97).alias("serial"))
    signers = T.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("cert_id"), F.concat(F.lit("p"), F.col("s_suppkey") * 3).alias("issuer"),
        (F.col("s_suppkey") % 97).alias("serial"), F.lit(500).alias("gen_time"))
    anchors = inter.filter("issuer = 'p0'").select(F.col("issuer").alias("subject")).distinct()
    names = inter.select("issuer").unionByName(inter.select(F.col("subject").alias("issuer"))).unionByName(signers.select("issuer")).distinct()
    n = F.substring("issuer", 2, 20).cast("bigint")
    lists = names.filter(n % 29 != 3).select(
        n.alias("list_id"), "issuer", F.lit(0).alias("this_update"), F.when(n % 37 == 5, 400).otherwise(900).alias("next_update"),
        F.when(n % 31 == 4, "delta").otherwise("full").alias("kind"))
    serials = spark.range(97).select(F.col("id").alias("serial"))
    revoked = lists.select("list_id").join(serials.withColumn("m", (47 - F.col("serial") % 41) % 41), F.col("list_id") % 41 == F.col("m"))
    return T.big(E.check_cert_paths(signers, inter, anchors, lists, revoked.select("list_id", "serial", F.lit(100).alias("revoked_at"))).select(
        "cert_id", "state", "error", F.col("error_at").cast("bigint").alias("error_at")))


@query("v17_token_checks", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 1 THEN 'accuracy' WHEN o_orderkey % 11 = 2 THEN 'status' WHEN o_orderkey % 11 = 3 THEN 'policy'
  WHEN o_orderkey % 11 IN (4, 5) THEN 'imprint' WHEN o_orderkey % 11 = 6 THEN 'signer' END AS error FROM orders""")
def v17(spark, sf):
    m = F.col("o_orderkey") % 11
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    t = T.table(spark, sf, "orders").select(
        "o_orderkey", F.when(m == 1, 1000).when(m == 7, 999).alias("millis"), F.when(m == 8, 1).alias("micros"),
        F.when(m == 2, 2).otherwise(0).alias("status"), F.when(m == 3, "1.2.4").otherwise("1.2.3").alias("policy_oid"),
        F.lit("1.2.3").alias("expected_policy_oid"),
        F.when(m == 4, "1.3.14.3.2.26").otherwise("2.16.840.1.101.3.4.2.1").alias("imprint_oid"),
        F.when(m == 5, F.sha2(sha, 256)).otherwise(sha).alias("imprint_sha256"), sha.alias("artifact_sha256"),
        F.when(m == 6, "b").otherwise("a").alias("signer_sha256"), F.lit("a").alias("expected_signer_sha256"))
    return E.check_tokens(t).select("o_orderkey", "error")


# Encoded responses: good ones, one for each register check, and three that cannot be read.
RESPONSES = [R.response(), R.response(accuracy={0x80: 1000}), R.response(status=2), R.response(policy="1.2.4"),
             R.response(algorithm="1.3.14.3.2.26"), R.response(), R.response(signer=8), R.response(accuracy={0x02: 1, 0x80: 999, 0x81: 1}),
             R.response()[:-1], R.response(certificates=(7, 7)), R.response(certificates=()), R.response() + b"\x00"]


@query("v17_token_responses", """SELECT o_orderkey, CASE WHEN m >= 8 THEN 'malformed' WHEN m = 1 THEN 'accuracy' WHEN m = 2 THEN 'status' WHEN m = 3 THEN 'policy'
  WHEN m IN (4, 5) THEN 'imprint' WHEN m = 6 THEN 'signer' END AS error, CASE WHEN m < 8 THEN CAST(1709251500 AS BIGINT) END AS gen_time,
  CASE WHEN m < 8 THEN '12c' END AS serial_hex, CASE WHEN m < 8 THEN sha256(CASE WHEN m = 5 THEN 'x' ELSE '' END || o_orderkey) END AS imprint_sha256,
  CAST(CASE m WHEN 1 THEN 1000 WHEN 7 THEN 999 END AS BIGINT) AS millis FROM (SELECT o_orderkey, o_orderkey % 12 AS m FROM orders)""")
def v17b(spark, sf):
    """From the bytes of a response to the first register check that fails."""
    m, key = F.col("o_orderkey") % len(RESPONSES), F.col("o_orderkey").cast("string")
    ends = [raw.split(R.HOLE) for raw in RESPONSES]
    pick = lambda side: F.element_at(F.array(*[F.lit(e[side]) for e in ends]), (m + 1).cast("int"))
    digest = F.unhex(F.sha2(F.concat(F.when(m == 5, "x").otherwise(""), key), 256))
    pin = hashlib.sha256(R.certificate(7)).hexdigest()
    t = T.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(pick(0), digest, pick(1)).alias("response"), F.sha2(key, 256).alias("artifact_sha256"),
        F.lit("1.2.3").alias("expected_policy_oid"), F.lit(pin).alias("expected_signer_sha256"))
    seen = E.check_tokens(decode_tokens(t))
    return seen.select("o_orderkey", F.when(F.col("malformed").isNotNull(), "malformed").otherwise(F.col("error")).alias("error"),
                       F.col("gen_time").cast("bigint").alias("gen_time"), "serial_hex", "imprint_sha256", F.col("millis").cast("bigint").alias("millis"))


@query("v21_vector_sets", f"""SELECT l_orderkey AS set_id, CASE WHEN l_orderkey % 6 = 1 THEN 'leaf' WHEN l_orderkey % 6 = 2 THEN 'root' END AS error FROM lineitem GROUP BY 1""")
def v21(spark, sf):
    from sealstream.operators.segments import check_vectors
    li = T.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("set_id"), C.text_bytes(F.concat_ws("|", "l_partkey", "l_linenumber", "l_suppkey")).alias("record"))
    li = li.withColumn("leaf", M.leaf_hash_v2("record"))
    roots = M.merkle_root_v2(li, ["set_id"]).select("set_id", C.hex_lower("root").alias("root"))
    bad = F.when(F.col("set_id") % 6 == 2, F.sha2("root", 256)).otherwise(F.col("root"))
    claimed = F.when(F.col("set_id") % 6 == 1, F.sha2("record", 256)).otherwise(C.hex_lower("leaf"))
    return check_vectors(li.select("set_id", "record", claimed.alias("leaf_sha256")), roots.select("set_id", bad.alias("root")))
