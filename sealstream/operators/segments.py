"""Checks of segments, their batches and published vector sets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sealstream.functions import codecs as K
from sealstream.functions import columns as C
from sealstream.functions import values as V
from sealstream.operators import merkle as M
from sealstream.operators.evidence import multiset_diff
from sealstream.operators.plan import merged, staged

SEG = ["ledger_id", "segment_number"]


def adjacent_unsorted(rows: DataFrame, group: list[str], leaf: str, position: str) -> DataFrame:
    """Whether any neighbouring pair is out of order. Groups are bounded lists (batches)."""
    w = Window.partitionBy(*group).orderBy(position)
    pairs = rows.select(*group, (F.col(leaf) < F.lag(leaf).over(w)).alias("_u"))
    return pairs.groupBy(*group).agg(F.coalesce(F.bool_or("_u"), F.lit(False)).alias("unsorted"))


def check_vectors(records: DataFrame, roots: DataFrame) -> DataFrame:
    """Vector sets: records (set_id, record, leaf_sha256) and claimed roots (set_id, root)."""
    own = records.withColumn("leaf", M.leaf_hash_v2("record"))
    differs = F.bool_or(C.hex_lower("leaf") != F.col("leaf_sha256"))
    if M.largest_group(own, ["set_id"]) <= M._SIZE:  # leaves are hashed and shuffled once for both checks
        both = M.small_roots(own, ["set_id"], 2, _leaf=differs)
    else:
        both = own.groupBy("set_id").agg(differs.alias("_leaf")).join(M.merkle_root_v2(own, ["set_id"]), "set_id")
    both = both.select("set_id", "_leaf", C.hex_lower("root").alias("_root"))
    return both.join(merged(roots), "set_id").select("set_id", C.first_failure([
        ("leaf", F.col("_leaf")), ("root", F.col("_root") != F.col("root"))]).alias("error"))


ORDERED = """exists(sequence(0, greatest(size({a}) - 2, 0)),
  i -> i + 1 < size({a}) and {a}[i] > {a}[i + 1])"""


def batch_flags(batches: DataFrame, segments: DataFrame) -> DataFrame:
    """First failing check of each embedded batch. Batches (SEG, position, batch_number, count,
    leaf_hashes, merkle_root, batch_ledger_id, batch_site_id, batch_segment_number) against
    segments (SEG, site_id, batch_record_limit). Lists are as long as the policy's batch limit."""
    owner = segments.select(*SEG, "site_id", "batch_record_limit")
    last = batches.groupBy(*SEG).agg(F.max("position").alias("_last"))
    df = batches.join(owner, SEG).join(last, SEG)
    leaves_ok = F.forall("leaf_hashes", lambda h: h.rlike("^[0-9a-f]{64}\\z"))
    df = df.withColumn("_nodes", F.when(leaves_ok, F.transform("leaf_hashes", F.unhex)))
    return df.withColumn("code", C.first_failure([
        ("embedded-batch-identity-or-cardinality",
         (F.col("batch_ledger_id") != F.col("ledger_id")) | (F.col("batch_site_id") != F.col("site_id"))
         | (F.col("batch_segment_number") != F.col("segment_number"))
         | (F.col("batch_number") != F.col("position")) | (F.col("count") == 0)
         | (F.col("count") != F.size("leaf_hashes")) | (F.col("count") > F.col("batch_record_limit"))),
        ("batch-leaf-hash", ~leaves_ok),
        ("batch-leaves-unsorted", F.expr(ORDERED.format(a="leaf_hashes"))),
        ("batch-root-mismatch", C.hex_lower(M.reduce_array(2, "_nodes")) != F.col("merkle_root")),
        ("non-final-batch-short", (F.col("position") != F.col("_last"))
         & (F.col("count") != F.col("batch_record_limit")))])).drop("_nodes", "_last")


def check_segment_invariants(segments: DataFrame, batches: DataFrame) -> DataFrame:
    """``code`` of the first failing invariant per segment, NULL when all hold."""
    reasons = [name for _, name in V.CLOSE_REASONS]

    def absent_or_positive(c):
        return F.coalesce(F.col(c) > 0, F.lit(True))
    zero = F.col("prev_segment_sha256") == V.ZERO_SHA256
    own = C.first_failure([
        ("segment-hex-field", ~(C.is_hex("ledger_id", 32) & C.is_hex("prev_segment_sha256", 64)
                                & C.is_hex("segment_root", 64))),
        ("segment-identity-or-closure-policy",
         (F.col("site_id") == "") | (F.col("interval_ms") <= 0) | (F.col("batch_record_limit") <= 0)
         | ~absent_or_positive("record_limit") | ~absent_or_positive("size_limit_bytes")
         | ~F.col("close_reason").isin(reasons)),
        ("epoch-predecessor-not-zero", (F.col("segment_number") == 0) & ~zero),
        ("successor-predecessor-is-zero", (F.col("segment_number") != 0) & zero),
        ("empty-segment", F.col("_n").isNull() & ((F.col("empty_mode") != "emit")
                                                  | (F.col("segment_root") != V.EMPTY_SHA256)))])
    flags = batch_flags(batches, segments)
    w = Window.partitionBy(*SEG).orderBy("position")
    edge = F.lag(F.element_at("leaf_hashes", -1)).over(w) > F.get("leaf_hashes", F.lit(0))
    per = flags.withColumn("_cross", F.coalesce(edge, F.lit(False))).groupBy(*SEG).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or("_cross").alias("_cross"),
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("position"))).alias("_batch"))
    # The root counts only where all leaves are digests, in order in and across batches: they are taken as listed, not sorted again.
    totals = batches.groupBy(*SEG).agg(F.sum(F.size("leaf_hashes")).alias("total"))
    roots = M.listed_roots(batches.select(*SEG, "position", F.array_compact("leaf_hashes").alias("_nodes")), SEG, "position", "_nodes", totals).select(
        *SEG, C.hex_lower("root").alias("_root"))
    df = segments.join(per, SEG, "left").join(roots, SEG, "left")
    later = F.coalesce("_batch", C.first_failure([
        ("batch-partitions-unsorted", F.coalesce("_cross", F.lit(False))),
        ("segment-root-mismatch", F.col("_root") != F.col("segment_root"))]))
    return df.withColumn("code", F.coalesce(own, later)).drop("_n", "_cross", "_batch", "_root")


# --- decoding ---------------------------------------------------------------------------------

BATCH_T = ("struct<ledger_id:string,site_id:string,segment_number:decimal(20,0),batch_number:decimal(20,0),"
           "merkle_root:string,count:decimal(20,0),leaf_hashes:array<string>>")
SEGMENT_T = ("struct<error:string,ledger_id:string,site_id:string,segment_number:decimal(20,0),"
             "close_reason:string,prev_segment_sha256:string,segment_root:string,interval_ms:decimal(20,0),"
             f"batch_record_limit:decimal(20,0),record_limit:decimal(20,0),size_limit_bytes:decimal(20,0),"
             f"empty_mode:string,batches:array<{BATCH_T}>>")

# Field types of the three maps; None allows null.
_SEGMENT = {"batches": (list,), "site_id": (str,), "version": (int,), "ledger_id": (str,),
            "close_reason": (str,), "segment_root": (str,), "closure_policy": (dict,),
            "segment_number": (int,), "prev_segment_sha256": (str,), "commitment_profile_id": (str,)}
_POLICY = {"version": (int,), "empty_mode": (str,), "interval_ms": (int,), "batch_record_limit": (int,),
           "record_limit": (int, type(None)), "size_limit_bytes": (int, type(None))}
_BATCH = {"count": (int,), "site_id": (str,), "version": (int,), "ledger_id": (str,), "leaf_hashes": (list,),
          "merkle_root": (str,), "batch_number": (int,), "segment_number": (int,)}


def _shaped(value, fields: dict, name: str) -> dict:
    if not isinstance(value, dict):
        raise K.CborError(f"{name} is not a map")
    for key, types in fields.items():
        if key not in value:
            raise K.CborError(f"missing {key}")
        if not isinstance(value[key], types):
            raise K.CborError(f"invalid {key}")
    extra = set(value) - set(fields)
    if extra:
        raise K.CborError(f"unexpected {min(extra)}")
    return value


def _read_segment(raw: bytes) -> dict:
    if K.check_item(raw, 0, "record") != len(raw):
        raise K.CborError("trailing bytes")
    seg = _shaped(K.decode(raw)[0], _SEGMENT, "segment")
    policy = _shaped(seg["closure_policy"], _POLICY, "closure_policy")
    limits = [policy[k] for k in ("interval_ms", "batch_record_limit", "record_limit", "size_limit_bytes")]
    if seg["version"] != 2 or policy["version"] != 1:
        raise K.CborError("invalid version")
    if seg["commitment_profile_id"] != V.PROFILE_V2:
        raise K.CborError("invalid commitment_profile_id")
    if any(x is not None and x <= 0 for x in limits) or policy["empty_mode"] not in ("emit", "suppress"):
        raise K.CborError("invalid closure_policy")
    batches = [_shaped(b, _BATCH, "batch") for b in seg["batches"]]
    for b in batches:
        if b["version"] != 2 or not all(isinstance(h, str) for h in b["leaf_hashes"]):
            raise K.CborError("invalid batch")
    return {**seg, **policy, "batches": batches}


def decode_segments(artifacts: DataFrame, col: str = "artifact_cbor") -> DataFrame:
    """Strictly decode segment bytes: adds ``seg`` (``seg.error`` is NULL when readable)."""
    kind = artifacts.sparkSession.range(0).select(F.lit(None).cast(SEGMENT_T).alias("s")).schema["s"].dataType
    form = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def read(raw: pa.Array) -> pa.Array:
        cells = []
        for x in raw:
            try:
                seg = _read_segment(x.as_py())
                if any(type(v) is int and v >= 2**63 for part in (seg, seg["closure_policy"], *seg["batches"]) for v in part.values()):
                    raise K.CborError("number out of range")  # the tables hold these numbers as bigint
                cells.append(pa.array([{"error": None, **seg}], form))
            except K.CborError as exc:
                cells.append(pa.array([{"error": str(exc)}], form))
            except RecursionError:
                cells.append(pa.array([{"error": "nested too deeply"}], form))
        return pa.concat_arrays(cells) if cells else pa.array([], form)

    return artifacts.withColumn("seg", read(col))


def decoded_tables(decoded: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(segments, batches) rows of readable artifacts."""
    good = decoded.filter("seg.error is null")
    flat = [F.col(f"seg.{n}").cast("bigint").alias(n) for n in (
        "segment_number", "interval_ms", "batch_record_limit", "record_limit", "size_limit_bytes")]
    segments = good.select(*keep, "seg.ledger_id", "seg.site_id", "seg.close_reason", "seg.prev_segment_sha256",
                           "seg.segment_root", "seg.empty_mode", *flat)
    batches = good.select(*keep, "seg.ledger_id", F.col("seg.segment_number").cast("bigint").alias("segment_number"),
                          F.posexplode("seg.batches").alias("position", "b")).select(
        *keep, *SEG, "position", F.col("b.batch_number").cast("bigint").alias("batch_number"),
        F.col("b.count").cast("bigint").alias("count"), "b.leaf_hashes", "b.merkle_root",
        F.col("b.ledger_id").alias("batch_ledger_id"), F.col("b.site_id").alias("batch_site_id"),
        F.col("b.segment_number").cast("bigint").alias("batch_segment_number"))
    return segments, batches


# --- bundle checks ------------------------------------------------------------------------------

MANIFEST_KEYS = ["ledger_id", "site_id", "segment_number"]
CLAIMS = ["verified", "pending", "missing", "failed", "skipped", "complete"]


def check_manifest_v2(manifests: DataFrame) -> DataFrame:
    """Identity, paths, digests and channel words of manifests with ``refs`` array<struct<path,
    sha256>> and the claimed channel states tsa, ots, peer."""
    number = F.col("segment_number")
    canonical = number.rlike(r"^(0|[1-9][0-9]{0,19})\z") & (
        number.try_cast("decimal(20,0)") <= F.expr("18446744073709551615BD"))
    bad_claim = F.lit(False)
    for c in ("tsa", "ots", "peer"):
        bad_claim = bad_claim | (F.col(c).isNotNull() & ~F.coalesce(F.col(c).isin(CLAIMS), F.lit(False)))
    return manifests.withColumn("error", C.first_failure([
        ("identity", (F.col("version") != 2) | (F.col("commitment_profile_id") != V.PROFILE_V2)
         | ~C.is_hex("ledger_id", 32) | (F.col("site_id") == "") | ~F.coalesce(canonical, F.lit(False))
         | ~F.col("disclosure_class").isin("A", "B", "C")),
        ("path", F.exists("refs", lambda r: ~C.portable_path(r["path"], 2))),
        ("digest", F.exists("refs", lambda r: ~r["sha256"].rlike("^[0-9a-f]{64}\\z"))),
        ("claim", bad_claim)]))


def check_segment_identity(manifests: DataFrame, segments: DataFrame) -> DataFrame:
    """Manifest identity (segment number as text) against the decoded segment of the bundle."""
    s = segments.select("bundle", *[F.col(c).alias(f"_{c}") for c in MANIFEST_KEYS])
    same = F.lit(True)
    for c in MANIFEST_KEYS:
        same = same & (F.col(c) == F.col(f"_{c}").cast("string"))
    return manifests.join(s, "bundle", "left").withColumn(
        "error", F.when(~F.coalesce(same, F.lit(False)), "identity")).drop(*[f"_{c}" for c in MANIFEST_KEYS])


def check_disclosure_precondition(manifests: DataFrame, enforce: bool) -> DataFrame:
    """With the baseline policy some timestamp proof must be present (has_tsa, or both has_ots
    and has_ots_meta)."""
    present = F.col("has_tsa") | (F.col("has_ots") & F.col("has_ots_meta"))
    return manifests.withColumn("error", F.when(F.lit(enforce) & ~present, "timestamp_proof_required"))


def check_chain(bundles: DataFrame) -> DataFrame:
    """Chain result per bundle: segment columns plus ``pred`` struct<ledger_id, site_id,
    segment_number, sha256> where the predecessor is disclosed."""
    p = F.col("pred")
    linked = ((p["ledger_id"] == F.col("ledger_id")) & (p["site_id"] == F.col("site_id"))
              & (p["segment_number"] + 1 == F.col("segment_number"))
              & (p["sha256"] == F.col("prev_segment_sha256")))
    epoch = F.col("segment_number") == 0
    zero = F.col("prev_segment_sha256") == V.ZERO_SHA256
    return bundles.withColumns({
        "error": F.when(epoch & ~zero, "epoch_predecessor").when(
            ~epoch & p.isNotNull() & ~F.coalesce(linked, F.lit(False)), "predecessor_linkage"),
        "chain": F.when(epoch | p.isNotNull(), "executed").otherwise("predecessor-not-disclosed")})


def recompute_class_a(bundles: DataFrame, records: DataFrame, batches: DataFrame) -> DataFrame:
    """Class A bundles (bundle, disclosure_class, segment_root): records (bundle, record) must be
    disclosed, canonical, and equal to the embedded leaves (bundle, leaf_hashes) and root."""
    a = bundles.filter("disclosure_class = 'A'")
    own = records.join(a.select("bundle"), "bundle").withColumn("_m", K.record_meta("record"))
    leaves = staged(own.select("bundle", "_m.error", M.leaf_hash_v2("record").alias("leaf")))  # records are read once
    stats = leaves.groupBy("bundle").agg(F.count(F.lit(1)).alias("_n"), F.count("error").alias("_bad"))
    embedded = batches.join(a.select("bundle"), "bundle").select(
        "bundle", F.explode(F.transform("leaf_hashes", F.unhex)).alias("leaf"))
    diff = multiset_diff(leaves.select("bundle", "leaf"), embedded).groupBy("bundle").agg(
        F.count(F.lit(1)).alias("_d"))
    roots = M.merkle_root_v2(leaves.select("bundle", "leaf"), ["bundle"]).select(
        "bundle", C.hex_lower("root").alias("record_multiset_root"))
    df = a.join(stats, "bundle", "left").join(diff, "bundle", "left").join(roots, "bundle", "left")
    return df.withColumn("error", C.first_failure([
        ("records_required", F.col("_n").isNull()), ("record_not_canonical", F.col("_bad") > 0),
        ("leaves_mismatch", F.col("_d").isNotNull()),
        ("root_mismatch", F.col("record_multiset_root") != F.col("segment_root"))])).drop("_n", "_bad", "_d")


SCOPES = {"A": "public_recompute", "B": "partial_verification", "C": "anchor_only"}


def check_class_bc(bundles: DataFrame, projections: DataFrame) -> DataFrame:
    """Classes B and C: scope, batch check state and error. ``projections`` holds the match
    status of each disclosed batch (bundle, status), see match_batch_projections."""
    stat = projections.groupBy("bundle").agg(F.bool_and(F.col("status") == "ok").alias("_ok"))
    bc = bundles.filter("disclosure_class <> 'A'").join(stat, "bundle", "left")
    cls = F.col("disclosure_class")
    state = F.when(cls == "C", "out_of_scope").when(F.col("_ok").isNull(), "not_disclosed").otherwise("executed")
    return bc.withColumns({
        "verification_scope": F.when(cls == "B", SCOPES["B"]).otherwise(SCOPES["C"]),
        "batch_check": state,
        "record_check": F.concat(F.lit("disclosure-class-"), F.lower(cls)),
        "error": F.when((state == "executed") & ~F.col("_ok"), "batch_projection_mismatch")}).drop("_ok")


def timestamp_channels(bundles: DataFrame, require_tsa: bool) -> DataFrame:
    """Channel states per bundle. Inputs: tsa_error (NULL and has_tsa means verified), has_tsa,
    has_ots, has_peer and the claimed states tsa, ots, peer."""
    tsa = (F.when(F.col("has_tsa"), F.when(F.col("tsa_error").isNull(), "verified").otherwise("failed"))
           .when(F.col("tsa").isNotNull() | F.lit(require_tsa), "missing"))
    def external(proof, claim):
        return F.when(F.col(proof) | F.col(claim).isNotNull(), F.coalesce(F.col(claim), F.lit("missing")))
    return bundles.withColumns({
        "tsa_channel": tsa, "ots_channel": external("has_ots", "ots"),
        "peer_channel": external("has_peer", "peer"),
        "error": F.when(tsa == "failed", "tsa_failed").when(
            F.lit(require_tsa) & ~F.col("has_tsa"), "tsa_required")})


def verdict_v2(checks: DataFrame) -> DataFrame:
    """Result per bundle from ordered check errors (columns e01..), first failure wins."""
    names = sorted(c for c in checks.columns if c.startswith("e") and c[1:].isdigit())
    first = F.coalesce(*[F.col(c) for c in names])
    return checks.withColumns({"failure": first, "overall": F.when(first.isNull(), "success").otherwise("failed")})


REF = "struct<path:string,sha256:string>"
SINGLE = ["segment_cbor", "predecessor_segment_cbor", "segment_json", "segment_sha256", "segment_ots", "segment_ots_meta",
          "peer_attest", "tsa_info", "tsa_tsr"]
LISTED = ["records", "batches"]
MANIFEST_T = ("struct<version:int,ledger_id:string,site_id:string,segment_number:string,commitment_profile_id:string,"
              f"disclosure_class:string,artifacts:struct<{','.join(f'{n}:{REF}' for n in SINGLE)},"
              f"{','.join(f'{n}:array<{REF}>' for n in LISTED)},extensions:map<string,{REF}>>,"
              "anchoring:struct<tsa:struct<status:string>,ots:struct<status:string>,peer:struct<status:string>>>")
PROJECTION_T = ("struct<version:int,ledger_id:string,site_id:string,segment_number:string,batch_number:string,"
                "merkle_root:string,count:string,leaf_hashes:array<string>>")


def read_manifests(manifests: DataFrame) -> DataFrame:
    """Manifest texts (bundle, manifest_json) to columns: identity, class, claims, ``refs`` of every artifact as
    struct<role, place, path, sha256>, and which proofs are there. A text that is no manifest has NULLs."""
    m, a = F.col("_m"), F.col("_m.artifacts")

    def ref(role, r, place=F.lit(0)):
        return F.struct(F.lit(role).alias("role"), place.cast("int").alias("place"), r["path"].alias("path"), r["sha256"].alias("sha256"))
    empty = F.array().cast("array<struct<role:string,place:int,path:string,sha256:string>>")
    single = F.array_compact(F.array(*[F.when(a[n].isNotNull(), ref(n, a[n])) for n in SINGLE]))
    def places(role):
        return lambda r, i: ref(role, r, i)
    listed = [F.coalesce(F.transform(a[n], places(n)), empty) for n in LISTED]
    more = F.coalesce(F.transform(F.map_values(a["extensions"]), places("extension")), empty)
    return manifests.withColumn("_m", F.from_json("manifest_json", MANIFEST_T)).select(
        "bundle", *[m[n].alias(n) for n in ("version", "ledger_id", "site_id", "segment_number", "commitment_profile_id",
                                            "disclosure_class")],
        *[m["anchoring"][n]["status"].alias(n) for n in ("tsa", "ots", "peer")],
        F.coalesce(F.concat(single, *listed, more), empty).alias("refs"),
        a["batches"].isNotNull().alias("has_batches"), a["records"].isNotNull().alias("has_records"),
        *[F.coalesce(a[n].isNotNull(), F.lit(False)).alias(c) for n, c in (
            ("tsa_tsr", "has_tsa"), ("segment_ots", "has_ots"), ("segment_ots_meta", "has_ots_meta"), ("peer_attest", "has_peer"))])


def verify_segment_bundles(files: DataFrame, tsa_errors: DataFrame | None = None, enforce: bool = False,
                           require_tsa: bool = False) -> DataFrame:
    """One verdict per segment bundle from its files (bundle, path, content, sha256), see ``scan_segment_bundles``.

    Columns: bundle, disclosure_class, verification_scope, artifact_sha256, record_multiset_root, checks_executed,
    checks_skipped (check:reason), channel states, failure (the first failing step, NULL if none) and overall. Steps, in order:
    manifest, references (each listed file there with its digest), segment artifact, identity, disclosure precondition, chain,
    record recompute (class A) or batch projections (B), timestamp channels. ``tsa_errors`` (bundle, tsa_error) has
    what an outside verifier found wrong with a timestamp response; responses it does not name count as verified.

    Files are read once into a table of their references; contents are joined only where a step needs them. Segments
    are told apart by bundle, so equal segments of different bundles do not meet.
    """
    at = files.withColumn("path", C.clean_path("path"))
    manifests = at.filter("path = 'segment.verify.json'").select("bundle", C.utf8("content").alias("manifest_json"))
    m = check_manifest_v2(read_manifests(manifests)).withColumnRenamed("error", "e01")
    m = staged(m.withColumn("e01", F.when(F.col("version").isNull(), "manifest").otherwise(F.col("e01"))))
    refs = m.select("bundle", F.inline("refs")).withColumn("path", C.clean_path("path"))
    met = staged(refs.join(at.select("bundle", "path", F.col("sha256").alias("_is"), "content"), ["bundle", "path"], "left"))
    missing = met.withColumn("e", C.first_failure([("artifact-missing", F.col("_is").isNull()),
                                                  ("artifact-sha256", F.col("_is") != F.col("sha256"))]))
    e02 = missing.filter("e IS NOT NULL").groupBy("bundle").agg(F.min_by("e", F.struct("role", "place")).alias("e02"))

    def decoded(role):
        return decode_segments(met.filter(F.col("role") == role).select(
            "bundle", F.col("content").alias("artifact_cbor"), F.col("_is").alias("artifact_sha256"))).drop("artifact_cbor")
    own = staged(decoded("segment_cbor"))
    # A bundle is one segment: its name stands in for the ledger, so that equal segments of two bundles stay apart.
    segs, batches = decoded_tables(own, "bundle", "artifact_sha256")
    named = [segs.withColumn("_ledger", F.col("ledger_id")).withColumn("ledger_id", F.md5("bundle")),
             batches.withColumn("batch_ledger_id", F.when(F.col("batch_ledger_id") == F.col("ledger_id"), F.md5("bundle"))
                                .otherwise(F.col("batch_ledger_id")))
             .withColumn("ledger_id", F.md5("bundle"))]
    codes = check_segment_invariants(*named).select("bundle", F.col("code").alias("_code"))
    e03 = own.select("bundle", F.col("seg.error").alias("_error")).join(codes, "bundle", "left").select(
        "bundle", F.coalesce("_error", "_code").alias("e03"))
    e04 = check_segment_identity(m.select("bundle", *MANIFEST_KEYS), segs).select("bundle", F.col("error").alias("e04"))
    e05 = check_disclosure_precondition(m, enforce).select("bundle", F.col("error").alias("e05"))

    # Of predecessors, decoded as strictly, only the identity is kept.
    named_only = F.col("seg").withField("batches", F.lit(None).cast(f"array<{BATCH_T}>"))
    earlier = staged(decoded("predecessor_segment_cbor").withColumn("seg", named_only))
    before = decoded_tables(earlier, "bundle", "artifact_sha256")[0].select("bundle", F.struct(
        "ledger_id", "site_id", "segment_number", F.col("artifact_sha256").alias("sha256")).alias("pred"))
    shown = refs.filter("role = 'predecessor_segment_cbor'").select("bundle", F.lit(True).alias("_shown"))
    chain = check_chain(segs.join(before, "bundle", "left").join(shown, "bundle", "left")).select(
        "bundle", "chain", F.when(F.col("_shown") & F.col("pred").isNull() & (F.col("segment_number") > 0),
                                  "predecessor_artifact").otherwise(F.col("error")).alias("e06"))
    classed = segs.join(m.select("bundle", "disclosure_class", "has_batches", "has_records"), "bundle")
    records = met.filter("role = 'records'").select("bundle", F.col("content").alias("record"))
    e07 = recompute_class_a(classed, records, batches).select(
        "bundle", "record_multiset_root", F.when(~F.col("has_records"), "records_required").otherwise(F.col("error")).alias("e07"))

    said = met.filter("role = 'batches'").select("bundle", "place", F.from_json(C.utf8("content"), PROJECTION_T).alias("p"))
    held = batches.select("bundle", F.col("position").alias("place"), F.struct(
        F.lit(2).alias("version"), F.col("batch_ledger_id").alias("ledger_id"), F.col("batch_site_id").alias("site_id"),
        F.col("batch_segment_number").cast("string").alias("segment_number"), F.col("batch_number").cast("string").alias("batch_number"),
        "merkle_root", F.col("count").cast("string").alias("count"), "leaf_hashes").alias("b"))
    pairs = said.join(held, ["bundle", "place"], "full_outer").join(
        m.filter("has_batches").select("bundle"), "bundle", "left_semi")
    status = pairs.select("bundle", F.when(F.col("p").eqNullSafe(F.col("b").cast(PROJECTION_T)), "ok").otherwise("mismatch").alias("status"))
    e08 = check_class_bc(classed, status).select("bundle", "batch_check", F.col("error").alias("e08"))
    none = m.select("bundle", F.lit(None).cast("string").alias("tsa_error")).filter("false")
    channels = timestamp_channels(m.join(none if tsa_errors is None else tsa_errors.select("bundle", "tsa_error"), "bundle", "left"),
                                  require_tsa).select("bundle", "tsa_channel", "ots_channel", "peer_channel", F.col("error").alias("e09"))
    out = m.select("bundle", "disclosure_class", "has_tsa", "e01")
    for part in (e02, e03, e04, e05, chain, e07, e08, channels, segs.select("bundle", "artifact_sha256")):
        out = out.join(part, "bundle", "left")
    is_a, cls = F.col("disclosure_class") == "A", F.lower("disclosure_class")
    executed = F.array_compact(F.array(
        F.lit("bundle_disclosure_validation"), F.lit("verification_manifest_validation"), F.lit("segment_artifact_validation"),
        F.when(F.col("chain") == "executed", "segment_chain_validation"), F.when(is_a, "record_level_recompute"),
        F.when(is_a | (F.col("batch_check") == "executed"), "batch_metadata_validation"), F.lit("segment_digest_binding"),
        F.when(F.col("tsa_channel") == "verified", "tsa_verification")))
    skipped = F.array_compact(F.array(
        F.when(F.col("chain") != "executed", F.concat(F.lit("segment_chain_validation:"), "chain")),
        F.when(~is_a, F.concat(F.lit("record_level_recompute:disclosure-class-"), cls)),
        F.when(~is_a & (F.col("batch_check") != "executed"), F.concat(F.lit("batch_metadata_validation:"), "batch_check"))))
    good = F.col("failure").isNull()
    scope = F.coalesce(*[F.when(F.col("disclosure_class") == k, v) for k, v in SCOPES.items()])
    return verdict_v2(out).select(
        "bundle", "disclosure_class", F.when(good, scope).alias("verification_scope"), "artifact_sha256",
        F.when(good, F.col("record_multiset_root")).alias("record_multiset_root"), F.when(good, executed).alias("checks_executed"),
        F.when(good, skipped).alias("checks_skipped"), "tsa_channel", "ots_channel", "peer_channel", "failure", "overall")
