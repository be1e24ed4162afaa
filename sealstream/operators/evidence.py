"""Joins and set operations over evidence tables: files, references, links, certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.functions import values as V
from sealstream.operators.plan import merged, previous_row, running_max_before, salted_join


# --- files and references -------------------------------------------------------

def artifact_digests(files: DataFrame, content: str = "content") -> DataFrame:
    """Digest of each artifact and the text of its digest sidecar."""
    return files.withColumn("sha256", C.sha256_hex(content)).withColumn(
        "sidecar", F.concat("sha256", F.lit("  "), F.element_at(F.split("path", "/"), -1), F.lit("\n")))


def match_artifacts(refs: DataFrame, files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``status`` of each reference: ok, bad_digest, missing or mismatch."""
    keys = keys or ["bundle", "path"]
    actual = files.select(*keys, F.col("sha256").alias("_a"))
    return refs.join(actual, keys, "left").withColumn(
        "status", F.when(~C.is_hex("sha256", 64), "bad_digest").when(F.col("_a").isNull(), "missing")
        .when(F.col("_a") != F.col("sha256"), "mismatch").otherwise("ok")).drop("_a")


def checksum_coverage(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Checksum list lines (bundle, line) against files (bundle, path, sha256): one row per
    path (or malformed line) with status ok, mismatch, stale, missing, duplicate, malformed."""
    shape = r"^([0-9a-f]{64})  (.+)$"
    parsed = lines.select("bundle", "line", F.col("line").rlike(shape).alias("_ok"),
                          F.regexp_extract("line", shape, 1).alias("_d"),
                          F.regexp_extract("line", shape, 2).alias("path"))
    malformed = parsed.filter("not _ok").select("bundle", F.col("line").alias("path"),
                                                F.lit("malformed").alias("status"))
    declared = parsed.filter("_ok").groupBy("bundle", "path").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_d"))
    actual = files.select("bundle", "path", F.col("sha256").alias("_a"))
    both = declared.join(actual, ["bundle", "path"], "full_outer").select(
        "bundle", "path", F.when(F.col("_n") > 1, "duplicate").when(F.col("_a").isNull(), "stale")
        .when(F.col("_d").isNull(), "missing").when(F.col("_a") != F.col("_d"), "mismatch")
        .otherwise("ok").alias("status"))
    return both.unionByName(malformed)


def first_artifact(files: DataFrame, group: list[str], col: str = "path") -> DataFrame:
    """First artifact per group by name; rows are combined before the shuffle."""
    rest = [c for c in files.columns if c not in group]
    return files.groupBy(*group).agg(F.min_by(F.struct(*rest), col).alias("_f")).select(*group, "_f.*")


def deterministic_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total order by range partitioning on all keys."""
    return df.orderBy(*keys)


def upsert_index(index: DataFrame, exported: DataFrame) -> DataFrame:
    """Replace entries of the same (site, day), append, order by ``site:day``."""
    kept = index.join(exported.select("site", "day"), ["site", "day"], "left_anti")
    return kept.unionByName(exported).orderBy(F.concat_ws(":", "site", "day"))


def unresolved_schema_refs(schemas: DataFrame) -> DataFrame:
    """References of (schema_id, body) that no schema of the table resolves."""
    refs = schemas.select("schema_id", F.explode(F.regexp_extract_all(
        "body", F.lit(r'"\$ref"\s*:\s*"([^"]*)"'), F.lit(1))).alias("ref"))
    refs = refs.withColumn("target", F.substring_index("ref", "#", 1))
    refs = refs.filter("target <> ''").filter(~F.col("target").startswith("https://json-schema.org/"))
    known = schemas.select(F.col("schema_id").alias("target"))
    return refs.join(known, "target", "left_anti")


# --- multisets and sets -----------------------------------------------------------

def _copies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both tables with their copies in each. Copies are counted in the map tasks first, so heavy duplicates
    shuffle as one row, and both tables go through one count."""
    sides = [df.withColumns({"left_copies": F.lit(left), "right_copies": F.lit(1 - left)}) for df, left in ((a, 1), (b, 0))]
    return sides[0].unionByName(sides[1]).groupBy(*a.columns).agg(
        F.sum("left_copies").alias("left_copies"), F.sum("right_copies").alias("right_copies"))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose copies differ between two tables, with both counts."""
    return _copies(a, b).filter("left_copies <> right_copies")


def compare_leaf_multisets(recomputed: DataFrame, embedded: DataFrame, group: list[str],
                           leaf: str = "leaf") -> DataFrame:
    """Per group, whether both sides hold the same leaves with the same copies."""
    cols = [*group, leaf]
    both = _copies(recomputed.select(*cols), embedded.select(*cols))
    return both.groupBy(*group).agg(F.count_if(F.col("left_copies") != F.col("right_copies")).alias("differing")).select(
        *group, "differing", (F.col("differing") == 0).alias("equal"))


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows on one side only."""
    return (a.subtract(b).withColumn("side", F.lit("missing"))
            .unionByName(b.subtract(a).withColumn("side", F.lit("stale"))))


def subset_violations(df: DataFrame, small: str, big: str) -> DataFrame:
    """Rows whose array ``small`` has values outside ``big``."""
    return df.withColumn("outside", F.array_sort(F.array_except(small, big))).filter(F.size("outside") > 0)


# --- segment links -------------------------------------------------------------------

def check_segment_links(segments: DataFrame) -> DataFrame:
    """Link state of (ledger_id, site_id, segment_number, prev_segment_sha256, artifact_sha256):
    epoch, linked, broken or undisclosed (no predecessor row)."""
    pred = segments.select("ledger_id", (F.col("segment_number") + 1).alias("segment_number"),
                           F.col("site_id").alias("_site"), F.col("artifact_sha256").alias("_sha"))
    joined = segments.join(pred, ["ledger_id", "segment_number"], "left")
    zero = F.col("prev_segment_sha256") == V.ZERO_SHA256
    good = (F.col("_site") == F.col("site_id")) & (F.col("_sha") == F.col("prev_segment_sha256"))
    return joined.withColumn("link", F.when(
        F.col("segment_number") == 0, F.when(zero, "epoch").otherwise("broken"))
        .when(F.col("_sha").isNull(), "undisclosed").when(good, "linked").otherwise("broken")).drop("_site", "_sha")


def match_batch_projections(projections: DataFrame, batches: DataFrame) -> DataFrame:
    """Standalone projections (numbers as text) against embedded batches by position."""
    keys = ["ledger_id", "segment_number", "batch_number"]
    p = projections.select(
        "ledger_id", F.col("segment_number").cast("string").alias("segment_number"),
        F.col("batch_number").cast("string").alias("batch_number"),
        F.struct("site_id", "merkle_root", F.col("count").cast("string").alias("count"), "leaf_hashes").alias("_p"))
    b = batches.select(
        "ledger_id", F.col("segment_number").cast("string").alias("segment_number"),
        F.col("batch_number").cast("string").alias("batch_number"),
        F.struct("site_id", "merkle_root", F.col("count").cast("string").alias("count"), "leaf_hashes").alias("_b"))
    return p.join(b, keys, "full_outer").select(
        *keys, F.when(F.col("_p").isNull(), "not_disclosed").when(F.col("_b").isNull(), "unexpected")
        .when(F.col("_p").eqNullSafe(F.col("_b")), "ok").otherwise("mismatch").alias("status"))


def pending_segments(segments: DataFrame) -> DataFrame:
    """Sealed segments still waiting for a timestamp, in order."""
    return segments.filter("tsa_status = 'pending'").orderBy("ledger_id", "segment_number")


def attach_proofs(segments: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments with attached responses, responses that hit no pending segment).

    A response hits when ledger, number and digest match and the segment is pending; a second
    response for the same segment is refused like a late one.
    """
    keys = ["ledger_id", "segment_number", "artifact_sha256"]
    ranked = responses.groupBy(*keys).agg(F.min_by("response", "seq").alias("_r"), F.min("seq").alias("_q"))
    hit = (F.col("tsa_status") == "pending") & F.col("_r").isNotNull()
    done = segments.join(ranked, keys, "left")
    updated = done.withColumns({
        "tsa_response": F.when(hit, F.col("_r")),
        "tsa_status": F.when(hit, "verified").otherwise(F.col("tsa_status"))}).drop("_r", "_q")
    used = done.filter(hit).select(*keys, F.col("_q").alias("seq"))
    return updated, responses.join(used, [*keys, "seq"], "left_anti")


# --- anchors ------------------------------------------------------------------------------

def uncovered_heights(heights: DataFrame, headers: DataFrame) -> DataFrame:
    """Attested heights (anchor_id, height, message) without a header, or whose header root
    (internal byte order hex) is another message."""
    roots = headers.select("height", F.col("merkle_root").alias("_root"))
    joined = heights.join(merged(roots), "height", "left")
    return joined.withColumn("problem", F.when(F.col("_root").isNull(), "uncovered").when(
        F.col("_root") != C.hex_lower(C.reverse_bytes(F.unhex("message"))), "root_mismatch")).drop(
            "_root").filter("problem is not null")


def state_rank(col):
    out = F.lit(None).cast("int")
    for name, rank in V.ANCHOR_STATES:
        out = F.when(F.col(col) == name, F.lit(rank)).otherwise(out)
    return out


def state_regressions(receipts: DataFrame) -> DataFrame:
    """Receipts (anchor_id, seq, state, heights) that fall behind their predecessor."""
    seen = previous_row(receipts, ["anchor_id"], "seq", ["state", "heights"])
    lost = F.size(F.array_except("prev_heights", "heights")) > 0
    lower = state_rank("state") < state_rank("prev_state")
    return seen.withColumn("problem", F.when(lost, "heights").when(lower, "state")).filter(
        "problem is not null").drop("prev_state", "prev_heights")


def derive_anchor_state(proofs: DataFrame, headers: DataFrame) -> DataFrame:
    """State per proof (anchor_id, has_proof, pending_uris, heights, messages): every attested height needs a header that
    passes its proof of work and whose root is the attested message. Headers with an ``anchor_id`` count for that
    anchor only."""
    keys = [c for c in ("anchor_id", "height") if c in headers.columns]
    root = C.hex_lower(F.substring("header", 37, 32))
    good = headers.filter(C.pow_ok("header")).select(*keys, root.alias("message")).distinct()
    each = proofs.select("anchor_id", F.inline(F.arrays_zip("heights", "messages"))).select(
        "anchor_id", F.col("heights").alias("height"), F.lower("messages").alias("message"))
    covered = each.join(merged(good.withColumn("_c", F.lit(1))), [*keys, "message"], "left").groupBy("anchor_id").agg(
        (F.count("_c") == F.count(F.lit(1))).alias("_all"))
    state = (F.when(~F.col("has_proof"), "stationary")
             .when((F.size("heights") > 0) & F.coalesce("_all", F.lit(False)), "bitcoin-header-quorum-verified")
             .when(F.size("heights") > 0, "bitcoin-attested-structure")
             .when(F.size("pending_uris") > 0, "calendar-pending").otherwise("failed"))
    return proofs.join(merged(covered), "anchor_id", "left").withColumn("state", state).drop("_all")


MATERIAL = ["state", "heights", "pending", "proof_sha256"]


def advance_anchors(receipts: DataFrame, observations: DataFrame) -> DataFrame:
    """Next receipt per anchor: final anchors stay, regressions are refused, unchanged material
    keeps its old observation time."""
    old = receipts.select("anchor_id", F.col("observed_at").alias("_at"),
                          *[F.col(c).alias(f"_{c}") for c in MATERIAL])
    df = observations.join(old, "anchor_id", "full_outer")
    final = F.coalesce(F.col("_state") == "bitcoin-header-quorum-verified", F.lit(False))
    lost = F.coalesce(F.size(F.array_except("_heights", "heights")) > 0, F.lit(False))
    lower = F.coalesce(state_rank("state") < state_rank("_state"), F.lit(False))
    same = F.lit(True)
    for c in MATERIAL:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = (F.when(final, "final").when(F.col("state").isNull(), "unobserved").when(lost | lower, "refused")
              .when(F.col("_state").isNull(), "created").when(same, "unchanged").otherwise("changed"))
    df = df.withColumn("action", action)
    fresh = F.col("action").isin("created", "changed")
    return df.select("anchor_id", "action", *[
        F.when(fresh, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in MATERIAL],
        F.when(fresh, F.col("observed_at")).otherwise(F.col("_at")).alias("observed_at"))


def cadence_policy_state(issued: DataFrame, acks: DataFrame) -> DataFrame:
    """Issued policies (pod_id, seq, epoch): epochs must rise; ``applied`` needs an ack."""
    seen = running_max_before(issued, ["pod_id"], "seq", "epoch", "_max")
    ok = F.col("_max").isNull() | (F.col("epoch") > F.col("_max"))
    applied = acks.filter("status = 'applied'").select("pod_id", "epoch").distinct().withColumn("_a", F.lit(1))
    return seen.join(applied, ["pod_id", "epoch"], "left").withColumn(
        "state", F.when(~ok, "rejected").when(F.col("_a").isNotNull(), "applied").otherwise("issued")).drop("_max", "_a")


# --- certificates -----------------------------------------------------------------------------

def applicable_revocations(certs: DataFrame, lists: DataFrame, revoked: DataFrame) -> DataFrame:
    """Certificates (cert_id, issuer, serial, gen_time) against revocation lists (list_id, issuer,
    this_update, next_update) and entries (list_id, serial, revoked_at): ``error`` or NULL.

    Lists are counted per issuer before the join, so each certificate meets one row; the range
    test follows on the single applicable list. Lists with a ``kind`` other than full (delta, indirect) are refused.
    """
    kind = F.col("kind") if "kind" in lists.columns else F.lit("full")
    per_issuer = lists.groupBy("issuer").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("list_id", "this_update", "next_update")).alias("_l"),
        F.bool_and(F.coalesce(kind == "full", F.lit(False))).alias("_full"))
    joined = salted_join(certs, per_issuer, ["issuer"], ["cert_id"]).withColumn("list_id", F.col("_l.list_id"))
    entries = revoked.groupBy("list_id", "serial").agg(F.min("revoked_at").alias("_r"))
    joined = joined.join(merged(entries), ["list_id", "serial"], "left")
    t = F.col("gen_time")
    return joined.withColumn("error", C.first_failure([
        ("list_count", F.coalesce("_n", F.lit(0)) != 1),
        ("list_kind", ~F.col("_full")),
        ("not_yet_valid", F.col("_l.this_update") > t),
        ("no_next_update", F.col("_l.next_update").isNull()),
        ("expired_list", F.col("_l.next_update") <= t),
        ("revoked", F.col("_r") <= t)])).drop("_n", "_l", "_r", "_full", "list_id")


def walk_cert_paths(signers: DataFrame, intermediates: DataFrame, anchors: DataFrame,
                    depth: int = 8) -> DataFrame:
    """Path state per signer (cert_id, issuer): anchored, ambiguous or too_deep, with its length.

    The walk runs over distinct issuers, not signers, so an issuer of many signers is one row.
    """
    both = intermediates.select("subject", "issuer", F.lit(0).alias("_a")).unionByName(
        anchors.select("subject", F.lit(None).cast("string").alias("issuer"), F.lit(1).alias("_a")))
    step = both.groupBy(F.col("subject").alias("at")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_a").alias("_a"), F.min("issuer").alias("_next"))
    walk = signers.select(F.col("issuer").alias("start")).distinct().withColumns({
        "at": F.col("start"), "state": F.lit(None).cast("string"), "length": F.lit(0)})
    for level in range(1, depth + 1):
        here = walk.join(merged(step), "at", "left")
        open_ = F.col("state").isNull()
        state = (F.when(F.coalesce("_n", F.lit(0)) != 1, "ambiguous").when(F.col("_a") == 1, "anchored"))
        walk = here.select("start", F.when(open_, F.col("_next")).alias("at"),
                           F.when(open_, state).otherwise(F.col("state")).alias("state"),
                           F.when(open_, F.lit(level)).otherwise(F.col("length")).alias("length"))
    walk = walk.select(F.col("start").alias("issuer"), F.coalesce("state", F.lit("too_deep")).alias("state"), "length")
    return salted_join(signers, walk, ["issuer"], ["cert_id"])


def check_cert_paths(signers: DataFrame, intermediates: DataFrame, anchors: DataFrame, lists: DataFrame,
                     revoked: DataFrame, depth: int = 8) -> DataFrame:
    """State, length and first revocation error along the path of each signer (cert_id, issuer, serial, gen_time).

    Intermediates have subject, issuer and serial. The signer and every intermediate up to the anchor are
    tested against the list of their issuer at the signer's time; ``error_at`` is the place on the path, 0 for the signer.
    The walk is over distinct issuers, and a path has at most ``depth`` certificates.
    """
    both = intermediates.select("subject", "issuer", "serial", F.lit(0).alias("_a")).unionByName(anchors.select(
        "subject", F.lit(None).cast("string").alias("issuer"), F.lit(None).cast("bigint").alias("serial"), F.lit(1).alias("_a")))
    step = both.groupBy(F.col("subject").alias("at")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_a").alias("_a"), F.min(F.struct("issuer", F.col("serial").cast("bigint").alias("serial"))).alias("_c"))
    walk = signers.select(F.col("issuer").alias("start")).distinct().withColumns({
        "at": F.col("start"), "path": F.array().cast("array<struct<issuer:string,serial:bigint>>")})
    for _ in range(depth):
        # An unknown, ambiguous or anchored place ends the path there; walk_cert_paths says which it was.
        walk = walk.join(merged(step), "at", "left").select("start", F.when((F.col("_n") == 1) & (F.col("_a") == 0), F.col("_c.issuer")).alias("at"), F.when(
            (F.col("_n") == 1) & (F.col("_a") == 0), F.concat("path", F.array(F.col("_c")))).otherwise(
            F.col("path")).alias("path"))
    walk = walk.select(F.col("start").alias("issuer"), "path")
    own = salted_join(signers, walk, ["issuer"], ["cert_id"])
    each = own.select("cert_id", "gen_time", F.posexplode(F.concat(F.array(F.struct(
        "issuer", F.col("serial").cast("bigint").alias("serial"))), F.coalesce("path", F.array().cast(
            "array<struct<issuer:string,serial:bigint>>")))).alias("place", "c"))
    tested = applicable_revocations(each.select("cert_id", "gen_time", "place", "c.issuer", "c.serial"), lists, revoked)
    first = tested.filter("error IS NOT NULL").groupBy("cert_id").agg(F.min(F.struct("place", "error")).alias("_e"))
    states = walk_cert_paths(signers, intermediates, anchors, depth).select("cert_id", "state", "length")
    return states.join(first, "cert_id", "left").select(
        "cert_id", "state", "length", F.col("_e.error").alias("error"), F.col("_e.place").alias("error_at"))


def check_tokens(tokens: DataFrame) -> DataFrame:
    """Decoded timestamp tokens against expected columns; ``error`` names the first mismatch."""
    def part_bad(c):
        return F.col(c).isNotNull() & ~F.col(c).between(1, 999)
    return tokens.withColumn("error", C.first_failure([
        ("accuracy", part_bad("millis") | part_bad("micros")),
        ("status", F.col("status") != 0),
        ("policy", F.col("policy_oid") != F.col("expected_policy_oid")),
        ("imprint", (F.col("imprint_oid") != "2.16.840.1.101.3.4.2.1")
         | (F.col("imprint_sha256") != F.col("artifact_sha256"))),
        ("signer", F.col("signer_sha256") != F.col("expected_signer_sha256"))]))
