import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.operators import merkle as M


def sha(b):
    return hashlib.sha256(b).digest()


def root_v1(leaves):
    level = sorted(leaves)
    while len(level) > 1:
        level = [sha(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    return level[0]


def root_v2(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << ((len(leaves) - 1).bit_length() - 1)
    return sha(b"\x01" + root_v2(leaves[:k]) + root_v2(leaves[k:]))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BITS", 2)
    monkeypatch.setattr(M, "_SIZE", 4)


def groups(seed=7):
    rnd = random.Random(seed)
    # Group g has g leaves; every third group is mostly copies of one leaf.
    out = {}
    for g in range(1, 64):
        out[g] = [sha(bytes([g, 0 if g % 3 == 0 and rnd.random() < 0.8 else rnd.randrange(256)])) for _ in range(g)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(g, bytearray(x)) for g, xs in data.items() for x in xs], "g int, leaf binary").repartition(4)


def test_roots_of_many_sizes(spark, small_blocks):
    data = groups()
    df = frame(spark, data)
    v1 = {r.g: (bytes(r.root), r.leaf_count) for r in M.merkle_root_v1(df, ["g"]).collect()}
    v2 = {r.g: (bytes(r.root), r.leaf_count) for r in M.merkle_root_v2(df, ["g"]).collect()}
    assert v1 == {g: (root_v1(xs), g) for g, xs in data.items()}
    assert v2 == {g: (root_v2(sorted(xs)), g) for g, xs in data.items()}


@pytest.mark.parametrize("version", [1, 2])
def test_proofs_fold_to_the_root(spark, small_blocks, version):
    data = groups(11)
    want = root_v1 if version == 1 else (lambda xs: root_v2(sorted(xs)))
    proofs = M.inclusion_proofs(frame(spark, data), ["g"], version)
    rows = proofs.select("g", M.fold_proof(version).alias("root")).collect()
    assert len(rows) == sum(len(set(xs)) for xs in data.values())
    assert all(bytes(r.root) == want(data[r.g]) for r in rows)


def test_order_and_partitioning_do_not_matter(spark):
    data = {1: [sha(str(i).encode()) for i in range(500)]}
    df = frame(spark, data)
    a = M.merkle_root_v2(df.repartition(1), ["g"]).first().root
    b = M.merkle_root_v2(df.orderBy(F.rand(3)), ["g"]).first().root
    assert a == b == bytearray(root_v2(sorted(data[1])))


def test_one_leaf_many_times(spark):
    """A run of copies is cut into blocks without being expanded first."""
    leaf = sha(b"x")
    df = spark.range(9000).select(F.lit(1).alias("g"), F.lit(leaf).alias("leaf"))
    assert M.sort_leaves(df, ["g"]).count() == 1
    assert bytes(M.merkle_root_v1(df, ["g"]).first().root) == root_v1([leaf] * 9000)
    assert bytes(M.merkle_root_v2(df, ["g"]).first().root) == root_v2([leaf] * 9000)


def test_batches_cut_runs(spark):
    leaves = sorted(sha(bytes([i])) for i in range(5)) + [sha(b"\x04")] * 6
    df = frame(spark, {1: leaves})
    rows = M.batch_lists(M.sort_leaves(df, ["g"]), ["g"], 4).orderBy("batch_number").collect()
    flat = sorted(leaves)
    assert [r["count"] for r in rows] == [4, 4, 3]
    assert [h for r in rows for h in r.leaf_hashes] == [x.hex() for x in flat]
    assert [r.merkle_root for r in rows] == [root_v2(flat[i:i + 4]).hex() for i in (0, 4, 8)]


def test_published_v2_vector(spark):
    # Three records, their leaves, batch roots and the segment root.
    records = ["87014800000000000000010100f600f6", "87014800000000000000020201f600f6", "87014800000000000000030302f600f6"]
    leaves = ["b83bc27f2d8be3a66373af24e6af3eeffff99ff0696ae18c70e379e853796d26",
              "b5227357cf5d0619914971d8dc5218c5a99260bc5d5e1b60cb1083a911a2acaf",
              "4f82e3e7ee90a111774dd951471a31d4582e0908a0bd5fd63c0080c0231f40cc"]
    df = spark.createDataFrame([(1, r) for r in records], "g int, h string").select("g", F.unhex("h").alias("record"))
    df = df.withColumn("leaf", M.leaf_hash_v2("record"))
    assert {r.h for r in df.select(C.hex_lower("leaf").alias("h")).collect()} == set(leaves)
    assert M.merkle_root_v2(df, ["g"]).select(C.hex_lower("root")).first()[0] == \
        "bc6502552ed0c515f58d1c632e54db37594042609b59838eb0d5b3d5842aa054"
    roots = M.batch_lists(M.sort_leaves(df, ["g"]), ["g"], 2).orderBy("batch_number").collect()
    assert [r.merkle_root for r in roots] == [
        "554491e4edf28061622396b83a870db4652211557127c664c6be1c4ad66471ff", leaves[0]]


def frames(spark):
    return spark.createDataFrame([(g, bytearray(b"%d" % (k % 3 if g == 2 else k))) for g in (1, 2, 3) for k in range(2 * g)]
                                 + [(None, bytearray(b"x")), (3, None)], "g long, frame binary")


def test_small_groups_are_not_staged(spark, monkeypatch):
    """Roots, batches and vector sets of small groups take one shuffle of their rows, with the results of the path for large groups."""
    from sealstream.operators import ledger as L
    from sealstream.operators import segments as S
    df = frames(spark)
    leaves = df.select("g", M.leaf_hash_v2("frame").alias("leaf"))
    records = df.filter("g IS NOT NULL AND frame IS NOT NULL").select(F.col("g").alias("set_id"), F.col("frame").alias("record"), C.hex_lower(
        M.leaf_hash_v2(F.when(F.col("g") == 1, b"other").otherwise(F.col("frame")))).alias("leaf_sha256"))
    claims = M.merkle_root_v2(records.withColumn("leaf", M.leaf_hash_v2("record")), ["set_id"]).select(
        "set_id", F.when(F.col("set_id") == 3, "no").otherwise(C.hex_lower("root")).alias("root"))
    key = lambda rows: sorted((tuple(map(str, r)) for r in rows))

    def run():
        return [key(x.collect()) for x in (M.merkle_root_v2(leaves, ["g"]), L.batch_objects(df, ["g"], 3), S.check_vectors(records, claims))]
    with monkeypatch.context() as m:
        def refused(df):
            raise AssertionError("staged")
        m.setattr(M, "staged", refused)
        m.setattr(L, "staged", refused)
        small = run()
    monkeypatch.setattr(M, "BLOCK_BITS", 2)
    monkeypatch.setattr(M, "_SIZE", 4)
    large = run()
    assert small[1:] == large[1:] and [r for r in small[0] if r[0] != "None"] == [r for r in large[0] if r[0] != "None"]
    assert {r[0]: r[1] for r in small[2]} == {"1": "leaf", "2": "None", "3": "root"}


def test_places_of_leaves_are_never_broadcast(spark):
    """Leaves and buckets grow with the input; a file of copies is small for its rows."""
    runs = spark.createDataFrame([(1, bytearray(sha(b"%d" % k)), 1) for k in range(40)], "g long, leaf binary, copies long")
    placed = M.located(runs, ["g"])
    assert "BroadcastHashJoin" not in placed._jdf.queryExecution().toString()
    assert sorted(r.start for r in placed.collect()) == list(range(40))


def test_listed_roots(spark):
    """Lists in order have the root of sorted leaves, in groups of one block and of several; NULL lists and empty ones count nothing."""
    from pyspark.sql import functions as F
    from sealstream.operators import merkle as M
    leaves = spark.range(9100).select(F.when(F.col("id") < 9000, "big").otherwise("small").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    leaves = leaves.unionByName(leaves.filter("h < '1'"))  # some twice
    lists = leaves.groupBy("g").agg(F.sort_array(F.collect_list("h")).alias("h")).select("g", F.posexplode(
        F.transform(F.sequence(F.lit(0), F.expr("size(h) div 7")), lambda k: F.slice("h", k * 7 + 1, 7))).alias("position", "nodes"))
    lists = lists.unionByName(spark.createDataFrame([("big", -1, None), ("none", 0, [])], "g string, position int, nodes array<string>"))
    totals = lists.groupBy("g").agg(F.sum(F.size("nodes")).alias("total"))
    got = {(r.g, r.leaf_count, bytes(r.root)) for r in M.listed_roots(lists, ["g"], "position", "nodes", totals).collect()}
    want = M.merkle_root_v2(leaves.select("g", F.unhex("h").alias("leaf")), ["g"])
    assert got == {(r.g, r.leaf_count, bytes(r.root)) for r in want.collect()} and len(got) == 2


def test_buckets_follow_the_largest_group(spark):
    """The split of a group by leading bits gives the same places for any number of bits."""
    from pyspark.sql import functions as F
    from sealstream.operators import merkle as M
    runs = M.leaf_runs(spark.range(6000).select((F.col("id") % 2).alias("g"), F.unhex(F.sha2((F.col("id") % 5500).cast("string"), 256)).alias("leaf")), ["g"])
    places = [{(r.g, bytes(r.leaf), r.copies, r.start, r.total) for r in M.located(runs, ["g"], bits).collect()} for bits in (1, 5, 16)]
    assert places[0] == places[1] == places[2] and len(places[0]) == 5500
    assert places[0] == {(r.g, bytes(r.leaf), r.copies, r.start, r.total) for r in M.located_small(runs, ["g"]).collect()}
