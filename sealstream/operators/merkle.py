"""Hash-sorted Merkle commitments over groups of any size.

Leaves are 32-byte digests. They are sorted within their group, given positions
and reduced in aligned blocks of 2**BLOCK_BITS leaves, so a group holding most of
the data is spread over many tasks. Positions come from a split of each group by
the leading bits of the digest (uniform by nature), never from a window over the
whole group. Equal leaves travel as one row with a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealstream.functions.columns import sha256_bytes
from sealstream.operators.plan import count_up, merged, staged

BLOCK_BITS = 12
_SIZE = 1 << BLOCK_BITS


def leaf_hash_v1(col) -> Column:
    return sha256_bytes(col)


def leaf_hash_v2(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return sha256_bytes(F.concat(F.lit(b"\x00"), col))


def leaf_runs(leaves: DataFrame, group: list[str], leaf: str = "leaf") -> DataFrame:
    """One row per distinct leaf of a group with its number of copies."""
    return leaves.groupBy(*group, F.col(leaf).alias("leaf")).agg(F.count(F.lit(1)).alias("copies"))


def located(runs: DataFrame, group: list[str], bits: int = 16) -> DataFrame:
    """Add ``start`` (0-based position of the first copy) and ``total`` leaves of the group. ``bits`` (at most 16) leading bits of
    the digest split a group: few enough that buckets are not as many as leaves, which would make their table as long."""
    # coalesce makes the bucket non-nullable, so the join below infers no null filter that
    # would evaluate the whole leaf expression a second time at the scan.
    runs = runs.withColumn("_b", F.expr(
        f"coalesce(shiftright(cast(conv(hex(substring(leaf, 1, 2)), 16, 10) as int), {16 - bits}), 0)")).repartition(*group, "_b")
    in_bucket = Window.partitionBy(*group, "_b").orderBy("leaf")
    before = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_in", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    sizes = runs.groupBy(*group, "_b").agg(F.sum("copies").alias("_n"))
    by_bucket = Window.partitionBy(*group).orderBy("_b")
    offsets = sizes.select(
        *group, "_b",
        F.coalesce(F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("total"),
    )
    return placed.join(merged(offsets), [*group, "_b"]).select(
        *group, "leaf", "copies", (F.col("_off") + F.col("_in")).alias("start"),
        "total")


def located_small(runs: DataFrame, group: list[str], *keep: str) -> DataFrame:
    """``located`` for groups that one block holds: a window over a group has a bounded number of rows. Columns ``keep`` stay."""
    whole = Window.partitionBy(*group)
    before = whole.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(*group, "leaf", "copies", F.coalesce(F.sum("copies").over(before), F.lit(0)).alias("start"),
                       F.sum("copies").over(whole).alias("total"), *keep)


def sort_leaves(leaves: DataFrame, group: list[str], leaf: str = "leaf", stage: bool = False) -> DataFrame:
    """Distinct leaves with position range ``start`` .. ``start + copies - 1``.

    Leaves are counted and written once; the largest group tells whether all fit one block each, which needs no split.
    With ``stage`` the result is a written table in every case.
    """
    return located_runs(staged(leaf_runs(leaves, group, leaf)), group, stage)


def largest_group(rows: DataFrame, group: list[str]) -> int:
    """Rows of the largest group; only the group's columns are read."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def located_runs(runs: DataFrame, group: list[str], stage: bool = False) -> DataFrame:
    """``sort_leaves`` for leaves that are counted already (group, leaf, copies); ``runs`` is read twice."""
    sizes = runs.groupBy(*group).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("d"))
    largest, distinct = (x or 0 for x in sizes.agg(F.max("n"), F.max("d")).first())
    if largest <= _SIZE:
        return staged(located_small(runs, group)) if stage else located_small(runs, group)
    # About _SIZE distinct leaves fall into a bucket of the largest group.
    return staged(located(runs, group, min(16, max(1, (distinct // _SIZE).bit_length()))))


def _rounds(runs: DataFrame) -> int:
    """Rounds that the largest group takes."""
    nodes, rounds = runs.agg(F.max("total")).first()[0] or 0, 1
    while nodes > _SIZE:
        nodes, rounds = -(-nodes // _SIZE), rounds + 1
    return rounds


def cut_runs(runs: DataFrame, width) -> DataFrame:
    """Split position runs at multiples of ``width``: adds ``part``, ``pos`` and ``n``."""
    width = F.lit(width).cast("bigint") if isinstance(width, int) else width
    start, end = F.col("start"), F.col("start") + F.col("copies")

    parts = count_up(runs.withColumn("_w", width), F.expr("start div _w"), F.expr("(start + copies - 1) div _w"), "part")
    lo = F.greatest(start, F.col("part") * F.col("_w"))
    hi = F.least(end, (F.col("part") + 1) * F.col("_w"))
    return (parts.withColumn("pos", lo - F.col("part") * F.col("_w"))
            .withColumn("n", hi - lo).drop("_w"))


def _pair(version: int, a: str, b: str) -> str:
    prefix = "X'01', " if version == 2 else ""
    return f"unhex(sha2(concat({prefix}{a}, {b}), 256))"


def _level(version: int, arr: str) -> str:
    """SQL for one tree level over an array of nodes."""
    lone = (f"{arr}[2 * i]" if version == 2
            else _pair(1, f"{arr}[2 * i]", f"{arr}[2 * i]"))
    return (f"transform(sequence(0, (size({arr}) - 1) div 2), i -> "
            f"if(2 * i + 1 < size({arr}), {_pair(version, f'{arr}[2 * i]', f'{arr}[2 * i + 1]')}, "
            f"{lone}))")


def _steps(nodes: str) -> str:
    """Levels to apply inside a block when ``nodes`` nodes exist at this height of the group."""
    return f"if({nodes} > {_SIZE}, {BLOCK_BITS}, cast(ceil(log2({nodes})) as int))"


def _reduce(version: int, arr: str, steps: str) -> Column:
    return F.expr(
        f"aggregate(slice(sequence(1, {BLOCK_BITS}), 1, {steps}), {arr}, "
        f"(a, s) -> {_level(version, 'a')})[0]")


def reduce_array(version: int, arr: str) -> Column:
    """Root of a bounded, already ordered ARRAY<BINARY> column (NULL when empty)."""
    steps = f"cast(ceil(log2(size({arr}))) as int)"
    return F.expr(
        f"aggregate(slice(sequence(1, 31), 1, {steps}), {arr}, "
        f"(a, s) -> {_level(version, 'a')})[0]")


def _blocks(runs: DataFrame, group: list[str]) -> DataFrame:
    """Leaf arrays of aligned blocks: group, ``part``, ``nodes`` array, ``total``."""
    cut = cut_runs(runs, _SIZE)
    return (cut.groupBy(*group, "part")
            .agg(F.max("total").alias("total"),
                 F.sort_array(F.collect_list(F.struct("pos", "n", "leaf"))).alias("_p"))
            .select(*group, "part", "total", F.expr(
                "flatten(transform(_p, x -> array_repeat(x.leaf, cast(x.n as int))))")
                .alias("nodes")))


def _next_round(roots: DataFrame, group: list[str]) -> DataFrame:
    return (roots.withColumn("_pos", F.pmod("part", F.lit(_SIZE)))
            .withColumn("part", F.expr(f"part div {_SIZE}"))
            .groupBy(*group, "part")
            .agg(F.max("total").alias("total"), F.max("_h").alias("_h"),
                 F.array_sort(F.collect_list(F.struct("_pos", "root"))).alias("_p"))
            .select(*group, "part", "total", "_h",
                    F.expr("transform(_p, x -> x.root)").alias("nodes")))


def _reduced(level: DataFrame, group: list[str], version: int) -> DataFrame:
    """Block roots of the groups of more than one block, and their number per group."""
    return level.filter(F.col("_h") > _SIZE).select(
        *group, "part", "total", _reduce(version, "nodes", _steps("_h")).alias("root"),
        F.expr(f"(_h + {_SIZE - 1}) div {_SIZE}").alias("_h"))


def roots_of(runs: DataFrame, group: list[str], version: int, totals: DataFrame | None = None) -> DataFrame:
    """Roots of located runs (see ``sort_leaves``): group, ``leaf_count``, ``root``. A round turns blocks into nodes; there are as
    many rounds as the largest group needs, and other groups leave earlier. ``totals`` has the column ``total`` where that is
    cheaper than from the runs."""
    level, done, rounds = _blocks(runs, group).withColumn("_h", F.col("total")), None, _rounds(runs if totals is None else totals)
    for rnd in range(rounds):
        # Groups of one block are finished and leave; for the others a round divides the nodes by the block size.
        ended = level.filter(F.col("_h") <= _SIZE).select(
            *group, F.col("total").alias("leaf_count"), _reduce(version, "nodes", _steps("_h")).alias("root"))
        done = ended if done is None else done.unionByName(ended)
        if rnd + 1 < rounds:
            level = _next_round(_reduced(level, group, version), group)
    return done


def merkle_root_v1(leaves: DataFrame, group: list[str], leaf: str = "leaf") -> DataFrame:
    """``sha256(l || r)``, odd last node paired with itself."""
    return roots_of(sort_leaves(leaves, group, leaf), group, 1)


def merkle_root_v2(leaves: DataFrame, group: list[str], leaf: str = "leaf") -> DataFrame:
    """``sha256(0x01 || l || r)``, odd last node promoted unchanged.

    Groups are counted first, which reads no leaves: where one block holds each of them, a group's leaves are sorted in its row.
    """
    if largest_group(leaves, group) > _SIZE:
        return roots_of(sort_leaves(leaves, group, leaf), group, 2)
    return small_roots(leaves, group, 2, leaf)


def small_roots(leaves: DataFrame, group: list[str], version: int, leaf: str = "leaf", **more: Column) -> DataFrame:
    """Roots of groups that one block holds, and further aggregates of the same rows."""
    rows = leaves.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(leaf).alias("leaf")))).alias("_p"),
                                      *[c.alias(n) for n, c in more.items()])
    rows = rows.select(*group, F.size("_p").cast("bigint").alias("leaf_count"), F.col("_p.leaf").alias("nodes"), *more)
    return rows.select(*group, "leaf_count", _reduce(version, "nodes", _steps("leaf_count")).alias("root"), *more)


def listed_roots(lists: DataFrame, group: list[str], position: str, nodes: str, totals: DataFrame, version: int = 2) -> DataFrame:
    """Roots over leaves in the order they are listed in: rows of a group have an array ``nodes`` of hex digests, one after the
    other by ``position``. Nothing is sorted or counted by leaf: where lists are in order, this is the root of ``sort_leaves``.
    Lists are bounded; a group may have any number of them. ``totals`` (total) has the leaves of each group, or more.
    """
    before = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    placed = lists.select(*group, position, nodes, F.size(nodes).cast("bigint").alias("_n")).select(
        *group, nodes, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("total"))
    runs = placed.select(*group, "_at", "total", F.posexplode(nodes).alias("_i", "leaf")).select(
        *group, F.unhex("leaf").alias("leaf"), F.lit(1).cast("bigint").alias("copies"), (F.col("_at") + F.col("_i")).alias("start"), "total")
    return roots_of(runs, group, version, totals)


def partition_batches(runs: DataFrame, group: list[str], limit) -> DataFrame:
    """Cut located runs into consecutive batches: adds ``batch_number``; positions restart."""
    return (cut_runs(runs, limit).withColumnRenamed("part", "batch_number")
            .withColumn("start", F.col("pos")).withColumn("copies", F.col("n"))
            .select(*group, "batch_number", "leaf", "copies", "start", "total"))


def batch_lists(runs: DataFrame, group: list[str], limit, version: int = 2) -> DataFrame:
    """Per batch: count, ordered leaf hex list and root. Lists are as long as ``limit``."""
    cut = cut_runs(runs, limit)
    lists = (cut.groupBy(*group, F.col("part").alias("batch_number"))
             .agg(F.sum("n").alias("count"),
                  F.sort_array(F.collect_list(F.struct("pos", "n", "leaf"))).alias("_p"))
             .select(*group, "batch_number", "count", F.expr(
                 "flatten(transform(_p, x -> array_repeat(x.leaf, cast(x.n as int))))")
                 .alias("nodes")))
    return lists.select(
        *group, "batch_number", "count",
        F.transform("nodes", lambda b: F.lower(F.hex(b))).alias("leaf_hashes"),
        F.lower(F.hex(reduce_array(version, "nodes"))).alias("merkle_root"))


def inclusion_proofs(leaves: DataFrame, group: list[str], version: int,
                     leaf: str = "leaf") -> DataFrame:
    """Siblings from leaf to root for every distinct leaf (at its first position)."""
    runs = sort_leaves(leaves, group, leaf)
    level, rounds = _blocks(runs, group).withColumn("_h", F.col("total")), _rounds(runs)
    paths = []
    for rnd in range(rounds):
        steps = _steps("_h")
        stacked = level.withColumn("_levels", F.expr(
            f"aggregate(slice(sequence(1, {BLOCK_BITS}), 1, {steps}), array(nodes), "
            f"(acc, s) -> concat(acc, array({_level(version, 'acc[s - 1]')})))"))
        own = "x[shiftright(p, k)]" if version == 1 else "cast(null as binary)"
        sibling = (f"transform(slice(_levels, 1, size(_levels) - 1), (x, k) -> "
                   f"if(shiftright(p, k) ^ 1 < size(x), x[shiftright(p, k) ^ 1], {own}))")
        # Paths are built inside the block's row: exploding first would copy every level per leaf.
        per_node = stacked.select(*group, "part", F.expr(
            "inline(transform(sequence(0, size(nodes) - 1), p -> named_struct('p', p, "
            f"'_s{rnd}', filter({sibling}, y -> y is not null))))"))
        paths.append(per_node)
        if rnd + 1 < rounds:
            level = _next_round(_reduced(level, group, version), group)
    out = runs.select(*group, "leaf", "start", "total")
    for rnd, path in enumerate(paths):
        shift = BLOCK_BITS * rnd
        keyed = path.select(*group, (F.col("part") * _SIZE + F.col("p")).alias("_k"), f"_s{rnd}")
        out = out.withColumn("_k", F.shiftright("start", shift)).join(
            keyed, [*group, "_k"], "left" if rnd else "inner").drop("_k")
    return out.select(*group, "leaf", F.col("start").alias("position"), F.col("total").alias("leaf_count"),
                      F.concat(*[F.coalesce(f"_s{r}", F.array().cast("array<binary>")) for r in range(rounds)]).alias("siblings"))


def fold_proof(version: int, leaf: str = "leaf", position: str = "position",
               count: str = "leaf_count", siblings: str = "siblings") -> Column:
    """Root implied by an inclusion proof. State: node, index, nodes on the level, next sibling."""
    lift = ("s.m > 1 and not (s.i = s.m - 1 and s.i % 2 = 0)" if version == 2 else "s.m > 1")
    pre = "X'01', " if version == 2 else ""
    left = f"unhex(sha2(concat({pre}{siblings}[s.k], s.h), 256))"
    right = f"unhex(sha2(concat({pre}s.h, {siblings}[s.k]), 256))"
    start = (f"named_struct('h', {leaf}, 'i', cast({position} as bigint), 'm', cast({count} as bigint), 'k', 0)")
    step = (f"named_struct('h', if({lift}, if(s.i % 2 = 1, {left}, {right}), s.h), 'i', s.i div 2, "
            f"'m', (s.m + 1) div 2, 'k', if({lift}, s.k + 1, s.k))")
    levels = f"sequence(1, greatest(1, cast(ceil(log2({count})) as int)))"
    return F.expr(f"aggregate({levels}, {start}, (s, x) -> {step}, s -> s.h)")
