"""The prefix trie of conversations, built as a burst trie.

A node is a distinct sequence of first turns ``(role, text)``; its members are the
conversations that start with it. All conversations begin in one container under
the root. A container whose members hold more than ``CONTAINER_TURNS`` turns bursts by
the id of the next turn: its top becomes a trie head and each next turn a
container of its own. One round bursts 1, 2, 4, ... levels at once and reads only
the members of containers still too large, so rounds grow with the logarithm of
the deepest burst. What remains is small: each container is sorted by its members'
remaining turn ids and swept once into nodes. A container with a single member is a
chain and needs no sweep, however long the conversation is.

Nothing gathers a hot key. Positions in a conversation come from ranges of the
sorted table; prefixes are named by an exclusive-or of hashes of (depth, turn),
carried along a conversation in stretches of ``STRETCH`` turns; heads, which may
hold a third of all conversations, are counted with partial aggregates. What lies
below a head is added up from per-conversation sums, as each node is charged to its
smallest member. The hash over the members that end at a head follows their order,
so it runs through one task by definition, but over strings of ``ENDS`` ids at most.

Turns and prefixes are told apart by 128 bits of hash.

Defined results: null roles and texts are empty; turns are ordered by number, null
first, equal numbers by role and text; rows without a conv_id belong to no
conversation; repeated rows are repeated turns; other columns are ignored; an empty
table has no nodes, not even a root. ``conv_id`` and ``parent_conv_id`` name a node by
its smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.llm.common import partitions
from quillvec.session import pin, scratch_path

#: Turns in a container beyond which it bursts, unless one member holds them all.
CONTAINER_TURNS = 512
#: Turns of a conversation that one window looks at.
STRETCH = 1024
#: Neighbouring ids of one string in the hash over a head's ends: two to this power.
ENDS_BITS = 9

KEY = ("depth", "p1", "p2")
HEADS = "depth long, p1 long, p2 long, q1 long, q2 long, conv_id long, n_convs long, size long"
NODE = (
    "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
_COLUMNS = [field.split()[0] for field in NODE.split(", ")]


def _kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, k1, k2, size``: turns numbered from 1; ``k1, k2`` name the turn."""
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first())
    text = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"),
        "turn",
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    # Equal numbers may be many, so ranges are cut by what the turns say as well.
    ranged = text.repartitionByRange(
        partitions(turns), *order, F.left("role", F.lit(32)), F.left("text", F.lit(64))
    ).sortWithinPartitions(*order, "role", "text")
    numbered = pin(
        ranged.select(
            "conv_id",
            F.xxhash64("role", "text").alias("k1"),
            F.xxhash64(F.lit("turn"), "role", "text").alias("k2"),
            F.char_length("text").cast("long").alias("size"),
            F.monotonically_increasing_id().alias("place"),
        )
    ).withColumn("part", F.shiftright("place", 33))
    # A row per conversation and range, so at most as many rows a conversation as ranges.
    parts = numbered.groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first")
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        "conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("base")
    )
    return numbered.join(bases, ["conv_id", "part"]).select(
        "conv_id", (F.col("base") + F.col("place") + 1).alias("pos"), "k1", "k2", "size"
    )


def plain_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, n)`` and ``(conv_id, depth, n, k1, k2, size)`` of conversations as they are."""
    rows = ordered(turns).withColumnRenamed("pos", "depth")
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return convs, rows.join(convs, "conv_id")


def rebuilt_conversations(
    turns: DataFrame, family: int = 100, most: int = 6
) -> tuple[DataFrame, DataFrame]:
    """As ``plain_conversations``, the first turns replaced by those of the family's head.

    The first ``h`` turns of conversation ``c`` become those of ``c - c % family``,
    with ``h = crc32(c) % most``; a head lends to fewer than two families of members.
    """
    rows = pin(ordered(turns))
    own = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    named = own.select(
        "conv_id",
        "own",
        (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % family).alias("head"),
    )
    heads = own.select(F.col("conv_id").alias("head"), F.col("own").alias("lent"))
    convs = pin(
        named.join(heads, "head", "left")
        .withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0))))
        .withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    )
    lent = rows.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).select(
        F.col("conv_id").alias("head"), "pos", "k1", "k2", "size"
    )
    borrowed = convs.join(lent, "head").where(F.col("pos") <= F.col("h"))
    rest = rows.join(convs, "conv_id").where(F.col("pos") > F.col("h"))
    steps = borrowed.select("conv_id", F.col("pos").alias("depth"), "n", "k1", "k2", "size").union(
        rest.select(
            "conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "n", "k1", "k2", "size"
        )
    )
    return convs.select("conv_id", "n"), steps


def _along(
    rows: DataFrame, values: dict[str, str], how, falling: bool = False
) -> DataFrame:
    """``rows`` with each of ``values`` replaced by its total over the conversation up to that depth.

    ``falling`` totals from the end. A window sees one stretch of a conversation; the
    totals of whole stretches are carried over in a second, short window.
    """
    rows = rows.withColumn("_stretch", F.floor((F.col("depth") - 1) / STRETCH).cast("long"))
    way = (lambda c: F.col(c).desc()) if falling else F.col
    inside = Window.partitionBy("conv_id", "_stretch").orderBy(way("depth"))
    before = (
        Window.partitionBy("conv_id").orderBy(way("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = rows.groupBy("conv_id", "_stretch").agg(*(how(v).alias(v) for v in values))
    carried = totals.select(
        "conv_id",
        "_stretch",
        *(F.coalesce(how(v).over(before), F.lit(0).cast("long")).alias(f"_{v}") for v in values),
    ).where(" or ".join(f"_{v} != 0" for v in values))
    plus = (lambda a, b: a.bitwiseXOR(b)) if how is F.bit_xor else (lambda a, b: a + b)
    return (
        rows.withColumns({new: how(v).over(inside) for v, new in values.items()})
        .join(carried, ["conv_id", "_stretch"], "left")
        .withColumns(
            {
                new: plus(F.col(new), F.coalesce(F.col(f"_{v}"), F.lit(0).cast("long")))
                for v, new in values.items()
            }
        )
        .drop("_stretch", *(f"_{v}" for v in values))
    )


def _prefixed(steps: DataFrame) -> DataFrame:
    """Steps with the names of their node ``p1, p2`` and of its parent ``q1, q2``."""
    marked = steps.withColumns(
        {
            "z1": F.xxhash64("depth", "k1", "k2"),
            "z2": F.xxhash64(F.lit("node"), "depth", "k1", "k2"),
        }
    )
    return (
        _along(marked, {"z1": "p1", "z2": "p2"}, F.bit_xor)
        .withColumns({f"q{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"z{i}")) for i in (1, 2)})
        .drop("z1", "z2")
    )


def burst(steps: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """The heads: nodes whose containers have burst."""
    spark = steps.sparkSession
    heads = spark.createDataFrame([], HEADS)
    members, low, levels = None, 0, 1
    while True:
        high = low + levels
        level = steps.where(f"depth > {low} and depth <= {high}")
        if members is not None:
            level = level.join(members, "conv_id", "left_semi")
        nodes = level.groupBy(*KEY, "q1", "q2").agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("size").alias("size"),
            F.sum(F.col("n") - F.col("depth") + 1).alias("turns"),
        )
        found = _kept(
            nodes.where((F.col("n_convs") > 1) & (F.col("turns") > container_turns)).drop("turns"),
            "trie-heads",
        )
        heads = heads.unionByName(found)
        deepest = found.agg(F.max("depth")).first()[0]
        if deepest != high:
            return heads
        # Conversations that reach this depth in a container still too large.
        last = found.where(F.col("depth") == high).select(*KEY)
        members = _kept(
            level.where(F.col("depth") == high).join(last, list(KEY), "left_semi").select("conv_id"),
            "trie-members",
        )
        low, levels = high, 2 * levels


def _hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def sweep(members: list[tuple[int, tuple, list[int]]], depth: int) -> list[list]:
    """Nodes of a container from ``(conv_id, turn ids, sizes)``; the first one is its top.

    A node is ``[depth, smallest member, parent's place, members, children, leaves,
    saved, hash of ends]``. Neighbours in sorted order share the longest prefixes, so
    one pass with a stack of open nodes meets every node once.
    """
    nodes: list[list] = []
    ends: list[list[int]] = []
    stack: list[int] = []
    sizes_at: list[int] = []

    def close() -> None:
        place, size = stack.pop(), sizes_at.pop()
        node = nodes[place]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * size
        node[7] = _hash(sorted(ends[place]))
        if stack:
            up = nodes[stack[-1]]
            up[4] += 1
            up[5] += node[5]
            up[6] += node[6]

    before: tuple = ()
    for conv_id, turns, sizes in sorted(members, key=lambda m: m[1]):
        common = next(
            (i for i, (x, y) in enumerate(zip(before, turns, strict=False)) if x != y),
            min(len(before), len(turns)),
        )
        while len(stack) > common:
            close()
        for i in range(common, len(turns)):
            nodes.append([depth + i, conv_id, stack[-1] if stack else None, 0, 0, 0, 0, ""])
            ends.append([])
            stack.append(len(nodes) - 1)
            sizes_at.append(sizes[i])
        for place in stack:
            nodes[place][1] = min(nodes[place][1], conv_id)
            nodes[place][3] += 1
        ends[stack[-1]].append(conv_id)
        before = turns
    while stack:
        close()
    return nodes


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all containers; rows come sorted by container, conversation, depth."""
    types = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
    key, up, members, made = None, None, [], []

    def finish() -> None:
        nodes = sweep([(c, tuple(k), s) for c, k, s in members], key[0])
        for node in nodes:
            # A parent's smallest member is known only when the whole container is swept.
            parent = up if node[2] is None else nodes[node[2]][1]
            made.append([*node[:2], parent, *node[3:], node[2] is None])
        members.clear()

    def taken() -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) or [()] * len(types)
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        made.clear()
        return pa.record_batch(arrays, names=[*_COLUMNS, "top"])

    for batch in batches:
        columns = ("t", "c1", "c2", "up", "conv_id", "k1", "k2", "size")
        for t, c1, c2, parent, conv_id, k1, k2, size in zip(
            *(batch.column(c).to_pylist() for c in columns), strict=True
        ):
            if key != (t, c1, c2):
                if members:
                    finish()
                key, up = (t, c1, c2), parent
            if not members or members[-1][0] != conv_id:
                members.append((conv_id, [], []))
            members[-1][1].append((k1, k2))
            members[-1][2].append(size)
        yield taken()
    if members:
        finish()
        yield taken()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash over all ids of a node; rows are strings of ids, sorted by node and place."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        made = [*([x] for x in key), [state.hexdigest()]]
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.record_batch(
            [pa.array(c, t) for c, t in zip(made, types, strict=True)], names=[*KEY, "ends_sha256"]
        )

    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in (*KEY, "ids")]
        for *node, ids in zip(*lists, strict=True):
            if key != node:
                if key is not None:
                    yield row()
                key, state = node, hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        yield row()


def _ends_of(at: DataFrame) -> DataFrame:
    """``ends_sha256`` for nodes of ``at (depth, p1, p2, conv_id)``."""
    near = at.groupBy(*KEY, F.shiftright("conv_id", ENDS_BITS).alias("place")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ","
        ).alias("ids")
    )
    return (
        near.repartition(partitions(at), *KEY)
        .sortWithinPartitions(*KEY, "place")
        .select(*KEY, "ids")
        .mapInArrow(_ends, "depth long, p1 long, p2 long, ends_sha256 string")
    )


def trie(
    convs: DataFrame, steps: DataFrame, container_turns: int = CONTAINER_TURNS
) -> DataFrame:
    """The nodes of ``convs (conv_id, n)`` with ``steps (conv_id, depth, n, k1, k2, size)``.

    ``n_convs`` are a node's members, ``n_leaves`` the childless nodes of its subtree,
    ``saved_tokens`` the sum over its subtree of ``(n_convs - 1) * size`` and
    ``ends_sha256`` the hash of the ids of members that end at it.
    """
    steps = _kept(_prefixed(steps), "trie-steps")
    heads = burst(steps, container_turns)
    empty_hash = _hash([])

    # How far each conversation runs through heads, and the container that it lies in then.
    marked = _kept(
        steps.join(heads.select(*KEY, F.lit(True).alias("head")), list(KEY), "left"), "trie-marked"
    )
    outside, inside = marked.where("head is null"), marked.where("head")
    tops = outside.groupBy("conv_id").agg(
        F.min_by(F.struct("depth", "p1", "p2", "q1", "q2"), "depth").alias("c")
    ).select("conv_id", F.col("c.depth").alias("t"), "c.p1", "c.p2", "c.q1", "c.q2")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where(
        "n_convs > 0"
    )
    zero = F.lit(0).cast("long")
    all_heads = heads.unionByName(
        root.select(
            *(zero.alias(c) for c in KEY),
            *(F.lit(None).cast("long").alias(c) for c in ("q1", "q2")),
            "conv_id",
            "n_convs",
            zero.alias("size"),
        )
    )
    above = all_heads.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("p1").alias("q1"),
        F.col("p2").alias("q2"),
        F.col("conv_id").alias("up"),
    )
    containers = _kept(
        tops.groupBy(F.col("t").alias("depth"), "p1", "p2", "q1", "q2")
        .agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"))
        .join(above, ["depth", "q1", "q2"])
        .withColumnRenamed("depth", "t"),
        "trie-containers",
    )
    below = outside.join(
        tops.drop("q1", "q2").join(containers.drop("q1", "q2"), ["t", "p1", "p2"]).select(
            "conv_id", "t", F.col("p1").alias("c1"), F.col("p2").alias("c2"), "members", "up"
        ),
        "conv_id",
    )
    at_end = F.col("depth") == F.col("n")
    chains = below.where("members = 1").select(
        "depth",
        "conv_id",
        F.when(F.col("depth") == F.col("t"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(at_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty_hash).alias("ends_sha256"),
    )
    swept = _kept(
        below.where("members > 1")
        .select("t", "c1", "c2", "up", "conv_id", "depth", "k1", "k2", "size")
        .repartition(partitions(steps), "c1", "c2")
        .sortWithinPartitions("t", "c1", "c2", "conv_id", "depth")
        .mapInArrow(_swept, f"{NODE}, top boolean"),
        "trie-swept",
    )

    # Of the heads: children, then what their subtrees hold, charged to smallest members.
    kids = (
        heads.select("depth", "q1", "q2")
        .union(containers.select(F.col("t").alias("depth"), "q1", "q2"))
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    known = _kept(
        all_heads.join(kids, list(KEY), "left").withColumn(
            "n_children", F.coalesce("n_children", zero)
        ),
        "trie-known",
    )
    charged = (
        known.select(
            "conv_id",
            "depth",
            (F.col("n_children") == 0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
        )
        .union(
            swept.where("top").select("conv_id", F.col("depth") - 1, "n_leaves", "saved_tokens")
        )
        .union(
            containers.where("members = 1").select(
                F.col("least"), F.col("t") - 1, F.lit(1).cast("long"), zero
            )
        )
        .groupBy("conv_id", "depth")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    payers = charged.select("conv_id").distinct()
    paths = (
        inside.select("conv_id", *KEY)
        .union(convs.select("conv_id", zero, zero, zero))
        .join(payers, "conv_id", "left_semi")
        .join(charged, ["conv_id", "depth"], "left")
        .fillna(0, ["leaves", "saved"])
    )
    sums = (
        _along(paths, {"leaves": "all_leaves", "saved": "all_saved"}, F.sum, falling=True)
        .groupBy(*KEY)
        .agg(F.sum("all_leaves").alias("n_leaves"), F.sum("all_saved").alias("saved_tokens"))
    )
    ends = _ends_of(
        inside.where(at_end)
        .select(*KEY, "conv_id")
        .union(convs.where("n = 0").select(zero, zero, zero, "conv_id"))
    )
    of_heads = (
        known.join(sums, list(KEY))
        .join(ends, list(KEY), "left")
        .join(above, ["depth", "q1", "q2"], "left")
        .select(
            "depth",
            "conv_id",
            F.col("up").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(empty_hash)).alias("ends_sha256"),
        )
    )
    return of_heads.unionByName(chains).unionByName(swept.drop("top")).select(
        "conv_id", *(c for c in _COLUMNS if c != "conv_id")
    )
