"""Prefix trie of conversations, with subtree sums by centroid decomposition.

A node is a distinct sequence of first turns. A turn is known by a digest of its place, role and text, a prefix by the
sums of the digests of its turns in four 32-bit lanes, so prefixes are running sums: no conversation is gathered in one
row or task, and nodes are one grouped count.

Subtree sums go over the parent edges, in as many rounds as the number of turns has binary digits, however deep the
trie. A node weighs as many as the conversations that pass it; its subtree then weighs what its members have left of
turns, which the grouped count gives as well. Each round, in every component: the centroid is the deepest node whose
subtree, within the component, has more than half of the weight; the nodes with more than half are exactly the path from
it to the top; the totals of what hangs on the centroid, itself included, are aggregated and added along that path; the
centroid is final and its removal leaves a component for each child and one above, each at most half as heavy.

Rows without conv_id belong to no conversation. A null role or text counts as empty. Turns come in ascending order,
null first; equal turns are ordered by digest. Repeated rows are turns of their own. An empty table gives no node.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, materialize, parted, pick, ranked, running

LANES = range(4)
BLOCK_CHARS = 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turns(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, n_bytes, _part of each turn; texts are read here and go no further."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = pick(conversations, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    return ranked(parted(scratch, rows, "conv_id", order, "turns"), "conv_id", order).select(
        "conv_id", F.col("_rank").alias("pos"), "digest", "n_bytes", "_part")


def share_heads(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared beginnings: all conv_ids, and their turns.

    The first h turns of conversation c - c % ``group`` (all if fewer), then c's own turns after its first h, where
    h = crc32(c) % ``most``. A rebuilt conversation may have no turn.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    ids = rows.groupBy("conv_id").agg(F.count("*").alias("_own"))
    heads = rows.filter(F.col("pos") < most).select(
        F.col("conv_id").alias("_base"), "pos", "digest", "n_bytes", F.lit(-1).alias("_part"))
    bases = ids.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % group).alias("_base"))
    sizes = ids.select(F.col("conv_id").alias("_base"), F.col("_own").alias("_there"))
    known = bases.join(sizes, "_base", "left").withColumn("_shared", F.least("h", F.coalesce("_there", F.lit(0))))
    shared = bases.join(heads, "_base").filter(F.col("pos") <= F.col("h")).select(*rows.columns)
    own = rows.join(known, "conv_id").filter(F.col("pos") > F.col("h")).withColumn(
        "pos", F.col("pos") - F.col("h") + F.col("_shared")).select(*rows.columns)
    return ids.select("conv_id"), shared.unionByName(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """Each turn with the key of the prefix that it ends (k0..k3), that of the prefix before it (p0..p3), and its conversation's n_turns."""
    placed = F.md5(F.concat_ws(":", F.col("pos").cast("string"), "digest"))
    lanes = rows.withColumns({f"_d{i}": F.conv(F.substring(placed, 8 * i + 1, 8), 16, 10).cast("long") for i in LANES})
    summed = running(lanes, "conv_id", [F.col("pos").asc()], {f"k{i}": f"_d{i}" for i in LANES})
    return summed.select(
        "conv_id", "pos", "n_bytes", F.col("_total").alias("n_turns"), *[f"k{i}" for i in LANES],
        *[(F.col(f"k{i}") - F.col(f"_d{i}")).alias(f"p{i}") for i in LANES])


def trie(conversations: DataFrame, rebuild=None) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rebuild`` may change the turns first, as ``share_heads`` does. saved_tokens counts the bytes of a node's last turn
    once for each member but one. ends_sha256 is that of the members that end at the node, ascending, comma-joined.
    Runs jobs before it returns.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    rows = scratch.put(turns(scratch, conversations), "numbered")
    ids, rows = rebuild(rows) if rebuild else (rows.select("conv_id").distinct(), rows)
    ids = scratch.put(ids, "ids")
    steps = scratch.put(prefixes(rows), "steps")
    scratch.drop("turns", "numbered")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    nodes, labels = _nodes(scratch, steps, root)
    sums = _roll_up(scratch, nodes, labels, root.conv_id)
    shas = _ends(ids, steps, labels, root.conv_id)
    out = sums.join(shas, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    result = materialize(out, "trie-nodes")
    scratch.close()
    return result


def _long(value: int | None) -> Column:
    return F.lit(value).cast("long")


def _nodes(scratch: Scratch, steps: DataFrame, root: Row) -> tuple[DataFrame, DataFrame]:
    """Nodes with their own values, and the node (its conv_id) and its parent at each step of each conversation.

    ``root``: smallest id and number of all conversations.
    """
    one = steps.sparkSession.range(1).filter(F.lit(root.n_convs > 0))
    keys, above = [f"k{i}" for i in LANES], [f"p{i}" for i in LANES]
    inner = scratch.put(steps.groupBy("pos", *keys, *above).agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"),
        F.sum(F.col("n_turns") - F.col("pos") + 1).alias("weight"), F.max("n_bytes").alias("n_bytes")), "inner")
    # The root's key is that of no turn at all: zero in each lane.
    upper = inner.select("pos", *keys, F.col("node").alias("parent")).unionByName(one.select(
        *[_long(0).alias(c) for c in ("pos", *keys)], _long(root.conv_id).alias("parent")))
    linked = scratch.put(inner.withColumn("_up", F.col("pos") - 1).join(
        upper.select(F.col("pos").alias("_up"), *[F.col(k).alias(p) for k, p in zip(keys, above)], "parent"),
        ["_up", *above]).drop("_up", *above), "linked")
    labels = scratch.put(steps.select("conv_id", "pos", *keys).join(
        linked.select("pos", *keys, "node", "parent"), ["pos", *keys]).select(
        "conv_id", F.col("pos").alias("depth"), "node", "parent"), "labels")
    children = linked.groupBy(F.col("parent").alias("conv_id"), (F.col("pos") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    nodes = linked.select(
        F.col("node").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
        "weight", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    ).unionByName(one.select(*[_long(v).alias(n) for n, v in (
        ("conv_id", root.conv_id), ("depth", 0), ("parent_conv_id", None), ("n_convs", root.n_convs),
        ("weight", steps.count() + root.n_convs), ("saved", 0))]))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return nodes, labels


def _roll_up(scratch: Scratch, nodes: DataFrame, labels: DataFrame, root: int | None) -> DataFrame:
    """Nodes with n_leaves and saved_tokens of their subtrees, by centroid decomposition."""
    component = ["top_conv", "top_depth"]
    zero = _long(0)
    state = scratch.put(nodes.select(
        "*", _long(root).alias("top_conv"), zero.alias("top_depth"), (F.col("n_children") == 0).cast("long").alias("leaf"),
        zero.alias("n_leaves"), zero.alias("saved_tokens")), "state-0")
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    lookup = labels.select("conv_id", F.col("depth").alias("_depth"), F.col("node").alias("_branch"),
                           F.col("parent").alias("_above"))
    done, level = None, 0
    while not state.isEmpty():
        tops = state.groupBy(*component).agg(F.max("weight").alias("_whole"))
        heavy = state.join(tops, component).filter(2 * F.col("weight") > F.col("_whole"))
        centroids = heavy.groupBy(*component).agg(
            F.max(F.struct("depth", "conv_id", "weight")).alias("_c"), F.max("_whole").alias("_whole"))
        reached = state.join(centroids, component).withColumn("_depth", F.col("_c.depth") + 1)
        placed = scratch.put(reached.join(lookup, ["conv_id", "_depth"], "left").select(
            *state.columns, "_c", "_branch", (2 * F.col("weight") > F.col("_whole")).alias("_on_path"),
            ((F.col("depth") > F.col("_c.depth")) & (F.col("_above") == F.col("_c.conv_id"))).alias("_below"),
            ((F.col("depth") == F.col("_c.depth")) & (F.col("conv_id") == F.col("_c.conv_id"))).alias("_is_c")), f"placed-{level}")
        totals = placed.filter(F.col("_below") | F.col("_is_c")).groupBy(*component).agg(
            F.sum("leaf").alias("_leaves"), F.sum("saved").alias("_saved"))
        # At a large component the join is split by Spark; only its path takes the totals.
        moved = scratch.put(placed.join(totals, component).withColumns({
            "n_leaves": F.col("n_leaves") + F.when(F.col("_on_path"), F.col("_leaves")).otherwise(0),
            "saved_tokens": F.col("saved_tokens") + F.when(F.col("_on_path"), F.col("_saved")).otherwise(0),
            "weight": F.col("weight") - F.when(F.col("_on_path") & ~F.col("_is_c"), F.col("_c.weight")).otherwise(0),
            "top_conv": F.when(F.col("_below"), F.col("_branch")).otherwise(F.col("top_conv")),
            "top_depth": F.when(F.col("_below"), F.col("_c.depth") + 1).otherwise(F.col("top_depth")),
        }).select(*state.columns, "_is_c"), f"moved-{level}")
        final = scratch.put(moved.filter("_is_c").select(*kept), "final")
        done = final if done is None else done.unionByName(final)
        state = moved.filter(~F.col("_is_c")).select(*state.columns)
        scratch.drop(f"placed-{level}", f"moved-{level - 1}", f"state-{level}")
        level += 1
    return done if done is not None else nodes.withColumns({"n_leaves": zero, "saved_tokens": zero}).select(*kept)


def _ends(ids: DataFrame, steps: DataFrame, labels: DataFrame, root: int | None) -> DataFrame:
    """SHA-256 per node of the ids that end there, in order.

    Ids are joined to blocks of text within ranges of (node, id), then the blocks of a node, in order, go through one
    running hash: neither a node's ids nor their text are ever held as a whole.
    """
    lengths = steps.groupBy("conv_id").agg(F.max("n_turns").alias("depth"))
    at_root = ids.join(lengths, "conv_id", "left_anti").select(
        _long(root).alias("node"), _long(0).alias("depth"), "conv_id")
    ends = labels.join(lengths, ["conv_id", "depth"]).select("node", "depth", "conv_id").unionByName(at_root)
    keys = ["node", "depth"]
    blocks = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(
        _join_ids, "node long, depth long, first long, text string")
    return blocks.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(
        _hash_blocks, "conv_id long, depth long, ends_sha256 string")


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    """Rows of long columns and a last column of text."""
    kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _join_ids(batches):
    """Sorted (node, depth, id) rows to blocks of comma-joined ids."""
    names = ("node", "depth", "first", "text")
    key, first, ids, size, out, held = None, None, [], 0, [], 0
    for batch in batches:
        for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, depth) != key or size > BLOCK_CHARS:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                    held += size
                key, first, ids, size = (node, depth), conv, [], 0
                if held > BLOCK_CHARS or len(out) >= 10_000:
                    yield _table(out, names)
                    out, held = [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield _table([*out, (*key, first, ",".join(ids))], names)


def _hash_blocks(batches):
    """Blocks in the order of their nodes to one hash per node."""
    names = ("conv_id", "depth", "ends_sha256")
    key, state, out = None, None, []
    for batch in batches:
        for node, depth, _, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, depth) == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (node, depth), hashlib.sha256(text.encode())
        if len(out) >= 10_000:
            yield _table(out, names)
            out = []
    if key is not None:
        yield _table([*out, (*key, state.hexdigest())], names)
