"""Conversations as a trie of their prefixes, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. Its key is the exclusive-or of 128 bits hashed from each
turn's place and SHA-256, so that prefixes of one very long conversation are keyed range by range.

Subtree totals come from the centroid decomposition of the forest of parent edges. A component is named
after its top. Its centroid is the deepest node whose subtree weighs more than half of it; the nodes that
do so are just the path from the top to the centroid. What the component holds in the centroid's subtree
is added to every node of that path, then the centroid is taken out: each of its children is the top of a
component, the rest another one, and each weighs half at most. A node and one that lies below it are
parted by exactly one centroid on the path between them, so every pair is counted once. Weights are known
before: a node weighs as many as its members, a subtree the turns that its members still have to go.

Components over a limit are split all together, one round for each halving; there are no more of
them than the total weight holds that limit, so one row of each is broadcast. Which child of the centroid a
node lies under is looked up by a member's turn of that depth. All smaller components fit a task
each and are split there to the end.

Defined results: rows without a conversation's number belong to none and are left out; a null role or
text is empty; turns are in the order of their numbers, null first, then of the SHA-256 of role and text,
so repeated turns count each; an empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.running import running
from duebook.llm.scratch import Scratch

A_WORD = r"[^\x20\x09-\x0D]+"
#: Components up to a 4096th of the forest's weight are split within a task, but at least and at most so heavy.
LARGE_AT_ONCE, LEAST_IN_TASK, MOST_IN_TASK = 1 << 12, 1 << 10, 1 << 17
IDS_AT_ONCE = 1 << 13


def numbered_turns(
    rows: DataFrame, scratch: Scratch, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id``, ``place`` (from 0), ``digest`` and ``words`` of every turn."""
    who, what = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    said = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what)
    slim = rows.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.sha2(said, 256)).alias("digest"),
        F.regexp_count(what, F.lit(A_WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    slim = scratch.put(slim, "turns")
    placed = running(slim, ["conv_id"], ["turn", "digest", "row"], {"place": ("sum", F.lit(1).cast("long"))}, scratch, "turn-ranges")
    return scratch.put(placed.select("conv_id", "place", "digest", "words"), "numbered")


def rebuilt(turns: DataFrame, scratch: Scratch, every: int = 20, kinds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each conversation opens like the first one of its ``every``.

    Conversation c takes the first h = crc32(c) mod ``kinds`` turns of c - c % ``every``, then its own after its first h.
    """
    number = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumns({"h": F.crc32(number.cast("string").cast("binary")) % kinds, "base": number - number % every})
    opening = own.select(number.alias("base"), F.col("n").alias("n_base"))
    convs = own.join(opening, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.put(convs.select("conv_id", "h", "base", "taken", "length"), "conversations")
    heads = turns.where(F.col("place") < kinds - 1).withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").where("place < taken").withColumn("depth", F.col("place") + 1)
    rest = turns.join(convs, "conv_id").where("place >= h").withColumn("depth", F.expr("place - h + taken + 1"))
    names = ["conv_id", "length", "depth", "digest", "words"]
    return scratch.put(first.select(*names).union(rest.select(*names)), "rebuilt"), convs.select("conv_id", "length")


def _members(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Every conversation's row at every depth, with the key of its prefix (``a``, ``b``) and of the one before (``pa``, ``pb``)."""
    lanes = {n: F.xxhash64(F.lit(k), "depth", "digest") for k, n in enumerate(("ta", "tb"))}
    rows = turns.select("conv_id", "length", "depth", "words", *(c.alias(n) for n, c in lanes.items()))
    prefixes = {"pa": ("bit_xor", F.col("ta")), "pb": ("bit_xor", F.col("tb"))}
    found = running(rows, ["conv_id"], ["depth"], prefixes, scratch, "prefix-ranges")
    found = found.withColumns({"a": F.col("pa").bitwiseXOR(F.col("ta")), "b": F.col("pb").bitwiseXOR(F.col("tb"))})
    return scratch.put(found.drop("ta", "tb"), "members")


def _nodes(members: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node with its parent's number and smallest member; ``weight`` is its subtree's."""
    to_go = F.col("length") - F.col("depth") + 1
    below = members.groupBy("depth", "a", "b").agg(
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("words").alias("words"),
        F.sum(to_go).alias("weight"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = convs.groupBy().agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")
    )
    top = top.where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"),
        "conv_id", "n_convs", zero.alias("words"), "weight",
    )
    nodes = scratch.put(below.unionByName(top).withColumn("node", F.monotonically_increasing_id()), "nodes")
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    return scratch.put(nodes.join(above, ["depth", "pa", "pb"], "left").drop("pa", "pb"), "linked")


def _ends(members: DataFrame, convs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and the SHA-256 of the numbers of the conversations that end there, joined by commas.

    Numbers are joined in sorted ranges first, so the one task that must read a node's list from its first
    byte to its last (a hash goes no other way) gets strings of thousands of numbers, one at a time.
    """
    ends = members.where("depth = length").select("conv_id", "depth", "a", "b")
    zero = F.lit(0).cast("long")
    ends = ends.union(convs.where("length = 0").select("conv_id", zero, zero, zero))
    ends = scratch.put(ends.join(nodes.select("depth", "a", "b", "node"), ["depth", "a", "b"]).select("node", "conv_id"), "ends")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, node = batch["conv_id"].to_numpy(), batch["node"].to_numpy()
            starts = np.flatnonzero(np.diff(node, prepend=node[0] - 1)) if len(node) else np.empty(0, np.int64)
            out = []
            for start, stop in zip(starts, [*starts[1:], len(node)], strict=True):
                for at in range(start, stop, IDS_AT_ONCE):
                    part = ids[at : min(stop, at + IDS_AT_ONCE)]
                    out.append((node[start], part[0], ",".join(map(str, part.tolist()))))
            yield pd.DataFrame(out, columns=["node", "first", "numbers"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for batch in batches:
            out = []
            for node, numbers in zip(batch["node"].tolist(), batch["numbers"].tolist(), strict=True):
                if node != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(numbers.encode())
                else:
                    digest.update(b"," + numbers.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["node", "ends_sha256"])

    parts = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    parts = scratch.put(parts.mapInPandas(joined, "node long, first long, numbers string"), "end-lists")
    parts = parts.repartition("node").sortWithinPartitions("node", "first")
    return parts.mapInPandas(hashed, "node long, ends_sha256 string")


def split_components(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over every node's subtree, by centroid decomposition of a forest held in memory.

    ``parent`` holds places in the arrays, -1 for tops; ``weight`` is that of a node's subtree. All components
    are split together, so there are as many rounds as the heaviest component can be halved.
    """
    n = len(parent)
    start, free, label = np.zeros(n, np.int64), [0] * n, np.arange(n)
    weights, parents, beyond = weight.tolist(), parent.tolist(), 0
    for v in np.argsort(depth, kind="stable").tolist():  # parents first: a subtree's nodes get places in one run
        p = parents[v]
        if p < 0:
            at, beyond = beyond, beyond + weights[v]
        else:
            at = free[p]
            free[p] = at + weights[v]
            label[v] = label[p]
        start[v], free[v] = at, at + 1
    stop, weight = start + weight, weight.copy()
    total, alive = np.zeros_like(values), np.arange(n)
    while len(alive):
        alive = alive[np.lexsort((start[alive], label[alive]))]
        first = np.flatnonzero(np.diff(label[alive], prepend=-1))  # the tops
        group = np.repeat(np.arange(len(first)), np.diff(first, append=len(alive)))
        on_path = 2 * weight[alive] > weight[alive[first]][group]
        path = np.flatnonzero(on_path)
        centroids = alive[path[np.flatnonzero(np.diff(group[path], append=-1))]]  # the last one of each path
        c = centroids[group]
        below = (start[alive] > start[c]) & (start[alive] < stop[c])
        inside = np.where((below | (alive == c))[:, None], values[alive], 0)
        total[alive[path]] += np.add.reduceat(inside, first)[group[path]]
        weight[alive[path]] -= weight[centroids][group[path]]
        child = np.maximum.accumulate(np.where(below & (parent[alive] == c), np.arange(len(alive)), 0))
        label[alive[below]] = alive[child[below]]
        alive = alive[alive != c]
    return total


def _split_in_tasks(state: DataFrame, in_one_task: int) -> DataFrame:
    """Components of at most ``in_one_task`` split to the end; several small ones are taken together."""

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows["node"].to_numpy()
        order = np.argsort(nodes)
        up = rows["parent"].fillna(-1).to_numpy(np.int64)
        at = order[np.minimum(np.searchsorted(nodes, up, sorter=order), len(nodes) - 1)]
        component = rows["component"].to_numpy()
        parent = np.where((nodes[at] == up) & (component[at] == component) & (component != nodes), at, -1)
        sums = split_components(
            parent, rows["depth"].to_numpy(), rows["weight"].to_numpy(), rows[["leaves", "tokens"]].to_numpy(np.int64)
        )
        return pd.DataFrame(
            {"node": nodes, "n_leaves": rows["n_leaves"] + sums[:, 0], "saved_tokens": rows["saved_tokens"] + sums[:, 1]}
        )

    def by_component(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) > 2 * in_one_task:
                rows = pd.concat(held, ignore_index=True)
                last = rows["component"] == rows["component"].iloc[-1]
                if not last.all():
                    yield solved(rows[~last].reset_index(drop=True))
                held = [rows[last]]
        if held:
            yield solved(pd.concat(held, ignore_index=True))

    return state.repartition("component").sortWithinPartitions("component").mapInPandas(
        by_component, "node long, n_leaves long, saved_tokens long"
    )


def rollup(nodes: DataFrame, members: DataFrame, scratch: Scratch, in_one_task: int | None = None) -> DataFrame:
    """``node``, ``n_leaves`` and ``saved_tokens``, both summed over the node's subtree."""
    zero = F.lit(0).cast("long")
    top = nodes.where("parent IS NULL").select("node", "weight").first()
    if in_one_task is None:
        in_one_task = min(MOST_IN_TASK, max(LEAST_IN_TASK, (top["weight"] if top else 0) // LARGE_AT_ONCE))
    component = F.lit(None if top is None else top["node"]).cast("long")
    state = nodes.select(
        "node", "parent", "conv_id", "depth", "weight", "leaves", "tokens",
        component.alias("component"), zero.alias("n_leaves"), zero.alias("saved_tokens"),
    )
    state = scratch.put(state, "state")  # a column now, no constant that would turn joins on it into cross joins
    index, small, level = None, [], 0
    while True:
        sizes = state.where("component IS NOT NULL").groupBy("component").agg(F.max("weight").alias("whole"))
        large = scratch.put(sizes.where(F.col("whole") > in_one_task), f"large-{level}")
        if large.isEmpty():
            small.append(state)
            break
        if index is None:
            index = scratch.put(
                members.join(nodes.select("depth", "a", "b", "node", "parent"), ["depth", "a", "b"]).select(
                    "conv_id", F.col("depth").alias("under"), F.col("node").alias("child"), F.col("parent").alias("child_of")
                ),
                "ancestors",
            )
        small.append(state.join(F.broadcast(large.select("component")), "component", "left_anti").select(*state.columns))
        state = scratch.put(_split_large(state, F.broadcast(large), index, scratch, level), f"state-{level}")
        level += 1
    rows = small[0]
    for part in small[1:]:
        rows = rows.unionByName(part)
    done = rows.where("component IS NULL").select("node", "n_leaves", "saved_tokens")
    return done.unionByName(_split_in_tasks(rows.where("component IS NOT NULL"), in_one_task))


def _split_large(state: DataFrame, large: DataFrame, index: DataFrame, scratch: Scratch, level: int) -> DataFrame:
    """One round: every component listed in ``large`` loses its centroid. ``index`` tells a conversation's node at each depth."""
    rows = state.join(large, "component").withColumn("on_path", 2 * F.col("weight") > F.col("whole"))
    found = rows.where("on_path").groupBy("component").agg(
        F.max_by(F.struct("node", "depth", "weight"), "depth").alias("c")
    )
    centroids = scratch.put(found.select("component", *(F.col(f"c.{n}").alias(f"c_{n}") for n in ("node", "depth", "weight"))), f"centroids-{level}")
    rows = rows.join(F.broadcast(centroids), "component").withColumn("under", F.col("c_depth") + 1)
    deep = rows.where("depth > c_depth").join(index, ["conv_id", "under"])
    inside = F.col("child_of") == F.col("c_node")
    names = [*rows.columns, "child"]
    deep = deep.withColumn("child", F.when(inside, F.col("child"))).select(*names)
    flat = rows.where("depth <= c_depth").withColumn("child", F.lit(None).cast("long")).select(*names)
    rows = scratch.put(deep.unionByName(flat), f"parted-{level}")
    in_centroid = F.col("child").isNotNull() | (F.col("node") == F.col("c_node"))
    totals = rows.where(in_centroid).groupBy("component").agg(
        F.sum("leaves").alias("t_leaves"), F.sum("tokens").alias("t_tokens")
    )
    rows = rows.join(F.broadcast(scratch.put(totals, f"totals-{level}")), "component")
    add = lambda c, t: F.when(F.col("on_path"), F.col(c) + F.col(t)).otherwise(F.col(c))
    return rows.select(
        "node", "parent", "conv_id", "depth",
        F.when(F.col("on_path"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"),
        "leaves", "tokens",
        F.when(F.col("node") != F.col("c_node"), F.coalesce("child", "component")).alias("component"),
        add("n_leaves", "t_leaves").alias("n_leaves"),
        add("saved_tokens", "t_tokens").alias("saved_tokens"),
    ).select(*state.columns)


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch, in_one_task: int | None = None) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, length, depth from 1, digest, words) of ``convs`` (conv_id, length).

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's, ``saved_tokens`` the words that
    need not be computed again where members share the node, summed over its subtree, ``ends_sha256`` that of the
    numbers of the members that end there.
    """
    members = _members(turns, scratch)
    nodes = _nodes(members, convs, scratch)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").na.fill(0, ["n_children"]).withColumns(
        {
            "leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"),
            "tokens": (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    nodes = scratch.put(nodes, "valued")
    sums = rollup(nodes, members, scratch, in_one_task)
    ends = _ends(members, convs, nodes, scratch)
    rows = nodes.join(sums, "node").join(ends, "node", "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
