"""Sharding by minimum-cost flow: from the sizes of old shards to new capacities, moving the fewest bytes.

A layout is a folder of rows in files by shard and block; a block holds about ``block_bytes``. ``reshard``
gives every new shard the same capacity, sends the bytes of each old shard along a minimum-cost flow (a byte
that stays costs nothing, one that moves costs what ``cost`` says) and lays the flow along each
shard's line of blocks. A block inside one piece of the flow stays or goes whole; only blocks across a cut are
dealt out by row. Only the files of blocks that move or are cut are written anew, as one more generation;
files of blocks that stay are listed as they are. The list of blocks is written last, so a job that dies
leaves the layout before it in force; files it no longer lists stay for those who still read that one.

The driver solves a flow over old and new shards, and places one by one: rows larger than an even
share (fewer than there are shards) and rows that lie across a cut (at most one per cut). All else is
tables.

Defined results: a null text has no bytes; rows are told apart by numbers of their own, so ids may repeat or be
null; columns are kept in a struct, so no name clashes; an empty table has an empty layout, and more
shards than rows leave some empty.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCKS_PER_SHARD = 8
MOST_BLOCK_BYTES = 128 << 20
ROW_BYTES = 16


def fewest_bytes_moved(
    supply: list[int], room: list[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)
) -> dict[tuple[int, int], int]:
    """What goes from each old shard to each new one, at the least cost; ``room`` must hold all.

    Successive shortest paths: each one fills an arc, and a later one may take back what an earlier one sent.
    """
    if sum(room) < sum(supply):
        raise ValueError("the new shards are too small")
    n, m = len(supply), len(room)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    left, free, flow = list(supply), list(room), [[0] * m for _ in range(n)]
    while any(left):
        far = [0 if left[i] else None for i in range(n)] + [None] * m
        came: list = [None] * (n + m)
        waiting, queued = deque(i for i in range(n) if left[i]), [bool(left[i]) for i in range(n)] + [False] * m
        while waiting:
            v = waiting.popleft()
            queued[v] = False
            steps = (
                ((n + j, price[v][j]) for j in range(m))
                if v < n
                else ((i, -price[i][v - n]) for i in range(n) if flow[i][v - n])
            )
            for u, p in steps:
                if far[u] is None or far[v] + p < far[u]:
                    far[u], came[u] = far[v] + p, v
                    if not queued[u]:
                        queued[u] = True
                        waiting.append(u)
        end = min((j for j in range(m) if free[j]), key=lambda j: far[n + j])
        path, v = [], n + end
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        amount = min([left[v], free[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        free[end] -= amount
    return {(i, j): flow[i][j] for i in range(n) for j in range(m) if flow[i][j]}


def even_capacities(total: int, taken: list[int]) -> list[int]:
    """Room of each shard so that all end at one level: ``total`` more bytes go on top of what is ``taken``."""
    level, used, shares = 0, 0, len(taken)
    for k, size in enumerate(sorted(taken)):
        used += size
        level = (total + used) // (k + 1)
        shares = k + 1
        if k + 1 < len(taken) and level <= sorted(taken)[k + 1]:
            break
    lowest = sorted(range(len(taken)), key=lambda j: (taken[j], j))[:shares]
    room = [0] * len(taken)
    for j in lowest:
        room[j] = max(0, level - taken[j])
    for k in range(total - sum(room)):
        room[lowest[k % shares]] += 1
    return room


def _weighed(docs: DataFrame, shard: Column, text: str) -> DataFrame:
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        shard.cast("int").alias("shard"),
        F.monotonically_increasing_id().alias("row"),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
    )


def lay_out(docs: DataFrame, folder: str, shard: Column, shards: int, text: str = "text") -> None:
    """Write the first layout: ``shard`` tells each row's shard, 0 to ``shards`` - 1.

    Rows are dealt to a shard's blocks by a hash of their own number, so equal rows and equal keys spread.
    """
    spark = docs.sparkSession
    rows = _weighed(docs, shard, text)
    sizes = dict(rows.groupBy("shard").agg(F.sum("size")).collect())
    each = max(1, min(MOST_BLOCK_BYTES, sum(sizes.values()) // (shards * BLOCKS_PER_SHARD)))
    blocks = spark.createDataFrame([(s, -(-n // each)) for s, n in sizes.items()], "shard int, blocks long")
    rows = rows.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).drop("blocks")
    _write(rows, f"{folder}/gen=0", ["shard", "block"], W.partitionBy("shard", "block").orderBy(F.desc("size"), "row"))
    listed = spark.read.schema(_schema(rows, "shard integer, block long, place long")).parquet(f"{folder}/gen=0")
    listed = listed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    listed = listed.select("shard", F.lit(0).alias("gen"), F.col("shard").alias("origin"), "block", "rows", "bytes")
    listed.write.parquet(f"{folder}/blocks=0")


def _schema(rows: DataFrame, more: str):
    kept = rows.select("doc", "row", "size").schema
    for part in more.split(", "):
        kept = kept.add(*part.split(" "))
    return kept


def _write(rows: DataFrame, folder: str, files: list[str], order) -> None:
    """Write the rows with their ``place`` in their block, one file per block."""
    placed = rows.withColumn("place", F.row_number().over(order).cast("long") - 1)
    placed.repartition(*files).sortWithinPartitions(*files, "place").write.partitionBy(*files).parquet(folder)


def _latest(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks=*/_SUCCESS")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return max(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _blocks(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("shard int, gen int, origin int, block long, rows long, bytes long").parquet(f"{folder}/blocks={version}")


def _stored(spark: SparkSession, folder: str, version: int, docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of all files of the blocks listed: ``doc``, ``row``, ``size``, ``place`` and what the list says of their block.

    A block is listed in one row and holds up to 128 MB, so the list is broadcast; it prunes the folders read.
    """
    key = ["shard", "gen", "origin", "block"]
    rows = None
    for gen in range(version + 1):
        where = f"{folder}/gen={gen}"
        if gen == 0:
            part = spark.read.schema(_schema(docs, "shard integer, block long, place long")).parquet(where)
            part = part.withColumn("origin", F.col("shard"))
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(where)
            if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
                continue
            part = spark.read.schema(_schema(docs, "shard integer, origin integer, block long, place long")).parquet(where)
        part = part.withColumn("gen", F.lit(gen)).select(*key, "doc", "row", "size", "place")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(F.broadcast(listed), key)


def _empty_layout(docs: DataFrame) -> DataFrame:
    return _weighed(docs, F.lit(0), docs.columns[0]).where("false")


def _cuts(flow: dict, kept: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, from, to, new shard): the flow laid along each old shard's bytes, what stays first."""
    pieces = []
    for i in range(len(kept)):
        at = 0
        for j, amount in sorted(((j, n) for (o, j), n in flow.items() if o == i), key=lambda p: (p[0] != i, p[0])):
            pieces.append((i, at, at + amount, j))
            at += amount
    return pieces


def _place_giants(giants: list, shards: int) -> tuple[dict[int, int], list[int]]:
    """Rows larger than an even share: each stays in its shard if it's the first there, else goes where least is."""
    taken, place = [0] * shards, {}
    for row in sorted(giants, key=lambda g: (-g["size"], g["row"])):
        home = row["shard"]
        to = home if home < shards and not taken[home] else min(range(shards), key=lambda j: (taken[j], j))
        taken[to] += row["size"]
        place[row["row"]] = to
    return place, taken


def reshard(
    spark: SparkSession, folder: str, docs: DataFrame, shards: int, cost: Callable[[int, int], int] = lambda i, j: int(i != j)
) -> dict:
    """Bring a layout to ``shards`` shards of near equal bytes; ``docs`` has the rows' columns. Returns what was moved.

    After it, two shards differ by about the size of a small row, or as much as rows larger than an even share force.
    """
    version = _latest(spark, folder)
    shape = _empty_layout(docs)
    blocks = _blocks(spark, folder, version)
    key = ["shard", "gen", "origin", "block"]
    sizes = dict(blocks.groupBy("shard").agg(F.sum("bytes")).collect())
    total = sum(sizes.values())
    old = max([shards, *(s + 1 for s in sizes)])
    stored = _stored(spark, folder, version, shape, blocks.select(*key))

    giants = stored.where(F.col("size") > total // shards).select("row", "size", *key).collect()  # fewer than shards
    place, taken = _place_giants(giants, shards)
    supply = [sizes.get(s, 0) for s in range(old)]
    of_giants: dict = {}
    for g in giants:
        supply[g["shard"]] -= g["size"]
        of_giants[tuple(g[k] for k in key)] = of_giants.get(tuple(g[k] for k in key), 0) + g["size"]
    flow = fewest_bytes_moved(supply, even_capacities(sum(supply), taken), cost)
    kind = "shard int, gen int, origin int, block long"
    minus = spark.createDataFrame([(*k, n) for k, n in of_giants.items()], f"{kind}, big long")
    pieces = spark.createDataFrame(_cuts(flow, supply), "shard int, lo long, hi long, target int")

    line = W.partitionBy("shard").orderBy("gen", "origin", "block").rowsBetween(W.unboundedPreceding, -1)
    lined = blocks.join(F.broadcast(minus), key, "left").withColumn("big", F.coalesce("big", F.lit(0).cast("long")))
    lined = lined.withColumn("own", F.col("bytes") - F.col("big"))
    lined = lined.withColumn("before", F.coalesce(F.sum("own").over(line), F.lit(0)))
    met = lined.join(F.broadcast(pieces), "shard").where("own > 0 AND before < hi AND before + own > lo")
    fate = met.groupBy(*key, "before", "big", "rows", "bytes").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "target"))).alias("pieces")
    )
    whole = (F.size("pieces") == 1) & (F.col("big") == 0)
    stays = whole & (F.col("pieces")[0]["target"] == F.col("shard"))
    untouched = fate.where(stays).select(*key, "rows", "bytes")

    big = spark.createDataFrame([(r, j) for r, j in place.items()], "row long, giant int")
    only_giants = lined.where("own = 0").select(*key, "before", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint,target:int>>)").alias("pieces"))
    touched = fate.where(~stays).select(*key, "before", "pieces").unionByName(only_giants)
    moving = _stored(spark, folder, version, shape, touched).join(F.broadcast(big), "row", "left")
    inside = W.partitionBy(*key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    own = F.when(F.col("giant").isNull(), F.col("size")).otherwise(0)
    moving = moving.withColumn("start", F.col("before") + F.coalesce(F.sum(own).over(inside), F.lit(0)))
    holds = F.filter("pieces", lambda p: (p["lo"] <= F.col("start")) & (p["hi"] >= F.col("start") + F.col("size")))
    moving = moving.withColumn("target", F.coalesce("giant", F.get(holds, F.lit(0))["target"]))

    slim = moving.select("row", "size", "shard", "target")
    loose = slim.where("target IS NULL").collect()  # at most one per cut
    now = dict(slim.where("target IS NOT NULL").groupBy("target").agg(F.sum("size")).collect())
    stay = dict(untouched.groupBy("shard").agg(F.sum("bytes")).collect())
    full = [now.get(j, 0) + stay.get(j, 0) for j in range(shards)]
    last = []
    for row in sorted(loose, key=lambda r: (-r["size"], r["row"])):
        to = min(range(shards), key=lambda j: (full[j], j != row["shard"], j))
        full[to] += row["size"]
        last.append((row["row"], to))
    loose_to = F.broadcast(spark.createDataFrame(last, "row long, last int"))
    moving = moving.join(loose_to, "row", "left").withColumn("target", F.coalesce("target", "last"))
    out = moving.select(
        "doc", "row", "size", F.col("place").alias("old_place"), F.col("shard").alias("origin"),
        (F.col("block") * (version + 1) + F.col("gen")).alias("block"), F.col("target").alias("shard"),
    )
    files = ["shard", "origin", "block"]
    gen = version + 1
    _write(out, f"{folder}/gen={gen}", files, W.partitionBy(*files).orderBy("old_place", "row"))
    fresh = spark.read.schema(_schema(shape, "shard integer, origin integer, block long, place long")).parquet(f"{folder}/gen={gen}")
    fresh = fresh.groupBy(*files).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    names = [*key, "rows", "bytes"]
    listed = untouched.select(*names).unionByName(fresh.withColumn("gen", F.lit(gen)).select(*names))
    listed.write.parquet(f"{folder}/blocks={gen}")
    changed = moving.where(F.col("target") != F.col("shard")).agg(F.sum("size")).first()[0]
    return {"bytes": total, "moved": changed or 0, "planned": sum(n for (i, j), n in flow.items() if i != j), "largest": full}


def read_layout(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """The rows of the layout in force: ``doc``, ``row``, ``size``, ``shard`` and ``slot``, gapless from 0 in each shard."""
    version = _latest(spark, folder)
    key = ["shard", "gen", "origin", "block"]
    line = W.partitionBy("shard").orderBy("gen", "origin", "block").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(line), F.lit(0)).alias("before")
    starts = _blocks(spark, folder, version).select(*key, before)
    rows = _stored(spark, folder, version, _empty_layout(docs), starts)
    return rows.select("doc", "row", "size", "shard", (F.col("before") + F.col("place")).alias("slot"))
