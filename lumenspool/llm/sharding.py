"""Minimum-cost-flow resharding.

Rows lie in old shards; new shards have capacities in bytes. Groups of equal texts are never parted
unless one is larger than any shard's capacity. Blocks of groups (by text hash) are the units of
transfer: their byte sums, a table bounded by parameters (old shards x ``BLOCKS`` x ``SUBS``, and ``OWN_SUBS`` a large group), come
to the driver; an integer minimum-cost flow between old and new shards says how many bytes go where
at the least moved bytes; whole blocks then fill the flows. Rows get their shard by a broadcast of
that bounded table and a gapless slot by block offsets, so ``assign`` shuffles no text. Texts whose copies
take more than 1 / ``SHARE`` of a shard, fewer than ``SHARE`` a shard, are found by a group-by on the text's
hash and get blocks of their own, whose rows are dealt over ``OWN_SUBS`` sub-blocks by doc_id; other blocks
have ``SUBS`` sub-blocks by text. So no large group meets in one task, and only a group that no shard holds is parted.

``rewrite`` writes the shards that gain or lose rows, as folders, and leaves the other folders alone.

Defined cases: null text is empty (size 1, crc 0) and equal to an empty one; repeated rows and equal
ids each get their own slot; an empty table gives an empty table. Extra columns pass through
``assign`` as they are; names that clash with the added ones, or begin with ``_s_``, are refused.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Blocks of an old shard, sub-blocks of a block and of a large group's own block: they bound what the driver sees.
BLOCKS, SUBS, OWN_SUBS = 1024, 4, 256
#: Rows of a file that ``rewrite`` writes, about.
FILE_ROWS = 100_000
#: Parts of a shard: a larger group of equal texts has a block of its own.
SHARE = 64
ADDED = ("size", "text_crc32", "law", "old_shard", "shard", "slot", "grown_shard")


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Integer flows [old][new] that ship all supply within demand at least total cost.

    Successive shortest augmenting paths over the residual network, found by label correction.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # [to, room, cost]; edge e ^ 1 is the reverse of e
    out: dict[int, list[int]] = defaultdict(list)

    def add(a: int, b: int, room: int, price: int) -> int:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])
        return len(edges) - 2

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for j, d in enumerate(demand):
        add(n + j, sink, d, 0)
    at = [[add(i, n + j, supply[i], cost[i][j]) for j in range(m)] for i in range(n)]
    while True:
        far, came, queue = {source: 0}, {}, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                b, room, price = edges[e]
                if room and far[a] + price < far.get(b, 1 << 62):
                    far[b], came[b] = far[a] + price, e
                    queue.append(b)
        if sink not in far:
            break
        path, node = [], sink
        while node != source:
            path.append(came[node])
            node = edges[came[node] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return [[edges[at[i][j] ^ 1][1] for j in range(m)] for i in range(n)]


def plan(blocks: dict[tuple[int, int], int], subs: dict[tuple[int, int], dict[int, int]], n_old: int, n_new: int) -> dict[tuple[int, int, int], int]:
    """New shard of each (old shard, block, sub-block), from their byte sums."""
    total = sum(blocks.values())
    room = [total // n_new + (j < total % n_new) for j in range(n_new)]
    even, left = max(1, total // n_new), list(room)
    placed: dict[tuple[int, int, int], int] = {}
    rest: dict[tuple[int, int], int] = {}
    # Large blocks first: at home if they fit, else where most room is; parted only if no shard holds one.
    for (i, b), size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        if size * SHARE <= even:
            rest[i, b] = size
            continue
        j = i if i < n_new and left[i] >= size else max(range(n_new), key=lambda x: (left[x], -x))
        if left[j] >= size or size <= even:
            placed |= {(i, b, s): j for s in subs[i, b]}
            left[j] -= size
            continue
        for s, part in sorted(subs[i, b].items(), key=lambda x: (-x[1], x[0])):
            j = max(range(n_new), key=lambda x: (left[x], -x))
            placed[i, b, s] = j
            left[j] -= part
    supply = [0] * n_old
    for (i, _), size in rest.items():
        supply[i] += size
    over = sum(max(0, -x) for x in left)
    demand = [max(0, x) for x in left]
    while over > 0:  # what a parted group takes beyond one shard's room, the others give up evenly
        most = max(range(n_new), key=lambda x: demand[x])
        take = min(over, max(1, demand[most] // n_new), demand[most])
        demand[most] -= take
        over -= take
    flow = min_cost_flow(supply, demand, [[int(i != j) for j in range(n_new)] for i in range(n_old)])
    for (i, b), size in sorted(rest.items(), key=lambda x: (-x[1], x[0])):
        j = max(range(n_new), key=lambda x: (flow[i][x], -x))
        flow[i][j] -= size
        placed |= {(i, b, s): j for s in subs[i, b]}
    return placed


def assign(docs: DataFrame, n_shards: int = 8, old_shard: Column | None = None, n_old: int = 6) -> DataFrame:
    """docs with size, text_crc32, law, old_shard, shard, slot and grown_shard (null under this law).

    old_shard: where rows lie now, 0 .. n_old - 1, a function of the text; by default the layout
    that deals texts over ``n_old`` shards by crc32.
    """
    if clash := {c for c in docs.columns if c in ADDED or c.startswith("_s_")}:
        raise ValueError(f"columns clash with the result's: {sorted(clash)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = docs.withColumns({
        "size": F.octet_length(text).cast("long") + 1,
        "text_crc32": crc,
        "old_shard": (F.pmod(crc, F.lit(n_old)) if old_shard is None else old_shard).cast("int"),
        "_s_text": F.xxhash64(text),
    })
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("old_shard", "_s_text").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * SHARE * n_shards > total)
    large = sorted((g.old_shard, g._s_text) for g in groups.collect())
    own = docs.sparkSession.createDataFrame([(i, h, BLOCKS + k) for k, (i, h) in enumerate(large)], "old_shard int, _s_text long, _s_own int")
    rows = rows.join(F.broadcast(own), ["old_shard", "_s_text"], "left").withColumns({
        "_s_block": F.coalesce("_s_own", F.pmod("_s_text", F.lit(BLOCKS)).cast("int")),
        "_s_sub": F.when(F.col("_s_own").isNull(), F.pmod(F.xxhash64("_s_text", F.lit(7)), F.lit(SUBS))).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(OWN_SUBS))).cast("int"),
    })
    units = rows.groupBy("old_shard", "_s_block", "_s_sub").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    blocks: dict[tuple[int, int], int] = defaultdict(int)
    subs: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for u in units:
        blocks[u.old_shard, u._s_block] += u.bytes
        subs[u.old_shard, u._s_block][u._s_sub] = u.bytes
    placed = plan(blocks, subs, n_old, n_shards)
    taken, table = [0] * n_shards, []
    for u in sorted(units, key=lambda x: (x.old_shard, x._s_block, x._s_sub)):
        j = placed[u.old_shard, u._s_block, u._s_sub]
        table.append((u.old_shard, u._s_block, u._s_sub, j, taken[j]))
        taken[j] += u.n
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("old_shard", "_s_block", "_s_sub", "shard")] + [T.StructField("_s_base", T.LongType())])
    places = docs.sparkSession.createDataFrame(table, schema)
    # Units are dealt over about as many tasks as a shard has files, shard by shard, so that a task writes few files and rows move once.
    files = max(8, sum(taken) // n_shards // FILE_ROWS)
    rows = rows.join(F.broadcast(places), ["old_shard", "_s_block", "_s_sub"]).withColumn("_s_file", F.pmod(F.xxhash64("old_shard", "_s_block", "_s_sub"), F.lit(files)))
    unit = Window.partitionBy("shard", "_s_file", "old_shard", "_s_block", "_s_sub").orderBy("doc_id", "text_crc32")
    return (rows.repartition("shard", "_s_file").withColumn("_s_row", F.row_number().over(unit))
            .withColumns({"law": F.lit("bytes"), "slot": F.col("_s_base") + F.col("_s_row") - 1, "grown_shard": F.lit(None).cast("int")})
            .drop("_s_text", "_s_own", "_s_block", "_s_sub", "_s_base", "_s_row", "_s_file"))


def rewrite(docs: DataFrame, path: str, n_shards: int = 8, old_shard: Column | None = None, n_old: int = 6) -> DataFrame:
    """Writes the shards that gain or lose rows, as folders shard=k under path; folders of others stay as they are.

    docs is the whole table and must not lie under path. Returns old_shard, shard, moved_bytes, moved_rows.
    """
    root = path.split(":", 1)[-1].rstrip("/") + "/"
    if any(("/" + f.split(":", 1)[-1].lstrip("/")).startswith("/" + root.lstrip("/")) for f in docs.inputFiles()):
        raise ValueError(f"{path} holds rows that are to be read; write to another folder")
    out = assign(docs, n_shards, old_shard, n_old)
    moves = out.where("old_shard <> shard").groupBy("old_shard", "shard").agg(F.sum("size").alias("moved_bytes"), F.count(F.lit(1)).alias("moved_rows"))
    moved = moves.collect()  # at most n_old x n_shards rows
    touched = sorted({k for m in moved for k in (m.old_shard, m.shard)})
    out.where(F.col("shard").isin(touched)).write.partitionBy("shard").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return docs.sparkSession.createDataFrame(moved, "old_shard int, shard int, moved_bytes long, moved_rows long")
