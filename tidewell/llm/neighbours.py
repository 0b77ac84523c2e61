"""Approximate nearest neighbours by a forest of random-projection trees.

Largest inner product is turned into smallest distance by one more coordinate, which makes
all candidates equally long. Trees split at medians of random projections of a bounded
sample; every vector is then indexed. A query searches all trees through one priority
queue, ordered by how far it lies beyond the splits, until the leaves it has opened hold
`share` of an average tree's rows per tree. Leaf candidates are ranked exactly, in double precision.

Vectors without structure, such as independent random ones, leave a tree nothing to prune:
there most rows must be opened for a recall of 0.9, hence the default share. Clustered
vectors do with far less.

Edge cases. Vectors that are null, empty, zero, of another length than most, or that hold a
null or non-finite component take no part. Equal vectors form one class, searched once; of
each class only the smallest ids that could reach a list are carried, which loses nothing,
as they tie. Repeated ids are rows of their own. Rows without an id are candidates and rank
behind those they tie with. Fewer candidates than k: all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.ordered import newest
from tidewell.session import materialise

TREES, LEAF_ROWS, SAMPLE_ROWS, SHARE = 2, 2048, 16_384, 0.62
#: Queries that meet in one cell of leaves, at most.
QUERY_ROWS = 65_536
#: Neighbouring leaves that one task ranks together, at most; a query holds a bit for each.
CELL_LEAVES = 62


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vec) that can be compared."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(sizes.select("n")), F.size("vec") == F.col("n"), "left_semi")


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], 1)


def grow_trees(sample: np.ndarray, leaves: int, trees: int, seed: int) -> list[list[tuple]]:
    """Nodes (direction, split, low child, high child), or (leaf number,)."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        nodes: list[tuple] = []
        count = 0

        def grow(points: np.ndarray, want: int, nodes: list[tuple] = nodes) -> int:
            nonlocal count
            me = len(nodes)
            nodes.append(())
            if want > 1 and len(points) > 1:
                direction = rng.normal(size=points.shape[1])
                direction /= np.linalg.norm(direction)
                along = points @ direction
                split = float(np.median(along))
                low = along <= split
                if 0 < low.sum() < len(points):
                    nodes[me] = (direction, split, grow(points[low], want // 2), grow(points[~low], want - want // 2))
                    return me
            nodes[me] = (count,)
            count += 1
            return me

        grow(sample, leaves)
        forest.append(nodes)
    return forest


def leaf_of(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int32)

    def visit(node: int, at: np.ndarray) -> None:
        if not len(at):
            return
        if len(nodes[node]) == 1:
            out[at] = nodes[node][0]
            return
        direction, split, low, high = nodes[node]
        side = x[at] @ direction <= split
        visit(low, at[side])
        visit(high, at[~side])

    visit(0, np.arange(len(x)))
    return out


def beyond_splits(forest: list[list[tuple]], queries: np.ndarray) -> list[np.ndarray]:
    """Per tree, how far each query lies above the split of each node; 0 at leaves."""
    out = []
    for nodes in forest:
        inner = [i for i, parts in enumerate(nodes) if len(parts) > 1]
        far = np.zeros((len(queries), len(nodes)))
        if inner:
            far[:, inner] = queries @ np.array([nodes[i][0] for i in inner]).T - np.array([nodes[i][1] for i in inner])
        out.append(far)
    return out


def open_leaves(forest: list[list[tuple]], beyond: list[list[float]], pops: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order the shared queue yields them, from a query's row of `beyond_splits`."""
    queue, found = [(0.0, t, 0) for t in range(len(forest))], []
    while queue and len(found) < pops:
        far, tree, node = heapq.heappop(queue)
        parts = forest[tree][node]
        if len(parts) == 1:
            found.append((tree, parts[0]))
            continue
        past = beyond[tree][node]
        near, other = (parts[2], parts[3]) if past <= 0 else (parts[3], parts[2])
        heapq.heappush(queue, (far, tree, near))
        heapq.heappush(queue, (far + past * past, tree, other))
    return found


def best_of_leaves(q: np.ndarray, opened: np.ndarray, leaves: list[tuple[int, np.ndarray, np.ndarray]], m: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, class, score) of the `m` best classes of each query in the leaves it has opened.

    opened: a bit per leaf. leaves: (bit, vectors, classes). What a leaf adds must reach the
    m-th score so far, so later leaves keep few rows.
    """
    # All that tie with the last one, up to the rounding of a sum of products, are ranked again.
    slack = 4 * q.shape[1] * np.finfo(float).eps * most * np.linalg.norm(q, axis=1) if len(q) else np.zeros(0)
    floor = np.full(len(q), -np.inf)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    kept, pending = [empty], 0

    def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, cid, score = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((cid, -score, who))
        who, cid, score = who[order], cid[order], score[order]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, int)
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        last = place == m - 1
        floor[who[last]] = score[last]
        return tuple(x[place < m] for x in (who, cid, score))

    for bit, c, own in leaves:
        asking = np.flatnonzero(opened >> bit & 1)
        for i in range(0, len(asking), 512):
            who = asking[i : i + 512]
            part = q[who] @ c.T
            least = floor[who]
            fresh = least == -np.inf
            if len(own) > m and fresh.any():
                least[fresh] = np.partition(part[fresh], len(own) - m, axis=1)[:, len(own) - m]
            r, at = np.nonzero(part >= (least - slack[who])[:, None])
            kept.append((who[r], own[at], (c[at] * q[who[r]]).sum(1)))
            pending += len(r)
        if pending > max(len(kept[0][0]), 1 << 16):
            kept, pending = [cut()], 0
    return cut()


def leaves_of_cell(leaves: int, cores: int) -> int:
    """Leaves that share a cell, so that some two cells a core hold all of them.

    Each cell lists its best for a query, so what the cells let out for one query stays the
    same while the cells grow, and does not follow the number of leaves.
    """
    return min(CELL_LEAVES, max(1, -(-leaves // (2 * cores))))


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, leaf_rows: int = LEAF_ROWS, share: float = SHARE, seed: int = 17
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each query row."""
    rows = materialise(usable(vectors))
    by_vec = W.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last())
    firsts = rows.withColumn("_n", F.row_number().over(by_vec)).where(F.col("_n") <= k + 1)
    ids = F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("no"), F.col("vec_id").alias("v"))))
    # A class without any id takes a number from the far end; the table is written, so it stays.
    cid = F.coalesce(F.min("vec_id"), F.lit((1 << 63) - 1) - F.monotonically_increasing_id())
    asked = rows.where(is_query).groupBy("vec").agg(F.lit(True).alias("asked"))
    classes = materialise(
        firsts.groupBy("vec").agg(ids.alias("ids"), cid.alias("cid")).join(asked, "vec", "left").select("cid", "ids", "vec", F.coalesce("asked", F.lit(False)).alias("asked"))
    )
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    total, queries, most = classes.agg(F.count("*"), F.count_if("asked"), F.sqrt(F.max(norm))).first()
    most = most or 0.0
    leaves = int(max(1, -(-total // leaf_rows)))
    sample = classes.orderBy(F.xxhash64(F.lit(seed), F.col("cid"))).limit(SAMPLE_ROWS).select("vec").collect()
    points = np.array([r[0] for r in sample], float) if sample else np.zeros((0, 1))
    forest = grow_trees(_lift(points, most), leaves, trees, seed)
    pops = int(np.ceil(share * sum(len(n) == 1 for nodes in forest for n in nodes)))
    groups = max(1, -(-queries // QUERY_ROWS))

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    per_cell = leaves_of_cell(trees * leaves, vectors.sparkSession.sparkContext.defaultParallelism)
    schema = "tree int, cell int, part int, query boolean, leaves long, cid long, vec array<double>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cid, asks = matrix(batch.column("vec")), batch.column("cid").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            out = []
            high = _lift(x, most)
            for tree, nodes in enumerate(forest):
                cell, leaf = np.divmod(leaf_of(nodes, high), per_cell)
                out += [(np.full(len(x), tree), cell, np.full(len(x), part), np.zeros(len(x), bool), leaf, np.arange(len(x))) for part in range(groups)]
            asking = np.flatnonzero(asks)
            for s in range(0, len(asking), 1024):
                who = asking[s : s + 1024]
                beyond = [far.tolist() for far in beyond_splits(forest, np.concatenate([x[who], np.zeros((len(who), 1))], 1))]
                for j, i in enumerate(who.tolist()):
                    # A query goes once to a cell, with a bit per leaf it opens there.
                    bits: dict[tuple[int, int], int] = {}
                    for tree, leaf in open_leaves(forest, [far[j] for far in beyond], pops):
                        key = (tree, leaf // per_cell)
                        bits[key] = bits.get(key, 0) | 1 << leaf % per_cell
                    n, to = len(bits), np.array(list(bits)).reshape(-1, 2)
                    out.append((to[:, 0], to[:, 1], np.full(n, cid[i] // 7 % groups), np.ones(n, bool), np.array(list(bits.values())), np.full(n, i)))
            tree, cell, part, query, leaf, at = (np.concatenate([o[j] for o in out]) for j in range(6))
            for s in range(0, len(at), 8192):
                p = slice(s, s + 8192)
                ints = [pa.array(c[p].astype(np.int32)) for c in (tree, cell, part)]
                yield pa.record_batch(
                    [*ints, pa.array(query[p]), pa.array(leaf[p].astype(np.int64)), pa.array(cid[at[p]]), batch.column("vec").take(pa.array(at[p]))],
                    names=["tree", "cell", "part", "query", "leaves", "cid", "vec"],
                )

    def rank(table: pa.Table) -> pa.Table:
        asking = table.column("query").to_numpy()
        x, cid, leaf = matrix(table.column("vec")), table.column("cid").to_numpy(), table.column("leaves").to_numpy()
        c, own, at = x[~asking], cid[~asking], leaf[~asking]
        there = [(int(bit), c[at == bit], own[at == bit]) for bit in np.unique(at)]
        who, best, score = best_of_leaves(x[asking], leaf[asking], there, k + 1, most)
        return pa.table({"qcid": cid[asking][who], "cid": best, "score": score})

    found = classes.mapInArrow(index, schema).groupBy("tree", "cell", "part").applyInArrow(rank, "qcid long, cid long, score double")
    # Best classes of a query class over all cells; a class found in several trees counts once.
    near = [F.col("score").desc(), F.col("cid")]
    once = newest(found, ["qcid"], near, trees * (k + 1)).groupBy("qcid", "cid").agg(F.max("score").alias("score"))
    hits = newest(once, ["qcid"], near, k + 1).select("qcid", "score", "cid")
    members = classes.select("cid", "ids")
    hits = hits.join(members, "cid").select("qcid", F.col("score"), F.explode("ids").alias("id"))
    listed = hits.groupBy("qcid").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "id.no", "id.v")).alias("list"))
    listed = listed.select("qcid", F.slice(F.sort_array("list"), 1, 2 * k + 2).alias("list"))
    asking = rows.where(is_query).join(classes.where("asked").select("vec", F.col("cid").alias("qcid")), "vec").select(F.col("vec_id").alias("query_id"), "qcid")
    own = F.slice(F.filter("list", lambda h: ~h["v"].eqNullSafe(F.col("query_id"))), 1, k)
    return (
        asking.join(listed, "qcid")
        .select("query_id", F.posexplode(own).alias("rank", "h"))
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("h.v").alias("vec_id"), (-F.col("h.s")).alias("score"))
    )
