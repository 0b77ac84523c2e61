"""SimHash near-duplicates found with vantage-point trees.

Fingerprints are 64 bits, one bit per majority over the hashes of three-word shingles. Two
fingerprints at distance 3 or less differ in at most one bit of their upper or of their
lower half. So two trees, one over each half, are searched with radius 1: a node holds a
vantage point and a distance; a fingerprint lives in one shard, and asks also the shards
that the triangle bound leaves open, which are those less than the radius beyond a boundary
on its path. Inside a shard the full 64 bits are compared.

Edge cases. Null or empty text: fingerprint zero, linked like any other. One or two words:
the whole sequence is the only shingle. Repeated rows share fingerprint and component. A
null doc_id never names a component; it is null only where no row of the component has an
id. An empty table gives an empty result. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewell.llm.components import components, roots
from tidewell.llm.textkit import blocks, flat, words
from tidewell.session import materialise

RADIUS = 3
#: Fingerprints a shard is meant to hold; shards of one tree at most, and the sampled
#: fingerprints per shard that place the vantage points.
SHARD, SHARDS, SAMPLE = 1024, 1 << 14, 16
#: Larger shards are cut into pieces of this many fingerprints that meet pairwise.
PIECE = 8192


def fingerprints_of(text: pa.Array) -> np.ndarray:
    data, offsets = flat(text)
    starts, ends, first = words(data, offsets)
    n, sizes = len(offsets) - 1, ends - starts
    low = data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5
    # Words of all documents joined by one space; `at` is where each begins.
    at = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[at + sizes] = False
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    np.subtract.at(keep, ends, 1)
    joined[inside] = low[np.cumsum(keep[:-1]) > 0]
    buffer = joined.tobytes()
    count = np.diff(first)
    begin = [np.arange(f, max(f + min(c, 1), f + c - 2)) for f, c in zip(first[:-1].tolist(), count.tolist(), strict=True)]
    per = np.array([len(b) for b in begin])
    begin = np.concatenate(begin) if begin else np.zeros(0, np.int64)
    last = np.minimum(begin + 2, np.repeat(first[1:], per) - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(buffer[i:j], 42) for i, j in zip(at[begin].tolist(), (at + sizes)[last].tolist(), strict=True)), np.uint64, len(begin)
    )
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(per)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(per) - per)[full], axis=0, dtype=np.int64)
        major = (2 * ones > per[full, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


@F.arrow_udf(LongType())
def _fingerprint(text: pa.Array) -> pa.Array:
    parts = [fingerprints_of(b.column(0)) for b in blocks([pa.record_batch([text], names=["text"])], "text")]
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64), pa.int64())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of every whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprint(F.col("text").cast("string")).alias("fingerprint"))


# A tree is a list of nodes: (vantage, distance, near, far), or (leaf number,).
Tree = list[tuple]


def grow_tree(sample: np.ndarray, shards: int, seed: int) -> Tree:
    """Tree over 32-bit values with about `shards` leaves.

    Of some vantage points the one is taken that leaves the fewest values in the strip both
    sides must be asked for, with a quarter of the values at least on either side.
    """
    rng = np.random.default_rng(seed)
    nodes: Tree = []
    leaves = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        me = len(nodes)
        nodes.append(())
        best = None
        if want > 1 and len(points) > 1:
            for vantage in rng.choice(points, min(8, len(points)), replace=False):
                counts = np.bincount(np.bitwise_count(points ^ vantage), minlength=34)
                inside = np.cumsum(counts)
                for t in range(32):
                    smaller = min(inside[t], len(points) - inside[t])
                    if smaller == 0:
                        continue
                    worth = (counts[t] + counts[t + 1]) / len(points) + max(0, 0.25 - smaller / len(points)) * 8
                    if best is None or worth < best[0]:
                        best = (worth, vantage, t)
        if best is None:
            nodes[me] = (leaves,)
            leaves += 1
            return me
        _, vantage, t = best
        near = np.bitwise_count(points ^ vantage) <= t
        share = min(max(round(want * near.mean()), 1), want - 1)
        nodes[me] = (vantage, t, grow(points[near], share), grow(points[~near], want - share))
        return me

    grow(np.asarray(sample, np.uint32), shards)
    return nodes


def route(tree: Tree, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, home) of every shard each value lives in or has to ask."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def visit(node: int, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if len(tree[node]) == 1:
            out.append((at, tree[node][0], home))
            return
        vantage, t, near, far = tree[node]
        d = np.bitwise_count(values[at] ^ vantage).astype(np.int16)
        left, right = d <= t + radius, d > t - radius
        visit(near, at[left], home[left] & (d <= t)[left])
        visit(far, at[right], home[right] & (d > t)[right])

    visit(0, np.arange(len(values)), np.ones(len(values), bool))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return (
        np.concatenate([a for a, _, _ in out]),
        np.concatenate([np.full(len(a), leaf) for a, leaf, _ in out]),
        np.concatenate([h for _, _, h in out]),
    )


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = values.view(np.uint64)
    return (bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)


def near_pairs(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that join all fingerprints within RADIUS: per shard a spanning forest.

    `distinct` has each fingerprint once. The trees are placed by a sample of at most
    SAMPLE values per shard and SHARDS shards; every fingerprint is then routed.
    """
    total = distinct.count()
    want = int(min(max(1, -(-total // shard)), SHARDS))
    sample = distinct.orderBy(F.xxhash64(F.lit(5), F.col("fingerprint")), "fingerprint").limit(SAMPLE * want)
    sample = np.array([r[0] for r in sample.select("fingerprint").collect()], np.int64)
    trees = [grow_tree(half, want, 3 + i) for i, half in enumerate(_halves(sample))]

    schema = "tree int, leaf int, home boolean, fingerprint long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for number, half in enumerate(_halves(values)):
                at, leaf, home = route(trees[number], half, RADIUS // 2)
                yield pa.record_batch(
                    [np.full(len(at), number, np.int32), leaf.astype(np.int32), pa.array(home, pa.bool_()), values[at]],
                    names=["tree", "leaf", "home", "fingerprint"],
                )

    routed = materialise(distinct.select("fingerprint").mapInArrow(send, schema))
    # Pieces of a shard: a resident goes to one row of the grid, an asker to one column.
    sizes = routed.groupBy("tree", "leaf").agg(
        F.ceil(F.count_if("home") / PIECE).cast("int").alias("rows"), F.ceil(F.count("*") / PIECE).cast("int").alias("cols")
    )
    placed = routed.join(F.broadcast(sizes), ["tree", "leaf"])  # at most 2 * SHARDS rows
    mark = F.xxhash64(F.lit(11), F.col("fingerprint"))
    residents = placed.where("home").select(
        "tree", "leaf", F.lit(True).alias("home"), "fingerprint", F.pmod(mark, F.col("rows")).cast("int").alias("row"),
        F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"),
    )
    askers = placed.where("rows > 0").select(
        "tree", "leaf", F.lit(False).alias("home"), "fingerprint",
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(mark, F.col("cols")).cast("int").alias("col"),
    )

    def compare(table: pa.Table) -> pa.Table:
        values = table.column("fingerprint").to_numpy()
        home = table.column("home").to_numpy()
        mine, ask = np.unique(values[home]).view(np.uint64), np.unique(values[~home]).view(np.uint64)
        points = np.unique(np.concatenate([mine, ask]))
        a, b, step = [], [], max(1, (1 << 22) // max(1, len(mine)))
        for i in range(0, len(ask), step):
            x, y = np.nonzero(np.bitwise_count(ask[i : i + step, None] ^ mine[None, :]) <= RADIUS)
            x, y = np.searchsorted(points, ask[x + i]), np.searchsorted(points, mine[y])
            own = x != y
            # Links of this block, reduced to a forest before the next block is read.
            x, y = np.concatenate([x[own], *a]), np.concatenate([y[own], *b])
            root = roots(len(points), x, y)
            tied = np.flatnonzero(root != np.arange(len(points)))
            a, b = [tied], [root[tied]]
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        return pa.table({"a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    return residents.unionByName(askers).groupBy("tree", "leaf", "row", "col").applyInArrow(compare, "a long, b long").select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable) of every row."""
    marked = materialise(fingerprints(docs))
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("_first"))
    distinct = materialise(distinct)
    found = components(near_pairs(distinct)).withColumnRenamed("id", "fingerprint")
    group = F.coalesce("component", "fingerprint")
    classes = materialise(distinct.join(found, "fingerprint", "left").select("fingerprint", group.alias("_group"), "_first"))
    names = classes.groupBy("_group").agg(F.min("_first").alias("component_id"))
    return marked.join(classes.join(names, "_group").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of `docs` that are the first of their group; rows that share an id stay together."""
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct("*").alias("_row"))  # keeps names apart
    return rows.join(kept, F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi").select("_row.*")
