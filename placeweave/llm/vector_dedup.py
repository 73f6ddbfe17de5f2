"""Near-duplicate embeddings of equal label by a forest of random-projection trees.

Equal vectors are one node with a weight. A tree splits a cell along one of `CANDIDATES` random
directions at one of the eighths of a bounded sample of the cell (`SAMPLE` nodes with the smallest
hash): the direction and eighth that leave the fewest pairs. Nodes within `SPILL` of the split go to
both sides, so a near pair is seldom torn apart, and hardly ever in all of `TREES` trees. A split is
only made if it leaves at most `SHARE` of the pairs, which also bounds what spill adds to the rows (by
about a fifth at a split into halves; an eighth for random vectors of 64 dimensions). Cells of more than `LEAF` nodes are split again, in rounds of `DEPTH`
levels, until none is left that can be; rules of a round are broadcast, or joined if they are many.
Where no direction splits a cell, since its nodes lie too close together, it is cut into blocks
and each pair of blocks is a task, so nothing is left out. If that is a whole tree, it holds
all pairs and the other trees of its root are not needed. Within a leaf all cosines are taken in
double precision. A pair that several leaves hold counts in the one with the smallest number, which
its members' lists of leaves tell; so leaves give sums of links and a spanning set of links, never
all pairs.

Cases: vectors that are null, zero or hold null or non-finite components, or whose label is null,
link with nothing and are their own component. Vectors of different length are not compared.
Rows are vectors of their own, also those that share an id or are repeated; a null id counts as
the largest. Empty tables give no rows. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.common import LAST_ID, components, order_id, written
from placeweave.llm.shingles import mix

THRESHOLD = 0.98
TREES, LEAF = 3, 1024
SPILL, SHARE = 0.02, 0.75
SAMPLE, DEPTH, CANDIDATES = 2048, 8, 4
# Cells whose rules are broadcast; those of more are joined to the rows.
RULES = 20_000
# Nodes in a block of a cell that cannot be split, and rows of cosines taken at a time.
BLOCK, _STRIP = 4096, 512

_ROW = "cell long, node long, weight long, vector array<double>"


def _directions(cell: int, splits: int, length: int) -> np.ndarray:
    """The random unit directions that a cell's splits choose from: the same wherever they are needed."""
    drawn = np.random.default_rng(cell & ((1 << 63) - 1)).standard_normal((CANDIDATES, splits, length))
    return drawn / np.linalg.norm(drawn, axis=2, keepdims=True)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _split_point(values: np.ndarray) -> tuple[float, float]:
    """(share, point): the eighth of the values with the fewest pairs on its sides, spill included."""
    ordered = np.sort(values)
    eighths = ordered[len(ordered) * np.array([4, 3, 5, 2, 6, 1, 7]) // 8]
    left = np.searchsorted(ordered, eighths + SPILL, side="right")
    right = len(ordered) - np.searchsorted(ordered, eighths - SPILL, side="right")
    pairs = (left * left + right * right) / len(ordered) ** 2
    best = int(np.argmin(pairs))
    return float(pairs[best]), float(eighths[best])


def _fit(table: pa.Table) -> pa.Table:
    """The rule of a cell from its sample: a point and a direction for each split in heap order; no
    point where a branch ends. The first has none if the cell cannot be split."""
    cell, n = table.column("cell")[0].as_py(), table.column("n")[0].as_py()
    x = _matrix(table.column("vector").combine_chunks())
    depth = min(DEPTH, max(1, int(np.ceil(np.log2(2 * n / LEAF)))))
    points, chosen = np.full((1 << depth) - 1, np.nan), np.zeros((1 << depth) - 1, np.uint8)
    directions = _directions(cell, len(points), x.shape[1])
    branches = {0: np.arange(len(x))}
    for split in range(len(points)):
        members = branches.pop(split, None)
        if members is None or len(members) < 8:
            continue
        values = x[members] @ directions[:, split].T
        (share, point), best = min((_split_point(values[:, c]), c) for c in range(CANDIDATES))
        if share > SHARE:
            continue
        points[split], chosen[split] = point, best
        # With spill, as the rows of the cell will go.
        branches[2 * split + 1] = members[values[:, best] <= point + SPILL]
        branches[2 * split + 2] = members[values[:, best] > point - SPILL]
    return pa.table({"cell": pa.array([cell], pa.int64()), "rule": pa.array([points.tobytes() + chosen.tobytes()], pa.binary()),
                     "splits": pa.array([not np.isnan(points[0])], pa.bool_())})


def _rule(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    splits = len(data) // 9
    return np.frombuffer(data, np.float64, splits), np.frombuffer(data, np.uint8, splits, 8 * splits)


def descend(x: np.ndarray, cell: int, points: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, new cell) of all leaves that the rows reach, with spill."""
    directions = _directions(cell, len(points), x.shape[1])[chosen, np.arange(len(points))]
    projected = x @ directions.T
    rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    done_rows, done_at = [], []
    while len(rows):
        split = at < len(points)
        split[split] = ~np.isnan(points[at[split]])
        done_rows.append(rows[~split])
        done_at.append(at[~split])
        rows, at = rows[split], at[split]
        beyond = projected[rows, at] - points[at]
        left, right = beyond <= SPILL, beyond > -SPILL
        rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    at = np.concatenate(done_at).astype(np.uint64)
    return np.concatenate(done_rows), mix(mix(np.uint64(cell & ((1 << 64) - 1)) + at) + np.uint64(1)).view(np.int64)


def _split(rows: DataFrame, rules: dict[int, bytes] | None) -> DataFrame:
    """Rows in their new cells; without `rules` each row brings its cell's in a fifth column."""
    shared = rows.sparkSession.sparkContext.broadcast(rules)

    def task(batches):
        for batch in batches:
            cells = batch.column(0).to_numpy()
            order = np.argsort(cells, kind="stable")
            for members in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                if not len(members):
                    continue
                some = batch.take(pa.array(members))
                cell = int(cells[members[0]])
                rule = some.column(4)[0].as_py() if shared.value is None else shared.value[cell]
                at, new = descend(_matrix(some.column(3)), cell, *_rule(rule))
                out = some.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(new), *out.columns[1:4]], names=["cell", "node", "weight", "vector"])

    return rows.mapInArrow(task, _ROW)


def leaves(nodes: DataFrame) -> DataFrame:
    """Rows (cell, node, weight, vector) of all trees; nodes: root, node, weight, vector."""
    sizes = nodes.groupBy("root").agg(F.count("*").alias("n"))
    # A group that fits one leaf needs one tree only.
    trees = F.sequence(F.lit(0), F.when(F.col("n") <= LEAF, 0).otherwise(TREES - 1))
    roots = sizes.select("root", "n", F.explode(trees).alias("tree")).withColumn("cell", F.xxhash64("root", "tree"))
    rows = nodes.join(roots.select("root", "cell"), "root").select("cell", "node", "weight", "vector")
    counts = roots.select("cell", "n")
    done, level = None, 0
    while True:
        large = counts.filter(F.col("n") > LEAF)
        picked = Window.partitionBy("cell").orderBy(F.xxhash64("node", "cell"), "node")
        sample = rows.join(large, "cell").withColumn("rank", F.row_number().over(picked)).filter(F.col("rank") <= SAMPLE).select("cell", "n", "vector")
        rules = written(sample.groupBy("cell").applyInArrow(lambda table: _fit(table), "cell long, rule binary, splits boolean"), "rules")
        if not level:
            # A tree that cannot be split has all pairs of its root: the first is kept, and no other tree.
            whole = roots.join(rules.filter("NOT splits"), "cell").groupBy("root").agg(F.min("cell").alias("first"))
            spare = written(roots.join(whole, "root").filter("cell <> first").select("cell"), "spare")
            rows, rules = rows.join(spare, "cell", "left_anti"), rules.join(spare, "cell", "left_anti")
        rules, level = rules.filter("splits"), level + 1
        some = rules.select("cell", "rule").limit(RULES + 1).collect() if rules.count() <= RULES else None
        if some is not None and not some:
            break
        settled = rows.join(rules.select("cell"), "cell", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if some is None:
            split = _split(rows.join(rules.select("cell", "rule"), "cell").select("cell", "node", "weight", "vector", "rule"), None)
        else:
            split = _split(rows.join(rules.select("cell"), "cell", "left_semi"), {r["cell"]: bytes(r["rule"]) for r in some})
        rows = written(split, "cells")
        counts = written(rows.groupBy("cell").agg(F.count("*").alias("n")), "counts")
    return rows if done is None else done.unionByName(rows)


def _link(table: pa.Table, threshold: float) -> pa.Table:
    """Sums of links and a spanning set of them, for a leaf or a pair of its blocks."""
    cell = table.column("cell")[0].as_py()
    nodes = table.column("node").to_numpy()
    weights = table.column("weight").to_numpy()
    block = table.column("block").to_numpy()
    x = _matrix(table.column("vector").combine_chunks())
    near = np.empty((len(x), len(x)), bool)
    for at in range(0, len(x), _STRIP):
        np.greater_equal(x[at:at + _STRIP] @ x.T, threshold, out=near[at:at + _STRIP])
    np.fill_diagonal(near, False)
    if table.column("i")[0].as_py() != table.column("j")[0].as_py():
        near &= block[:, None] != block[None, :]
    if near.any():
        # Pairs that meet in a leaf of smaller number count there.
        lists = table.column("cells").combine_chunks()
        owner = np.repeat(np.arange(len(nodes)), np.diff(lists.offsets.to_numpy()))
        other = lists.flatten().to_numpy()
        earlier = other < cell
        owner, other = owner[earlier], other[earlier]
        order = np.argsort(other, kind="stable")
        for members in np.split(owner[order], np.flatnonzero(np.diff(other[order])) + 1):
            if len(members) > 1:
                near[np.ix_(members, members)] = False
    sums = np.concatenate([near[at:at + _STRIP] @ weights for at in range(0, len(x), _STRIP)])
    linked = np.flatnonzero(sums)
    a, b = [], []
    group = np.full(len(nodes), -1)
    for first in linked.tolist():  # breadth first, so that one link per node remains
        if group[first] >= 0:
            continue
        group[first], edge = first, [first]
        while edge:
            reached = np.flatnonzero(near[edge].any(axis=0) & (group < 0))
            for y in reached.tolist():
                group[y] = first
                a.append(int(nodes[y]))
                b.append(int(nodes[first]))
            edge = reached.tolist()
    return pa.table({
        "node": pa.array([*nodes[linked].tolist(), *a], pa.int64()),
        "links": pa.array([*sums[linked].tolist(), *[0] * len(a)], pa.int64()),
        "other": pa.array([*[None] * len(linked), *b], pa.int64()),
    })


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id",
                    vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per vector."""
    values = F.col(vector_column)
    whole = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col(label_column).isNotNull() & values.isNotNull() & whole & F.exists(values, lambda v: v != 0)
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), order_id(id_column).alias("key"), F.coalesce(usable, F.lit(False)).alias("usable"),
        F.transform(values, lambda v: v.cast("double") + 0.0).alias("vector"), F.col(label_column).alias("label"))
    rows = rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", F.size("vector"), "vector")))
    # Scaled by the largest component first, so that no square overflows or vanishes.
    largest = F.array_max(F.transform("vector", lambda v: F.abs(v)))
    scaled = F.transform("vector", lambda v: v / largest)
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, v: s + v * v))
    nodes = written(
        rows.filter("usable").groupBy("node").agg(
            F.count("*").alias("weight"), F.min("label").alias("label"), F.first("vector").alias("vector"))
        .withColumn("scaled", scaled).withColumn("norm", norm)
        .select(F.xxhash64("label", F.size("vector")).alias("root"), "node", "weight",
                F.transform("scaled", lambda v: v / F.col("norm")).alias("vector")), "vectors")
    cells = leaves(nodes)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    lists = cells.groupBy("node").agg(F.collect_list("cell").alias("cells"))
    # A leaf fits one task; what could not be split is dealt into blocks, two of which do.
    blocks = F.when(F.col("n") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("long")
    dealt = (
        cells.join(sizes.filter("n > 1").select("cell", blocks.alias("blocks")), "cell").join(lists, "node")
        .withColumn("block", F.pmod("node", F.col("blocks")))
        .withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("cell", "node", "weight", "vector", "cells", "block",
                F.least("block", "meets").alias("i"), F.greatest("block", "meets").alias("j"))
    )
    found = written(
        dealt.groupBy("cell", "i", "j").applyInArrow(lambda table: _link(table, threshold), "node long, links long, other long"), "links")
    sums = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select("node", "other").distinct())
    named = (
        rows.select("vec_id", "key", "node").join(nodes.select("node", "weight"), "node", "left").join(sums, "node", "left")
        .join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("m", "node"))
    )
    smallest = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("least"))
    result = named.join(smallest, "root", "left").withColumn("least", F.coalesce("least", "key"))
    return result.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.when(F.col("least") < LAST_ID, F.col("least")).alias("component_id"), (F.col("key") == F.col("least")).alias("kept"))
