"""Groups of documents whose word 5-grams overlap: a prefix-tree join.

All n-grams have one global order: those that a corpus-wide count sketch shows as frequent come
last, the others are ordered by hash. Two sets of Jaccard similarity s share a gram within the
first (1 - s) part of either, and k grams within prefixes that are k - 1 longer. Only such
prefixes are shuffled. Sets that share fewer than k prefix grams with sets of fitting size are
out, and of the others those that share less than s of all their grams with such sets. The rest
are ordered anew, by how many of the rest hold a gram, and their grams that no set of fitting size
has are left out. They are chained where they meet at a prefix gram of this order, and the chains'
connected parts (candidates) are joined exactly, each in a prefix tree: sets are paths, shared
partial overlaps are counted once, and subtrees whose remaining length cannot reach the similarity
are left out, as are those that are already connected to the probe. Candidate parts too large for
one task are ordered and chained once more within themselves. What stays too large is cut into
blocks by size and hash; each pair of blocks whose sizes fit is a task of bounded size, and the
pairs meet in rounds, so that a round's copies are at most three of each set.

Equal sets are one node, so copies cost nothing. The result is a component per document; links
within a component are not all listed. The count sketch has a fixed size and orders grams only:
it affects cost, never the result.

Cases: a text without words has an empty set and no links. Rows are documents of their own, also
those that share an id; a null id counts as the largest and is shown as null. Repeated rows are
linked like other copies. Empty tables give no rows. Other columns are not read.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.common import LAST_ID, components, drop_written, order_id, scratch, written
from placeweave.llm.shingles import WordHashes, shingle_sets, slices

SIZE = 5
# Similarity as a fraction: 75 of 100.
SIMILAR, OF = 75, 100
# Share of a set by which its prefix is longer than one common gram asks for.
EXTRA, OF_EXTRA = 8, 100
# Cells of the count sketch, its parts, and how far above the mean a cell is frequent.
CELLS, PARTS, FREQUENT, LEAST_FREQUENT = 1 << 21, 64, 4, 16
# Grams that a task joins at most; larger candidate parts are cut into blocks of half as many.
TASK_GRAMS = 4_000_000
# Grams of prefixes, and texts, are shuffled in so many shares, one after the other.
PASSES = 2


def node_of(grams: np.ndarray) -> int:
    """A set's number: a signed 64-bit hash of its grams."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def count_sketch(texts: DataFrame, size: int) -> np.ndarray:
    """How often grams fall in each cell, over all documents. Its size is fixed; tasks send
    their counts by part, and each part is summed as it streams in."""
    def count(batches):
        seen, cells = WordHashes(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                grams = np.concatenate(shingle_sets(texts, size, seen))
                cell, times = np.unique((grams & np.uint64(CELLS - 1)).astype(np.int64), return_counts=True)
                cells[cell] += times
        for part, counts in enumerate(np.split(cells, PARTS)):
            if counts.any():
                small = counts.astype(np.min_scalar_type(int(counts.max())))
                yield pa.RecordBatch.from_pydict({"part": [part], "width": [small.itemsize], "counts": [small.tobytes()]})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, width, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, f"<u{width}").astype(np.int64)
        for part, counts in total.items():
            yield pa.RecordBatch.from_pydict({"part": [part], "counts": [counts.tobytes()]})

    rows = texts.mapInArrow(count, "part long, width long, counts binary").repartition(PARTS, "part").mapInArrow(add, "part long, counts binary")
    cells, rows = np.zeros(CELLS, np.int64), written(rows, "cells")
    for row in rows.toLocalIterator():
        cells[row["part"] * (CELLS // PARTS):(row["part"] + 1) * (CELLS // PARTS)] = np.frombuffer(row["counts"], np.int64)
    drop_written(rows)
    return cells


def frequent_cells(cells: np.ndarray) -> np.ndarray:
    return cells > max(LEAST_FREQUENT, FREQUENT * cells.mean())


def prefix(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first grams in global order: enough for any similar set to share 1 + EXTRA% of the
    smaller of the two within its own prefix."""
    n = len(grams)
    common = frequent[(grams & np.uint64(CELLS - 1)).astype(np.int64)]
    ordered = np.concatenate([grams[~common], grams[common]])
    return ordered[: n - -(-n * SIMILAR // OF) + 1 + n * EXTRA // OF_EXTRA]


def sets_of(documents: DataFrame, size: int, frequent) -> DataFrame:
    """Rows (key, tie, doc_id, node, n, grams): a set's number, size and prefix. Of equal sets in
    a task the first has the prefix."""
    def task(batches):
        seen, known = WordHashes(), set()
        for batch in batches:
            nodes, sizes, prefixes = [], [], []
            for texts in slices(batch.column(3)):
                for grams in shingle_sets(texts, size, seen):
                    node = node_of(grams)
                    nodes.append(node)
                    sizes.append(len(grams))
                    prefixes.append(prefix(grams, frequent.value).view(np.int64) if len(grams) and node not in known else [])
                    known.add(node)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["key", "tie", "doc_id", "node", "n", "grams"])

    return documents.mapInArrow(task, "key long, tie long, doc_id long, node long, n long, grams array<long>")


class _Node:
    __slots__ = ("edge", "children", "ends", "low", "high", "depth", "hint")

    def __init__(self, edge, low, high, depth, hint):
        self.edge, self.children, self.ends = edge, {}, []
        self.low, self.high, self.depth, self.hint = low, high, depth, hint


def _parent(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


class PrefixTree:
    """Sets as sorted number arrays; probes find members that are similar and not yet connected."""

    def __init__(self, up: list[int], sizes):
        self.up, self.sizes = up, sizes
        self.root = _Node(np.zeros(0, np.int64), 1 << 62, 0, 0, -1)

    def insert(self, x: int, path: np.ndarray) -> None:
        n, node = self.sizes[x], self.root
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            node.depth = max(node.depth, len(path))
            if not len(path):
                node.ends.append(x)
                return
            child = node.children.get(int(path[0]))
            if child is None:
                child = node.children[int(path[0])] = _Node(path, n, n, 0, x)
                child.ends.append(x)
                return
            length = min(len(child.edge), len(path))
            differ = np.flatnonzero(child.edge[:length] != path[:length])
            same = int(differ[0]) if len(differ) else length
            if same < len(child.edge):  # cut the edge
                rest = child.edge[same:]
                upper = _Node(child.edge[:same], child.low, child.high, child.depth + len(rest), child.hint)
                child.edge = rest
                upper.children[int(rest[0])] = child
                node.children[int(path[0])] = child = upper
            if child.hint >= 0 and _parent(self.up, child.hint) != _parent(self.up, x):
                child.hint = -1  # members of several components below
            node, path = child, path[same:]

    def probe(self, x: int, path: np.ndarray):
        """Members similar to x, one of each component at least."""
        n, up = self.sizes[x], self.up
        smallest = -(-n * SIMILAR // OF)
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, shared = stack.pop()
            if node.high < smallest or node.low * SIMILAR > n * OF:
                continue
            if node.hint >= 0 and _parent(up, node.hint) == _parent(up, x):
                continue
            # 100 * i >= 75 * (a + b - i)
            need = SIMILAR * (n + max(node.low, smallest))
            edge = node.edge
            if (OF + SIMILAR) * (shared + min(len(path) - at, len(edge) + node.depth)) < need:
                continue
            if len(edge):
                found = np.searchsorted(path[at:], edge)
                inside = found < len(path) - at
                shared += int(np.count_nonzero(path[at:][found[inside]] == edge[inside]))
                at += int(np.searchsorted(path[at:], edge[-1], "right"))
                if (OF + SIMILAR) * (shared + min(len(path) - at, node.depth)) < need:
                    continue
            for y in node.ends:
                if _parent(up, y) != _parent(up, x) and (OF + SIMILAR) * shared >= SIMILAR * (n + self.sizes[y]):
                    yield y
            for first, child in node.children.items():
                stack.append((child, at, shared))


def spanning_links(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all sets which similar pairs connect."""
    sizes = np.array([len(s) for s in sets])
    alive = np.arange(len(sets))
    # A gram that only one set has cannot be shared; a set with too few others has no link.
    while True:
        owner = np.repeat(np.arange(len(alive)), sizes[alive])
        tokens, index, counts = np.unique(np.concatenate([sets[i] for i in alive]), return_inverse=True, return_counts=True)
        shared = counts[index] >= 2
        kept = np.bincount(owner[shared], minlength=len(alive))
        fit = kept * OF >= sizes[alive] * SIMILAR
        if fit.all() or not fit.any():
            break
        alive = alive[fit]
    if not fit.any():
        return []
    # Frequent grams first, so that paths are shared from the root on.
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    ranks, owner = rank[index[shared]], owner[shared]
    order = np.lexsort((ranks, owner))
    paths = np.split(ranks[order], np.cumsum(np.bincount(owner, minlength=len(alive)))[:-1])
    up = list(range(len(alive)))
    tree, links = PrefixTree(up, sizes[alive].tolist()), []
    for x in np.argsort(sizes[alive], kind="stable").tolist():
        for y in tree.probe(x, paths[x]):
            a, b = _parent(up, x), _parent(up, y)
            if a != b:
                up[max(a, b)] = min(a, b)
                links.append((int(nodes[alive[x]]), int(nodes[alive[y]])))
        tree.insert(x, paths[x])
    return links


def _join_group(table: pa.Table) -> pa.Table:
    lists = table.column("grams").combine_chunks()
    grams, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    found = {node: grams[a:b] for node, a, b in zip(table.column("node").to_pylist(), offsets[:-1], offsets[1:], strict=True)}
    links = spanning_links(np.array(list(found)), list(found.values())) if len(found) > 1 else []
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _met(grams: DataFrame) -> DataFrame:
    """Each (gram, n, node) with its neighbours by size among the sets that have the gram. If any
    of these is of a size that allows the similarity, the next smaller or larger one is. (Rows
    that repeat a node are next to each other and count as one.)"""
    near = Window.partitionBy("gram").orderBy("n", "node")
    return grams.select(
        "n", "node", F.lag("node").over(near).alias("before"), F.lag("n").over(near).alias("smaller"),
        F.lead("node").over(near).alias("after"), F.lead("n").over(near).alias("larger"))


_BEFORE = f"node <> before AND smaller * {OF} >= n * {SIMILAR}"
_AFTER = f"node <> after AND n * {OF} >= larger * {SIMILAR}"


def _counts(grams: DataFrame) -> DataFrame:
    """Rows (node, n, shared): how many of its grams a node shares with others of fitting size."""
    return _met(grams).filter(f"({_BEFORE}) OR ({_AFTER})").groupBy("node", "n").agg(F.count("*").alias("shared"))


def _sharing(grams: DataFrame, least) -> DataFrame:
    """Nodes that share at least so many of their grams with others of fitting size."""
    return _counts(grams).filter(F.col("shared") >= least).select("node")


def _sharing_in_passes(grams: DataFrame, least) -> DataFrame:
    """The same, with a share of all grams shuffled at a time."""
    counts = [written(_counts(grams.filter(F.pmod("gram", F.lit(PASSES)) == k)), "counts") for k in range(PASSES)]
    total = reduce(DataFrame.unionByName, counts).groupBy("node", "n").agg(F.sum("shared").alias("shared"))
    sharing = written(total.filter(F.col("shared") >= least).select("node"), "sharing")
    for rows in counts:
        drop_written(rows)
    return sharing


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("grams").alias("gram"), "n", "node")


def whole_sets(documents: DataFrame, rows: DataFrame, sharing: DataFrame, size: int) -> DataFrame:
    """Rows (node, n, grams) with all grams of the nodes whose prefixes share enough. A share of
    the texts is shuffled at a time."""
    spark, path = documents.sparkSession, scratch(documents.sparkSession, "whole")
    members = written(
        rows.filter("n > 0").join(sharing, "node").groupBy("node", "n")
        .agg(F.min(F.struct("key", "tie")).alias("first")).select("node", "n", "first.*"), "members")

    def task(batches):
        seen = WordHashes()
        for batch in batches:
            grams = [g.view(np.int64) for texts in slices(batch.column(2)) for g in shingle_sets(texts, size, seen)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(grams, pa.list_(pa.int64()))], names=["node", "n", "grams"])

    schema, own = "node long, n long, grams array<long>", F.pmod(F.xxhash64("key", "tie"), F.lit(PASSES))
    paths = [f"{path}/{k}" for k in range(PASSES)]
    for k, to in enumerate(paths):
        texts = documents.filter(own == k).join(members.filter(own == k).hint("merge"), ["key", "tie"]).select("node", "n", "text")
        written(texts.mapInArrow(task, schema), "whole", to)
    drop_written(members)
    return spark.read.schema(schema).parquet(*paths)


def _shared_grams(grams: DataFrame) -> DataFrame:
    """Rows (node, n, gram) of what a set of fitting size has as well. The gram has the number of
    sets that hold it, 127 at most, in its upper bits."""
    near = Window.partitionBy("gram").orderBy("n", "node")
    found = grams.select(
        "gram", "n", "node", F.lag("node").over(near).alias("before"), F.lag("n").over(near).alias("smaller"),
        F.lead("node").over(near).alias("after"), F.lead("n").over(near).alias("larger"),
        F.count(F.lit(1)).over(Window.partitionBy("gram")).alias("sets")).filter(f"({_BEFORE}) OR ({_AFTER})")
    place = F.shiftleft(F.least("sets", F.lit(127)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned("gram", 8))
    return found.select("node", "n", place.alias("gram"))


def _chained(grams: DataFrame) -> DataFrame:
    """Rows (node, part): sets that may be similar, with those that they are chained to. Similar
    sets share SIMILAR of either's n grams at least, all among those that a set of fitting size has
    as well. Of these the ones that fewest sets hold are the prefix: all but one less than that share."""
    least = F.ceil(F.col("n") * SIMILAR / OF).cast("int")
    own = _shared_grams(grams).groupBy("node", "n").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    own = own.filter(F.size("grams") >= least)
    prefixes = written(own.select("node", "n", F.slice("grams", F.lit(1), F.size("grams") - least + 1).alias("grams")), "prefixes")
    linked = components(_met(_exploded(prefixes)).filter(_BEFORE).select("node", "before").distinct())
    drop_written(prefixes)
    return linked.select(F.col("v").alias("node"), F.col("m").alias("part")).unionByName(
        linked.select(F.col("m").alias("node"), F.col("m").alias("part")).distinct())


def candidate_parts(sets: DataFrame) -> DataFrame:
    """Rows (node, part, grams): nodes that may be similar to another, with the part they fall in and
    its size. Parts too large for one task are chained anew by what is shared within them, until that
    makes the largest hardly smaller."""
    sizes = sets.select("node", "n")
    close = written(_sharing(_exploded(sets), F.ceil(F.col("n") * SIMILAR / OF)), "close")
    chained, done, largest = _chained(_exploded(sets.join(close, "node"))), [], None
    while True:
        parts = chained.join(sizes, "node")
        totals = parts.groupBy("part").agg(F.sum("n").alias("grams"))
        parts = written(parts.join(totals, "part").select("node", "part", "grams"), "parts")
        most = parts.agg(F.max("grams")).first()[0]
        if most is None or most <= TASK_GRAMS or (largest and most > 0.9 * largest):
            return reduce(DataFrame.unionByName, [*done, parts])
        largest = most
        done.append(parts.filter(F.col("grams") <= TASK_GRAMS))
        within = sets.join(parts.filter(F.col("grams") > TASK_GRAMS).select("node", "part"), "node")
        # The same gram in two parts is two grams.
        chained = _chained(within.select("n", "node", "part", F.explode("grams").alias("gram")).select(
            F.xxhash64("gram", "part").alias("gram"), "n", "node"))


def _dealt(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (node, part, level, block, blocks, below, above): members of parts too large for one task
    by levels of size, so that similar sets are on one level or on two that follow each other, and
    levels in blocks by hash; with the numbers of blocks of the level, the one below and the one above."""
    width = math.log(OF / SIMILAR) * (1 + 1e-9)
    large = F.col("grams") > TASK_GRAMS
    members = parts.join(sets.select("node", "n"), "node").select(
        "node", "n", "part", large.alias("large"), F.when(large, F.floor(F.log("n") / width)).otherwise(0).cast("int").alias("level"))
    blocks = F.when(F.col("large"), F.ceil(F.sum("n") / (TASK_GRAMS // 2))).otherwise(1).cast("int")
    levels = members.groupBy("part", "level", "large").agg(blocks.alias("blocks"))
    up = Window.partitionBy("part").orderBy("level")
    below = F.when(F.lag("level").over(up) == F.col("level") - 1, F.lag("blocks").over(up)).otherwise(0)
    above = F.when(F.lead("level").over(up) == F.col("level") + 1, F.lead("blocks").over(up)).otherwise(0)
    levels = levels.select("part", "level", "blocks", below.alias("below"), above.alias("above"))
    return members.select("node", "part", "level").join(levels, ["part", "level"]).withColumn(
        "block", F.pmod("node", F.col("blocks")).cast("int"))


def _meeting(at: int):
    """The blocks that a set's block meets in a round, three at most: of its level, of the next one
    and of the one below. Blocks i and j meet if i + j is the round's number modulo the larger number of blocks."""
    level, block, found = F.col("level"), F.col("block"), []
    for name, pair in (("blocks", 2 * level), ("above", 2 * level + 1), ("below", 2 * level - 1)):
        most = F.greatest("blocks", name)
        other = F.pmod(F.lit(at) - block, most).cast("int")
        i, j = {"blocks": (F.least(block, other), F.greatest(block, other)), "above": (block, other), "below": (other, block)}[name]
        found.append(F.when((most > at) & (other < F.col(name)), F.struct(pair.alias("pair"), i.alias("i"), j.alias("j"))))
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def links_in_parts(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Spanning links of every candidate part. Blocks of large parts meet in rounds, for each of which
    a set is copied three times at most."""
    spark = sets.sparkSession
    path, dealt = scratch(spark, "similar"), written(_dealt(sets, parts), "dealt")
    turns = F.greatest("blocks", "below", "above")
    rounds = [f"{path}/{at}" for at in range(dealt.agg(F.max(turns)).first()[0] or 1)]
    for at, to in enumerate(rounds):
        now = dealt.filter(turns > at).select("node", "part", F.explode(_meeting(at)).alias("meet"))
        meets = sets.select("node", "grams").join(now, "node").select("node", "grams", "part", "meet.*")
        written(meets.groupBy("part", "pair", "i", "j").applyInArrow(lambda table: _join_group(table), "a long, b long"), "similar", to)
    drop_written(dealt)
    return spark.read.schema("a long, b long").parquet(*rounds)


def similar_documents(documents: DataFrame, size: int = SIZE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, tie, n_shingles, component_id, first): `component_id` is the smallest id
    that links reach, and `first` marks one row of each component: of those with that id the one
    with the smallest text hash (rows equal in both are all marked)."""
    docs = documents.select(
        order_id(id_column).alias("key"), F.xxhash64(F.col(text_column).cast("string")).alias("tie"),
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    spark = documents.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_cells(count_sketch(docs.select("text"), size)))
    sets = written(sets_of(docs, size, frequent), "sets")
    # A partner has SIMILAR of n grams at least, and its prefix the extra of those.
    least = F.floor(F.ceil(F.col("n") * SIMILAR / OF) * EXTRA / OF_EXTRA) + 1
    sharing = _sharing_in_passes(_exploded(sets), least)
    rows = written(sets.drop("grams"), "rows")
    drop_written(sets)
    whole = whole_sets(docs, rows, sharing, size)
    links = links_in_parts(whole, candidate_parts(whole))
    drop_written(whole)
    roots = components(links)
    narrow = rows.select("doc_id", "key", "tie", "n", "node").join(roots.withColumnRenamed("v", "node"), "node", "left")
    root = F.coalesce("m", "node")
    named = narrow.withColumn("root", root)
    firsts = named.filter("n > 0").groupBy("root").agg(F.min(F.struct("key", "tie")).alias("least"))
    joined = named.join(firsts, "root", "left")
    alone = F.col("n") == 0
    smallest = F.when(alone, F.col("key")).otherwise(F.col("least.key"))
    return joined.select(
        "doc_id", "tie", F.col("n").alias("n_shingles"), F.when(smallest < LAST_ID, smallest).alias("component_id"),
        (alone | (F.struct("key", "tie") == F.col("least"))).alias("first"))
