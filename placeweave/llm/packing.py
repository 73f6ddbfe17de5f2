"""Best-fit packing of documents into training sequences by hierarchical residual packing.

Each input task encodes its documents, cuts only those that are too long, and packs what is left
best-fit decreasing, CHUNK pieces at a time. Bins that are nearly full are final; all others go up a
tree as items. A round deals the bins that are still open by hash to groups of FAN tasks of the round
before, so that each group sees bins of all sizes, and packs each group best-fit decreasing again;
bins that this makes nearly full are final, and the others go on. Groups get fewer from round to
round, but none gets more than ITEMS bins. The rounds end with one group, or with a round that saves
no bin. What then is left is packed once more over all groups: best-fit decreasing depends on the
lengths alone, and there are at most `LENGTH` of them, so it runs over counts of lengths and takes
equal bins together. There bins are items, or are opened where their pieces alone take fewer. Tasks
find the place of a piece from its length and its rank among the pieces of that length, so no
task ever holds more than its share. Every round is written to the shared folder, so that a lost
executor changes nothing that a later step has used.

Cases: a null or empty text is its end mark alone. Every row is packed, repeated rows and ids
too; a null id is kept. An empty table gives no rows. Other columns are not read.
"""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.common import written
from placeweave.llm.tokens import encoder, vocabulary_path

LENGTH, END = 1024, 2
# A bin with at most this much room is final.
NEARLY_FULL = 4
# Rows of a batch that a task hands on.
CARRY = 50_000
# Pieces that a task packs at a time, groups that a round makes one, and bins that one may get.
CHUNK, FAN, ITEMS = 400_000, 4, 200_000
# Parts among which the open bins of the end are ranked.
SPREAD = 256

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
# used: ids in the bin.
_SCHEMA = f"{_PIECE}, bin long, offset long, final boolean, used long"
_PLACED = f"{_PIECE}, bin long, offset long"


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first is the remainder, the others are full."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of the items by bin: largest first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    by_room = defaultdict(list)
    rooms = 0  # bit r is set if some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fitting = rooms >> sizes[i]
        if fitting:
            room = sizes[i] + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        room -= sizes[i]
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    return bins


def best_fit_counts(counts: dict[int, int], capacity: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The bins that `best_fit` takes for items of which only the number of each size is known,
    and where these go: (size, rank, bin, each, offset) sends the items of a size from this rank on,
    up to the next entry, to the bins from this one on, `each` to a bin, the first at the offset.

    Neighbouring bins that are equally full are one entry. A bin that got an item is the fullest
    for the next of that size, so it is filled before another one is touched, and a size cuts
    at most one entry into three."""
    bins, placed = 0, []
    by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first bin, number of bins)
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, rank = counts[size], 0
        changed = []
        for room in sorted(r for r in by_room if r >= size):
            each, same = room // size, by_room[room]
            while same and left:
                first, n = same.pop()
                take = min(n, left // each)
                if take < n:
                    same.append((first + take, n - take))
                if take:
                    changed.append((room - each * size, first, take))
                else:  # the last items of the size, too few to fill one more bin
                    same.pop()
                    if n > 1:
                        same.append((first + 1, n - 1))
                    changed.append((room - left * size, first, 1))
                placed.append((size, rank, first, each, capacity - room))
                done = take * each or left
                left, rank = left - done, rank + done
            if not left:
                break
        if left:
            each = capacity // size
            placed.append((size, rank, bins, each, 0))
            full, some = divmod(left, each)
            if full:
                changed.append((capacity - each * size, bins, full))
            if some:
                changed.append((capacity - some * size, bins + full, 1))
            bins += full + (some > 0)
        for room, first, n in changed:
            if room:
                by_room[room].append((first, n))
    return bins, placed


def _batches(rows, schema: pa.Schema):
    """Batches of at most CARRY rows."""
    for at in range(0, len(rows), CARRY):
        columns = zip(*rows[at:at + CARRY], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("bin", pa.int64()), ("offset", pa.int64()), ("final", pa.bool_()), ("used", pa.int64())])
# Task and bin of the first packing; round, group and bin of a later one.
_TASK, _ROUND = 28, 52


def encode_and_pack(documents: DataFrame, path: str, length: int, end: int) -> DataFrame:
    """Rows of each task's bins."""
    def task(batches):
        encode = encoder(path)
        mark = end.to_bytes(4, "little")
        part = TaskContext.get().partitionId() << _TASK
        pieces, bins = [], 0

        def packed():
            nonlocal bins
            rows = []
            for members in best_fit([p[3] for p in pieces], length):
                used, offset = sum(pieces[i][3] for i in members), 0
                for i in members:
                    rows.append((*pieces[i], part + bins, offset, length - used <= NEARLY_FULL, used))
                    offset += pieces[i][3]
                bins += 1
            pieces.clear()
            return _batches(rows, _ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py() or "") + mark
                for k, (start, n) in enumerate(cuts(len(data) // 4, length)):
                    pieces.append((doc_id, k, start, n, zlib.crc32(data[4 * start:4 * (start + n)])))
                if len(pieces) >= CHUNK:
                    yield from packed()
        yield from packed()

    return documents.mapInArrow(task, _SCHEMA)


_MERGED = pa.schema([("bin", pa.int64()), ("into", pa.int64()), ("shift", pa.int64()), ("used", pa.int64()), ("final", pa.bool_())])


def merge_round(bins: DataFrame, groups: int, number: int, length: int) -> DataFrame:
    """Bins (bin, used), dealt by hash to so many groups and packed: rows (bin, into, shift, used, final)
    say which bin each becomes part of, behind how many ids, and how full that one is."""
    def task(batches):
        rows = sorted((-used, b) for batch in batches for b, used in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        first = (number << _ROUND) + (TaskContext.get().partitionId() << _TASK)
        merged = []
        for k, members in enumerate(best_fit([-used for used, _ in rows], length)):
            used, shift = -sum(rows[i][0] for i in members), 0
            for i in members:
                merged.append((rows[i][1], first + k, shift, used, length - used <= NEARLY_FULL))
                shift -= rows[i][0]
        yield from _batches(merged, _MERGED)

    dealt = bins.select("bin", "used").repartition(groups, F.xxhash64("bin", F.lit(number)))
    return dealt.mapInArrow(task, "bin long, into long, shift long, used long, final boolean")


def merge_up(bins: DataFrame, parts: int, length: int) -> DataFrame:
    """All rounds over the open bins of `parts` tasks: rows (bin, into, shift, used, final) for each of
    them, with the bin that it is in after the last round."""
    whole, groups, number = None, parts, 0
    while True:
        number += 1
        n = bins.count()
        groups = max(-(-groups // FAN), -(-n // ITEMS), 1)
        merged = written(merge_round(bins, groups, number, length), "merged")
        left = merged.filter("shift = 0").count()
        if whole is None:
            whole = merged
        else:
            later = merged.select(F.col("bin").alias("_bin"), *[F.col(c).alias(f"_{c}") for c in ("into", "shift", "used", "final")])
            whole = written(whole.join(later, F.col("into") == F.col("_bin"), "left").select(
                "bin", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"),
                F.coalesce("_used", "used").alias("used"), F.coalesce("_final", "final").alias("final")), "merged")
        if groups == 1 or left == n:
            return whole
        bins = merged.filter("shift = 0 AND NOT final").select(F.col("into").alias("bin"), "used")


def place_residue(rows: DataFrame, length: int) -> DataFrame:
    """Pack the bins that no round has filled, of all groups together."""
    spread = F.pmod(F.xxhash64("bin"), F.lit(SPREAD)).alias("part")
    rows = rows.select("*", spread)

    def ranked(items, size, order):
        """Items with the number of those of their size and part before them."""
        return items.withColumn("size", F.col(size)).withColumn("nth", F.row_number().over(Window.partitionBy("part", "size").orderBy(*order)) - 1)

    def counted(rows, size):
        return rows.groupBy("part", F.col(size).alias("size")).agg(F.count("*").alias("n"))

    def totals(counts):
        return {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}

    bins, pieces = counted(rows.filter("offset = 0"), "used"), counted(rows, "length")
    together, alone = (best_fit_counts(totals(counts), length) for counts in (bins, pieces))
    opened = alone[0] < together[0]
    counts, placed = (pieces, alone[1]) if opened else (bins, together[1])
    # Sizes are positive and below 2^16, ranks below 2^47.
    table = np.array(placed, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 47) + table[:, 1]
    order = np.argsort(keys)
    shared = rows.sparkSession.sparkContext.broadcast((keys[order], table[order]))

    def task(batches):
        keys, table = shared.value
        for batch in batches:
            size, rank, inside = (batch.column(i).to_numpy() for i in (5, 6, 7))
            at = np.searchsorted(keys, (size << 47) + rank, side="right") - 1
            _, first_rank, bin_, each, offset = table[at].T
            into, nth = np.divmod(rank - first_rank, each)
            found = [pa.array((1 << 62) + bin_ + into), pa.array(offset + nth * size + inside)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], names=[*_ARROW.names[:7]])

    before = F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("part", "size", F.coalesce(before, F.lit(0)).alias("before"))
    if opened:
        items = ranked(rows, "length", ["bin", "offset"]).withColumn("inside", F.lit(0).cast("long"))
    else:
        heads = ranked(rows.filter("offset = 0"), "used", ["bin"]).select("bin", "size", "nth")
        items = rows.join(heads, "bin").withColumn("inside", F.col("offset"))
    placed = items.join(ranks, ["part", "size"])
    return placed.select(*_ARROW.names[:5], "size", (F.col("before") + F.col("nth")).alias("rank"), "inside").mapInArrow(task, _PLACED)


def pack(documents: DataFrame, length: int = LENGTH, end: int = END, vocabulary: str | None = None,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset): one per piece."""
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = written(encode_and_pack(docs, vocabulary or vocabulary_path(), length, end), "packed")
    placed = _ARROW.names[:7]
    open_ = rows.filter("NOT final")
    whole = merge_up(open_.filter("offset = 0").select("bin", "used"), docs.rdd.getNumPartitions(), length)
    moved = written(open_.drop("used", "final").join(whole, "bin").select(
        *placed[:5], F.col("into").alias("bin"), (F.col("offset") + F.col("shift")).alias("offset"), "final", "used"), "merged")
    done = rows.filter("final").select(*placed).unionByName(moved.filter("final").select(*placed)).unionByName(
        place_residue(moved.filter("NOT final"), length))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
