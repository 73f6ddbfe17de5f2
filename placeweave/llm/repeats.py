"""Substring dedup by recompression: runs of words that occur earlier are removed.

A window is 20 consecutive words. Of all windows with the same words the earliest stays (smaller
document id, then earlier start); the words that any later one covers are removed. Windows are
judged on the input.

Words are recompressed in rounds: runs of equal symbols get a name, then pairs whose left symbol
is of one half of the alphabet and whose right one is of the other. A name is a hash of what it
stands for, and so are the halves: names are global without a table of them, equal words get
equal symbols in every task, and a round needs no exchange. Inside equal windows the rounds cut
equal phrases, except near the ends, where the neighbours outside have a say; how far they have is
known from the window alone. `JOINED` neighbouring phrases that are safe in a window are one symbol of
a higher level, a pair of pairs, about seven words long, and the smallest of these names is the
window's anchor. Anchors are what Spark groups: windows whose anchor occurs only once in the corpus
are unique. A name that several documents of a chunk have is known to be repeated there, and only
one of them goes on to meet the rest of the corpus. Windows with a repeated anchor are then named
whole (96 bits, pairs of pairs of words), shuffled by that name and ranked; of those that a chunk
has several times only the first is, and the others leave it as spans.

Documents whose words are all equal are one node throughout: the first keeps its words as far as
they are not repeated, and of the others nothing of 20 words or more stays.

Cases: a null text has no words. Rows are documents of their own: those that share an id are
ordered by a hash of their text, rows equal in both are the same document, and a null id comes
last. Texts of fewer than 20 words are left alone. Empty tables give no rows. All columns are
passed on; the three that are added replace columns of their names.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placeweave.llm.common import order_id, written
from placeweave.llm.shingles import WordHashes, join, mix, windows

SIZE = 20
ROUNDS = 2
# Neighbouring phrases that an anchor's name stands for: a power of two.
JOINED = 4
# Words that are recompressed together, when anchors are found and when windows are named.
CHUNK, NAMED_CHUNK = 100_000, 400_000

_RUN = np.uint64(0xD6E8FEB86659FD93)


class Parse:
    """The phrases of a chunk of documents after some rounds, with what is safe in a window."""

    def __init__(self, hashes: np.ndarray, begins: np.ndarray, size: int):
        """`begins`: where documents begin in `hashes`, and the end."""
        n = self._count = len(hashes)
        self._cut(np.arange(n), mix(hashes))
        self._barrier = np.zeros(n + 1, bool)
        self._barrier[begins] = True
        last = np.repeat(begins[1:], np.diff(begins))
        whole = np.arange(n) + size <= last  # windows inside one document
        self.windows = np.flatnonzero(whole)
        self.low, self.high = self.windows.copy(), self.windows + size
        # Without a whole phrase between them, the bounds of a window tell nothing any more.
        self.safe = np.ones(len(self.windows), bool)
        for k in range(ROUNDS):
            self._runs()
            self.safe &= self.low < self.high
            self._pairs(np.uint64(k + 1))
            self.safe &= self.low < self.high

    def _cut(self, starts: np.ndarray, names: np.ndarray) -> None:
        self.starts, self.names = starts, names
        marks = np.zeros(self._count + 2, np.int64)
        marks[starts + 1] = 1
        # Number of phrases that begin before each position.
        self.before = np.cumsum(marks)

    def _following(self, x: np.ndarray) -> np.ndarray:
        """The first phrase bound after each position."""
        bounds = np.append(self.starts, self._count)
        return bounds[np.minimum(self.before[x + 1], len(self.starts))]

    def _containing(self, x: np.ndarray) -> np.ndarray:
        """The phrase that has each position."""
        return self.before[x + 1] - 1

    def _runs(self) -> None:
        head = np.ones(len(self.names), bool)
        head[1:] = (self.names[1:] != self.names[:-1]) | self._barrier[self.starts[1:]]
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(head)))
        names = self.names[at]
        self._cut(self.starts[at], np.where(length > 1, mix(names + length.astype(np.uint64) * _RUN), names))
        # The run at either end of a window may go on outside it.
        self.low = self._following(self.low)
        self.high = self.starts[self._containing(self.high - 1)]

    def _pairs(self, seed: np.uint64) -> None:
        right = (mix(self.names + seed) >> np.uint64(63)).astype(bool)
        # A left symbol at the window's end, or a right one at its start, may pair outside.
        first = self._containing(np.minimum(self.low, self._count - 1))
        after = self._following(self.low)
        self.low = np.where(right[first], after, self.low)
        final = self._containing(self.high - 1)
        self.high = np.where(right[final], self.high, self.starts[final])
        pair = np.zeros(len(right), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~self._barrier[self.starts[1:]]
        second = np.append(False, pair[:-1])
        names = self.names.copy()
        at = np.flatnonzero(pair)
        names[at] = join(self.names[at], self.names[at + 1], int(seed))
        self._cut(self.starts[~second], names[~second])


def _smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Position of the first smallest value in each range [low, high), all of them not empty."""
    width = high - low
    tables = [np.arange(len(values))]
    while (1 << len(tables)) <= int(width.max(initial=1)):
        before, step = tables[-1], 1 << (len(tables) - 1)
        other = before[np.minimum(np.arange(len(before)) + step, len(before) - 1)]
        tables.append(np.where(values[other] < values[before], other, before))
    level = np.frexp(width.astype(float))[1] - 1
    table = np.stack(tables)
    a, b = table[level, low], table[level, high - (1 << level)]
    return np.where(values[b] < values[a], b, a)


def anchors(hashes: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a chunk: its start, its anchor's position and its anchor's name."""
    parse = Parse(hashes, begins, size)
    # Phrase i and its neighbours to the right, as one symbol.
    names = windows(parse.names, JOINED, seed=7)
    bounds = parse.starts
    order = mix(names)
    low = np.minimum(parse.before[parse.low], len(names))
    # Whole phrases only: the last one of a symbol ends where what is safe ends.
    high = np.minimum(parse.before[parse.high] - (JOINED - 1), len(names))
    position, name = parse.windows.copy(), np.zeros(len(parse.windows), np.uint64)
    safe = parse.safe & (high > low)
    chosen = _smallest(order, low[safe], high[safe])
    position[safe], name[safe] = bounds[chosen], names[chosen]
    # Without so many safe phrases, as inside a long run, the window is its own anchor.
    own = ~safe
    if own.any():
        name[own] = windows(hashes, size, seed=13)[parse.windows[own]]
    return parse.windows, position, name


def chunks(batches, text_column: int, seen: WordHashes, most: int):
    """Batches in chunks: (batch, first row, word hashes, where documents begin)."""
    for batch in batches:
        texts, first, parts, total = batch.column(text_column), 0, [], 0
        for i in range(len(texts)):
            parts.append(seen.of((texts[i].as_py() or "").encode("utf-8", "replace").split()))
            total += len(parts[-1])
            if total >= most or i == len(texts) - 1:
                begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                yield batch, first, np.concatenate(parts), begins
                first, parts, total = i + 1, [], 0


def scan(docs: DataFrame, size: int) -> DataFrame:
    """Rows (key, tie, n, node, proof, names, again, shared): all documents' words as two hashes, and the
    names of the document's anchors: those that it has once, those that are known to be repeated and
    that others have to learn of, and those that another document of the chunk makes known. Of equal
    documents in a task the first has the names."""
    def task(batches):
        seen, known = WordHashes(), set()
        for batch, first, hashes, begins in chunks(batches, 2, seen, CHUNK):
            count = len(begins) - 1
            sizes = np.diff(begins)
            prints = [hashes[begins[i]:begins[i + 1]].tobytes() for i in range(count)]
            nodes = [xxhash.xxh3_64_intdigest(p, seed=1) - (1 << 63) for p in prints]
            proofs = [xxhash.xxh3_64_intdigest(p, seed=2) - (1 << 63) for p in prints]
            names, again, shared = [[]] * count, [[]] * count, [[]] * count
            if len(hashes) >= size:
                start, position, name = anchors(hashes, begins, size)
                # Windows that follow each other mostly share their anchor.
                fresh = np.append(True, position[1:] != position[:-1])
                start, position, name = start[fresh], position[fresh], name[fresh]
                doc = np.searchsorted(begins, start, "right") - 1
                order = np.lexsort((position, name, doc))
                doc, name, position = doc[order], name[order], position[order]
                head = np.append(True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1]))
                moved = np.append(False, ~head[1:] & (position[1:] != position[:-1]))
                often = np.add.reduceat(moved, np.flatnonzero(head)) > 0
                doc, name = doc[head], name[head].view(np.int64)
                cut = np.searchsorted(doc, np.arange(count + 1))
                fresh = np.zeros(count, bool)
                for i in np.flatnonzero(np.diff(cut)):
                    if (nodes[i], proofs[i]) not in known:
                        known.add((nodes[i], proofs[i]))
                        fresh[i] = True
                # Of the documents that have a name the first tells the rest of the corpus.
                doc, name, often = (x[fresh[doc]] for x in (doc, name, often))
                _, first_at, which, total = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
                often |= total[which] > 1
                told = np.ones(len(name), bool)
                told[total[which] > 1] = False
                told[first_at] = True
                cut = np.searchsorted(doc, np.arange(count + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    mine, twice, tells = (x[cut[i]:cut[i + 1]] for x in (name, often, told))
                    names[i], again[i], shared[i] = mine[~twice], mine[twice & tells], mine[~tells]
            rows = batch.slice(first, count)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(proofs, pa.int64()), pa.array(names, longs), pa.array(again, longs), pa.array(shared, longs)],
                names=["key", "tie", "n", "node", "proof", "names", "again", "shared"])

    return docs.select("key", "tie", "text").mapInArrow(
        task, "key long, tie long, n long, node long, proof long, names array<long>, again array<long>, shared array<long>")


def repeated_names(rows: DataFrame) -> DataFrame:
    """Rows (node, names): the anchors of a node that other nodes have too, or it itself again."""
    def told(column, again):
        return F.transform(column, lambda name: F.struct(name.alias("name"), F.lit(again).alias("again")))

    found = rows.select("node", F.explode(F.concat(told("names", False), told("again", True))).alias("anchor")).select("node", "anchor.*")
    near = Window.partitionBy("name").orderBy("node")
    beside = found.select("node", "name", "again", F.lag("node").over(near).alias("a"), F.lead("node").over(near).alias("b"))
    met = beside.filter("again OR a <> node OR b <> node").select("node", "name")
    known = rows.select("node", F.explode("shared").alias("name"))
    return met.unionByName(known).groupBy("node").agg(F.collect_set("name").alias("names"))


def shared_windows(docs: DataFrame, size: int) -> DataFrame:
    """Rows (key, tie, start, length, name, proof, known) of the windows with a repeated anchor;
    docs: key, tie, text, names and others. Of a window that a chunk has several times only the
    first is named; the others are known to be repeats and are given as spans."""
    names_at, text_at = docs.columns.index("names"), docs.columns.index("text")

    def task(batches):
        seen = WordHashes()
        for batch, first, hashes, begins in chunks(batches, text_at, seen, NAMED_CHUNK):
            if len(hashes) < size:
                continue
            rows = batch.slice(first, len(begins) - 1)
            wanted = np.unique(rows.column(names_at).flatten().to_numpy().view(np.uint64))
            start, _, name = anchors(hashes, begins, size)
            start = start[np.isin(name, wanted)]
            if not len(start):
                continue
            key, tie = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            doc = np.searchsorted(begins, start, "right") - 1
            at = start - begins[doc]
            whole, proof = windows(hashes, size, seed=3)[start], windows(hashes, size, seed=5)[start] >> np.uint64(32)
            order = np.lexsort((at, tie[doc], key[doc], proof, whole))
            whole, proof, doc, at = whole[order], proof[order], doc[order], at[order]
            same = np.zeros(len(order), bool)
            same[1:] = (whole[1:] == whole[:-1]) & (proof[1:] == proof[:-1])
            # Rows that repeat a document are that document.
            group = np.cumsum(~same) - 1
            lead = np.flatnonzero(~same)[group]
            same &= (key[doc] != key[doc[lead]]) | (tie[doc] != tie[doc[lead]]) | (at != at[lead])
            # Repeats in spans of starts that follow each other.
            later = np.lexsort((at[same], doc[same]))
            rdoc, rat = doc[same][later], at[same][later]
            begin = np.ones(len(rdoc), bool)
            begin[1:] = (rdoc[1:] != rdoc[:-1]) | (rat[1:] > rat[:-1] + size)
            heads = np.flatnonzero(begin)
            tails = np.append(heads[1:], len(rdoc)) - 1 if len(heads) else heads
            sdoc, sat, slen = rdoc[heads], rat[heads], rat[tails] + size - rat[heads]
            lead = ~same
            docs_ = np.concatenate([doc[lead], sdoc])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[docs_]), pa.array(tie[docs_]), pa.array(np.concatenate([at[lead], sat]).astype(np.int32)),
                 pa.array(np.concatenate([np.full(lead.sum(), size), slen]).astype(np.int32)),
                 pa.array(np.concatenate([whole[lead].view(np.int64), key[sdoc]])),
                 pa.array(np.concatenate([proof[lead].astype(np.int64), sat])),
                 pa.array(np.concatenate([np.zeros(lead.sum(), bool), np.ones(len(sdoc), bool)]))],
                names=["key", "tie", "start", "length", "name", "proof", "known"])

    return docs.mapInArrow(task, "key long, tie long, start int, length int, name long, proof long, known boolean")


def _apply(docs: DataFrame) -> DataFrame:
    """Docs with kept, n_words and n_removed from their spans."""
    names = [c for c in docs.columns if c != "spans"]
    text_at, spans_at, kept_at = docs.columns.index("text"), docs.columns.index("spans"), [docs.columns.index(c) for c in names]

    def task(batches):
        for batch in batches:
            kept, total, removed = [], [], []
            for text, spans in zip(batch.column(text_at), batch.column(spans_at), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                total.append(len(words))
                if spans.is_valid:
                    gone = np.zeros(len(words), bool)
                    for span in spans.as_py():
                        gone[span["start"]:span["start"] + span["length"]] = True
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept_at], pa.array(kept, pa.string()),
                 pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "kept", "n_words", "n_removed"])

    kinds = {"kept": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType()}
    return docs.mapInArrow(task, T.StructType(
        [f for f in docs.schema.fields if f.name != "spans"] + [T.StructField(n, t) for n, t in kinds.items()]))


def remove_repeats(documents: DataFrame, size: int = SIZE, id_column: str = "doc_id", text_column: str = "text",
                   out: tuple[str, str, str] = ("kept", "n_words", "n_removed")) -> DataFrame:
    """The documents with three more columns: the words that stay, joined by one space, and the
    numbers of all and of removed words."""
    others = [c for c in documents.columns if c not in out]
    wrapped = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    docs = documents.select(
        order_id(id_column).alias("key"), F.xxhash64(F.col(text_column).cast("string")).alias("tie"),
        F.col(text_column).cast("string").alias("text"), wrapped)
    docs = docs.withColumn("row", F.col("row").dropFields(text_column)) if len(others) > 1 else docs.withColumn("row", F.lit(None).cast("string"))
    rows = written(scan(docs, size), "anchors")
    long_enough = rows.filter(F.col("n") >= size)
    firsts = long_enough.groupBy("node", "proof").agg(F.min(F.struct("key", "tie")).alias("first"))
    names = written(repeated_names(rows), "repeated")
    wanted = firsts.join(names, "node").select("first.key", "first.tie", "names")
    shared = shared_windows(docs.join(wanted, ["key", "tie"]), size)
    ranked = shared.withColumn("rank", F.rank().over(Window.partitionBy("name", "proof", "known").orderBy("key", "tie", "start")))
    repeats = ranked.filter("known OR rank > 1").select("key", "tie", "start", "length")
    copies = (
        long_enough.select("key", "tie", "node", "proof", "n").join(firsts, ["node", "proof"])
        .filter(F.struct("key", "tie") != F.col("first")).select("key", "tie", F.lit(0).alias("start"), F.col("n").cast("int").alias("length"))
    )
    spans = repeats.unionByName(copies).groupBy("key", "tie").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    done = _apply(docs.join(spans, ["key", "tie"], "left"))
    columns = [F.col("text").cast(documents.schema[c].dataType).alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in others]
    return done.select(*columns, *[F.col(a).alias(b) for a, b in zip(("kept", "n_words", "n_removed"), out, strict=True)])
