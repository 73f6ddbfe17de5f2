"""Benchmark decontamination by a prefix-filtered set join (built-in Spark functions only).

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is 13
consecutive words of a benchmark item; an item of fewer words is one window. A window lies in a
document only if all its words do, so of its words, ordered by how rare they are in the corpus,
the first one is a sufficient prefix. Its occurrences, less its offset, are the only places
where the window can start; places that leave the document are cut off (position and length
bounds). The words found there are compared with the windows exactly.

Cases: null texts have no words. Items without words are skipped; the words of items without
an id are hit as well, but these are not listed. An item id that is listed several times has all
its texts. Documents that share an id are judged each on
its own text, and a null id is kept. Empty tables give no rows, or no hits. Columns other than
the id and the text are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import order_id

WINDOW = 13
# At most this many benchmark words or windows are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def benchmark_windows(benchmark: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """Rows (window, length, items): each distinct window with the ids of its items, if any has one."""
    words = (
        benchmark.select(F.col(id_column).cast("string").alias("item"), item_words(F.col(text_column)).alias("words"))
        .filter(F.size("words") > 0)
    )
    length = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    windows = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("words"))
    return windows.groupBy(F.array_join("words", " ").alias("window")).agg(
        F.collect_set("item").alias("items")).withColumn("length", F.size(F.split("window", " ")))


def word_positions(docs: DataFrame) -> DataFrame:
    words = docs.select("key", "tie", item_words(F.col("text")).alias("words"))
    return words.select("key", "tie", F.size("words").alias("n_words"), F.posexplode("words").alias("position", "word"))


def union_length(spans: Column) -> Column:
    """Number of places that (start, length) spans cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state, span):
        end = F.greatest(state["end"], span["start"] + span["length"])
        return F.struct(end.alias("end"), (state["n"] + end - F.greatest(state["end"], span["start"])).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add)["n"]


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20,
                  id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items, contaminated): a document is contaminated when
    words are hit and at least one in `share` of its words is."""
    docs = documents.select(
        F.col(id_column).alias("doc_id"), order_id(id_column).alias("key"),
        F.xxhash64(text_column).alias("tie"), F.col(text_column).cast("string").alias("text"))
    windows = benchmark_windows(benchmark, size, item_column, item_text)
    listed = windows.select("window", "length", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    vocabulary = listed.select("word").distinct()
    few = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)

    # Rarity: occurrences over the whole corpus. Words it lacks make their windows impossible.
    spread = docs.select(F.explode(item_words(F.col("text"))).alias("word"))
    if not few:  # one row per word before it meets the vocabulary
        counts = spread.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word")
    else:
        counts = spread.join(small(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = listed.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = (
        ranked.groupBy("window", "length").agg(F.min(F.struct("n", "word", "offset")).alias("first"))
        .filter("first.n > 0").select("length", F.col("first.word").alias("word"), F.col("first.offset").alias("offset"))
        .distinct()
    )
    places = (
        word_positions(docs).join(small(anchors), "word")
        .withColumn("start", F.col("position") - F.col("offset"))
        .filter("start >= 0 AND start + length <= n_words")
        .groupBy("key", "tie").agg(F.collect_set(F.struct("start", "length")).alias("places"))
    )
    # The texts are moved, and cut into words again where they arrive: the words would be longer.
    checked = (
        docs.select("key", "tie", "text").join(places, ["key", "tie"])
        .select("key", "tie", item_words(F.col("text")).alias("words"), "places")
        .select("key", "tie", "words", F.explode("places").alias("place"))
        .select("key", "tie", "place", F.array_join(
            F.slice("words", F.col("place.start") + 1, F.col("place.length")), " ").alias("window"))
    )
    hits = (
        checked.join(small(windows.select("window", "items")), "window")
        .groupBy("key", "tie").agg(
            F.collect_set("place").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select("key", "tie", union_length(F.col("spans")).alias("n_hit"), "items")
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        docs.select("doc_id", "key", "tie", F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
        .join(hits, ["key", "tie"], "left")
        .select("doc_id", "tie", "n_words", n_hit.alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )
