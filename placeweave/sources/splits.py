"""Readers of large single files whose rows may hold line breaks: tasks read ranges of bytes, and what
a range has to know of those before it is summed up per range first.

A file is read as pieces between separators (line breaks, closing braces). Whether a piece begins
inside quotes, and how deep it is nested, depends on everything before it. Each range (`block`)
counts both ways, as if it began outside or inside quotes; a running sum over the ranges of a file, one
row each, tells which of the two it is. Pieces that make up one row are then put together. Nothing
larger than a range of bytes or one row of the result is in one place.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.operators.skew import cut_lineage, lookup_join

_BLOCK = ["file", "block"]


def _in_block(last: int):
    """From the beginning of a block to the piece before (-1) or to the piece itself (0)."""
    return Window.partitionBy(*_BLOCK).orderBy("line").rowsBetween(Window.unboundedPreceding, last)


def _blocks_before():
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def pieces(spark: SparkSession, path, separator: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(file, block, line, value): text between separators; `line` grows along a block."""
    reader = spark.read.option("lineSep", separator)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def _count(text, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _sum(c, window) -> Column:
    return F.coalesce(F.sum(c).over(window), F.lit(0))


def csv_blocks(lines: DataFrame) -> DataFrame:
    """One row per block: whether it begins inside quotes, the rows that begin before it, and the
    header where it is a file's first."""
    narrow = lines.select(*_BLOCK, "line", _count(F.col("value"), '"').alias("quotes"), F.when(F.col("block") == 0, F.col("value")).alias("value"))
    placed = narrow.withColumn("odd", _sum(F.col("quotes"), _in_block(-1)) % 2)
    placed = placed.withColumn("row", F.sum(F.when(F.col("odd") == 0, 1).otherwise(0)).over(_in_block(0)))
    head = F.sort_array(F.collect_list(F.when((F.col("block") == 0) & (F.col("row") == 1), F.struct("line", "value"))))
    totals = placed.groupBy(*_BLOCK).agg(
        (F.sum("quotes") % 2).alias("quotes"), F.count(F.when(F.col("odd") == 0, 1)).alias("outside"),
        F.count(F.when(F.col("odd") == 1, 1)).alias("inside"), F.array_join(F.transform(head, lambda p: p["value"]), "\n").alias("header"))
    begun = totals.withColumn("begins_inside", _sum(F.col("quotes"), _blocks_before()) % 2)
    rows = F.when(F.col("begins_inside") == 0, F.col("outside")).otherwise(F.col("inside"))
    counted = begun.withColumn("rows", rows).withColumn("rows_before", _sum(F.col("rows"), _blocks_before()))
    return counted.select(*_BLOCK, "begins_inside", "rows_before", F.regexp_replace("header", "\r$", "").alias("header"))


def csv_rows(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, row, block, value): the text of every row of every file, numbered from 1, the header
    included. `block` is where it begins."""
    placed = lookup_join(lines, blocks.drop("header"), _BLOCK, "line").withColumn("quotes", _count(F.col("value"), '"'))
    odd = (F.col("begins_inside") + _sum(F.col("quotes"), _in_block(-1))) % 2
    starts = placed.withColumn("starts", F.when(odd == 0, 1).otherwise(0))
    row = F.col("rows_before") + F.sum("starts").over(_in_block(0))
    parts = starts.select("file", row.alias("row"), F.struct("block", "line", "value").alias("part"))
    whole = parts.groupBy("file", "row").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    value = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return whole.select("file", "row", F.get("parts", F.lit(0))["block"].alias("block"), F.regexp_replace(value, "\r$", "").alias("value"))


def read_csv_splits(spark: SparkSession, path, names, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """The named columns of CSV files as text, and `seq` (file, block, line), the place of each row. One
    file is read by many tasks, whatever its quoted fields hold. Columns go by each file's own
    header; a file that lacks one has nulls."""
    lines = pieces(spark, path, "\n", recursive, pattern)
    blocks = cut_lineage(csv_blocks(lines))
    heads = blocks.filter("block = 0").select("file", "header")
    width = heads.agg(F.max(_count(F.col("header"), ",") + 1)).first()[0] or 1
    schema = ", ".join(f"c{k} string" for k in range(width))
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}

    def fields(text):
        parsed = F.from_csv(text, schema, options)
        return F.array(*[parsed[f"c{k}"] for k in range(width)])

    rows = csv_rows(lines, blocks).filter("row > 1 AND value <> ''")
    named = lookup_join(rows, heads.select("file", fields("header").alias("names")), "file", "row")
    split = named.withColumn("fields", fields("value"))
    place = F.struct("file", "block", F.col("row").alias("line"))
    return split.select(*[
        F.get("fields", F.nullif(F.coalesce(F.array_position("names", n), F.lit(0)).cast("int"), F.lit(0)) - 1).alias(n) for n in names
    ], place.alias("seq"))


_STRING = r'"(?:[^"\\]++|\\.)*+"'


def _json_counts(value) -> dict[str, Column]:
    """Quotes of a piece, and the braces that it opens if it begins outside or inside a string."""
    plain = F.regexp_replace(value, r"(?s)\\.", "")
    rest = F.regexp_replace(plain, r'^[^"]*+(?:"|\z)', "")
    outside, inside = (F.regexp_replace(t, r'"[^"]*+(?:"|\z)', "") for t in (plain, rest))
    return {"quotes": _count(plain, '"'), "opens0": _count(outside, "{"), "opens1": _count(inside, "{")}


def _depths(parts: DataFrame) -> DataFrame:
    """Pieces with the depth behind them (`depth0`, `depth1`), counted from their block's beginning,
    if that lies outside or inside a string. The brace that ends a piece counts unless it is in one."""
    counted = parts.withColumns(_json_counts(F.col("value"))).withColumn("odd", _sum(F.col("quotes"), _in_block(-1)) % 2)
    for k in (0, 1):
        begins = (F.col("odd") + k) % 2
        ends = (begins + F.col("quotes")) % 2
        change = F.when(begins == 0, F.col("opens0")).otherwise(F.col("opens1")) - F.when(ends == 0, 1).otherwise(0)
        counted = counted.withColumn(f"change{k}", change)
    return counted.withColumns({f"depth{k}": F.sum(f"change{k}").over(_in_block(0)) for k in (0, 1)})


def json_blocks(parts: DataFrame) -> DataFrame:
    """One row per block: whether it begins inside a string, the depth there, and the last piece before
    it that ends an object of the outermost list (`cut`)."""
    placed = _depths(parts)
    lowest = [F.min(F.struct(F.col(f"depth{k}"), (-F.col("line")).alias("line"))).alias(f"low{k}") for k in (0, 1)]
    totals = placed.groupBy(*_BLOCK).agg(
        (F.sum("quotes") % 2).alias("quotes"), F.sum("change0").alias("change0"), F.sum("change1").alias("change1"), *lowest)
    begun = totals.withColumn("begins_inside", _sum(F.col("quotes"), _blocks_before()) % 2)
    outside = F.col("begins_inside") == 0
    known = begun.withColumns({
        "change": F.when(outside, F.col("change0")).otherwise(F.col("change1")),
        "low": F.when(outside, F.struct(F.col("low0.depth0").alias("depth"), F.col("low0.line").alias("line"))).otherwise(
            F.struct(F.col("low1.depth1").alias("depth"), F.col("low1.line").alias("line")))})
    deep = known.withColumn("depth_before", _sum(F.col("change"), _blocks_before()))
    # Inside the outermost object the depth is 1 at least, so a block's lowest piece is a cut or there is
    # none; behind its end nothing follows that matters.
    cut = F.when(F.col("depth_before") + F.col("low.depth") <= 1, F.struct("block", (-F.col("low.line")).alias("line")))
    return deep.withColumn("own", cut).select(
        *_BLOCK, "begins_inside", "depth_before", F.last("own", ignorenulls=True).over(_blocks_before()).alias("cut"))


def json_objects(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, value): the text of every object directly below the outermost one, or in a list there."""
    known = lookup_join(parts, blocks, _BLOCK, "line")
    placed = _depths(known)
    depth = F.col("depth_before") + F.when(F.col("begins_inside") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    marked = placed.withColumn("ends", F.when(depth == 1, F.struct("block", "line")))
    nothing = F.struct(F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("line"))
    of = F.coalesce(F.last("ends", ignorenulls=True).over(_in_block(-1)), F.col("cut"), nothing)
    grouped = marked.select("file", of.alias("of"), F.struct("block", "line", "value").alias("part")).groupBy("file", "of").agg(
        F.sort_array(F.collect_list("part")).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    # What stands before an object's brace: signs and names; before the first one the outermost brace too.
    before = rf'(?s)^(?:[^{{"]++|{_STRING})*+'
    first = F.when(F.col("of.line") == -1, F.regexp_replace(text, before + r"\{", "")).otherwise(text)
    return grouped.select("file", F.regexp_replace(first, before, "").alias("value")).filter("value <> '' AND value <> '}'")


def read_json_objects(spark: SparkSession, path) -> DataFrame:
    """(file, value) of every object in the lists of JSON files, each of which is one object. One file
    is read by many tasks, on one line or on many."""
    parts = pieces(spark, path, "}")
    return json_objects(parts, cut_lineage(json_blocks(parts)))
