"""From raw documents to packed training sequences, in five stages.

Each stage is one operator of placeweave.llm and works on all that the stage before it kept.
Documents are told apart by id and a hash of their text; rows equal in both are one document, of
which the near-duplicate stage keeps one row. Null ids and texts pass through: a null text is
empty, gets the classifier's prior score and is packed as its end mark. Columns of any name pass
through unchanged; those that a stage adds for itself take names that the documents do not have.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import decontaminate, ngram_join, packing, quality, repeats
from placeweave.llm.common import drop_written, order_id, scratch, temporary, written
from placeweave.llm.registry import shipped

# The classifier and the rows of four stages cannot be stated in SQL: tests compare each stage
# with a brute-force version.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _without(docs: DataFrame, rows: DataFrame, once: bool = False) -> DataFrame:
    """Documents but for those of `rows` (doc_id, tie); with `once`, one row of each."""
    key, tie = _free(docs, "__document"), _free(docs, "__text")
    named = rows.select(order_id("doc_id").alias(key), F.col("tie").alias(tie)).distinct()
    marked = docs.withColumns({key: order_id("doc_id"), tie: F.xxhash64(F.col("text").cast("string"))})
    left = marked.join(named, [key, tie], "left_anti")
    return (left.dropDuplicates([key, tie]) if once else left).select(*_columns(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "__score")
    return quality.score(docs, model, out=score).filter(F.col(score) >= quality.THRESHOLD).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    return _without(docs, ngram_join.similar_documents(docs).filter("NOT first"), once=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word runs that occur earlier; untouched texts stay as they are."""
    out = tuple(_free(docs, name) for name in ("__kept", "__words", "__removed"))
    cut = F.col(out[2]) > 0
    changed = {"text": F.when(cut, F.col(out[0])).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(out[0]).cast("long")).otherwise(F.col("n_chars"))
    return repeats.remove_repeats(docs, out=out).withColumns(changed).select(*_columns(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", shipped(quality_classifier)),
    ("near_duplicates", shipped(near_duplicates)),
    ("repeats", shipped(substring_dedup)),
    ("decontamination", shipped(benchmark_decontamination)),
    ("packing", shipped(best_fit_packing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's input. What a
    stage wrote on its way, and its input, are removed once it is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with temporary(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            drop_written(before)
        before = docs
    return docs
