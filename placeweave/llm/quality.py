"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document's terms are the shapes of its words (case, leading and trailing marks), the words
themselves in hashed buckets, and how often words repeat. Term weights (log counts, inverse
document frequency) are projected on the leading singular vectors of a labelled sample. That
sample is the one thing that is bounded: `PER_LABEL` documents for each label, those with the
smallest hash of their id. Its vectors are broadcast, and every document is compared with all of
them in blocks. The `NEIGHBOURS` most similar vote with their similarity as weight.

Cases: a null or empty text has no terms and gets the share of label 1 in the sample, or 0.5
without labels. A row whose id is null is scored and counts as not held out. Labels that are
null, or that contradict each other for one id, are not learned. Repeated rows are each scored.
Documents that were held out (crc32 of the id as text, modulo 5, is 0) are never learned from.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHAPES, WORDS, STEPS = 512, 512, 11
TERMS = SHAPES + WORDS + 2 * STEPS
PER_LABEL = 2048
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
_SEEN = 250_000
_BLOCK = 1024


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


class _Codes(dict):
    """Word to its shape's and its own bucket, in one number."""

    def __missing__(self, word: str) -> int:
        core = word.strip("".join(c for c in set(word) if not c.isalnum()))
        head = word[: len(word) - len(word.lstrip("".join(c for c in set(word) if not c.isalnum())))]
        tail = word[len(head) + len(core):]
        case = ("none" if not core else "digit" if core.isdigit() else "lower" if core.islower() else
                "upper" if core.isupper() and len(core) > 1 else "title" if core[0].isupper() else "mixed")
        shape = zlib.crc32(f"{case} {head[:2]} {tail[:3]}".encode()) % SHAPES
        code = shape * WORDS + zlib.crc32(core.lower().encode()) % WORDS
        if len(word) <= 64:
            self[word] = code
        return code


def term_counts(text: str, codes: _Codes) -> np.ndarray:
    out = np.zeros(TERMS, np.float32)
    words = text.split()
    if not words:
        return out
    if len(codes) > _SEEN:
        codes.clear()
    found = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    out[:SHAPES] = np.bincount(found // WORDS, minlength=SHAPES)
    out[SHAPES:SHAPES + WORDS] = np.bincount(found % WORDS, minlength=WORDS)
    again = np.count_nonzero(found[1:] == found[:-1]) / len(words)
    fresh = len(set(words)) / len(words)
    # Rates weigh as much as the document is long, like the terms beside them.
    out[SHAPES + WORDS + int(again * (STEPS - 1) + 0.999)] = len(words)
    out[SHAPES + WORDS + STEPS + int(fresh * (STEPS - 1))] = len(words)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times inverse document frequency; shapes, words and rates each of unit length."""
    out = np.log1p(counts) * idf
    for a, b, weight in ((0, SHAPES, 1.0), (SHAPES, SHAPES + WORDS, 0.3), (SHAPES + WORDS, TERMS, 1.2)):
        part = out[:, a:b]
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        np.divide(part * weight, norm, out=part, where=norm > 0)
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        latent = weigh(counts, self.idf) @ self.axes
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 0)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Label 1's share of the neighbours' votes."""
        out = np.full(len(counts), self.prior)
        known = counts.any(axis=1)
        k = min(NEIGHBOURS, len(self.labels))
        if not k or not known.any():
            return out
        latent = self.embed(counts[known])
        scores = []
        for at in range(0, len(latent), _BLOCK):
            cosine = latent[at:at + _BLOCK] @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            votes = np.clip(np.take_along_axis(cosine, near, 1), 1e-6, None).astype(np.float64) ** SHARPNESS
            scores.append((votes * self.labels[near]).sum(1) / votes.sum(1))
        out[known] = np.clip(np.concatenate(scores), 0, 1)
        return out


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_label: int, id_column: str, text_column: str):
    """Rows (text, label) of the bounded sample, the same on every run."""
    agreed = (
        labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & ~held_out(id_column))
        .groupBy(F.col(id_column).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .filter("label = other").drop("other")
    )
    chosen = None
    for value in (0, 1):
        some = agreed.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    docs = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    # At most 2 * per_label rows, by the limits above.
    return docs.join(F.broadcast(chosen), "id").select("id", "text", "label")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL,
        dimensions: int = DIMENSIONS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on the sample: its term counts, 2 * per_label rows at most, come to the driver."""
    def task(batches):
        codes = _Codes()
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            rows = [term_counts(t, codes).astype("<f4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)],
                                             names=["id", "counts", "label"])

    sample = labelled_sample(documents, labels, label, per_label, id_column, text_column)
    # Ids may repeat in the documents: one text of each is enough.
    rows = (
        sample.groupBy("id").agg(F.min("text").alias("text"), F.first("label").cast("int").alias("label"))
        .mapInArrow(task, "id long, counts binary, label int").orderBy("id").collect()
    )
    return fit_counts(np.array([np.frombuffer(r["counts"], "<f4") for r in rows], np.float32).reshape(-1, TERMS),
                      np.array([r["label"] for r in rows], np.int64), dimensions)


def fit_counts(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    known = counts.any(axis=1)
    prior = float(labels.mean()) if len(labels) else 0.5
    counts, labels = counts[known], labels[known]
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    weights = weigh(counts, idf)
    values, vectors = np.linalg.eigh((weights.T @ weights).astype(np.float64))
    model = Model(idf, np.ascontiguousarray(vectors[:, ::-1][:, :dimensions], np.float32), np.zeros((0, dimensions), np.float32), labels, prior)
    model.vectors = model.embed(counts)
    return model


def score(documents: DataFrame, model: Model, text_column: str = "text", out: str = "quality_score") -> DataFrame:
    """The rows of `documents` with one more column, `out` (which replaces one of that name)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.drop(out)
    last = len(rows.columns)

    def task(batches):
        codes = _Codes()
        for batch in batches:
            texts = batch.column(last)
            scores = []
            for begin in range(0, len(texts), _BLOCK):
                counts = np.array([term_counts(t.as_py() or "", codes) for t in texts.slice(begin, _BLOCK)])
                scores.append(shared.value.score(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                                             names=[*batch.schema.names[:last], out])

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    return rows.select("*", F.col(text_column).cast("string").alias("__text_to_score")).mapInArrow(task, schema)
