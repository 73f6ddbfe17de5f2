"""Personal data in texts: rules first, and a boosted judge of what the rules leave.

Base spans are the leftmost matches of a rule per kind (`RULES`) that pass its check. They always
stay. The method adds to them:

* High-recall generators propose overlapping candidates: every window of neighbouring groups of
  digits that could be a card, a telephone or (dotted) an address; whatever has an at sign, or one
  spelt out, between words; colon-separated hexadecimal groups.
* Boosted trees judge a candidate by its format (digits, groups, separators, check sum, parts,
  domain) and its context (neighbouring characters, digits and cue words), one model for each kind.
  They learn from the texts themselves: base spans are examples, candidates that overlap one without
  being it or that fail the kind's check are counter-examples, and the others are what is asked for.
* The trees' margins are calibrated on documents that they have not seen (crc32 of the id modulo 5 is
  0), and the least probability at which PRECISION of the candidates there are base spans is the
  threshold. Of candidates above it the most probable ones that overlap no chosen span are added.

All documents are learnt from, each row as often as it occurs: trees, calibration and thresholds come
from sums and counts over all candidates whose class is known (`boosting.fit_rows`). Every whole text is
searched. Each rule reads a text once, whatever it holds.

Cases: a null or empty text has no spans. A null id is a document like others. Repeated rows are each
searched. A kind without examples adds nothing; an empty table gives no rows. Spans are in code
points, end exclusive, sorted by kind as listed and start. Other columns are not read by `find_spans`;
`redact` keeps them and replaces the text.
"""

import re
from bisect import bisect_left, insort
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm import boosting
from placeweave.llm.common import drop_written, written

KINDS = ("email", "ip", "card", "phone")
# Candidates with different features in one task, about, when trees are fitted.
FIT_ROWS = 50_000
PRECISION = 0.99
# A kind needs so many examples and counter-examples, on either side of the split.
_LEAST = 8

# The characters of the rules.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can begin inside a number that it could have begun before.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def small_parts(s: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def _emails(text: str):
    free = 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all matches of the rules that pass."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if small_parts(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# Groups of digits, and what may stand between two of one number.
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[ ().-]{1,3}")
_AT = re.compile(r"[@＠]|[\[({]at[\])}]| dot ")
_SPELT = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?(?:[\[({]at[\])}]|@|＠| at ) ?([A-Za-z0-9-]{1,63}(?: ?(?:[\[({]dot[\])}]|\.| dot ) ?[A-Za-z0-9-]{1,63}){0,5})")
_HEX = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])")
_MOST_DIGITS = 19


def _number_windows(text: str):
    """Windows of neighbouring groups with 7 to 19 digits: (start, end, digits, groups, separators)."""
    row = []
    for m in _GROUP.finditer(text):
        if row and not _BETWEEN.fullmatch(text, row[-1][1], m.start()):
            row = []
        if m.end() - m.start() > _MOST_DIGITS:
            row = []
            continue
        row.append((m.start(), m.end()))
        total, k = 0, len(row) - 1
        while k >= 0 and total + row[k][1] - row[k][0] <= _MOST_DIGITS:
            total += row[k][1] - row[k][0]
            # A shorter run of dotted parts may be an address.
            if total >= 7 or len(row) - k == 4:
                yield row[k][0], m.end(), row[k:]
            k -= 1
        if len(row) > _MOST_DIGITS:
            row = row[1:]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of everything that may be personal data; they overlap."""
    out = set()
    if _AT.search(text):
        out.update((0, m.start(), m.end()) for m in _SPELT.finditer(text) if _AT.search(m.group()))
    if text.count(":") > 2:
        out.update((1, m.start(), m.end()) for m in _HEX.finditer(text) if _DIGIT.search(m.group()))
    if not _DIGIT.search(text):
        return sorted(out)
    for a, b, groups in _number_windows(text):
        digits = sum(y - x for x, y in groups)
        between = {text[y:z] for (_, y), (z, _) in zip(groups, groups[1:], strict=False)}
        if len(groups) == 4 and between == {"."}:
            out.add((1, a, b))
        if digits >= 13:
            out.add((2, a, b))
        if 7 <= digits <= 15:
            start = a - 1 if a and text[a - 1] in "+(" else a
            if start and text[start] == "(" and text[start - 1] == "+":
                start -= 1
            out.add((3, start, b))
    return sorted(out)


# Words that go with a kind, and words that go with other numbers.
_CUES = (
    frozenset("mail email e-mail contact write address".split()),
    frozenset("ip host server address ping from client".split()),
    frozenset("card visa mastercard amex credit debit payment pan".split()),
    frozenset("tel phone telephone call fax mobile cell whatsapp sms".split()),
)
_OTHER = frozenset("version order id invoice token key isbn serial page no number release build ref".split())
_CONTEXT = 40
_WORD = re.compile(r"[A-Za-z][A-Za-z-]*")
N_FEATURES = 28


def _side(c: str) -> int:
    """What kind of character stands beside a span."""
    if not c:
        return 0
    if c.isspace():
        return 1
    if c.isdigit():
        return 5
    if c.isalpha():
        return 4
    return 3 if c in "+-.:/@=_#" else 2


def features(text: str, kind: int, a: int, b: int) -> list[float]:
    span = text[a:b]
    digits = _digits(span)
    groups = [m.end() - m.start() for m in _GROUP.finditer(span)]
    before, after = text[max(0, a - _CONTEXT):a], text[b:b + _CONTEXT]
    words = [w.lower() for w in _WORD.findall(before)[-3:]]
    domain = re.split(r"@|＠|\bat\b", span)[-1] if kind == 0 else ""
    labels = [p for p in re.split(r"[^A-Za-z0-9-]+", domain) if p]
    parts = [p.lstrip("0") for p in span.split(".")] if kind == 1 else []
    largest = max((int(p) if p.isdigit() and len(p) < 5 else 0 if not p else 9999 for p in parts), default=0)
    return [
        b - a, len(digits), len(groups), float(luhn(digits)) if digits else 0.0, max(groups, default=0), min(groups, default=0),
        len(set(re.findall(r"[^0-9A-Za-z]", span))), "+" in span, "(" in span, _side(before[-1:]), _side(after[:1]),
        any(c.isdigit() for c in before[-2:]), any(c.isdigit() for c in after[:2]), largest, span.count("."),
        any(len(p) > 1 and p[0] == "0" for p in span.split(".")), "@" in span, len(labels), len(labels[-1]) if labels else 0,
        bool(labels) and labels[-1].isalpha(), span.find("@"), int(digits[0]) if digits else -1,
        len(set(digits)) / len(digits) if digits else 0, any(w in _CUES[kind] for w in words), any(w in _OTHER for w in words),
        before.rstrip()[-1:] in ("=", '"', "'"), span.count(":"), len(before) - len(before.rstrip("0123456789abcdefABCDEF")),
    ]


def _fails(text: str, kind: int, a: int, b: int) -> bool:
    """Does a candidate fail the check of its kind?"""
    span = text[a:b]
    digits = _digits(span)
    if kind == 0:
        return "." not in span and "dot" not in span
    if kind == 1:
        return ":" not in span and not small_parts(span)
    if kind == 2:
        return not luhn(digits) or len(set(digits)) == 1
    return not 8 <= len(digits) <= 15


def examples(text: str) -> list[tuple[int, int, int, list[float]]]:
    """(kind, class, start, features) of the candidates whose class is known."""
    base = base_spans(text)
    known, taken, out = set(base), _Taken(base), []
    for kind, a, b in sorted({*candidates(text), *base}):
        if (kind, a, b) in known:
            out.append((kind, 1, a, features(text, kind, a, b)))
        elif taken.meets(a, b) or _fails(text, kind, a, b):
            out.append((kind, 0, a, features(text, kind, a, b)))
    return out


@dataclass
class Judge:
    """Models and thresholds by kind; a kind without one adds nothing."""

    models: dict
    thresholds: dict

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Candidates chosen beside the base spans, with their probabilities."""
        taken = _Taken(base)
        left = [c for c in candidates(text) if c[0] in self.models and not taken.meets(c[1], c[2])]
        if not left:
            return []
        scored = []
        for kind, model in self.models.items():
            mine = [c for c in left if c[0] == kind and not _fails(text, *c)]
            if mine:
                p = model.probability(np.array([features(text, *c) for c in mine], np.float64))
                scored += [(-x, c) for x, c in zip(p, mine, strict=True) if x >= self.thresholds[kind]]
        out = []
        for minus, (kind, a, b) in sorted(scored):
            if not taken.meets(a, b):
                out.append((kind, a, b, -minus))
                taken.add(a, b)
        return out


class _Taken:
    """Stretches that are taken: spans of the rules, which may overlap, and chosen ones, which don't."""

    def __init__(self, spans):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts, self.reach = [a for a, _ in ordered], list(accumulate((b for _, b in ordered), max))
        self.chosen = []

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        if k and self.reach[k - 1] > a:
            return True
        k = bisect_left(self.chosen, (b, 0))
        return k > 0 and self.chosen[k - 1][1] > a

    def add(self, a: int, b: int) -> None:
        insort(self.chosen, (a, b))


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, precision: float = PRECISION) -> Judge:
    """Models from all documents. The driver gets sums by node, feature and bin, and counts by margin."""
    def task(batches):
        for batch in batches:
            rows = [(late, *e) for late, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) if t for e in examples(t)]
            if rows:
                late, kind, label, _, values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(late, pa.bool_()), pa.array(kind, pa.int32()), pa.array(label, pa.int32()),
                     pa.array([np.array(v, "<f8").tobytes() for v in values], pa.binary())],
                    names=["held_out", "kind", "label", "features"])

    texts = documents.select(held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(task, "held_out boolean, kind int, label int, features binary")
    # Candidates with equal features are one row, which counts as many.
    rows = written(found.groupBy("held_out", "kind", "label", "features").agg(F.count(F.lit(1)).alias("n")), "private-examples")
    counts = {(late, kind, label): (n, different) for late, kind, label, n, different in rows.groupBy("held_out", "kind", "label").agg(
        F.sum("n"), F.count(F.lit(1))).collect()}
    kinds = [k for k in range(len(KINDS)) if all(counts.get((late, k, label), (0, 0))[0] >= _LEAST for late in (False, True) for label in (0, 1))]
    if not kinds:
        return Judge({}, {})
    early = rows.filter(~F.col("held_out") & F.col("kind").isin(kinds))
    cuts = boosting.quantiles(early, N_FEATURES)
    shares = {k: counts[False, k, 1][0] / (counts[False, k, 0][0] + counts[False, k, 1][0]) for k in kinds}
    tasks = 1 + sum(counts[False, k, label][1] for k in kinds for label in (0, 1)) // FIT_ROWS
    coded = written(boosting.coded(early, cuts, N_FEATURES).repartition(tasks), "private-codes")
    models, thresholds = boosting.fit_rows(coded, cuts, shares), {}
    for kind, (margins, hits, n) in boosting.margin_counts(rows.filter("held_out"), models, N_FEATURES).items():
        boosting.calibrate_counts(models[kind], margins, hits, n)
        thresholds[kind] = boosting.threshold(models[kind].scaled(margins), hits, precision, n)
    drop_written(coded)
    drop_written(rows)
    return Judge(models, thresholds)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"


def spans_of(text: str | None, judge: Judge) -> list[dict]:
    """All spans of a text in order; base spans have score 1."""
    base = base_spans(text or "")
    every = [(*s, 1.0, True) for s in base] + [(*s, False) for s in judge.added(text or "", base)]
    return [dict(zip(("kind", "start", "end", "score", "base"), (KINDS[s[0]], *s[1:]), strict=True)) for s in sorted(every)]


def find_spans(documents: DataFrame, judge: Judge) -> DataFrame:
    """(doc_id, spans): every document with its spans (kind, start, end, score, base)."""
    shared = documents.sparkSession.sparkContext.broadcast(judge)

    def task(batches):
        for batch in batches:
            found = [spans_of(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, T.StructType([rows.schema["doc_id"], T.StructField("spans", T._parse_datatype_string(_SPANS))]))


def redact(documents: DataFrame, judge: Judge) -> DataFrame:
    """The documents with every span replaced by its kind in square brackets. Of spans that overlap
    the whole stretch is replaced, under the kind of the first."""
    shared = documents.sparkSession.sparkContext.broadcast(judge)
    at = documents.columns.index("text")

    def cut(text):
        if not text:
            return text
        out, done = [], 0
        for s in sorted(spans_of(text, shared.value), key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= done:
                out += [text[done:s["start"]], f"[{s['kind']}]"]
            done = max(done, s["end"])
        return "".join(out) + text[done:]

    def task(batches):
        for batch in batches:
            yield batch.set_column(at, "text", pa.array([cut(t.as_py()) for t in batch.column(at)], pa.string()))

    return documents.withColumn("text", F.col("text").cast("string")).mapInArrow(task, documents.withColumn("text", F.col("text").cast("string")).schema)
