"""Licence notices in texts, by patience alignment with templates.

Words that are unique in both a stretch of text and a template are anchors; the longest chain of
anchors in the same order is kept, and the gaps between them are aligned again in the same way
(a word may be unique in a gap). Coverage is the share of the template's words that align.

A template of fewer than `SHORT` words must align as a whole and without a gap, since any of its words
may name the licence. What tells a longer one from its kin comes from aligning the templates with
each other: of the words that a sufficient alignment with another licence leaves out, half at least
must align, and a stretch that has half or more of what the other one has in between is the other
one's. Numbers, which are versions, must always align.

Whole texts are searched, in overlapping stretches at fixed steps that are long enough for a notice
wherever it begins. A notice that covers a template has one of its words from any set of words
larger than what may be missing, so only stretches with one of the template words that are rarest in
the text are aligned, each of them once: long texts that repeat a word take linear time.

Cases: null and empty texts have no notices. Every row has a result, repeated rows and null ids
too. Of templates with equal coverage that align with equally many words, the first by name is
the best one, and reserved rights come after every licence; of equal stretches of one template,
the earliest counts. Templates without words are ignored. An empty table gives no rows. Other columns are not read.
"""

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.license_texts import MORE, RESERVED, TEMPLATES

COVERAGE, SHORT = 0.8, 10
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_SEEN = 400_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by piles."""
    tops, last, before = [], [], [0] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        before[i] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(value)
            last.append(i)
        else:
            tops[pile], last[pile] = value, i
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of aligned positions, in order."""
    found, waiting = [], [(0, len(text), 0, len(template))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if there[w] == 1 and here[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        chain = [anchors[k] for k in rising([j for _, j in anchors])]
        found += chain
        if chain:
            begin_a, begin_c = a, c
            for i, j in [*chain, (b, d)]:
                waiting.append((begin_a, i, begin_c, j))
                begin_a, begin_c = i + 1, j + 1
    return sorted(found)


def family(name: str) -> str:
    """The licence that a template is a wording of."""
    return regex.sub(r"(-full)?-(text|header)$", "", name)


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, words_of(text)
        self.counts = Counter(self.words)
        self.size = size = len(self.words)
        self.short = size < SHORT
        self.need = size if self.short else -(-size * int(coverage * 1000) // 1000)
        slack = 0 if self.short else size // 4 + 2
        # Stretches begin every `step` words; one of them holds a notice with `slack` words around it.
        self.step, self.length = slack + 1, size + 2 * slack + (slack and slack + 1)
        self.numbers = [i for i, w in enumerate(self.words) if w.isdigit()]
        self.own: list[list[int]] = []
        self.other: list[set[str]] = []

    def tell_from(self, kin: "Template") -> None:
        """Note what differs from another licence's template that covers enough of this one."""
        if self.short or family(kin.name) == family(self.name):
            return
        pairs = align(kin.words, self.words)
        if len(pairs) < self.need:
            return
        there = {j for _, j in pairs}
        left_out = [j for j in range(self.size) if j not in there]
        used = {i for i, _ in pairs}
        between = {kin.words[i] for i in range(pairs[0][0], pairs[-1][0]) if i not in used} - set(self.words)
        if left_out:
            self.own.append(left_out)
        if between:
            self.other.append(between)

    def told(self, stretch: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Is an aligned stretch this licence and none of its kin?"""
        there, used = {j for _, j in pairs}, {i for i, _ in pairs}
        if not there.issuperset(self.numbers) or any(2 * sum(j in there for j in own) < len(own) for own in self.own):
            return False
        rest = {stretch[i] for i in range(pairs[0][0], pairs[-1][0]) if i not in used}
        return not any(2 * len(rest & other) >= len(other) for other in self.other)

    def at(self, words: list[str], first: int) -> list[tuple[int, int]]:
        """The aligned pairs of the stretch that begins at a word, or none if it is not enough."""
        stretch = words[first:first + self.length]
        pairs = align(stretch, self.words)
        return pairs if len(pairs) >= self.need and self.told(stretch, pairs) else []

    def starts(self, count: int, places: dict[str, list[int]]) -> list[int]:
        """Where stretches begin that may hold a notice, in a text of so many words."""
        # One of these template words is in any stretch that covers enough.
        rarest = sorted(range(self.size), key=lambda i: (len(places.get(self.words[i], ())), i))[: self.size - self.need + 1]
        found = set()
        for i in rarest:
            for p in places.get(self.words[i], ()):
                if self.short:
                    found.add(p - i)
                else:
                    found.update(range(-(-max(0, p - self.length + 1) // self.step), p // self.step + 1))
        if self.short:
            return sorted(s for s in found if 0 <= s <= count - self.size)
        return [k * self.step for k in sorted(found)]

    def best(self, words: list[str], places: dict[str, list[int]]) -> tuple[int, int, int]:
        """(aligned words, first and last word of the stretch) of the best stretch, or zeros."""
        best = (0, 0, 0)
        if sum(min(n, len(places.get(w, ()))) for w, n in self.counts.items()) < self.need:
            return best
        for first in self.starts(len(words), places):
            pairs = self.at(words, first)
            if len(pairs) > best[0]:
                best = len(pairs), first + pairs[0][0], first + pairs[-1][0]
        return best


def listed_templates(templates, coverage: float) -> list[Template]:
    """Templates that have words, each told from the others."""
    listed = [t for t in (Template(n, x, coverage) for n, x in sorted(templates)) if t.words]
    for t in listed:
        for kin in listed:
            t.tell_from(kin)
    return listed


def scan(documents: DataFrame, templates=TEMPLATES + MORE, coverage: float = COVERAGE,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, license, coverage, first_word, last_word, licenses): the best
    template that is covered, where it is, and the names of all that are."""
    listed = listed_templates(templates, coverage)
    vocabulary = {w for t in listed for w in t.words}
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    names = ["doc_id", "n_words", "license", "coverage", "first_word", "last_word", "licenses"]

    class Known(dict):
        """White-space separated word to its words and whether a template has any of them."""

        def __missing__(self, token):
            parts = words_of(token)
            found = (len(parts), parts if any(p in vocabulary for p in parts) else None)
            if len(token) <= 64:
                self[token] = found
            return found

    def one(text: str, known) -> tuple:
        places: dict[str, list[int]] = {}
        at = 0
        for count, parts in map(known.__getitem__, text.split()):
            if parts:
                for i, part in enumerate(parts):
                    if part in vocabulary:
                        places.setdefault(part, []).append(at + i)
            at += count
        words = None
        found = []
        for template in listed:
            if sum(min(n, len(places.get(w, ()))) for w, n in template.counts.items()) >= template.need:
                words = words or [w for token in text.split() for w in words_of(token)]
                aligned, first, last = template.best(words, places)
                if aligned:
                    found.append((-aligned / len(template.words), -aligned, template.name, first, last))
        if not found:
            return at, None, None, None, None, []
        covered, _, name, first, last = min(found, key=lambda f: (f[2] == RESERVED, f))
        return at, name, -covered, first, last, sorted({f[2] for f in found})

    def task(batches):
        known = Known()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(known) > _SEEN:
                    known.clear()
                rows.append((doc_id, *one(text.as_py() or "", known)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_words long, license string, coverage double, first_word long, last_word long, licenses array<string>")
