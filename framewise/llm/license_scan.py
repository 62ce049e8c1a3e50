"""Licence detections by ordered signature rules.

A text becomes words of lower-case letters, digits and characters beyond ASCII, with one space between them. One pass of an
Aho-Corasick automaton finds the keywords it holds; only rules of these keywords are tried, so nearly all texts are left
after that pass. Detections are then resolved from the strongest priority to the weakest: one that overlaps a
stronger one goes, and so does one that lies inside another of its own priority; of equal spans the earlier rule counts.

Base phrases are counted on their own, at every place, and keep their labels whatever the rules say.

The scan is one pass over the table without a shuffle; a task holds one text at a time.

Defined results
    a null text is an empty one; a text without words has no detections, no labels and score 0; every row gives one row,
    repeated and null ids too; an empty table gives no rows; further columns do not matter.
    The score is one minus the product, over labels, of the distrust in their most trusted detection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framewise.llm.license_rules import NAMED, WEIGHTS, Rule, rules
from framewise.llm.shared import columns, ship

#: Phrases counted at all places, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "detections array<struct<rule: string, label: string, priority: int, start: long, end: long>>, score double"
)
#: Bytes kept as they are, in lower case; all others end a word.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

Span = tuple[int, int, int]


def normalise(text: str | None) -> tuple[str, int]:
    """The words with a space around each, one character per byte, and their number."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split(b" ")
    found = [w for w in found if w]
    return f" {b' '.join(found).decode('latin-1')} ", len(found)


class Scanner:
    """Rules with their keywords in one automaton."""

    def __init__(self, found: list[Rule] | None = None):
        import ahocorasick

        self.rules = found if found is not None else rules()
        self.patterns = [re.compile(f"(?<= )(?:{_bytes(r.pattern)})(?= )", re.ASCII) for r in self.rules]
        by_keyword: dict[str, list[int]] = {}
        for n, rule in enumerate(self.rules):
            by_keyword.setdefault(_bytes(rule.keyword), []).append(n)
        for phrase in BASE:
            by_keyword.setdefault(phrase, [])
        self.gate = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            self.gate.add_word(keyword, (keyword, tuple(numbers)))
        self.gate.make_automaton()

    def matches(self, text: str, numbers: set[int]) -> list[Span]:
        """(first character, character after the last, rule) of everything these rules find."""
        return [(m.start(), m.end(), n) for n in sorted(numbers) for m in self.patterns[n].finditer(text)]

    def resolve(self, found: list[Span]) -> list[Span]:
        """The detections that stand, by place."""
        by_priority: dict[int, list[Span]] = {}
        for span in found:
            by_priority.setdefault(self.rules[span[2]].priority, []).append(span)
        kept: list[Span] = []
        starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)  # what stronger detections cover
        for priority in sorted(by_priority):
            last, own = -1, []
            for start, end, n in sorted(by_priority[priority], key=lambda s: (s[0], -s[1], s[2])):
                # The first stretch that ends behind this start reaches into it, or none does.
                at = int(np.searchsorted(ends, start, "right"))
                if end > last and not (at < len(starts) and starts[at] < end):
                    own.append((start, end, n))
                    last = end
            kept += own
            starts, ends = _union(starts, ends, own)
        return sorted(kept)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[Rule, int, int]]]:
        """The number of words, the base phrases by first word, and the detections as ranges of words (end exclusive)."""
        body, n_words = normalise(text)
        hits = {value for _, value in self.gate.iter(body)}
        if not hits:
            return n_words, [], []
        numbers = {n for _, group in hits for n in group}
        spaces = np.flatnonzero(np.frombuffer(body.encode("latin-1"), np.uint8) == 32)
        word = lambda at: int(np.searchsorted(spaces, at)) - 1
        base = []
        for phrase, label in BASE.items():
            at = body.find(f" {phrase} ") if any(k == phrase for k, _ in hits) else -1
            while at >= 0:
                base.append((word(at + 1), label))
                at = body.find(f" {phrase} ", at + 1)
        spans = self.resolve(self.matches(body, numbers))
        return n_words, sorted(base), [(self.rules[n], word(a), word(b) + 1) for a, b, n in spans]


def _bytes(pattern: str) -> str:
    return pattern.encode().decode("latin-1")


def _union(starts: np.ndarray, ends: np.ndarray, more: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint stretches, ascending, that cover these and those."""
    if not more:
        return starts, ends
    a = np.concatenate([starts, [s for s, _, _ in more]]).astype(np.int64)
    b = np.concatenate([ends, [e for _, e, _ in more]]).astype(np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.concatenate([[True], a[1:] >= b[:-1]])
    return a[first], b[np.concatenate([first[1:], [True]])]


def score(base: list[str], found: list[tuple[Rule, int, int]]) -> float:
    trust = {label: WEIGHTS[NAMED] for label in base}
    for rule, _, _ in found:
        trust[rule.label] = max(trust.get(rule.label, 0.0), WEIGHTS[rule.priority])
    distrust = 1.0
    for label in sorted(trust):
        distrust *= 1 - trust[label]
    return 1 - distrust


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = scanner()
    kinds = [
        pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
        pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])), pa.float64(),
    ]
    names = "doc_id n_words n_base first_word last_word base_labels detections score".split()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n_words, base, found = own.scan(text.as_py())
            labels = sorted({label for _, label in base})
            places = [at for at, _ in base]
            detections = [{"rule": r.name, "label": r.label, "priority": r.priority, "start": a, "end": b} for r, a, b in found]
            rows.append((doc_id, n_words, len(base), min(places, default=None), max(places, default=None), labels, detections, score(labels, found)))
        for at in range(0, len(rows), 1024):
            part = list(zip(*rows[at : at + 1024], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(part, kinds, strict=True)], names=names)


def detect(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text) its base phrases and the detections that stand, as ranges of words."""
    ship(docs.sparkSession)
    return columns(docs, doc_id="long", text="string").mapInArrow(_scan_batches, SCHEMA)
