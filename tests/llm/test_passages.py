import collections
import pathlib

import numpy as np
import pytest

from framewise.llm import passage_dedup
from framewise.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, DOCS, docs, prose, words


def shared_runs(texts, n=50):
    """Documents and places of every run of ``n`` words that another document has too."""
    owners = collections.defaultdict(set)
    for i, t in texts.items():
        w = words(t)
        for j in range(len(w) - n + 1):
            owners[tuple(w[j : j + n])].add(i)
    return [(i, j) for i, t in texts.items() for j in range(len(words(t)) - n + 1) if len(owners[tuple(words(t)[j : j + n])]) > 1]


def covers(rows, runs):
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start_word, r.end_word))
    return all(any(a < j + 50 and j < b for a, b in spans[i]) for i, j in runs)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_passages_are_found_and_clean_documents_left_alone(spark, scratch, seed):
    passage = prose(1000 + seed, 52).upper()
    rows = [(i, f"{prose(10 * seed + i, 40)} {passage} {prose(500 + 10 * seed + i, 30)}\n{prose(700 + i, 25)}", "a") for i in range(6)]
    rows += [(50 + i, prose(5000 + 10 * seed + i, 200), "b") for i in range(6)]
    got = passage_dedup.repeats(docs(spark, rows), scratch).collect()
    assert {r.doc_id for r in got} == set(range(6))
    assert covers(got, shared_runs({i: t for i, t, _ in rows}))
    assert {r.doc_id for r in got if r.removed} == set(range(1, 6))


def test_near_equal_lines(spark, scratch):
    line = prose(1, 80).split()
    other = " ".join([*line[:79], "changed"])
    rows = [(1, " ".join(line), "a"), (2, "intro\n" + other, "a"), (3, prose(2, 90), "a"), (4, "short line\nshort line", "b"), (5, "short line", "b")]
    got = passage_dedup.repeats(docs(spark, rows), scratch).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.removed) for r in got} >= {(1, 0, 80, False), (2, 1, 81, True)}
    assert {r.doc_id for r in got} == {1, 2}


def test_awkward_rows(spark, scratch):
    table = docs(spark, AWKWARD, extra=True)
    got = passage_dedup.repeats(table, scratch).collect()
    assert {(r.doc_id, r.removed) for r in got} == {(7, False), (8, True)}
    out = passage_dedup.without_repeats(table, scratch)
    assert out.columns == table.columns and out.count() == len(AWKWARD)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[8].strip() in ("", "more") and texts[7] == AWKWARD[8][1] and texts[1] is None


def test_a_hot_passage(spark, scratch):
    passage = prose(77, 60)
    rows = [(i, f"{prose(i, 15)} {passage} {prose(9000 + i, 15)}", "a") for i in range(400)]
    got = passage_dedup.repeats(docs(spark, rows), scratch).collect()
    assert {r.doc_id for r in got} == set(range(400)) and {r.doc_id for r in got if r.removed} == set(range(1, 400))


def test_empty(spark, scratch):
    assert passage_dedup.repeats(spark.createDataFrame([], DOCS), scratch).count() == 0


def test_query_covers_every_shared_run(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert covers(QUERIES["op7_passage_dedup"](spark, SF).collect(), shared_runs(texts))


def words_in(rows, doc_id, removed):
    return {w for r in rows if r.doc_id == doc_id and r.removed == removed for w in range(r.start_word, r.end_word)}


def test_every_place_of_a_passage_in_one_document(spark, scratch):
    passage = prose(1234, 60)
    rows = [(1, f"{prose(1, 15)} {passage} {prose(2, 15)} {passage} {prose(3, 15)}", "a"), (2, f"{prose(4, 15)} {passage} {prose(5, 15)} {passage} {prose(6, 15)}", "a")]
    got = passage_dedup.repeats(docs(spark, rows), scratch).collect()
    first, second = set(range(15, 75)), set(range(90, 150))
    assert words_in(got, 1, False) & first and not words_in(got, 1, True) & first
    assert words_in(got, 1, True) & second
    assert words_in(got, 2, True) & first and words_in(got, 2, True) & second


def test_a_window_that_overlaps_itself_keeps_one_copy(spark, scratch):
    table = docs(spark, [(1, "x " * 200, "a"), (2, "x " * 200, "a")])
    left = {r.doc_id: len(words(r.text)) for r in passage_dedup.without_repeats(table, scratch, min_words=1000).collect()}
    assert 20 <= left[1] < 200 and left[2] == 0


@pytest.mark.parametrize("length", [52, 100])
def test_every_word_of_a_passage_is_covered(spark, scratch, length):
    passage = prose(4321, length)
    rows = [(i, f"{prose(10 + i, 15)} left{i} {passage} right{i} {prose(30 + i, 15)}", "a") for i in range(4)]
    # The first half of the words before the passage is shared by two documents only, of which none is the first.
    rows += [(i, f"{prose(50 + i, 15)} left{i} {prose(99, 12)} {passage} right{i} {prose(70 + i, 15)}", "a") for i in (4, 5)]
    table = docs(spark, rows)
    got = passage_dedup.repeats(table, scratch).collect()
    plain, longer = set(range(16, 16 + length)), set(range(16, 28 + length))
    assert words_in(got, 0, False) == plain and not words_in(got, 0, True)
    assert all(words_in(got, i, True) == plain for i in (1, 2, 3))
    assert words_in(got, 4, True) == set(range(28, 28 + length)) and longer >= words_in(got, 4, False) >= set(range(16, 28))
    assert words_in(got, 5, True) == longer


def disk_files(spark, scratch):
    """Sizes of the shuffle files of the session and of the tables that are kept."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    found = [f for d in manager.localDirs() for f in pathlib.Path(d.toString()).rglob("shuffle_*.data")]
    found += [f for paths in scratch.paths.values() for p in paths for f in pathlib.Path(p).rglob("*.parquet")]
    return {f: f.stat().st_size for f in found}


def test_a_window_takes_one_row_of_disk(spark, scratch):
    passages = [prose(3000 + i, 300) for i in range(20)]
    rows = [(i, f"{prose(4000 + i, 10)} {passages[i % 20]} {prose(6000 + i, 10)}", "a") for i in range(1000)]
    table = docs(spark, rows)
    before = disk_files(spark, scratch)
    assert {r.doc_id for r in passage_dedup.repeats(table, scratch).collect()} == set(range(1000))
    taken = sum(size for f, size in disk_files(spark, scratch).items() if f not in before)
    assert taken < 5 * sum(len(text) for _, text, _ in rows)


def test_windows_of_many_places_are_extended_alike(spark, scratch, monkeypatch):
    passage = prose(88, 90).split()
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(100_000 + i, f"{prose(8000 + i, 15)} {' '.join(passage[i % 7 : 60 + i % 11])} {prose(9000 + i % 3, 20)}", "a") for i in range(150)]
    rows += [(200_000 + i, f"{prose(7000 + i, 15)} {' '.join(passage)} {prose(7500 + i, 3)} {' '.join(passage[: 50 + i])}", "a") for i in range(20)]
    rows += [(None, " ".join(passage), "a"), (None, "x " * 200, "a"), (300_000, "x " * 200, "a"), (300_000, "x " * 200, "a")]
    table = docs(spark, rows)
    spans = lambda: sorted((tuple(r) for r in passage_dedup.repeats(table, scratch).drop("key").collect()), key=str)
    few = spans()
    # Small lots, so that most classes run over the ends of lots.
    monkeypatch.setattr(passage_dedup, "HOT", 2)
    monkeypatch.setattr(passage_dedup, "LOT", 128)
    assert spans() == few and len(few) > 300


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ends_of_runs_against_every_pair(seed):
    rng = np.random.default_rng(seed)
    n = 120
    group, doc = np.sort(rng.integers(0, 5, n)), np.sort(rng.integers(0, 40, n))
    words = rng.integers(1, 3, (n, passage_dedup.SIDE)).astype(np.uint64)
    words[rng.integers(0, n, n // 2)] = words[rng.integers(0, n, n // 2)]
    words[np.arange(passage_dedup.SIDE) >= rng.integers(0, passage_dedup.SIDE + 1, n)[:, None]] = 0
    alike = lambda i, j: int(((words[i] == words[j]) & (words[i] != 0)).cumprod().sum()) if group[i] == group[j] else 0
    reach, gone = passage_dedup._common(group, np.arange(n), doc, words)[2:]
    for i in range(n):
        others = max((alike(i, j) for j in range(n) if doc[j] != doc[i]), default=0)
        assert reach[i] == others and gone[i] == min(others, max((alike(i, j) for j in range(i)), default=0))
