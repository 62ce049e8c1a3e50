import random

import numpy as np
import pytest

from framewise.llm import bbit_minhash, neargroups, textarrays
from framewise.llm.components import components
from framewise.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, DOCS, docs, near_components, prose


def edited(seed, text, share):
    r, w = random.Random(seed), text.split()
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def compare(spark, scratch, rows, k=4, extra=False):
    got = bbit_minhash.document_components(docs(spark, rows, extra), scratch, k, 80).collect()
    want, sizes = near_components({i: t for i, t, _ in rows}, k, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_awkward_rows(spark, scratch):
    rows = [r for n, r in enumerate(AWKWARD) if r[0] is not None and n != 4]
    compare(spark, scratch, rows, extra=True)
    # Repeated rows and a null id: same groups, every row answered.
    got = bbit_minhash.document_components(docs(spark, AWKWARD), scratch, 4, 80).collect()
    assert len(got) == len(AWKWARD)
    ones = [r for r in got if r.doc_id in (4, 5, None) and r.n_shingles == 1]
    assert {r.component_id for r in ones} == {4} and sum(r.kept for r in ones) == 2


def test_a_hot_group_with_chains_and_strangers(spark, scratch):
    base = prose(3, 160)
    rows = [(i, edited(i, base, 0.002 * (i % 40)), "a") for i in range(300)]
    rows += [(1000 + i, prose(50 + i, 90) + " " + prose(4, 70), "b") for i in range(80)]
    rows += [(2000 + i, base, "c") for i in range(60)]
    compare(spark, scratch, rows)


def test_a_link_outside_the_star(spark, scratch):
    """x-y-z where only neighbours are similar: the component needs the link that no common centre has."""
    words = prose(9, 400).split()
    rows = [(i, " ".join(words[8 * i : 8 * i + 120]), "a") for i in range(20)]
    compare(spark, scratch, rows)


def test_survivors_keep_all_columns(spark, scratch):
    table = docs(spark, AWKWARD, extra=True)
    out = bbit_minhash.survivors(table, scratch, k=5)
    assert out.columns == table.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 2, 3, 4, 4, 6, 7, 9, 10, 11], key=repr)


def test_empty(spark, scratch):
    assert bbit_minhash.document_components(spark.createDataFrame([], DOCS), scratch).count() == 0


def test_query_against_all_pairs(spark):
    got = QUERIES["op10_bbit_minhash"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, _ = near_components(texts, 4, 80)
    assert {r.doc_id: r.component_id for r in got} == want


def test_the_estimate_and_the_bound(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 600, dtype=np.uint64)
    rows = []
    for shared in (0, 100, 200, 280, 300):
        a, b = np.sort(pool[:300]), np.sort(np.concatenate([pool[:shared], pool[300 : 600 - shared]]))
        true = shared / (600 - shared)
        marks = []
        for x in (a, b):
            bits = neargroups.DOCUMENTS.packed_bits(neargroups.DOCUMENTS.minima(x, np.array([0, 300])))[0].view(np.int64).tolist()
            marks += [300, *bits, neargroups.set_rows(__import__("pyarrow").array([1]), [x]).column(2).to_pylist()[0]]
        rows.append((true, *marks))
    longs = [f"s{i} long" for i in range(8)]
    schema = "true double, " + ", ".join(f"{side}_{c}" for side in "ab" for c in ("n long", *longs, "parity array<long>"))
    out = spark.createDataFrame(rows, schema).select("true", neargroups.DOCUMENTS.estimate("a_", "b_").alias("e"), neargroups.DOCUMENTS.likely("a_", "b_", 80).alias("likely")).collect()
    for x in out:
        assert x.e == pytest.approx(x.true, abs=0.15) and (x.likely or x.true < 0.8)
    assert not out[0].likely and out[-1].likely


def test_components(spark, scratch):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)] + [(300, i) for i in range(301, 420)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path, "u long, v long"), scratch).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 150, 200)} | {i: 300 for i in range(300, 420)}
    assert components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_word_hashes_agree_with_a_plain_split():
    import pyarrow as pa

    from tests.llm.helpers import words

    texts = [None, "", " ", "a", "A b", "b\ta\x0bb\x0c", "é  x y z", prose(1, 500), "x" * 3000]
    raw, offsets = textarrays.text_buffer(pa.array(texts))
    hashes, counts = textarrays.words(raw, offsets)
    flat = [w for t in texts for w in words(t)]
    assert len(flat) == len(hashes) and [*np.diff(counts)] == [len(words(t)) for t in texts]
    by_word = {}
    assert all(by_word.setdefault(w, h) == h for w, h in zip(flat, hashes, strict=True)) and len(set(by_word.values())) == len(by_word)
