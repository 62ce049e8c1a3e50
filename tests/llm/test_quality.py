import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewise.llm import quality_fm
from framewise.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, DOCS, docs, prose


def test_the_identity_equals_the_sum_over_pairs():
    r = np.random.default_rng(1)
    machine = quality_fm.Machine(0.3, r.normal(size=quality_fm.SLOTS), r.normal(size=(quality_fm.SLOTS, quality_fm.FACTORS)))
    slots, values, before = np.array([5, 9, 700, 5, 42]), r.normal(size=5), np.array([0, 3, 5])
    for row, got in enumerate(machine.predict(slots, values, before)):
        at = range(before[row], before[row + 1])
        want = 0.3 + sum(machine.weights[slots[i]] * values[i] for i in at)
        want += sum(machine.factors[slots[i]] @ machine.factors[slots[j]] * values[i] * values[j] for i in at for j in at if i < j)
        assert got == pytest.approx(want)
    again = quality_fm.Machine.unpack(machine.pack())
    assert again.predict(slots, values, before) == pytest.approx(machine.predict(slots, values, before), rel=1e-4)


def test_fitting_learns_an_interaction():
    """Label 1 exactly if both or none of two words occur: no weight per word tells."""
    rows = [([1, 2], 1), ([1, 3], 0), ([4, 2], 0), ([4, 3], 1)] * 60
    slots, values = np.concatenate([r for r, _ in rows]), np.ones(2 * len(rows))
    before = np.arange(0, 2 * len(rows) + 1, 2)
    machine = quality_fm.fit(slots, values, before, np.array([y for _, y in rows], float), steps=600, rate=0.05)
    assert ((machine.predict(slots, values, before) > 0) == np.array([y for _, y in rows])).all()


def test_every_text_has_all_statistics():
    texts = pa.array([None, "", "A b.\nA b.\n", "x" * 500, "de de de de", "##$ 1 2 3 | | |"])
    stored = np.array([-1, 0, 10, 500, 3, 15])
    for first, last, slots, values, before in quality_fm.features(texts, stored):
        per = [slots[before[i] : before[i + 1]] for i in range(last - first)]
        assert all((p >= quality_fm.WORD_SLOTS).sum() == len(quality_fm.STATISTICS) and p.max() < quality_fm.SLOTS for p in per)
        assert np.isfinite(values).all()


def test_awkward_rows(spark):
    table = docs(spark, AWKWARD, extra=True)
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (7, 1), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality_fm.train(table, labels, F.lit(True), sample_rows=50)
    rows = quality_fm.score(table, model)
    assert rows.select("row.*").columns == table.columns
    got = rows.select("row.doc_id", "row.text", "quality_score").collect()
    assert sorted((r.text or "") for r in got) == sorted((t or "") for _, t, _ in AWKWARD) and all(0 <= r.quality_score <= 1 for r in got)
    none = quality_fm.train(table, labels.where("false"), F.lit(True))
    assert none is None and {r.quality_score for r in quality_fm.score(table, none).collect()} == {0.5}
    assert quality_fm.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id], r.predicted) for r in QUERIES["op9_quality_fm"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in rows if y == 1], [s for s, y, _ in rows if y == 0]
    ranks = np.mean([[(g > b) + (g == b) / 2 for g in good] for b in bad])
    assert ranks > 0.95 and np.mean([p == y for _, y, p in rows]) > 0.93


def test_query_scores_every_row(spark):
    rows = QUERIES["op9_quality_fm"](spark, SF)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_query_on_awkward_tables(spark, tmp_path):
    """Null ids are never held out, and every row has a score."""
    rows = [*AWKWARD, *((100 + i, prose(i, 40), "a") for i in range(30))]
    docs(spark, rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(100 + i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op9_quality_fm"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.held_out is not None and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
