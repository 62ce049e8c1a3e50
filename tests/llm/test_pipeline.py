import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewise.llm import mixing, packing, quality_fm
from framewise.llm.queries import ORACLES, QUERIES
from framewise.llm.shared import Scratch
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, docs, near_components, words
from tests.llm.test_packing import check
from tools.check import compare, oracle


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage wrote, the documents first."""
    scratch, table = Scratch(spark, "stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [table]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], SF), name))
    return out


def test_all_but_the_last_stage_return_documents(stages):
    for df in stages[1:-1]:
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in stages[0].schema]


def test_quality_drops_what_the_classifier_rejects(spark, stages):
    model = quality_fm.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    kept = {r.doc_id for r in quality_fm.score(stages[0], model).where("quality_score >= 0.3").select("row.doc_id").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good - kept) <= 0.02 * len(good)


def test_exact_and_near(stages):
    largest = {}
    for r in stages[1].collect():
        largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", -1))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(largest.values())
    texts = {r.doc_id: r.text for r in stages[2].collect()}
    want, _ = near_components(texts, 5, 80)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(want.values()))


def test_mix(spark, stages):
    target = {r.source: r.target for r in mixing.taken_words(mixing.mix(stages[3], Scratch(spark, "again"))).collect()}
    taken, per = collections.Counter(), collections.Counter()
    for r in stages[4].collect():
        taken[r.source] += len(words(r.text))
        per[r.doc_id] += len(words(r.text))
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    size = {r.doc_id: len(words(r.text)) for r in stages[3].collect()}
    assert all(n <= 2 * size[i] for i, n in per.items())


def test_pack(stages):
    rows = stages[5].collect()
    _, want = check(rows, [r.text for r in stages[4].collect()], packing.WINDOW)
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in want)


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.drop("ids").collect()) or stages[5].count() == 0
    assert got.agg(F.sum("length")).first() == stages[5].agg(F.sum("length")).first()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    table = docs(spark, AWKWARD, extra=True)
    out = stage(spark, table, SF)
    assert out.count() > 0 and (name == "pack" or out.columns == table.columns)
    assert stage(spark, table.where("false"), SF).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(spark, name):
    ok, note = compare(spark, SF, oracle(SF), QUERIES[name], ORACLES[name])
    assert ok, note
