import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from framewise.llm import merkle
from framewise.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, DOCS, docs, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = (None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text))
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(bottom):
    """The root, and per leaf the siblings from below, each with its side."""
    paths, here, level = [[] for _ in bottom], list(range(len(bottom))), list(bottom)
    while len(level) > 1:
        for i, at in enumerate(here):
            other = at ^ 1
            paths[i].append((at & 1, level[other] if other < len(level) else None))
            here[i] = at // 2
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], paths


def folded(start, path):
    for left, other in path:
        start = h(start) if other is None else h(other, start) if left else h(start, other)
    return start


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, path) per row of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf(i, source, lang, n, text), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])]) for g in order]
    root, tops = tree([t[0] for t in trees])
    return root, [
        (x[3], x[2], trees[k][0], trees[k][1][j] + tops[k])
        for k, g in enumerate(order) for j, x in enumerate(sorted(groups[g]))
    ]


def check(spark, scratch, rows):
    table = spark.createDataFrame(rows, DOCS)
    found = merkle.manifest(table, scratch)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest().alias("proof"), merkle.fold_path(F.col("leaf")).alias("folded")).collect()
    root, want = by_hand(rows)
    plain = [(i, x, sub, root, h(*(o for _, o in path if o)), folded(x, path)) for i, x, sub, path in want]
    assert sorted(map(repr, plain)) == sorted(repr(tuple(r)) for r in got)
    assert all(r.folded == root for r in got)


@pytest.mark.parametrize("sizes", [[1], [2], [7], [1, 1], [1, 1, 1], [9, 1, 4], [33, 2, 1, 17, 5]])
def test_against_plain_trees(spark, scratch, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    langs = ["en", None, "", "fr", "\U0001f600"]
    rows = [(100 * k + i, f"text {i}", langs[k], "s", i) for k, n in enumerate(sizes) for i in range(n)]
    check(spark, scratch, rows)


def test_awkward_rows(spark, scratch):
    rows = [(i, t, lang, s, None if t is None else len(t)) for k, (i, t, s) in enumerate(AWKWARD) for lang in ("en", None if k % 3 else "fr")]
    check(spark, scratch, rows)


def test_one_group_holds_nearly_all(spark, scratch):
    rows = [(i % 700, "same", "en", "s", 4) for i in range(3000)] + [(5, prose(3, 9), "de", "s", 1)]
    check(spark, scratch, rows)


def test_changed_rows_are_found(spark, scratch):
    rows = [(i, prose(i, 5), "en", "s", 2**63 - 1 if i == 3 else None if i == 4 else i) for i in range(21)]
    table = spark.createDataFrame(rows, DOCS)
    claimed = F.when(F.col("doc_id") % 2 == 0, merkle.leaf(n_chars=merkle.more_chars())).when(F.col("doc_id") == 3, merkle.leaf(n_chars=merkle.more_chars()))
    found = merkle.manifest(table, scratch, carry={"claimed": claimed})
    got = found.select("doc_id", "root", merkle.fold_path(F.coalesce(F.lower(F.hex("claimed")), "leaf")).alias("folded")).collect()
    # A null count stays null, so that nothing was changed there.
    assert {r.doc_id for r in got if r.folded != r.root} == {3, *range(0, 21, 2)} - {4}


def test_empty_and_extra_columns(spark, scratch):
    empty = merkle.manifest(spark.createDataFrame([], DOCS), scratch, carry={"claimed": merkle.leaf()})
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "path", "claimed"]
    table = docs(spark, AWKWARD, extra=True).withColumn("tree", F.lit(1)).withColumn("idx", F.lit(1)).withColumn("path", F.lit(1))
    plain = merkle.manifest(docs(spark, AWKWARD), scratch).select("doc_id", "leaf", "root").collect()
    assert sorted(map(repr, merkle.manifest(table, scratch).select("doc_id", "leaf", "root").collect())) == sorted(map(repr, plain))


def test_query_verifies_what_was_not_changed(spark):
    rows = QUERIES["op11_merkle_manifest"](spark, SF).collect()
    assert rows and all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)
