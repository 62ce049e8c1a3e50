import pytest

from framewise.llm import line_spread
from tests.llm.helpers import DOCS, docs


def by_hand(rows, least):
    spread = {}
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if body := line.strip(" \t\r"):
                spread.setdefault(body, set()).add(source)
    wide = {b for b, s in spread.items() if len(s) >= least}
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if x.strip(" \t\r") not in wide]
        out.append((i, text if len(left) == len(lines) else "\n".join(left), len(lines) if text else 0, len(lines) - len(left)))
    return sorted(out, key=repr)


ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "\n\n", None), (4, "keep\nfooter\n\nlast", "a"), (5, "footer\r\nown", "b"), (6, " footer", "c"),
    (7, "footer", None), (7, "footer", None), (None, "footer\nx", "a"), (8, "x\ny", "b"), (9, "only a\nonly a\nonly a", "a"),
]


@pytest.mark.parametrize("least", [2, 3, 4])
@pytest.mark.parametrize("margin", [0.0, 0.1, 5.0])
def test_awkward_rows(spark, scratch, least, margin):
    table = docs(spark, ROWS, extra=True)
    out = line_spread.remove_lines(table, scratch, min_sites=least, margin=margin)
    assert out.columns == [*table.columns, "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr)
    assert got == by_hand(ROWS, least)


def test_many_sites_decided_by_the_sketch_alone(spark):
    rows = [(i, f"everywhere\nown {i}", f"site{i}") for i in range(300)] + [(1000 + i, "rare", f"site{i}") for i in range(40)]
    lines = line_spread.boilerplate(docs(spark, rows), min_sites=100)
    assert lines.count() == 1
    assert line_spread.boilerplate(docs(spark, rows), min_sites=300, margin=0.1).collect()[0].sites == 300
    assert line_spread.boilerplate(docs(spark, rows), min_sites=301, margin=0.1).count() == 0


def test_empty(spark, scratch):
    assert line_spread.remove_lines(spark.createDataFrame([], DOCS), scratch).count() == 0
