from framewise.llm import preference

TURNS = "conv_id long, turn long, role string, text string"


def run(spark, rows, pairs):
    threads = preference.conversations(spark.createDataFrame(rows, TURNS))
    return preference.format_pairs(threads, spark.createDataFrame(pairs, "chosen_id long, rejected_id long")).collect()


def test_prefix_prompt_and_masks(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (2, 3, "assistant", "bad answer"), (2, 4, "user", "?"),
    ]
    (r,) = run(spark, rows, [(1, 2)])
    assert r.prefix_turns == 3 and r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["good<|end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_spans] == ["bad answer<|end|>\n"]
    assert r.rejected.endswith("<|user|>\n?<|end|>\n")


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "assistant", "é\U0001f600x"), (2, None, "", ""), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "a"),
        (None, 0, "user", "lost"), (5, 2, "assistant", "late"), (5, 1, "assistant", "early"),
    ]
    got = {(r.chosen_id, r.rejected_id): r for r in run(spark, rows, [(1, 2), (3, 4), (4, 4), (5, 1), (1, 77)])}
    assert set(got) == {(1, 2), (3, 4), (4, 4), (5, 1)}
    one = got[1, 2]
    assert one.prefix_turns == 1 and one.rejected == "" and one.chosen[one.chosen_spans[0].start : one.chosen_spans[0].end] == "é\U0001f600x<|end|>\n"
    assert got[3, 4].prefix_turns == 1 and got[3, 4].chosen == "<|user|>\na<|end|>\n" and got[4, 4].chosen == ""
    five = got[5, 1]
    assert five.prefix_turns == 0 and five.prompt == "" and [five.chosen[s.start : s.end] for s in five.chosen_spans] == ["early<|end|>\n", "late<|end|>\n"]


def test_pairs_by_opening(spark):
    rows = [(i, 0, "user", "same") for i in range(50, 60)] + [(7, 0, "user", "own"), (8, 0, "user", "x"), (9, 0, "user", "y")]
    threads = preference.conversations(spark.createDataFrame(rows, TURNS))
    got = {(r.chosen_id, r.rejected_id) for r in preference.pairs_by_opening(threads).collect()}
    assert got == {(50, i) for i in range(51, 60)} | {(i, i + 1) for i in range(50, 60, 2)} | {(8, 9)}


def test_empty(spark):
    empty = preference.conversations(spark.createDataFrame([], TURNS))
    assert preference.format_pairs(empty, preference.pairs_by_opening(empty)).count() == 0


def test_long_texts_and_clashing_columns(spark):
    """A text of a megabyte, and further columns named as those inside."""
    from pyspark.sql import functions as F

    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", long), (2, 1, "assistant", "short")]
    table = spark.createDataFrame(rows, TURNS)
    for name in ("pos", "start", "turns", "opening", "chosen_id", "rejected_id", "prompt"):
        table = table.withColumn(name, F.lit("x"))
    threads = preference.conversations(table)
    (r,) = preference.format_pairs(threads, preference.pairs_by_opening(threads)).collect()
    assert (r.chosen_id, r.rejected_id, r.prefix_turns) == (1, 2, 1) and r.prompt == f"<|user|>\n{long}<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == [f"{long}<|end|>\n"] and r.rejected.endswith("short<|end|>\n")
