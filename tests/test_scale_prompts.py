"""Prompts per sentence move no text of an id that stands in one row."""

from collections import Counter

from curatio.operators import expand as E

PROMPTS = {"a": ("head ", " cue"), "b": ("other ", "?")}
ROWS = [(1, ["X", "S"], ["one", "two"]), (2, ["X"], ["three"]), (2, ["X", None], ["four", "five"]),
        (None, ["X"], ["six"]), (3, None, None), (4, ["S"], ["seven"]), (5, [], [])]
SCHEMA = "context_id LONG, labels ARRAY<STRING>, contexts ARRAY<STRING>"


def test_prompts_equal_the_join(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    want = E.prefix_by_sentence(E.explode_contexts(d, "S"), E.context_backgrounds(d), PROMPTS)
    got = E.prompts_by_sentence(d, "S", PROMPTS)
    assert set(got.columns) == set(want.columns)
    assert Counter(got.select(*want.columns).collect()) == Counter(want.collect())
    assert want.count() == 2 * (1 + 2 * 3)


def test_ids_of_one_row_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(E, "ID_RANGES", 8)      # a range holds repeated ids and others
    rows = ROWS + [(10 + i, ["X"], [f"s{i}"]) for i in range(40)]
    d = spark.createDataFrame(rows, SCHEMA)
    want = E.prefix_by_sentence(E.explode_contexts(d, "S"), E.context_backgrounds(d), PROMPTS)
    assert Counter(E.prompts_by_sentence(d, "S", PROMPTS).select(*want.columns).collect()) == Counter(want.collect())
