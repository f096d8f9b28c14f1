from __future__ import annotations

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from scanmill.llm.mixing import allocate, mix_sources, repeated

LEVELS = {"domain": "kind", "lang": "lang", "source": "source"}


def test_shortage_goes_to_siblings_before_ancestors():
    usable = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    assert allocate(usable, {}, 200) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    # The whole of `a` is short: the rest goes to `b`.
    usable[("a", "y")] = 20
    assert allocate(usable, {}, 200) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 170}
    assert allocate(usable, {("b",): 0}, 200) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 0}
    assert allocate({}, {}, 200) == {}


@settings(max_examples=200, deadline=None)
@given(
    st.dictionaries(
        st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.sampled_from("123")),
        st.integers(0, 500),
        min_size=1,
    ),
    st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz")), st.integers(1, 5)),
    st.integers(0, 4000),
)
def test_allocation_uses_the_budget_and_respects_capacity(usable, weights, budget):
    given_ = allocate(usable, weights, budget)
    assert all(0 <= given_[leaf] <= usable[leaf] for leaf in usable)
    total = min(budget, sum(usable.values()))
    assert total - 3 * len(usable) <= sum(given_.values()) <= total
    # Two leaves of one family that are both short of their capacity get equal shares.
    for p in usable:
        for q in usable:
            if p[:2] == q[:2] and given_[p] + 1 < usable[p] and given_[q] + 1 < usable[q]:
                assert abs(Fraction(given_[p]) - Fraction(given_[q])) <= 1


ROWS = [
    *((i, "one two three", "web", "en", "s1") for i in range(30)),
    *((100 + i, "one two", "web", "de", "s1") for i in range(4)),
    (200, "some words", None, None, None),
    (201, None, "web", "en", "s1"),
    (202, "", "web", "en", "s1"),
    (7, "one two three", "web", "en", "s1"),
    (None, "no id", "web", "en", "s1"),
]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, kind string, lang string, source string")


def test_epochs_and_prefix(spark):
    mixed = mix_sources(docs(spark, ROWS), LEVELS, {}, total_tokens=60, max_epochs=3)
    assert mixed.columns == ["doc_id", "text", "kind", "domain", "lang", "source", "n_tokens", "n_epochs"]
    rows = mixed.collect()
    spent = {}
    for r in rows:
        key = (r.domain, r.lang)
        spent[key] = spent.get(key, 0) + r.n_tokens * r.n_epochs
    # The null branch can use 6 of its 30 tokens, so 54 go to the web: half to each language,
    # of which German can use 24.
    assert spent[None, None] == 6 and spent["web", "de"] == 24
    assert 27 <= spent["web", "en"] <= 30
    assert {r.n_epochs for r in rows if r.lang == "de"} == {3}
    again = mix_sources(docs(spark, ROWS[::-1]), LEVELS, {}, total_tokens=60, max_epochs=3).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    other = mix_sources(docs(spark, ROWS), LEVELS, {}, total_tokens=60, max_epochs=3, seed=8).collect()
    assert sorted(map(repr, rows)) != sorted(map(repr, other))
    assert repeated(mixed).count() == sum(r.n_epochs for r in rows)


def test_everything_fits_and_empty_table(spark):
    mixed = mix_sources(docs(spark, ROWS), LEVELS, {}, total_tokens=10**9, max_epochs=2).collect()
    assert len(mixed) == len(ROWS) and {r.n_epochs for r in mixed} == {2}
    assert mix_sources(docs(spark, []), LEVELS, {}).collect() == []
