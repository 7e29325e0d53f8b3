import random

import pytest

from tessera.llm.mixing import mix, mixture_plan

SIZES = "doc_id bigint, source string, n_tokens bigint, h int, rest string"
TARGETS = "source string, target_share double, max_repeats int"


def data(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = [(i, rnd.choices(["a", "b", "c", None, "x"], [60, 25, 5, 5, 5])[0], rnd.choice([0, 1, 5, 40, 300]), 1, "r") for i in range(n)]
    return rows, spark.createDataFrame(rows, SIZES)


def test_shares_are_met_and_repeats_are_capped(spark):
    rows, df = data(spark)
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.2, 4), ("none", 0.1, 3), ("a", 0.3, 9), (None, 0.1, 1)], TARGETS)
    docs, shares = mix(df, t)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"a", "b", "c", "none"} and s["none"].mixed_tokens == 0 and s["none"].actual_share == 0
    for source, share in (("a", 0.4), ("b", 0.4), ("c", 0.2)):
        assert s[source].actual_share == pytest.approx(share, abs=0.01)
    copies = docs.collect()
    size = {r[0]: r for r in rows}
    assert all(1 <= r.n_copies <= {"a": 1, "b": 2, "c": 4}[r.source] and size[r.doc_id][2] > 0 for r in copies)
    assert len({r.doc_id for r in copies}) == len(copies)
    for source in "abc":
        assert s[source].mixed_tokens == sum(size[r.doc_id][2] * r.n_copies for r in copies if r.source == source)
        budget = {r.source: r.budget for r in mixture_plan(df.filter("n_tokens > 0"), t).collect()}[source]
        assert abs(s[source].mixed_tokens - budget) <= 150  # half of the longest document


def test_a_total_goes_to_those_who_can_fill_it(spark):
    _, df = data(spark)
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.4, 1)], TARGETS)
    p = {r.source: r for r in mixture_plan(df, t, 50_000).collect()}
    assert p["c"].budget == p["c"].available < 0.4 * 50_000
    assert p["a"].budget == pytest.approx(p["b"].budget) and sum(r.budget for r in p.values()) == pytest.approx(50_000)
    everything = {r.source: r.budget for r in mixture_plan(df, t, 1e9).collect()}
    assert everything == {k: v.available for k, v in p.items()}


def test_selection_is_stable_when_the_corpus_grows(spark):
    rows, df = data(spark, 1000)
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    some = {r.doc_id for r in mix(df, t, 5000)[0].collect()}
    more = {r.doc_id for r in mix(df, t, 9000)[0].collect()}
    assert some < more


def test_empty(spark):
    none, t = spark.createDataFrame([], SIZES), spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    docs, shares = mix(none, t)
    assert docs.count() == 0 and [(r.source, r.mixed_tokens) for r in shares.collect()] == [("a", 0)]
    docs, shares = mix(data(spark, 50)[1], spark.createDataFrame([], TARGETS))
    assert docs.count() == 0 and shares.count() == 0
