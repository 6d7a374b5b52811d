"""Bag metrics and quotes in time that grows with the input, and the smaller operators on tables."""

import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigauge.functions import match, parse, text
from lexigauge.operators import aggregate, joins, sample


def test_bags(spark):
    rnd = random.Random(1)
    word = lambda n: [rnd.choice("abcdef") for _ in range(rnd.randint(0, n))]
    rows = [(i, word(9), word(9)) for i in range(300)] + [(300, [], []), (301, ["a"], None), (302, None, ["a"])]
    df = spark.createDataFrame(rows, "i int, g array<string>, p array<string>")
    for r in df.select("g", "p", match.bag_classify(F.col("g"), F.col("p")).alias("c"), match.token_hits(F.col("g"), F.col("p")).alias("h")).collect():
        if r.g is None or r.p is None:
            assert r.c.correct is None and r.h.hits is None
            continue
        g, p = Counter(r.g), Counter(r.p)
        many = lambda of, n: [t for t in dict.fromkeys(of) for _ in range(n(t))]
        assert list(r.c) == [
            many(r.p, lambda t: min(g[t], p[t])), many(r.p, lambda t: max(p[t] - g[t], 0) if g[t] else 0), many(r.p, lambda t: 0 if g[t] else p[t]), many(r.g, lambda t: max(g[t] - p[t], 0))
        ]
        assert (r.h.hits, r.h.tokens) == (sum(t in p for t in r.g), len(r.g))
        assert r.h.edit == pytest.approx(sum(1.0 for t in r.g if t not in p))


def test_long_bags(spark):
    n = 40_000
    words = lambda step, m: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), (i * step % m).cast("string")))
    d = spark.range(1).select(words(1, n // 2).alias("g"), words(7, n).alias("p"))
    begin = time.time()
    r = d.select(match.bag_classify(F.col("g"), F.col("p")).alias("c")).select(*[F.size(f"c.{k}").alias(k) for k in ("correct", "duplicate", "irrelevant", "missing")]).first()
    assert tuple(r) == (n // 2, 0, n // 2, n // 2) and time.time() - begin < 60


def test_match_counts(spark):
    rows = [("鱼龙 a", "龙a鱼鱼"), ("one two two", "two one"), ("", "x"), (" a　b ", "b\nc"), (None, "x"), ("x", None)]
    got = [tuple(r.m) if r.m else None for r in spark.createDataFrame(rows, "g string, r string").select(match.match_counts(F.col("g"), F.col("r")).alias("m")).collect()]
    assert got[:4] == [(3, 4), (2, 3), (0, 0), (1, 2)]
    d = spark.createDataFrame(rows[:4], "g string, r string").withColumn("k", F.lit(1))
    r = aggregate.match_ratio(d, ["k"], "g", "r").first()
    assert (r.matched, r.expected) == (6, 9) and r.ratio == pytest.approx(6 / 9)
    assert spark.range(1).select(text.characters(F.lit("a 😀\n鱼"))).first()[0] == ["a", "😀", "鱼"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["'", '"', "''", '""', "\\", " ", "a", "b", "the text: ", "the  text :", "s", "\n"]), max_size=18).map("".join))
def test_quotes_leave_no_quotes_inside(prompt):
    """What is found holds no further quotation."""
    found = parse.nested_quotes(prompt)
    assert len(set(found)) == len(found) and all(x and x == x.strip() and not parse.nested_quotes(x) for x in found)


def test_quotes_by_hand():
    cases = {
        "a 'b' c": ["b"], "it's John's": [], "say \"one 'two' three\"": ["two", "one  three"], "''x'' and \"y\" and 'z'": ["x", "z", "y"], "the text: 'a'": ["a"], "the text :\n \"b\"": ["b"], "bathe text: 'a'": ["a"],
        "'a' 'a'": ["a"], "\\'a' b'": [], "\\\\'a'": ["a"], "'' ''": [], "\"open": [], "": [],
    }
    assert {p: parse.nested_quotes(p) for p in cases} == cases


@pytest.mark.parametrize("unit", ["'a ", " 'a", '"', "'a' ", "the text : ", "\\", " 'a'b"])
def test_quotes_take_linear_time(unit):
    begin = time.process_time()
    parse.nested_quotes(unit * 40_000 + "'")
    assert time.process_time() - begin < 20


def test_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (1, "x")], "i int, v string")
    b = spark.createDataFrame([(1, "x", 5), (3, "y", 6)], "i int, v string, n int")
    assert [tuple(r) for r in joins.distinct_values([a, b], "i", "v").collect()] == [(1, "x"), (2, None), (3, "y")]
    assert sorted(map(repr, map(tuple, joins.concat_chunks([a, b]).collect()))) == sorted(map(repr, [(1, "x", 0, None), (2, None, 0, None), (1, "x", 0, None), (1, "x", 1, 5), (3, "y", 1, 6)]))
    lists = spark.createDataFrame([(1, [1, 2, 3], [4, 5]), (2, [], [6])], "k int, a array<int>, b array<int>")
    assert sorted(tuple(r) for r in joins.transposed(lists, "k", ["a", "b"]).collect()) == [(1, 0, "a", 1), (1, 0, "b", 4), (1, 1, "a", 2), (1, 1, "b", 5)]
    rows = spark.createDataFrame([(1, "b", 3), (1, "a", 9), (1, "b", 1), (2, "c", 2), (1, None, 5)], "k int, v string, at int")
    assert sorted(map(tuple, aggregate.first_occurrences(rows, ["k"], "v", "at").collect()), key=lambda r: (r[0], r[2])) == [(1, "b", 0), (1, None, 1), (1, "a", 2), (2, "c", 0)]


def test_prompts_by_name(spark):
    d = spark.range(60).withColumnRenamed("id", "s")
    for kind, shape in (("count", "^[2-9] (owl|dog)s$"), ("sign", '^A (owl|dog) holding a sign that says "6{1,9}"$'), ("activity", "^(an owl|a dog) runs$"), ("subject", "^(owl|dog)$")):
        got = sample.prompts(d, kind, "s", ["owl", "dog"], ["runs"])
        assert got.filter(~F.col("prompt").rlike(shape)).isEmpty() and got.select("prompt").distinct().count() > 1
        assert got.exceptAll(sample.prompts(d.repartition(3), kind, "s", ["owl", "dog"], ["runs"])).isEmpty()
    with pytest.raises(ValueError, match="no prompts of"):
        sample.prompts(d, "of", "s", ["owl"])
