"""Golden values of text, matching, parsing and vector functions."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigauge.functions import assign, match, parse, text, vec


def one(spark, expr, **cols):
    """The value of an expression over one row of literal columns."""
    d = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in cols.items()])
    return d.select(expr.alias("v")).first().v


@pytest.mark.parametrize(("a", "b", "want"), [("kitten", "sitting", 3 / 7), ("", "", 0.0), ("", "a", 1.0), ("鱼龙", "鱼虫", 0.5)])
def test_ned(spark, a, b, want):
    assert one(spark, match.ned(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)
    assert assign.ned(a, b) == pytest.approx(want)


@pytest.mark.parametrize(("s", "amp", "want"), [("AB#C", 1.0, 0.75), ("<###> ok", 1.0, 4 / 7), ("", 1.0, 0.0), ("AB#C", 5.0, 0.0)])
def test_quality(spark, s, amp, want):
    assert one(spark, match.quality(F.col("s"), amp), s=s) == pytest.approx(want)


@pytest.mark.parametrize(("gt", "pred", "want"), [(["hello", "world"], ["hello"], 0.5), (["cat", "dog"], ["dig", "cat", "x"], 4 / 9), (["a", "b"], [""], 1.0), ([], [], 0.0), ([""], [""], 0.0)])
def test_gned(spark, gt, pred, want):
    assert assign.gned_of(gt, pred) == pytest.approx(want)
    assert one(spark, assign.gned("g", "p"), g=gt, p=pred) == pytest.approx(want)


@pytest.mark.parametrize(("w", "sane", "compat"), [("鱼龙fish", ["鱼", "龙", "fish"], ["鱼", "龙"]), ("fish鱼", ["fish", "鱼"], ["鱼", "fish"]), ("plain", ["plain"], ["plain"])])
def test_tokens(spark, w, sane, compat):
    assert one(spark, text.tokens(F.array("w")), w=w) == sane
    assert one(spark, text.tokens(F.array("w"), compat=True), w=w) == compat


def test_bags(spark):
    gt, pred = "a a b".split(), "a b b c".split()
    b = one(spark, match.bag_classify(F.col("g"), F.col("p")), g=gt, p=pred)
    assert (b.correct, b.duplicate, b.irrelevant, b.missing) == (["a", "b"], ["b"], ["c"], ["a"])
    assert one(spark, match.bag_overlap(F.col("g"), F.col("p")), g=gt, p="a b b".split()) == 2


def test_greedy_recall(spark):
    assert one(spark, match.recall_greedy(F.col("g"), F.col("p")), g=["cat", "cats"], p=["cats", "cat"]) == 1.0
    assert one(spark, match.recall_greedy(F.col("g"), F.col("p")), g=["cat", "cat"], p=["cat"]) == 0.5
    assert one(spark, match.recall_greedy(F.col("g"), F.col("p")), g=[], p=["cat"]) is None


@pytest.mark.parametrize(("p", "g", "want"), [(7, 10, "TP"), (14, 10, "TP"), (6, 10, "FP"), (15, 10, "FP"), (1, 0, "FP"), (0, 0, "TN"), (0, 3, "FN")])
def test_anomaly_confusion(spark, p, g, want):
    assert one(spark, match.anomaly_confusion(F.col("p"), F.col("g")), p=p, g=g) == want


@pytest.mark.parametrize(("rec", "want"), [("xabcx", 1.0), ("abd", 2 / 3), ("", 0.0)])
def test_ocr_reward(spark, rec, want):
    assert one(spark, match.ocr_reward(F.lit("abc"), F.col("r")), r=rec) == pytest.approx(want)


@pytest.mark.parametrize(("x", "w", "want"), [(730, 1024, 714), (30, 1024, 29), (5, 1, 0), (2000, 1024, 1000)])
def test_boxes(spark, x, w, want):
    assert one(spark, text.normalise_coordinate(F.col("x"), F.col("w")), x=x, w=w) == want


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ('{"recognized_text": "l1\nl2"}', "l1\nl2"),
        ('so\n```json\n{"recognized_text": "in"}\n``` after {"recognized_text": "out"}', "in"),
        ('{"recognized_text": "a"} trailer', "a"),
        ('{"recognized_text": ["a", "b"]}', "a b"),
        ('x "recognized_text": "a <#> b", "duplicate_text": "', "a  b"),
        ("nothing", None),
        (None, None),
    ],
)
def test_responses(spark, s, want):
    assert one(spark, parse.recognised(F.col("s")), s=s) == want


@pytest.mark.parametrize(("s", "want"), [("a “b c” and 'd'", ["b c", "d"]), ("“open 'x'", []), ("'' \"q\"", ["q"]), ("“a 'b' c”", ["a 'b' c"])])
def test_quoted_spans(spark, s, want):
    assert one(spark, text.quoted_spans(F.col("s")), s=s) == want


@pytest.mark.parametrize(("s", "want"), [("the dog's \"big 'red' house\"", ["red", "big  house"]), ('say "a" then "b" and "a"', ["a", "b"]), ("no quotes, it's fine", [])])
def test_nested_quotes(s, want):
    assert parse.nested_quotes(s) == want


@pytest.mark.parametrize(("s", "want"), [("a，b, c", "a b c"), ("'a, b' c,d", "a, b c d"), ('say \\"x,y\\" z', "say x,y z"), (None, ""), ("“a,b” c", "“a b” c"), ("“a,b” “c,d", "a,b” “c,d")])
def test_process_raw_text(spark, s, want):
    assert one(spark, text.process_raw_text(F.col("s")), s=s) == want


def test_yes_no_and_scores(spark):
    assert one(spark, text.yes_no_lines(F.col("s"), F.lit(2)), s="Yes, it is\n\n no") == ["yes", "no"]
    assert one(spark, text.yes_no_lines(F.col("s"), F.lit(3)), s="yes\nno") is None
    assert one(spark, text.score_tag(F.col("s")), s="<Score>4</Score>") == 0.8
    assert one(spark, text.final_score(F.col("s")), s="Final Score: 2.5") == 0.5
    assert one(spark, text.final_score(F.col("s")), s="none") == 0.0


def test_keywords_and_cleaning(spark):
    s = "addCriterion Été, No text recognized. ok"
    assert one(spark, text.strip_keywords(F.col("s")), s=s) == " Été,  ok"
    assert one(spark, text.strip_keywords(F.col("s"), compat=True), s=s) == "addCriterion Été,  ok"
    assert one(spark, text.clean(F.col("s")), s="A  b-C é!") == "a bc é"
    assert one(spark, text.clean_auto(F.col("s")), s="鱼 龙, ok") == "鱼龙ok"


def test_levels(spark):
    v = one(spark, parse.score_levels(F.col("s"), F.col("r")), s='{"recognized_text": "hello", "correct_text": "hell"}', r="hello")
    assert (v.semantic, v.quality, v.recognised, v.correct) == (2, 2, "hello", "HELL")
    assert one(spark, parse.score_levels(F.col("s"), F.col("r"), True), s="#### #", r=None).quality == 0
    assert one(spark, parse.score_levels(F.col("s"), F.col("r")), s="???", r="x").recognised == "<JSON_ERROR>"


def test_score_pipeline(spark):
    v = one(spark, parse.score(F.col("s"), F.col("r")), s='{"recognized_text": "hello wor#d"}', r="hello world")
    assert v.quality == pytest.approx(0.9) and v.semantic == pytest.approx(0.9)
    v = one(spark, parse.score(F.col("s"), F.col("r")), s="bad", r=None)
    assert (v.quality, v.semantic, v.recognised) == (0.0, None, "<EXTRACT FAILED>")


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = d.select(vec.cosine(F.col("a"), F.col("b")).alias("c"), vec.clip_score(F.col("a"), F.col("b")).alias("k"), vec.cosine(F.col("a"), F.col("z")).alias("n"), vec.mean_known(F.array(F.lit(1.0), F.lit(None))).alias("m")).first()
    assert r.c == pytest.approx(0.96) and r.k == pytest.approx(2.4) and r.n is None and r.m == 1.0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_least(n, m, rnd):
    c = np.array([[rnd.choice([0.0, 0.25, 0.5, rnd.random()]) for _ in range(m)] for _ in range(n)])
    rows, cols = assign.assign(c)
    small, big = min(n, m), max(n, m)
    best = min(sum(c[i, p[i]] if n <= m else c[p[i], i] for i in range(small)) for p in itertools.permutations(range(big), small))
    assert len(set(rows)) == len(set(cols)) == small
    assert c[rows, cols].sum() == pytest.approx(best)


@settings(max_examples=80, deadline=None)
@given(st.text("abé鱼", max_size=12), st.text("abé鱼", max_size=12))
def test_distance(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert assign.distance(a, b) == d[len(a)][len(b)]


words = st.lists(st.text("abc", max_size=4), max_size=6)


@settings(max_examples=80, deadline=None)
@given(words, words, st.randoms(use_true_random=False))
def test_gned_properties(a, b, rnd):
    v = assign.gned_of(a, b)
    assert 0 <= v <= 1 and assign.gned_of(a, a) == 0
    mixed = list(b)
    rnd.shuffle(mixed)
    assert assign.gned_of(a, mixed) == pytest.approx(v)


def test_bag_properties(spark):
    rng = np.random.default_rng(3)
    rows = [([str(x) for x in rng.integers(0, 5, rng.integers(0, 9))], [str(x) for x in rng.integers(0, 5, rng.integers(0, 9))]) for _ in range(200)]
    d = spark.createDataFrame(rows, "g array<string>, p array<string>")
    r = d.select("g", "p", match.bag_classify(F.col("g"), F.col("p")).alias("b"), match.bag_overlap(F.col("g"), F.col("p")).alias("o")).collect()
    for x in r:
        assert len(x.b.correct) == x.o
        assert sorted(x.b.correct + x.b.duplicate + x.b.irrelevant) == sorted(x.p)
        assert sorted(x.b.correct + x.b.missing) == sorted(x.g)


def test_quoted_spans_against_a_state_machine(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab “”‘’\"'《》"), 14)) for _ in range(400)]

    def plain(s):
        out, close, start = [], None, 0
        for i, c in enumerate(s):
            if close is None and c in text.QUOTES:
                close, start = text.QUOTES[c], i + 1
            elif c == close:
                out.append(s[start:i].strip())
                close = None
        return [x for x in out if x]

    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", text.quoted_spans(F.col("s")).alias("q")).collect()
    assert all(r.q == plain(r.s) for r in got)


def test_raw_text_against_a_state_machine(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab ,，。“”‘'\"〝〞"), 12)) for _ in range(400)]

    def plain(s):
        pairs = dict(zip(text.OPENERS, text.CLOSERS))
        if sum(c in pairs for c in s) < 2:
            return " ".join("".join(" " if c in "，。！？," else c for c in s).split())
        out, close = "", None
        for c in s:
            if c in pairs and close is None:
                close = pairs[c]
            elif c in pairs and c == close:
                close = None
            else:
                out += " " if c in text.SOFT and close is None else c
        return " ".join(out.split())

    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", text.process_raw_text(F.col("s")).alias("t")).collect()
    assert all(r.t == plain(r.s) for r in got)
