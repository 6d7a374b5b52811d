"""Whole evaluations on a few rows."""

import pytest

from lexigauge.operators import evaluate


def test_scores_and_board(spark):
    s = spark.createDataFrame([("1", "hello world", "a", "m"), ("2", "fish", "b", "m"), ("3", "x", "b", "m")], "id string, target string, ds string, model string")
    r = spark.createDataFrame([("1", '{"recognized_text": "hello world"}'), ("2", '{"recognized_text": "f#sh"}')], "id string, response string")
    got = {x.id: x for x in evaluate.score_samples(s, r).collect()}
    assert (got["1"].qua, got["1"].gned, got["1"].error) == (1.0, 1.0, None)
    assert got["2"].qua == 0.75 and got["2"].gned == 0.75 and got["3"].error == "no response" and got["3"].qua is None
    assert evaluate.score_samples(s, r, compat_drop=True).count() == 2
    t = evaluate.board(evaluate.score_samples(s, r), "ds", "model", ["qua", "gned"], ["a", "b", "c"])["qua"].first()
    assert (t.a, t.b, t.c) == (1.0, 0.75, None) and t.OVERALL == pytest.approx(0.875)


def test_classified(spark):
    d = spark.createDataFrame([("鱼龙 big house cat", "鱼鱼 big huose dog dog")], "target string, recognised string")
    r = evaluate.classified(d).first()
    assert r.correct_text == "鱼 big" and r.duplicate_text == "鱼" and r.typo_text == "huose" and r.missing_text == "龙 cat" and r.irrelevant_text == "dog dog"


def test_anomaly_board(spark):
    rows = [
        ("1_box", "anno v1_box", '{"recognized_text": "ab #"}', '{"recognized_text": "ab #"}'),
        ("2_box", "sythetic_box", '{"recognized_text": "cd"}', '{"recognized_text": "cd #"}'),
        ("3", "anno v1_box", '{"recognized_text": "鱼"}', '{"recognized_text": "鱼龙"}'),
        ("4", "unknown", "{}", "{}"),
    ]
    c = evaluate.converted(spark.createDataFrame(rows, "id string, data_source string, response string, labels string"))
    b = {(r.lang, r.level, r.category): r for r in evaluate.anomaly_board(c).collect()}
    assert b["en", "box", "anno_box"].tp == 1 and b["en", "box", "render_box"].fn == 1
    t = b["en", "box", "total"]
    assert (t.tp, t.fn, t.hits, t.tokens) == (1, 1, 2, 2)
    zh = b["zh", "image", "anno_box"]
    assert (zh.hits, zh.tokens, zh.edit) == (1, 2, 1.0)
    assert [(r.level, r.category, r.n) for r in evaluate.mismatches(c).collect()] == [("image", "anno_box", 1)]
