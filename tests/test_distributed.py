"""Line numbers across splits, scans, histories, micro levels, batches by length, nearest words, metrics by name."""

import difflib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigauge.functions import sequence
from lexigauge.operators import aggregate, batches, history, layout, nearest, packing, placement, registry, scan
from lexigauge.sources import readers

# -- lines


@pytest.fixture
def splits(spark):
    """Sets how many bytes of a file a task reads."""
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_lines_are_numbered_across_splits(spark, tmp_path, splits, ends):
    rnd = random.Random(1)
    files = {f"f{k}.txt": ["x" * rnd.choice([0, 1, 7, 300]) + str(i) * (i % 3 > 0) for i in range(n)] for k, n in enumerate([900, 1, 40])}
    for name, ls in files.items():
        (tmp_path / name).write_bytes((ends.join(ls) + ends * (name != "f2.txt")).encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    files["f2.txt"] = files["f2.txt"] if files["f2.txt"][-1] else files["f2.txt"][:-1]
    tasks = set()
    for size in ("64m", "20k", "3k"):
        splits(size)
        d = readers.lines(spark, str(tmp_path))
        got = {}
        for r in d.collect():
            got.setdefault(os.path.basename(r.file), {})[r.pos] = r.prompt
        assert {f: [ls[i] for i in range(len(ls))] for f, ls in got.items()} == files
        tasks.add(spark.read.text(str(tmp_path)).rdd.getNumPartitions())
    assert len(tasks) == 3 and max(tasks) > 20
    assert sorted(r.pos for r in readers.lines(spark, str(tmp_path / "f0.txt"), 400, 500).collect()) == list(range(400, 500))
    assert readers.lines(spark, str(tmp_path / "f1.txt"), 1, 5).count() == 0


def test_until_the_first_bad_line_of_each_file(spark, tmp_path, splits):
    good = [f'{{"a": {i}, "b": "{"y" * (i % 50)}"}}' for i in range(2000)]
    (tmp_path / "one.jsonl").write_text("\n".join(good[:1500] + ['{"a": 15'] + good[1500:]) + "\n")
    (tmp_path / "two.jsonl").write_text("\n".join(["", *good[:30], "   ", *good[30:60]]))
    (tmp_path / "three.jsonl").write_text("nonsense\n" + good[0])
    for size in ("64m", "5k"):
        splits(size)
        got = readers.jsonl_until_bad(spark, str(tmp_path), "a INT, b STRING").collect()
        assert sorted(r.a for r in got) == sorted([*range(1500), *range(60)])


# -- scans


def slow_average(rows, decay, every):
    v, out = next((x for _, x in rows if x is not None), None), []
    for s, (i, x) in enumerate(rows):
        if (s + 1) % every == 0 and x is not None:
            v += (1 - min((1 + s) / (10 + s), decay)) * (x - v)
        out.append((i, v))
    return out


@pytest.mark.parametrize("chunk", [2, 5, 1000])
def test_moving_average(spark, chunk):
    """A hot key that needs several levels of chunks, a key of one row, nulls, columns of clashing names."""
    rnd = random.Random(chunk)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", rnd.choice([None, rnd.uniform(-5, 5), rnd.uniform(0, 1)])) for i in range(120)] + [(500, "one", 3.0)]
    df = spark.createDataFrame(rows, "i int, k string, v double").withColumn("at", F.lit("mine")).withColumn("a", F.lit(1)).withColumn("entry", F.lit(2)).repartition(3)
    got = scan.moving_average(df, ["k"], ["i"], "v", 0.9, 2, chunk=chunk)
    want = {}
    for key in {k for _, k, _ in rows}:
        want |= dict(slow_average([(i, v) for i, k, v in rows if k == key], 0.9, 2))
    assert {r.i: r.ema for r in got.collect()} == {i: None if v is None else pytest.approx(v) for i, v in want.items()}
    assert got.columns == ["k", "i", "v", "at", "a", "entry", "ema"] and {(r["at"], r.a, r.entry) for r in got.collect()} == {("mine", 1, 2)}
    assert scan.moving_average(df.limit(0), ["k"], ["i"], "v", 0.9, chunk=chunk).count() == 0


def test_places_are_dense(spark):
    df = spark.range(300).select("id", (F.col("id") % 4).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n")).repartition(5)
    got = scan.with_places(df, ["k"], ["id"]).collect()
    assert {(r.k, r.at) for r in got} == {(k, i) for k in range(4) for i in range(75)} and all(r.id == 4 * r.at + r.k for r in got)


# -- history


def test_history_outlives_batches_and_repeats(spark, tmp_path):
    rnd = random.Random(2)
    data = [[f"p{rnd.randint(0, 30)}" for _ in range(rnd.randint(1, 60))] + [None] * (i == 2) for i in range(5)]
    h = history.PromptHistory(spark, str(tmp_path), "prompt")
    assert h.report().count() == 0
    for i, b in enumerate(data):
        df = spark.createDataFrame([(p,) for p in b], "prompt string")
        h.update(df, i)
        if i in (1, 3):  # a batch that is run again after a failure
            history.PromptHistory(spark, str(tmp_path), "prompt").update(df, i)
    seen, want = set(), []
    for i, b in enumerate(data):
        new = set(b) - seen
        seen |= new
        want.append((i, pytest.approx(len(b) / len(set(b))), len(set(b)), len(new), len(seen)))
    got = h.report().orderBy("batch").collect()
    assert [tuple(r)[:5] for r in got] == want
    assert all(abs(r.about_ever - r.ever) <= 1 + 0.05 * r.ever for r in got)
    whole = spark.createDataFrame([(i, p) for i, b in enumerate(data) for p in b], "batch int, prompt string")
    assert [tuple(r) for r in history.prompt_history(whole, "batch", "prompt").orderBy("batch").collect()] == want


# -- micro levels


def test_micro_levels_by_hand(spark):
    rows = [("m", "zh", "box", 1, 2, 0, 0, 3, 4, 0.5), ("m", "zh", "image", 0, 0, 1, 5, 1, 2, 1.5), ("m", "en", "box", 4, 0, 0, 0, None, None, None), ("n", "en", "box", 0, 0, 0, 1, 0, 0, 0.0), ("m", None, "box", 1, 0, 0, 0, 1, 1, 0.0)]
    df = spark.createDataFrame(rows, "model string, lang string, level string, tp int, fp int, fn int, tn int, hits int, tokens int, edit double")
    got = {(r.model, r.lang, r.level): r for r in aggregate.micro_levels(df, ["model"], ["lang", "level"]).collect()}
    assert len(got) == 10 + 4  # m: all, three languages (one null), two levels, four cells; n: one of each
    r = got["m", "all", "all"]
    assert (r.tp, r.fp, r.fn, r.tn, r.hits, r.tokens, r.edit) == (6, 2, 1, 5, 5, 7, 2.0)
    assert (r.precision, r.recall, r.token_recall, r.token_ned) == pytest.approx((6 / 8, 6 / 7, 5 / 7, 2 / 7))
    assert got["m", "en", "all"].token_ned == 0 and got["n", "all", "all"].f1 == 0 and got["m", None, "box"].tp == 1


# -- batches


def test_length_classes(spark):
    got = spark.range(0, 5000).select("id", batches.length_class(F.col("id")).alias("c")).collect()
    assert all(r.id <= r.c <= max(1, r.id * 9 / 8) for r in got) and len({r.c for r in got if r.id >= 2048 and r.id < 4096}) <= 10


def test_batches(spark):
    rnd = random.Random(4)
    lengths = [rnd.choice([0, 3, 50, 51, 400, 5000]) for _ in range(500)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i int, n int").repartition(7)
    fixed, budget = batches.fixed_batches(df, "n", 16, "i"), batches.budget_batches(df, "n", 1000, "i")
    for d in (fixed, budget):
        assert [(r.i, r.row) for r in batches.in_old_order(d).collect()] == [(i, i) for i in range(500)]
    by = {}
    for r in budget.collect():
        by.setdefault(r.batch, []).append(r.n)
    assert all(len(b) == 1 or len(b) * max(b) <= 1000 for b in by.values())
    one = batches.padding(fixed, "n", "batch").first()
    arrival = batches.padding(fixed.withColumn("batch", F.floor(F.col("row") / 16)), "n", "batch").first()
    assert one.rows == 500 and one.batches == 32 and one.padding < arrival.padding
    assert batches.padding(batches.budget_batches(df.limit(0), "n", 10, "i"), "n", "batch").first().batches == 0


# -- nearest words

WORDS = st.text("abcde", max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd é鱼", max_size=14), st.text("abcd é鱼", max_size=14))
def test_ratio(a, b):
    assert sequence.ratio_of(a, b) == difflib.SequenceMatcher(None, a, b).ratio() <= sequence.Against(b).at_most(a)


@settings(max_examples=40, deadline=None)
@given(st.text("abc", min_size=180, max_size=260), st.text("abcxyz", min_size=180, max_size=260))
def test_ratio_of_long_texts(a, b):
    """Frequent characters don't begin a block there."""
    assert sequence.ratio_of(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


@settings(max_examples=200, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=12))
def test_nearest_of_a_list(word, others):
    assert sequence.Against(word).nearest(others) == (difflib.get_close_matches(word, others, 1, 0.0) or [None])[0]


def test_nearest_words(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 9)))
    words, vocabulary = ([(k, word()) for k in (1, 2, None) for _ in range(60)] for _ in range(2))
    words += [(1, None), (3, "alone"), (1, "zzz"), (1, words[0][1])]
    got = nearest.nearest_words(spark.createDataFrame(words, "k int, word string"), spark.createDataFrame([*vocabulary, (2, None)], "k int, other string"), ["k"]).collect()
    want = {}
    for k, w in words:
        have = [v for x, v in vocabulary if x == k]
        if w is not None and have:
            best = max((difflib.SequenceMatcher(None, v, w).ratio(), v) for v in have)
            want[k, w] = best[::-1]
    assert {(r.k, r.word): (r.other, r.ratio) for r in got} == want and len(got) == len(want)
    alone = nearest.nearest_words(spark.createDataFrame(words, "k int, word string"), spark.createDataFrame(vocabulary, "k int, other string"), [])
    assert {r.word for r in alone.collect()} == {w for _, w in words if w is not None}
    assert nearest.nearest_words(spark.createDataFrame(words, "k int, word string"), spark.createDataFrame([], "k int, other string"), []).count() == 0


# -- registry


def test_tag_rewards(spark):
    rows = [("g", "color", 1.0, 1.0), ("g", "color", 0.5, 0.0), ("g", "count", 0.0, 0.0), ("h", "count", None, 1.0), ("h", "other", 2.0, 1.0)]
    d = registry.tag_rewards(spark.createDataFrame(rows, "g string, tag string, r double, s double"), "tag", "r", "s", ["color", "count"])
    assert all(len(r.rewards) == 6 for r in d.collect())
    got = {(r.g, r.name): (r["mean"], r.n) for r in registry.map_means(d, ["g"]).collect()}
    assert got["g", "color_accuracy"] == (0.75, 2) and got["g", "strict_accuracy"] == (pytest.approx(1 / 3), 3) and got["h", "accuracy"] == (2.0, 1) and ("h", "color_accuracy") not in got
    as_map = {r.g: r.rewards for r in registry.as_map(registry.map_means(d, ["g"]), ["g"]).collect()}
    assert as_map["g"]["count_strict_accuracy"] == 0.0 and "count_accuracy" not in as_map["h"]


def test_metrics_by_name_scan_once(spark, tmp_path):
    rows = [("a", "one two", "one too", 1, ["ned", "wa"]), ("a", "b#c", "b#c", 2, ["ned"]), ("z", "", "", 3, ["wa"])]
    spark.createDataFrame(rows, "k string, gt string, rec string, n int, units array<string>").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    asked = {"ned": ("ned", ["gt", "rec"]), "wa": ("word_accuracy", ["gt", "rec"]), "f1": ("anomaly_f1", ["gt", "rec"]), "cr": ("completion", ["gt", "rec"])}
    out = registry.evaluate(df, ["k"], asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "n#" not in plan.split("ReadSchema")[1]
    got = {r.k: r for r in out.collect()}
    assert got["a"].ned == pytest.approx(1 / 14) and got["a"].wa == pytest.approx(2 / 3) and got["a"].f1 == 1.0 and got["a"].cr == 0.5 and got["z"].f1 is None
    by_unit = {r.k: r for r in registry.evaluate(df, ["k"], {n: asked[n] for n in ("ned", "wa")}, "units").collect()}
    assert by_unit["a"].wa == 0.5 and by_unit["z"].ned is None
    with pytest.raises(ValueError, match="no metric nothing"):
        registry.evaluate(df, [], {"x": ("nothing", ["n"])})


# -- packing and placement


def test_packed(spark):
    rnd = random.Random(9)
    lengths = [rnd.choice([None, 0, 5, 40, 99, 100, 250]) for _ in range(150)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i int, n int").withColumn("row", F.lit("mine"))
    want = []
    for run in range(0, 150, 20):
        pack, used = -1, 0
        for i in range(run, min(run + 20, 150)):
            n = lengths[i] or 0
            if pack < 0 or used + n > 100:
                pack, used = pack + 1, 0
            want.append((i, f"{run // 20}-{pack}", used))
            used += n
    got = packing.packed(df, "n", 100, "i", run=20)
    assert sorted((r.i, r.pack, r.begin) for r in got.collect()) == want and got.columns == ["i", "n", "row", "pack", "begin"]
    assert packing.packed(df.limit(0), "n", 100, "i").count() == 0


def test_attention_runs(spark):
    """The rectangles against a mask of cells."""
    rnd = random.Random(10)
    rows = [(s, i, rnd.randint(0, 4), rnd.choice(["causal", "full", "noise"])) for s in range(30) for i in range(rnd.randint(1, 7))]
    got = packing.attention_runs(spark.createDataFrame(rows, "s int, i int, n int, m string"), "s", "i", "n", "m").collect()
    for s in range(30):
        splits = [(n, m) for x, _, n, m in rows if x == s]
        size = sum(n for n, _ in splits)
        mask = np.zeros((size, size), bool)
        at = 0
        for n, m in splits:
            mask[at : at + n, at : at + n] = np.tril(np.ones((n, n))) if m == "causal" else True
            mask[at : at + n, :at] = True
            at += n
        at = 0
        for n, m in splits:
            if m == "noise":
                mask[:, at : at + n] = False
                mask[at : at + n, at : at + n] = True
            at += n
        mine = np.zeros((size, size), int)
        for r in (r for r in got if r.s == s):
            box = np.ones((r.q_end - r.q_begin, r.k_end - r.k_begin), int)
            mine[r.q_begin : r.q_end, r.k_begin : r.k_end] += np.tril(box) if r.triangle else box
        assert (mine == mask).all()
    assert len(got) <= 4 * len(rows)


def on_the_grid(points, w=4, h=2):
    """The least cost in tenths over all places of a grid that holds an optimum."""
    spots = [(x, y) for x in range(w // 2, 11 - w // 2) for y in range(h // 2, 11 - h // 2)]
    cost = lambda p, s: abs(p[0] - s[0]) + abs(p[1] - s[1])
    apart = lambda a, b: abs(a[0] - b[0]) >= w or abs(a[1] - b[1]) >= h

    def best(chosen, rest, least):
        if not rest:
            return 0
        for s in sorted(spots, key=lambda s: cost(rest[0], s)):
            c = cost(rest[0], s)
            if c >= least:
                break
            if all(apart(s, t) for t in chosen):
                least = min(least, c + best([*chosen, s], rest[1:], least - c))
        return least

    return best([], points, 10**6)


def test_placement():
    rnd = random.Random(11)
    for n in (1, 2, 2, 2, 3, 3, 3, 3):
        points = [(rnd.randint(2, 8), rnd.randint(1, 9)) for _ in range(n)]
        cost, regions = placement.place([(x / 10, y / 10) for x, y in points], 0.08, (2.0,))
        assert 10 * cost == pytest.approx(on_the_grid(points))
        assert cost == pytest.approx(sum(abs(a + w / 2 - x / 10) + abs(b + h / 2 - y / 10) for (a, b, w, h), (x, y) in zip(regions, points)))
    assert placement.place([(0.5, 0.5)] * 3, 0.5) is None and placement.place([], 0.1) == (0, [])


def test_placement_of_five_with_open_shapes(spark):
    points = [(0.5, 0.5), (0.5, 0.45), (0.2, 0.5), (0.8, 0.9), (0.4, 0.1)]
    rows = [(k, i, *p) for k in range(3) for i, p in enumerate(points[: 3 + k])] + [(9, 0, 0.5, 0.5)]
    d = spark.createDataFrame(rows, "layout int, pos int, x double, y double")
    got = placement.placed(d, "layout", "pos", "x", "y", 0.06)
    assert got.filter(layout.region_ok(0.06, slack=1e-9)).count() == len(rows)
    assert layout.overlaps(got.withColumns({c: F.round(c, 9) for c in ("m_offset", "n_offset", "m_scale", "n_scale")}), "layout", "pos").count() == 0
    one = {r.layout: r.cost for r in placement.placed(d, "layout", "pos", "x", "y", 0.06, (2.0,)).collect()}
    assert all(r.cost <= one[r.layout] + 1e-9 for r in got.collect())
