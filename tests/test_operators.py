"""Golden values of joins, aggregates, rewards, samples, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lexigauge.operators import aggregate, joins, layout, registry, report, reward, sample
from lexigauge.sources import readers, sinks
from lexigauge.streaming import rewards as streams


def rewards(spark, prompts="abacba", values=(1, 2, 3, 4, 5, 6)):
    return spark.createDataFrame([(i, p, float(v)) for i, (p, v) in enumerate(zip(prompts, values))], "pos int, prompt string, reward double")


def column(df, name="advantage"):
    return [r[name] for r in df.orderBy("pos").collect()]


def test_grpo(spark):
    assert column(reward.grpo_advantage(rewards(spark), "prompt", "reward")) == pytest.approx([-1.135495, -0.999933, -0.162214, 0.0, 0.999933, 1.297708], abs=1e-6)


def test_best_and_pairs(spark):
    d = rewards(spark, "aaabbc", (3, 1, 3, 2, 2, 9))
    assert column(reward.best_of_group(d, "prompt", "reward")) == [1, 0, 1, 1, 1, 1]
    assert column(reward.dpo_pair(d, "prompt", "reward", "pos")) == [1, -1, 0, -1, 1, 0]


def test_zero_std(spark):
    z = reward.zero_std(rewards(spark, "pppqq", (0.1, 0.1, 0.1, 0, 1)), "prompt", "reward").first()
    assert z.zero_ratio == 0.5 and z.groups == 2 and z.mean_std == pytest.approx(0.25)


def test_mask(spark):
    d = spark.createDataFrame([(i, i < 3) for i in range(8)], "pos int, m boolean")
    assert reward.masked(d, "m", 4, "pos").count() == 4
    assert reward.masked(d.filter("pos < 3"), "m", 4, "pos").count() == 3


def test_policy_on_policy(spark):
    d = spark.createDataFrame([(1.0, -2.0, -2.0), (-1.0, -3.0, -3.0)], "advantage double, log_prob double, old_log_prob double")
    r = reward.policy_stats(d, 0.2).first()
    assert (r.approx_kl, r.clipfrac, r.policy_loss) == (0, 0, 0)


def test_largest_remainder(spark):
    d = spark.createDataFrame(list(enumerate([0.7, 0.3, 0.1, 0.5, 0.1])), "pos int, w double")
    assert column(sample.largest_remainder(d, "w", 50_000, "pos"), "quota") == [20588, 8824, 2941, 14706, 2941]


def test_k_repeat(spark):
    d = sample.k_repeat(spark.range(50).withColumnRenamed("id", "k"), "k", 2, 6, 4).collect()
    assert len(d) == 12 and len({r.k for r in d}) == 3 and sum(r["rank"] == 0 for r in d) == 6


def test_hash_seed_and_shards(spark):
    assert spark.range(1).select(sample.hash_seed(F.lit("abc")).alias("s")).first().s == 3128432319 % 2**31
    assert sorted(r["count"] for r in reward.shards(spark.range(10), 3, "id").groupBy("shard").count().collect()) == [3, 3, 4]


def test_parts_sum(spark):
    d = spark.range(1, 30).select("id", sample.composition_parts(F.col("id"), F.lit(5)).alias("p"))
    assert all(sum(r.p) == r.id and min(r.p) > 0 for r in d.collect())


def test_lookups(spark):
    f = spark.createDataFrame([(1, "x"), (2, "y")], "id int, path string")
    p = spark.createDataFrame([(1, "p")], "id int, prompt string")
    assert joins.lookup_join(f, p, "id", "skip").count() == 1
    assert joins.lookup_join(f, p, "id", "null").count() == 2
    with pytest.raises(Exception, match="no prompt"):
        joins.lookup_join(f, p, "id", "error").collect()
    assert joins.last_wins(p.union(spark.createDataFrame([(1, "q")], p.schema)), "id", F.col("prompt")).first().prompt == "q"
    two = f.union(spark.createDataFrame([(1, "z")], f.schema))
    assert {r.id: r.path for r in joins.exactly_one(p.select("id").union(spark.createDataFrame([(2,)], "id int")), two, "id", "path").collect()} == {1: None, 2: "y"}


def test_dependencies(spark):
    s = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 1)], "item int, question int, score int")
    p = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "question int, parent int")
    assert [r.score for r in aggregate.dependency_filtered(s, p).orderBy("question").collect()] == [0, 0, 1]


def test_text_score(spark):
    d = spark.createDataFrame([("m", 0, 8, 10), ("m", 20, 8, 10)], "k string, d int, m int, n int")
    assert aggregate.text_score(d, ["k"], "d", "m", "n").first().text_score == pytest.approx(0.99)


def test_groups_and_report(spark):
    assert len(aggregate.attribute_groups()["Advanced_Following_Overall"]) == 26
    d = spark.createDataFrame([("m1", "a", 0.5), ("m1", "b", 0.25)], "model string, ds string, v double")
    r = report.as_text(report.pivot_table(d, "model", "ds", "v", ["b", "a", "c"]), ["a", "b", "c"]).first()
    assert r.asDict() == {"model": "m1", "b": "0.250", "a": "0.500", "c": "NA"}


def test_confusion_total(spark):
    d = spark.createDataFrame([("en", 1, 1), ("en", 0, 1), ("zh", 1, 0)], "lang string, g int, p int")
    r = {x.lang: (x.tp, x.fp, x.fn) for x in aggregate.confusion(d, ["lang"], F.col("g") == 1, F.col("p") == 1).collect()}
    assert r == {"en": (1, 1, 0), "zh": (0, 0, 1), "total": (1, 1, 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt_id": 1, "prompt": "p", "text": ["x", "y"]}\n\nbroken\n')
    assert readers.jsonl(spark, str(tmp_path / "a.jsonl"), "longtext", "skip").count() == 1
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), "longtext").collect()
    (tmp_path / "p.json").write_text(json.dumps({"prompts": ["a", "b"], "targets": ["c", "d"]}))
    assert [tuple(r) for r in readers.columnar_json(spark, str(tmp_path / "p.json")).collect()] == [(0, "a", "c"), (1, "b", "d")]
    (tmp_path / "m.json").write_text('{"0": "x", "1": "y"}')
    assert readers.json_map(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "l.txt").write_text("a\nb\nc\n")
    assert [r.prompt for r in readers.lines(spark, str(tmp_path / "l.txt"), 1, 3).collect()] == ["b", "c"]


def test_loader(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for n in ("1_0.png", "2.jpg", "9.png", "note.txt"):
        (tmp_path / "img" / n).write_bytes(b"x")
    (tmp_path / "captions.json").write_text(json.dumps([{"id": "1", "enhanced_caption": "c1", "text": ["a", "b"]}, {"id": "2", "enhanced_caption": "c2", "text": ["d"]}]))
    rows = readers.load(spark, "captions", str(tmp_path / "img"), str(tmp_path / "captions.json")).orderBy("id").collect()
    assert [(r.id, r.prompt, r.target) for r in rows] == [("1", "c1", "a b"), ("2", "c2", "d")]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "o")
    d = spark.createDataFrame([(1, "é")], "id int, s string")
    sinks.resume(d, out, "id")
    sinks.resume(d.union(spark.createDataFrame([(2, "b")], d.schema)), out, "id")
    assert sorted(r.id for r in spark.read.json(out).collect()) == [1, 2]
    sinks.once(d, out)
    assert spark.read.json(out).count() == 2


def test_stream_batches(spark, tmp_path):
    rewards(spark).write.parquet(str(tmp_path / "in"))
    got = []
    f = streams.advantages_per_batch("prompt", "reward", lambda df, _: got.extend(r.advantage for r in df.collect()))
    q = spark.readStream.schema("pos int, prompt string, reward double").parquet(str(tmp_path / "in")).writeStream.foreachBatch(f).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert len(got) == 6 and sum(got) == pytest.approx(0, abs=1e-9)


def test_layouts(spark):
    d = layout.fixed_layouts(spark)
    assert d.count() == 15 and layout.overlaps(d).count() == 0
    two = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 0.5), (1, 1, 0.4, 0.4, 0.5, 0.5)], layout.SCHEMA)
    assert layout.overlaps(two).count() == 1
    r = spark.range(200).select(layout.random_region(F.col("id")).alias("r")).select("r.*")
    assert r.filter("m_offset + m_scale > 1.0000001 OR n_offset + n_scale > 1.0000001 OR m_scale < 0.1").count() == 0


def test_more_loaders(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for n in ("1.png", "001_a.png", "0.png"):
        (tmp_path / "img" / n).write_bytes(b"x")
    img = str(tmp_path / "img")
    put = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    load = lambda kind, path, mode="en": [(r.id, r.prompt, r.target) for r in readers.load(spark, kind, img, path, mode).orderBy("id").collect()]
    assert load("regions", put("r.json", json.dumps({"data_list": [{"index": 1, "prompt": "sign '中' “鱼”"}]})), "zh") == [("1", "sign '中' “鱼”", "中 鱼")]
    assert load("table_text", put("t.csv", ",id,prompt_en,prompt_cn,text_content\n0,001,p,q,\"['a', 'b']\"\n")) == [("001", "p", "a b")]
    assert load("annotations", put("a.json", json.dumps([{"id": "1", "annotation": "p", "raw_text": "t"}]))) == [("1", "p", "t")]
    assert load("instructions", put("i.jsonl", json.dumps({"type": "text", "short_description": 'say "hi there"'}) + "\n")) == [("0", 'say "hi there"', "hi there")]
    assert load("gentext", put("g.jsonl", "\n".join(json.dumps({"prompt_id": i, "prompt": "p", "target": "a,b"}) for i in (0, 1, 1)))) [:1] == [("0", "p", "a b")]
    with pytest.raises(Exception, match="no prompt"):
        load("longtext", put("l.jsonl", json.dumps({"prompt_id": 7, "prompt": "p", "text": ["a"]})))


def test_registry(spark):
    d = registry.add_rewards(spark.createDataFrame([("abc", "xabc", 4.0)], "t string, r string, g double"), {"o": ("ocr", ["t", "r"]), "g": ("grade", ["g"])})
    assert registry.composite(d, {"o": 0.5, "g": 0.5}).first().reward_avg == pytest.approx(0.9)


def test_small_helpers(spark):
    d = spark.createDataFrame([("m", float("nan"), 1.0, None)], "k string, a double, b double, c double")
    assert aggregate.wide_mean(d, ["a", "b", "c"]).first()["mean"] == 1.0
    x = spark.createDataFrame([(1, 2, ["b"]), (1, 1, ["a"])], "k int, i int, v array<string>")
    assert aggregate.concat_lists(x, ["k"], "v", "i").first().v == ["a", "b"]
    assert joins.whitelist(x, "i", [1]).count() == 1 and joins.whitelist(x, "i", None).count() == 2
    assert joins.with_default(x, x.limit(0).withColumn("s", F.lit(1.0)), "k", "s").first().s == 0.0
    p = spark.range(40).select(sample.composed_prompts(F.col("id"), ["owl", "dog"], ["runs"]).alias("p"), sample.sign_prompts(F.col("id"), ["owl"]).alias("s"))
    assert {r.p for r in p.collect()} == {"an owl runs", "a dog runs"} and all(r.s.endswith('6"') for r in p.collect())
    assert sample.near_equal_parts(spark.range(130), 64, "id").groupBy("batch").count().count() == 3


def test_optional_and_nudged(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "none.jsonl"), "longtext").count() == 0
    d = spark.createDataFrame([([0.0, 0.0],), ([0.0, 0.0],)], "a array<double>")
    assert [r.a for r in reward.nudged(d, "a").collect()] == [[1e-6, 1e-6]] * 2
    d = d.union(spark.createDataFrame([([1.0, 0.0],)], d.schema))
    assert sorted(r.a for r in reward.nudged(d, "a").collect()) == [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]]
    p = spark.createDataFrame([(1.0, 0.0, 0.0, 0.5)], "advantage double, log_prob double, old_log_prob double, dt double")
    assert reward.policy_stats(p, 0.2, dt="dt").first().policy_loss == -2.0


def test_advantage_properties(spark):
    rows = [(i, f"p{i % 37 % 11}", float((i * 7919) % 13)) for i in range(300)]
    d = spark.createDataFrame(rows, "pos int, prompt string, reward double")
    sums = reward.grpo_advantage(d, "prompt", "reward").groupBy("prompt").agg(F.sum("advantage").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in sums)
    pairs = reward.dpo_pair(d, "prompt", "reward", "pos").groupBy("prompt").agg(F.sum("advantage").alias("s"), F.count_if(F.col("advantage") != 0).alias("n")).collect()
    assert all(r.s == 0 and r.n == 2 for r in pairs)
