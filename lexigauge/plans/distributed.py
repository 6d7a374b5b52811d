"""Registered queries of the operators that number, scan, batch and remember rows, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import aggregate, batches, history, layout, nearest, packing, placement, registry, scan
from ..sources import readers, scratch
from .catalog import RATIOS, query, r6, table

# -- lines of large files


def _one_file(df, order, spark, name):
    """Lines of a column ``value`` as one file. It is written by one task, since it is one file; it is read by many."""
    at = scratch.new_path(spark, name)
    df.repartition(1).sortWithinPartitions(order).select("value").write.text(at)
    return at


@query("WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT pos, concat(doc_id, ' ', lang) AS prompt FROM d")
def document_lines(spark, sf):
    """Every document's line of one file, with its number."""
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit(""))).alias("value"))
    return readers.lines(spark, _one_file(d, "doc_id", spark, "lines")).select("pos", "prompt")


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT pos, CAST(doc_id AS VARCHAR) AS prompt FROM d WHERE pos >= 100 AND pos < 350")
def document_lines_slice(spark, sf):
    """A slice of the lines, which is the feature."""
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("value"))
    return readers.lines(spark, _one_file(d, "doc_id", spark, "lines"), 100, 350).select("pos", "prompt")


@query("SELECT doc_id, text FROM documents WHERE doc_id < (SELECT coalesce(min(doc_id) FILTER (doc_id % 1000 = 777), max(doc_id) + 1) FROM documents) AND text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id < (SELECT coalesce(min(doc_id) FILTER (doc_id % 1000 = 777), max(doc_id) + 1) FROM documents) AND text IS NULL")
def documents_until_bad(spark, sf):
    """Whole documents as JSON lines of one file; the line of the first id that ends in 777 is cut off, and reading stops there."""
    row = F.to_json(F.struct("doc_id", "text"))
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 1000 == 777, F.substring(row, 1, 5)).otherwise(row).alias("value"))
    return readers.jsonl_until_bad(spark, _one_file(d, "doc_id", spark, "until"), "doc_id LONG, text STRING")


# -- scans


@query(
    """WITH RECURSIVE e AS (
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type END AS k, value,
               row_number() OVER (PARTITION BY CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type END ORDER BY ts, event_id) - 1 AS s FROM events),
    r AS (
        SELECT event_id, k, s, CAST(value AS DOUBLE) AS v FROM e WHERE s = 0
        UNION ALL
        SELECT e.event_id, e.k, e.s, CASE WHEN (e.s + 1) % 2 = 0 THEN r.v + (1 - least((1.0 + e.s) / (10.0 + e.s), 0.9)) * (e.value - r.v) ELSE r.v END
        FROM r JOIN e ON e.k = r.k AND e.s = r.s + 1)
    SELECT event_id, k, round(v, 6) AS ema FROM r"""
)
def moving_average_rows(spark, sf):
    """Moving average with warm-up along the events of a type, every second one; one key has a third of the rows."""
    k = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_type"))
    d = table(spark, sf, "events").select("event_id", "ts", "value", k.alias("k"))
    return scan.moving_average(d, ["k"], ["ts", "event_id"], "value", 0.9, 2).select("event_id", "k", r6(F.col("ema")).alias("ema"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS at FROM events")
def places_in_key(spark, sf):
    return scan.with_places(table(spark, sf, "events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", "at")


# -- what was seen in earlier batches

HISTORY = """WITH e AS (SELECT {batch} AS batch, user_id FROM events),
    g AS (SELECT batch, user_id, count(*) AS n FROM e GROUP BY 1, 2), f AS (SELECT user_id, min(batch) AS batch FROM g GROUP BY 1), b AS (SELECT DISTINCT batch FROM g)
    SELECT b.batch, (SELECT round(avg(n), 6) FROM g WHERE g.batch = b.batch) AS mean_size, (SELECT count(*) FROM g WHERE g.batch = b.batch) AS prompts,
           (SELECT count(*) FROM f WHERE f.batch = b.batch) AS new_prompts, (SELECT count(*) FROM f WHERE f.batch <= b.batch) AS ever FROM b"""


@query(HISTORY.format(batch="CAST(CAST(ts AS DATE) AS VARCHAR)"))
def prompt_history(spark, sf):
    """Batches are days, prompts are users."""
    d = table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("batch"), "user_id")
    return history.prompt_history(d, "batch", "user_id").withColumn("mean_size", r6(F.col("mean_size")))


@query(HISTORY.format(batch="event_id % 4"))
def remembered_prompts(spark, sf):
    """Four micro-batches of one stream, stopped and started again in between; the seen prompts and the statistics outlive it."""
    events, at = table(spark, sf, "events").select("event_id", "user_id"), scratch.new_path(spark, "history")
    seen = history.PromptHistory(spark, f"{at}/history", "user_id")
    for i in range(4):
        events.filter(F.col("event_id") % 4 == i).write.mode("append").parquet(f"{at}/source")
        stream = spark.readStream.schema(events.schema).parquet(f"{at}/source")
        stream.writeStream.foreachBatch(seen.update).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return seen.report().select("batch", r6(F.col("mean_size")).alias("mean_size"), "prompts", "new_prompts", "ever")


# -- micro totals

LEVELS = """WITH c AS (
        SELECT source AS model, CASE WHEN lang IN ('de', 'fr') THEN 'b' ELSE 'a' END AS lang, CASE WHEN n_chars < 400 THEN 'box' ELSE 'image' END AS level,
               length(text) - length(replace(text, '#', '')) AS p, doc_id % 3 AS g, len(string_split(text, ' ')) AS tokens, len(list_filter(string_split(text, ' '), lambda x: NOT contains(x, '#') AND length(x) < 6)) AS hits FROM documents),
    k AS (SELECT *, CASE WHEN p > 0 THEN CASE WHEN 0.7 * g <= p AND p <= (1 / 0.7) * g THEN 'tp' ELSE 'fp' END ELSE CASE WHEN g = 0 THEN 'tn' ELSE 'fn' END END AS kind FROM c),
    s AS (SELECT coalesce(model, 'none') AS model, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(level) = 1 THEN 'all' ELSE level END AS level,
                 count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (kind = 'tn') AS tn,
                 CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, coalesce(sum((tokens - hits) * 0.5), 0) AS edit
          FROM k GROUP BY GROUPING SETS ((model), (model, lang), (model, level), (model, lang, level))),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM s)
    SELECT model, lang, level, tp, fp, fn, tn, hits, tokens, CAST(edit AS DOUBLE) AS edit, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(coalesce(hits / nullif(tokens, 0), 0), 6) AS token_recall, round(coalesce(edit / nullif(tokens, 0), 0), 6) AS token_ned FROM r"""


@query(LEVELS)
def micro_totals(spark, sf):
    """Anomaly and token counts of a model at every level over languages and picture kinds, with the ratios of each."""
    from ..functions import match

    t = F.col("text")
    words = F.split(t, " ")
    hits = F.size(F.filter(words, lambda x: ~F.contains(x, F.lit("#")) & (F.length(x) < 6)))
    kind = match.anomaly_confusion(match.count_marks(t), F.col("doc_id") % 3)
    d = table(spark, sf, "documents").select(
        F.coalesce("source", F.lit("none")).alias("model"), F.when(F.col("lang").isin("de", "fr"), "b").otherwise("a").alias("lang"), F.when(F.col("n_chars") < 400, "box").otherwise("image").alias("level"),
        kind.alias("kind"), F.when(t.isNotNull(), hits).alias("hits"), F.when(t.isNotNull(), F.size(words)).alias("tokens"),
    )
    d = d.withColumns({k: (F.col("kind") == k.upper()).cast("int") for k in ("tp", "fp", "fn", "tn")}).withColumn("edit", (F.col("tokens") - F.col("hits")) * 0.5)
    out = aggregate.micro_levels(d, ["model"], ["lang", "level"])
    return out.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1", "token_recall", "token_ned")}).withColumn("edit", F.col("edit").cast("double"))


# -- batches of similar length

PADDED = "SELECT {kind} AS kind, CAST(sum(n) AS BIGINT) AS rows, count(*) AS batches, max(n * longest) AS largest, round(1 - sum(used) / sum(n * longest), 6) AS padding FROM (SELECT {batch} AS b, count(*) AS n, max(len) AS longest, sum(len) AS used FROM {table} GROUP BY 1)"


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS len, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents),
    c AS (SELECT *, greatest(1, 1 << greatest(length(bin(greatest(len, 1))) - 4, 0)) AS step FROM d),
    k AS (SELECT *, (greatest(len, 1) + step - 1) // step * step AS class FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY len DESC, row) - 1 AS place, row_number() OVER (PARTITION BY class ORDER BY len DESC, row) - 1 AS nth FROM k)
    {PADDED.format(kind="'arrival'", batch="row // 64", table="p")} UNION ALL {PADDED.format(kind="'fixed'", batch="place // 64", table="p")}
    UNION ALL {PADDED.format(kind="'budget'", batch="concat(class, '-', nth // greatest(65536 // class, 1))", table="p")}"""
)
def length_batches(spark, sf):
    """Share of padding of batches in order of arrival, of 64 rows by length, and by length within 65,536 characters."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("len"))
    fixed = batches.fixed_batches(d, "len", 64, "doc_id")
    kinds = {"arrival": fixed.withColumn("batch", F.floor(F.col("row") / 64)), "fixed": fixed, "budget": batches.budget_batches(d, "len", 65536, "doc_id")}
    out = [batches.padding(b, "len", "batch").select(F.lit(k).alias("kind"), "rows", "batches", "largest", r6(F.col("padding")).alias("padding")) for k, b in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, doc_id, sha256(coalesce(text, '')) AS result FROM documents")
def batched_results(spark, sf):
    """What batches by length give, with the place in the old order that each result goes back to."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("len", F.length("text"))
    done = batches.budget_batches(d, "len", 65536, "doc_id").select("row", "doc_id", F.sha2("text", 256).alias("result"))
    return batches.in_old_order(done)


# -- rewards by tag, metrics by name


@query(
    """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS tag, value, CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END AS strict FROM events),
    n AS (SELECT day, 'accuracy' AS name, value AS v FROM e UNION ALL SELECT day, 'strict_accuracy', strict FROM e UNION ALL SELECT day, concat(tag, '_accuracy'), value FROM e UNION ALL SELECT day, concat(tag, '_strict_accuracy'), strict FROM e)
    SELECT CAST(day AS VARCHAR) AS day, name, round(avg(v), 6) AS mean, count(*) AS n FROM n GROUP BY 1, 2"""
)
def tag_reward_means(spark, sf):
    """Rewards and strict rewards over all and by tag, carried as a map with the same keys in each row."""
    e = table(spark, sf, "events")
    tags = [r.event_type for r in e.select("event_type").distinct().collect()]  # the names of the tags
    d = e.select(F.to_date("ts").cast("string").alias("day"), "event_type", "value", F.when(F.col("value") > 10, 1.0).otherwise(0.0).alias("strict"))
    return registry.map_means(registry.tag_rewards(d, "event_type", "value", "strict", tags), ["day"]).withColumn("mean", r6(F.col("mean")))


@query(
    """WITH d AS (SELECT p_brand, lower(p_name) AS gt, lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN reverse(p_name) WHEN 2 THEN concat(p_name, '#') ELSE substring(p_name, 2) END) AS rec, p_size FROM part),
    m AS (SELECT *, len(list_filter(list_distinct(string_split(gt, ' ')), lambda x: list_contains(string_split(rec, ' '), x))) AS hits, len(string_split(gt, ' ')) AS words,
          list_sum(list_transform(list_distinct(string_split(replace(gt, ' ', ''), '')), lambda c: least(len(gt) - len(replace(gt, c, '')), len(rec) - len(replace(rec, c, ''))))) AS chars, len(replace(gt, ' ', '')) AS n FROM d)
    SELECT p_brand, round(avg(levenshtein(gt, rec) / greatest(length(gt), length(rec))), 6) AS ned, round(avg(CASE WHEN gt = rec THEN 1.0 ELSE 0.0 END), 6) AS completion, min(CAST(p_size AS DOUBLE)) AS worst,
           round(sum(hits) / sum(words), 6) AS words, round(sum(chars) / sum(n), 6) AS chars FROM m GROUP BY 1"""
)
def metrics_by_name(spark, sf):
    """Five metrics asked for by name; one scan and one aggregation answer all."""
    name = F.col("p_name")
    rec = F.element_at(F.array(name, F.reverse(name), F.concat(name, F.lit("#")), F.expr("substring(p_name, 2)")), (F.col("p_partkey") % 4 + 1).cast("int"))
    d = table(spark, sf, "part").select("p_brand", F.lower(name).alias("gt"), F.lower(rec).alias("rec"), "p_size")
    both = ["gt", "rec"]
    out = registry.evaluate(d, ["p_brand"], {"ned": ("ned", both), "completion": ("completion", both), "worst": ("worst", ["p_size"]), "words": ("word_accuracy", both), "chars": ("char_accuracy", both)})
    return out.withColumns({c: r6(F.col(c)) for c in ("ned", "completion", "words", "chars")})


# -- nearest words


@query(
    f"""WITH RECURSIVE w AS (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark),
    pairs AS (SELECT row_number() OVER () AS p, x.item_id, y.v AS a, x.w AS b FROM w x JOIN (SELECT DISTINCT item_id, substring(w, 2) AS v FROM w) y ON x.item_id = y.item_id), {RATIOS}
    SELECT item_id, w, arg_max(r.a, struct_pack(r := r, a := r.a)) AS nearest, round(max(r), 6) AS ratio FROM (SELECT p.item_id, p.b AS w, r.a, r.r FROM pairs p JOIN ratios r USING (p)) r GROUP BY 1, 2"""
)
def nearest_words(spark, sf):
    """Each word of an item and the nearest of the item's words without their first letters."""
    w = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w"))
    cut = w.select("item_id", F.expr("substring(w, 2)").alias("v"))
    return nearest.nearest_words(w, cut, ["item_id"], "w", "v").select("item_id", "w", F.col("v").alias("nearest"), r6(F.col("ratio")).alias("ratio"))


# -- packed sequences


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, coalesce(length(text), 0) // 4 AS n, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents),
    p AS (SELECT doc_id, row, n, row // 512 AS run, 0 AS pack, CAST(0 AS BIGINT) AS start FROM d WHERE row % 512 = 0
          UNION ALL SELECT d.doc_id, d.row, d.n, p.run, CASE WHEN p.start + p.n + d.n <= 2048 THEN p.pack ELSE p.pack + 1 END, CASE WHEN p.start + p.n + d.n <= 2048 THEN p.start + p.n ELSE 0 END FROM p JOIN d ON d.row = p.row + 1 AND d.row % 512 <> 0)
    SELECT doc_id, concat(run, '-', pack) AS pack, start AS "begin" FROM p"""
)
def packed_sequences(spark, sf):
    """Documents, of a token for every four characters, packed to 2048 tokens."""
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("n"))
    return packing.packed(d, "n", 2048, "doc_id").select("doc_id", "pack", "begin")


@query(
    """WITH s AS (SELECT conv_id, turn, length(text) AS n, CASE role WHEN 'user' THEN 'full' WHEN 'system' THEN 'noise' ELSE 'causal' END AS mode FROM conversations),
    o AS (SELECT conv_id, turn, n, mode, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS b FROM s),
    k AS (SELECT x.conv_id, x.n * y.n AS n, x.turn > y.turn AND y.mode <> 'noise' AS seen, x.turn = y.turn AS own, CASE WHEN x.mode = 'causal' THEN x.n * (x.n + 1) // 2 ELSE x.n * x.n END AS mine FROM o x JOIN o y USING (conv_id))
    SELECT conv_id, CAST(coalesce(sum(n) FILTER (seen), 0) + coalesce(sum(mine) FILTER (own), 0) AS BIGINT) AS cells FROM k GROUP BY 1"""
)
def attention_cells(spark, sf):
    """How many pairs of characters of a conversation attend to each other: questions in full, answers causally, system turns only within themselves."""
    role = F.when(F.col("role") == "user", "full").when(F.col("role") == "system", "noise").otherwise("causal")
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"), role.alias("mode"))
    q = F.col("q_end") - F.col("q_begin")
    cells = F.when(F.col("triangle"), F.floor(q * (q + 1) / 2)).otherwise(q * (F.col("k_end") - F.col("k_begin")))
    return packing.attention_runs(d, "conv_id", "turn", "n", "mode").groupBy("conv_id").agg(F.sum(cells).cast("long").alias("cells"))


@query("WITH p AS (SELECT p_partkey, p_size % 5 + 1 AS h, CAST(floor(p_retailprice) AS BIGINT) % 7 + 1 AS w FROM part) SELECT p_partkey, string_agg(CAST(y * 8 + x AS VARCHAR), ',' ORDER BY y, x) AS corner, string_agg(CAST((y * 8 // h) * 8 + x * 8 // w AS VARCHAR), ',' ORDER BY y, x) AS spread FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM p)) GROUP BY 1")
def patch_grid(spark, sf):
    """Positions of the patches of pictures of different sizes."""
    h, w = (F.col("p_size") % 5 + 1) * 14, (F.floor("p_retailprice") % 7 + 1) * 14
    text = lambda spread: F.array_join(packing.patch_positions(h, w, 14, 8, spread).cast("array<string>"), ",")
    return table(spark, sf, "part").select("p_partkey", text(False).alias("corner"), text(True).alias("spread"))


# -- placement


@query(
    """WITH p AS (SELECT s_suppkey, (s_suppkey % 7 + 2) / 10.0 AS x1, (s_nationkey % 9 + 1) / 10.0 AS y1, (s_nationkey % 7 + 2) / 10.0 AS x2, (s_suppkey % 9 + 1) / 10.0 AS y2 FROM supplier),
    g AS (SELECT x.i / 10.0 AS x, y.i / 10.0 AS y FROM (SELECT unnest(range(2, 9)) AS i) x, (SELECT unnest(range(1, 10)) AS i) y),
    c AS (SELECT s_suppkey, abs(a.x - x1) + abs(a.y - y1) + abs(b.x - x2) + abs(b.y - y2) AS cost FROM p, g a, g b WHERE abs(a.x - b.x) >= 0.4 - 1e-9 OR abs(a.y - b.y) >= 0.2 - 1e-9)
    SELECT s_suppkey, pos, round(min(cost), 6) AS cost, true AS inside FROM c, (SELECT unnest([1, 2]) AS pos) GROUP BY 1, 2"""
)
def placed_regions(spark, sf):
    """Two regions of 0.4 by 0.2 a supplier, near points made of its keys; the oracle tries all places of a grid that holds an optimum."""
    s = table(spark, sf, "supplier")
    point = lambda pos, a, b: F.struct(F.lit(pos).alias("pos"), ((F.col(a) % 7 + 2) / 10).alias("x"), ((F.col(b) % 9 + 1) / 10).alias("y"))
    d = s.select("s_suppkey", F.explode(F.array(point(1, "s_suppkey", "s_nationkey"), point(2, "s_nationkey", "s_suppkey"))).alias("p")).select("s_suppkey", "p.*")
    out = placement.placed(d, "s_suppkey", "pos", "x", "y", 0.08, (2.0,))
    return out.select("s_suppkey", "pos", r6(F.col("cost")).alias("cost"), layout.region_ok(0.08, slack=1e-9).alias("inside"))
