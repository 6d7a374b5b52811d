"""Registered queries of the smaller operators on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assign, match, parse, sequence, text, vec
from ..operators import aggregate, evaluate, joins, layout, registry, report, reward, sample
from .catalog import BYTES, NED, RATIOS, query, r6, table

# -- text


@query("SELECT p_partkey, concat(p_name, ' x ', p_type, ' ', p_brand, ' end') AS cleaned FROM part")
def raw_text(spark, sf):
    """Punctuation becomes white space, but for what stands in quotes."""
    raw = F.concat("p_name", F.lit(",，x  "), F.lit('"'), "p_type", F.lit('" '), "p_brand", F.lit("\\n end ,"))
    return table(spark, sf, "part").select("p_partkey", text.process_raw_text(raw).alias("cleaned"))


@query(f"SELECT item_id, regexp_replace(text, '[^{text.CJK_NARROW}a-zA-Z0-9#]', '', 'g') AS marks, regexp_replace(text, '\\s+', '', 'g') AS tight FROM benchmark")
def bare_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.strip_to_marks(F.col("text")).alias("marks"), text.strip_whitespace(F.col("text")).alias("tight"))


@query("SELECT p_partkey, CASE WHEN 2 * length(p_type) <= length(p_name) THEN p_name ELSE p_type END AS target, p_name AS kept FROM part")
def target_rule(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.target_or_original(F.col("p_name"), F.col("p_type")).alias("target"), text.target_or_original(F.col("p_name"), F.lit("")).alias("kept"))


@query("SELECT p_partkey, lower(p_type) AS last, p_name AS first FROM part")
def between_quotes(spark, sf):
    s = F.concat(F.lit('a "'), "p_name", F.lit('" and "'), "p_type", F.lit('" b'))
    return table(spark, sf, "part").select("p_partkey", text.between_last_quotes(s).alias("last"), text.after_first_quote(s).alias("first"))


@query("SELECT p_partkey, concat_ws('|', '中', '文', p_name, '字', concat('a', p_size)) AS split, concat_ws('|', '中', '文', p_name, '字') AS kept FROM part")
def mixed_tokens(spark, sf):
    """Ideographs one by one, other runs whole; for anomaly figures only the ideographs of a mixed word."""
    words = F.array(F.lit("中文"), F.col("p_name"), F.concat(F.lit("字a"), F.col("p_size").cast("string")))
    marked = F.concat(words, F.array(F.lit("br#ken")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.tokens(words), "|").alias("split"), F.array_join(text.anomaly_tokens(marked), "|").alias("kept"))


@query("SELECT p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN '$' WHEN 1 THEN '&' WHEN 2 THEN '￥' ELSE '#' END) AS rec FROM part")
def matched_marks(spark, sf):
    """Anomaly marks give way to the sign that the reference holds."""
    ref = F.element_at(F.array(F.lit("a#"), F.lit("a$#&"), F.lit("b$#￥"), F.lit("$#")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.match_marks(F.concat(F.lit("<"), "p_name", F.lit("#>")), ref).alias("rec"))


@query("SELECT conv_id, turn, len(string_split(lower(text), ' ')) AS n, lower(string_split(text, ' ')[1]) AS first, role = 'user' AS same FROM conversations")
def lowered_words(spark, sf):
    w = text.lower_split(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(w).cast("long").alias("n"), F.get(w, F.lit(0)).alias("first"), text.same_ignoring_case(F.col("role"), F.lit(" USER ")).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END, '|no') END AS answers FROM part")
def yes_no_answers(spark, sf):
    """Two questions; a fifth of the responses answer one."""
    s = F.concat(F.when(F.col("p_size") > 25, "Yes, it is\n\n").otherwise("NO.\n\n"), F.when(F.col("p_partkey") % 5 == 0, "maybe").otherwise(" no"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.yes_no_lines(s, F.lit(2)), "|").alias("answers"))


@query("SELECT p_partkey, concat('Recognise all text visible in ', CASE WHEN p_size % 2 = 0 THEN concat('the area ', p_brand) ELSE 'the whole image' END, '.') AS head, length(p_brand) * 2 + 9 AS more FROM part")
def prompt_templates(spark, sf):
    """Instructions for a box or a whole image; how much longer a box makes one."""
    box, whole = text.recognition_prompt(F.col("p_brand")), text.recognition_prompt()
    head = F.regexp_extract(F.when(F.col("p_size") % 2 == 0, box).otherwise(whole), r"^[^.]*\.", 0)
    return table(spark, sf, "part").select("p_partkey", head.alias("head"), (F.length(box) - F.length(whole) + F.length(F.lit("the whole image")) + F.length(F.lit("the image"))).cast("long").alias("more"))


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) AS merged FROM events WHERE value > 20 GROUP BY 1")
def merged_lines(spark, sf):
    """Event types as recognised lines, those with a positive confidence joined."""
    lines = F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("text"), (F.col("value") - 20).alias("conf"))))
    return table(spark, sf, "events").groupBy("user_id").agg(lines.alias("l")).select("user_id", text.merge_lines(F.col("l"), " ").alias("merged")).filter("merged <> ''")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'zh' ELSE 'en' END AS mode, CASE WHEN p_size % 2 = 0 THEN 'box' ELSE 'image' END AS level FROM part")
def name_modes(spark, sf):
    """Language and level from names of files made of part names."""
    file = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "_ZH").otherwise("_EN"), F.lit(".json"))
    id_ = F.concat(F.when(F.col("p_size") % 2 == 0, "box_").otherwise("image_"), "p_name")
    return table(spark, sf, "part").select("p_partkey", text.language_mode(file).alias("mode"), text.level_of_id(id_).alias("level"))


@query("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) - 1 AS place FROM events GROUP BY 1, 2")
def first_occurrences(spark, sf):
    """The kinds of events of each user, in the order in which they first came."""
    return aggregate.first_occurrences(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT p_partkey, concat(p_name, '|', p_type) AS items, concat(p_size, '|', p_brand) AS values_ FROM part")
def list_literals(spark, sf):
    """Lists written as Python and as JSON literals."""
    py = F.concat(F.lit("['"), "p_name", F.lit('\', "'), "p_type", F.lit('"]'))
    js = F.to_json(F.array(F.col("p_size").cast("string"), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(parse.python_list(py), "|").alias("items"), F.array_join(F.from_json(js, "array<string>"), "|").alias("values_"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_brand, ' say ', p_name) ELSE p_brand END AS en, concat(p_type, ' ', p_brand) AS zh FROM part")
def prompt_targets(spark, sf):
    """Quoted texts of prompts: plain, two in a row, and with an escaped mark and a possessive."""
    n, b = F.col("p_name"), F.col("p_brand")
    prompts = F.array(F.concat(F.lit("A sign, the text : '"), n, F.lit("' on it")), F.concat(F.lit("'say', \""), n, F.lit("\" and ''"), b, F.lit("''")), F.concat(F.lit("the dogs' \\'x\\' \""), b, F.lit('"')))
    en = F.element_at(prompts, (F.col("p_partkey") % 3 + 1).cast("int"))
    zh = F.concat(F.lit("写“"), "p_type", F.lit("”和《"), b, F.lit("》"))
    return table(spark, sf, "part").select("p_partkey", parse.prompt_target(en, "en").alias("en"), parse.prompt_target(zh, "zh").alias("zh"))


# -- matching

PAIRS = "WITH p AS (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS a1, split_part(lower(p_name), ' ', 2) AS a2, lower(p_type) AS b1, lower(p_brand) AS b2, CAST(p_size AS VARCHAR) AS b3 FROM part)"


@query(
    PAIRS + ", n AS (SELECT p_partkey, " + ", ".join(f"{NED.format(f'a{i}', f'b{j}')} AS d{i}{j}" for i in (1, 2) for j in (1, 2, 3)) + " FROM p)"
    " SELECT p_partkey, round((least(" + ", ".join(f"d1{i} + d2{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i != j) + ") + 1) / 3, 6) AS gned FROM n"
)
def gned_three(spark, sf):
    """Two expected words against three."""
    pred = F.array(F.lower("p_type"), F.lower("p_brand"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", r6(assign.gned(F.split(F.lower("p_name"), " "), pred)).alias("gned"))


@query(
    f"""WITH p AS (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS w, lower(p_type) AS t FROM part),
    q AS (SELECT *, translate(w, 'ei', 'ie') AS x FROM p), n AS (SELECT *, {NED.format('x', 'w')} AS d FROM q)
    SELECT p_partkey, CASE WHEN x <> w AND d < 0.5 THEN x ELSE '' END AS typo, CASE WHEN x <> w AND d >= 0.5 THEN x ELSE '' END AS irrelevant, CASE WHEN x <> w AND d < 0.5 OR x = w THEN '' ELSE w END AS missing FROM n"""
)
def typo_of_word(spark, sf):
    """One word and its misspelling."""
    w = F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1))
    b = match.bag_classify(F.array(w), F.array(F.translate(w, "ei", "ie")))
    d = table(spark, sf, "part").select("p_partkey", b.alias("b")).select("p_partkey", assign.typo_pairs("b.irrelevant", "b.missing").alias("t"))
    return d.select("p_partkey", F.array_join("t.typo", " ").alias("typo"), F.array_join("t.irrelevant", " ").alias("irrelevant"), F.array_join("t.missing", " ").alias("missing"))


@query(
    f"""WITH RECURSIVE w AS (SELECT p_partkey, reverse(p_name) AS w, unnest([p_type, p_name, p_brand]) AS v FROM part), pairs AS (SELECT row_number() OVER () AS p, p_partkey, v AS a, w AS b FROM w), {RATIOS}
    SELECT p_partkey, arg_max(r.a, struct_pack(r := r.r, a := r.a)) AS best FROM pairs JOIN ratios r USING (p) GROUP BY 1"""
)
def closest_of_list(spark, sf):
    """The name read backwards, among other words."""
    words = F.array("p_type", "p_name", "p_brand")
    return table(spark, sf, "part").select("p_partkey", sequence.closest(F.reverse("p_name"), words).alias("best"))


@query(
    """WITH p AS (SELECT p_partkey, concat(p_name, repeat('#', p_partkey % 6)) AS rec, substring(p_name, 1, 1 + p_size % 12) AS cor, p_name AS ref FROM part),
    n AS (SELECT p_partkey, length(replace(rec, ' ', '')) AS nr, length(replace(cor, ' ', '')) AS nc, length(replace(ref, ' ', '')) AS nf, p_partkey % 6 AS marks FROM p)
    SELECT p_partkey, CASE WHEN marks <= 0.05 * nr THEN 2 WHEN marks <= 0.25 * nr THEN 1 ELSE 0 END AS quality, CASE WHEN nc >= 0.8 * greatest(nr, nf) THEN 2 WHEN nc >= 0.5 * greatest(nr, nf) THEN 1 ELSE 0 END AS semantic FROM n"""
)
def scored_levels(spark, sf):
    """Graded responses: names with up to five marks, of which a part is right."""
    rec = F.concat("p_name", F.repeat(F.lit("#"), (F.col("p_partkey") % 6).cast("int")))
    cor = F.substr("p_name", F.lit(1), 1 + F.col("p_size") % 12)
    response = F.to_json(F.struct(rec.alias("recognized_text"), cor.alias("correct_text")))
    return table(spark, sf, "part").select("p_partkey", parse.score_levels(response, F.col("p_name")).alias("l")).select("p_partkey", "l.quality", "l.semantic")


@query(
    f"""WITH p AS (SELECT p_partkey, p_size, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b FROM part), q AS (SELECT *, substring(a, 1, length(a) - 1) AS c FROM p),
    d AS (SELECT *, least({NED.format('c', 'a')}, 2) + 0 AS ca, {NED.format('c', 'b')} AS cb, {NED.format('b', 'a')} AS ba FROM q)
    SELECT p_partkey, CASE WHEN p_size <= 20 THEN -1.0 WHEN p_partkey % 4 = 3 THEN 0.0 ELSE 1.0 END AS qua,
           round(CASE WHEN p_size <= 20 THEN -1.0 WHEN p_partkey % 4 = 0 THEN 1.0 WHEN p_partkey % 4 = 1 THEN 0.5 WHEN p_partkey % 4 = 2 THEN 1 - least(ca, cb + ba) / 2 ELSE 0.0 END, 6) AS gned,
           CASE WHEN p_size <= 20 THEN 'no response' ELSE 'none' END AS error FROM d"""
)
def scored_samples(spark, sf):
    """Samples joined with responses that are whole, lack a word, lack a letter or can't be read; those without one keep their row."""
    p = table(spark, sf, "part")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    said = F.element_at(F.array(F.col("p_name"), a, F.concat(F.substr(a, F.lit(1), F.length(a) - 1), F.lit(" "), b)), (F.col("p_partkey") % 4 + 1).cast("int"))
    response = F.when(F.col("p_partkey") % 4 == 3, F.col("p_type")).otherwise(F.to_json(F.struct(said.alias("recognized_text"))))
    samples = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("target"))
    out = evaluate.score_samples(samples, p.filter("p_size > 20").select(F.col("p_partkey").alias("id"), response.alias("response")))
    return out.select(F.col("id").alias("p_partkey"), r6(F.coalesce("qua", F.lit(-1.0))).alias("qua"), r6(F.coalesce("gned", F.lit(-1.0))).alias("gned"), F.coalesce("error", F.lit("none")).alias("error"))


@query(
    f"""WITH p AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b, lower(p_type) AS t FROM part),
    l AS (SELECT p_partkey, [a, b, t] AS g, CASE p_partkey % 3 WHEN 0 THEN [a, b] WHEN 1 THEN [a, b, a] ELSE [a, substring(b, 2)] END AS q FROM p),
    w AS (SELECT p_partkey, g, q, unnest(list_distinct(list_concat(g, q))) AS w FROM l),
    c AS (SELECT p_partkey, w, len(list_filter(g, lambda x: x = w)) AS ng, len(list_filter(q, lambda x: x = w)) AS nq FROM w),
    i AS (SELECT p_partkey, max(w) AS x FROM c WHERE ng = 0 GROUP BY 1),
    m AS (SELECT i.p_partkey, x, arg_min(w, {NED.format('x', 'w')}) AS y, min({NED.format('x', 'w')}) AS d FROM i JOIN c ON c.p_partkey = i.p_partkey AND ng > nq GROUP BY 1, 2),
    k AS (SELECT c.*, coalesce(m.d < 0.5 AND m.y = w, false) AS found, coalesce(m.d < 0.5 AND m.x = w, false) AS typo FROM c LEFT JOIN m USING (p_partkey))
    SELECT p_partkey, coalesce(string_agg(w, ' ' ORDER BY w) FILTER (least(ng, nq) > 0), '') AS correct, coalesce(string_agg(w, ' ' ORDER BY w) FILTER (ng > 0 AND nq > ng), '') AS duplicate,
           coalesce(string_agg(w, ' ' ORDER BY w) FILTER (ng = 0 AND NOT typo), '') AS irrelevant, coalesce(string_agg(w, ' ' ORDER BY w) FILTER (typo), '') AS typo,
           coalesce(string_agg(w, ' ' ORDER BY w) FILTER (ng - nq - found::INT > 0), '') AS missing FROM k GROUP BY 1"""
)
def classified_tokens(spark, sf):
    """Recognised texts that lack the last word, repeat the first one, or misspell the second one; the different tokens of each class."""
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    said = F.element_at(F.array(F.col("p_name"), F.concat_ws(" ", "p_name", a), F.concat_ws(" ", a, F.expr("substring(split_part(p_name, ' ', 2), 2)"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    d = evaluate.classified(table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("target"), said.alias("recognised")))
    different = lambda k: F.array_join(F.array_sort(F.array_distinct(F.split(f"{k}_text", " "))), " ").alias(k)
    return d.select("p_partkey", *map(different, ("correct", "duplicate", "irrelevant", "typo", "missing")))


BOARD = "SELECT CASE p_partkey % 2 WHEN 0 THEN 'anno_box' ELSE 'render_image' END AS category, 'en' AS lang, CASE p_partkey % 2 WHEN 0 THEN 'box' ELSE 'image' END AS level, p_name, p_size FROM part WHERE p_partkey % 3 > 0"


@query(f"SELECT category, lang, level, count(*) FILTER (p_size % 4 = 0) AS fp, count(*) FILTER (p_size % 4 <> 0) AS tn, CAST(sum(2) AS BIGINT) AS tokens, CAST(sum(2) AS BIGINT) AS hits FROM ({BOARD}) GROUP BY 1, 2, 3")
def anomaly_categories(spark, sf):
    """Rows by source category and level; a third has an unknown source and is left out."""
    source = F.when(F.col("p_partkey") % 3 == 0, "unknown").when(F.col("p_partkey") % 2 == 0, "anno v1_box").otherwise("sythetic_image")
    id_ = F.concat(F.when(F.col("p_partkey") % 2 == 0, "box_").otherwise("img_"), F.col("p_partkey").cast("string"))
    marks = F.concat("p_name", F.when(F.col("p_size") % 4 == 0, " #").otherwise(""))
    d = table(spark, sf, "part").select(id_.alias("id"), source.alias("data_source"), marks.alias("pred_text"), F.col("p_name").alias("gt_text"))
    return evaluate.anomaly_board(d, with_total=False).select("category", "lang", "level", "fp", "tn", F.col("tokens").cast("long").alias("tokens"), F.col("hits").cast("long").alias("hits"))


# -- joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_strict(spark, sf):
    """Orders with their customer; one without would fail the query."""
    o, c = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), table(spark, sf, "customer").select("c_custkey", "c_name")
    o = o.join(c.select("c_custkey"), "c_custkey", "left_semi")
    return joins.lookup_join(o, c, "c_custkey", "error").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def lookup_skip(spark, sf):
    o, c = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    return joins.lookup_join(o, c, "c_custkey", "skip").select("o_orderkey", "c_name")


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) = 1 THEN max(o_orderstatus) ELSE 'none' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def exactly_one_order(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    return joins.exactly_one(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "status").select("c_custkey", F.coalesce("status", F.lit("none")).alias("status"))


@query("SELECT concat(CASE WHEN p_size > 30 THEN 'b_' ELSE 't_' END, p_partkey) AS key, CASE WHEN p_size > 30 THEN p_brand ELSE p_type END AS about, p_name FROM part")
def prefixed_keys(spark, sf):
    """Scores under prefix and id joined with what is known of category and id, two categories."""
    p, id_ = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    scores = p.select(F.concat(F.when(F.col("p_size") > 30, "b_").otherwise("t_"), id_).alias("key"))
    meta = joins.concat_chunks([p.select(F.lit(c).alias("category"), id_.alias("id"), "p_name", F.col(about).alias("about")) for c, about in (("brands", "p_brand"), ("types", "p_type"))])
    return joins.prefixed_lookup(scores, meta, "key", {"b": "brands", "t": "types"}).select("key", "about", "p_name")


@query("SELECT a.p_partkey AS pos, b.p_partkey AS idx, b.p_name FROM part a JOIN part b ON b.p_partkey = a.p_partkey - a.p_partkey % 10")
def gathered_rows(spark, sf):
    """Rows picked by index, each tenth one ten times."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), "p_name")
    picks = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("idx"))
    return joins.gather(rows, picks, "idx").select("pos", "idx", "p_name")


@query("SELECT doc_id, coalesce(quality, 0) + 0.0 AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def default_scores(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return joins.with_default(table(spark, sf, "documents").select("doc_id"), labels, "doc_id", "quality")


@query("SELECT p_partkey, x, y FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x, [p_type, p_brand] AS b FROM part), LATERAL (SELECT unnest(b) AS y)")
def token_grid(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.array("p_type", "p_brand").alias("b"))
    return joins.token_pairs(d, "p_partkey", "a", "b")


@query("SELECT p_type, p_brand, p_size FROM part WHERE p_type IN ('LARGE', 'PROMO')")
def whitelisted(spark, sf):
    p = table(spark, sf, "part").select("p_type", "p_brand", "p_size")
    return joins.whitelist(joins.whitelist(p, "p_type", ["LARGE", "PROMO"]), "p_brand", None)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_of_key(spark, sf):
    return joins.last_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_id"))


@query("SELECT concat('item_', row_number() OVER (ORDER BY p_name, p_partkey) - 1) AS id, p_partkey FROM part")
def numbered_items(spark, sf):
    return joins.numbered(table(spark, sf, "part").select("p_name", "p_partkey"), "item", "p_name", "p_partkey").select("id", "p_partkey")


# -- aggregates


@query("SELECT round(avg(value), 6) AS reward_a, round(avg(value / 2), 6) AS reward_b FROM events")
def logged_rewards(spark, sf):
    d = table(spark, sf, "events").select(F.col("value").alias("reward_a"), (F.col("value") / 2).alias("reward_b"), F.lit(1.0).alias("reward_b_accuracy"), "event_id")
    out = aggregate.logged_means(d)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("SELECT user_id, round(coalesce(avg(CASE WHEN event_id % 4 = 0 AND value > 20 THEN value - 20 END), 0.0), 6) AS reward FROM events GROUP BY 1")
def video_reward(spark, sf):
    """Events as frames of a user's video."""
    d = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") - 20).alias("reward"))
    return aggregate.every_nth_positive_mean(d, ["user_id"], "event_id", "reward").withColumn("reward", r6(F.col("reward")))


@query("WITH d AS (SELECT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents) SELECT CASE WHEN source IN ('src0', 'src1') THEN concat(lang, '_EN') ELSE lang END AS model, count(*) AS n FROM d GROUP BY 1")
def board_names(spark, sf):
    d = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"))
    return d.groupBy(aggregate.board_name(F.col("lang"), F.concat(F.lit("x/"), "source", F.lit("/y")), ["/src0/", "/src1/"]).alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_linenumber = 1 THEN (l_discount + l_tax) / 2 ELSE (l_discount + l_tax + l_quantity) / 3 END, 6) AS mean FROM lineitem")
def wide_means(spark, sf):
    """NaN is no value."""
    d = table(spark, sf, "lineitem").withColumn("l_quantity", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")))
    return aggregate.wide_mean(d, ["l_discount", "l_tax", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", r6(F.col("mean")).alias("mean"))


@query("SELECT count(*) AS n, count(*) FILTER (value > 30) AS ok, round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events")
def success_rate(spark, sf):
    return aggregate.success(table(spark, sf, "events"), F.col("value") > 30).withColumn("rate", r6(F.col("rate")))


@query("SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS texts, count(*) AS n FROM conversations GROUP BY 1")
def concatenated_batches(spark, sf):
    """A conversation's turns as batches of one."""
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.array("text").alias("v"))
    return aggregate.concat_lists(d, ["conv_id"], "v", "turn").select("conv_id", F.array_join("v", "|").alias("texts"), F.size("v").cast("long").alias("n"))


@query("WITH c AS (SELECT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, round_even(avg(n_chars), 3) AS v FROM documents GROUP BY 1, 2) SELECT lang, round(max(CASE WHEN source = 'src0' THEN v END), 3) AS src0, round(avg(v), 6) AS overall FROM c GROUP BY 1")
def evaluation_board(spark, sf):
    """Models by data sets, and the mean of the rounded cells."""
    d = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.col("n_chars").cast("double").alias("chars"))
    b = evaluate.board(d, "source", "lang", ["chars"], ["src0"])["chars"]
    return b.select("lang", F.round("src0", 3).alias("src0"), r6(F.col("OVERALL")).alias("overall"))


@query("SELECT lang, mean, row_number() OVER (ORDER BY mean DESC, lang) AS place FROM (SELECT coalesce(lang, 'none') AS lang, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1)")
def ranked_models(spark, sf):
    """The order of a ranking, as numbers."""
    d = table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(r6(F.avg("n_chars")).alias("mean"))
    return sample.with_row_numbers(report.ranked(d, "mean", "lang"), F.col("mean").desc(), "lang", name="r").select("lang", "mean", (F.col("r") + 1).alias("place"))


@query("SELECT p_type, p_brand, row_number() OVER (ORDER BY p_type, p_brand) - 1 AS place FROM (SELECT DISTINCT p_type, p_brand FROM part)")
def sorted_types(spark, sf):
    """The different types and brands, in order."""
    d = joins.distinct_values([table(spark, sf, "part")], "p_type", "p_brand")
    return sample.with_row_numbers(d, "p_type", "p_brand", name="place")


@query("SELECT lang, source, row_number() OVER (ORDER BY lang NULLS FIRST, source NULLS FIRST) - 1 AS place FROM (SELECT lang, source FROM documents WHERE n_chars > 500 UNION SELECT lang, source FROM documents WHERE n_chars <= 500 OR n_chars IS NULL)")
def union_of_models(spark, sf):
    """Models that any of two result sets names; unknown ones count as one."""
    d = table(spark, sf, "documents")
    both = joins.distinct_values([d.filter("n_chars > 500"), d.filter("n_chars <= 500 OR n_chars IS NULL")], "lang", "source")
    return sample.with_row_numbers(both, F.col("lang").asc_nulls_first(), F.col("source").asc_nulls_first(), name="place")


@query("SELECT event_id, CASE WHEN value > 10 THEN 0 ELSE 1 END AS chunk, event_type, CASE WHEN value <= 10 THEN user_id ELSE -1 END AS user_id FROM events WHERE value IS NOT NULL")
def chunk_union(spark, sf):
    """Results of two chunks, one of which has a column more."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    return joins.concat_chunks([e.filter("value > 10").drop("user_id"), e.filter("value <= 10")]).drop("value").fillna(-1, ["user_id"])


# -- rewards and vectors


@query("SELECT event_id, value AS advantage FROM events")
def raw_advantage(spark, sf):
    return reward.raw_advantage(table(spark, sf, "events").select("event_id", "value"), "value").select("event_id", "advantage")


@query(
    """WITH e AS (SELECT (value - 10) / 10 AS a, exp(((event_id % 7) - 3) * 0.03) AS r FROM events), c AS (SELECT greatest(-5.0, least(5.0, a)) AS a, r FROM e)
    SELECT round(avg(CASE WHEN r - 1 > 0.08 OR 1 - r > 0.02 THEN 1.0 ELSE 0.0 END), 6) AS clipfrac, round(avg(CASE WHEN r - 1 > 0.08 THEN 1.0 ELSE 0.0 END), 6) AS clipfrac_gt_one, round(avg(CASE WHEN 1 - r > 0.02 THEN 1.0 ELSE 0.0 END), 6) AS clipfrac_lt_one,
    round(avg(greatest(-a * r, -a * greatest(0.98, least(1.08, r)))), 6) AS policy_loss FROM c"""
)
def policy_two_sided(spark, sf):
    """Clipping with a side of its own for ratios above one."""
    d = table(spark, sf, "events").select(((F.col("value") - 10) / 10).alias("advantage"), (((F.col("event_id") % 7) - 3) * 0.03).alias("log_prob"), F.lit(0.0).alias("old_log_prob"))
    out = reward.policy_stats(d, 0.02, 0.08)
    return out.select(*[r6(F.col(c)).alias(c) for c in ("clipfrac", "clipfrac_gt_one", "clipfrac_lt_one", "policy_loss")])


@query("WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT n + (7 - n % 7) % 7 AS rows_, n AS groups FROM n")
def padded_groups(spark, sf):
    """Groups repeated until seven workers have the same number."""
    g = table(spark, sf, "events").select("user_id").distinct()
    return reward.pad_groups(g, "user_id", 7).agg(F.count(F.lit(1)).alias("rows_"), F.countDistinct("user_id").alias("groups"))


@query("WITH c AS (SELECT count(*) FILTER (value > 20) AS k, count(*) FILTER (value <= 20) AS z FROM events) SELECT CASE WHEN k % 8 = 0 OR z < 8 - k % 8 THEN k ELSE k + 8 - k % 8 END AS n, k FROM c")
def refilled_batch(spark, sf):
    """Rows with signal, filled up to whole batches of eight."""
    d = table(spark, sf, "events").select("event_id", (F.col("value") > 20).alias("m"))
    return reward.masked(d, "m", 8, "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("m").alias("k"))


@query("SELECT event_id, round(value - 0.1 * 1, 6) AS first, round(value - 0.1 * 2, 6) AS second FROM events")
def penalised_steps(spark, sf):
    s = reward.over_steps(F.col("value"), 2, F.array(F.lit(1.0), F.lit(2.0)), 0.1)
    return table(spark, sf, "events").select("event_id", s.alias("s")).select("event_id", r6(F.col("s")[0]).alias("first"), r6(F.col("s")[1]).alias("second"))


@query("SELECT p_partkey, greatest(-5.0, least(5.0, p_size - 20.0)) AS clipped, round((greatest(1.0, least(10.0, p_size / 4.0)) - 1) / 9, 6) AS aesthetic, round(p_size / 26.0, 6) AS pick, round(p_size / 30.0, 6) AS clip, round(-p_size / 500.0, 6) AS jpeg FROM part")
def rescaled_rewards(spark, sf):
    size, by = F.col("p_size"), registry.REWARDS
    return table(spark, sf, "part").select(
        "p_partkey", vec.clamp(size - 20.0, -5.0, 5.0).alias("clipped"), r6(by["aesthetic"](size / 4.0)).alias("aesthetic"), r6(by["pickscore"](size)).alias("pick"), r6(by["clipscore"](size)).alias("clip"), r6(by["jpeg_size"](size)).alias("jpeg")
    )


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE p_retailprice END AS score FROM part")
def safe_scores(spark, sf):
    """A row whose scorer failed counts 0."""
    error = F.when(F.col("p_size") % 3 == 0, "time out")
    return table(spark, sf, "part").select("p_partkey", registry.safe(F.col("p_retailprice"), error).alias("score"))


EMBEDDED = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query(EMBEDDED + ", r AS (SELECT label, arg_min(e, vec_id) AS r FROM v GROUP BY 1) SELECT vec_id, round(100 * list_cosine_similarity(e, r) / 26, 6) AS preference, round((e[1] + e[2]) / 2, 6) AS mean_known FROM v JOIN r USING (label)")
def preference_score(spark, sf):
    d = table(spark, sf, "embeddings")
    d = d.join(d.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("r")), "label")
    known = vec.mean_known(F.array(F.col("embedding")[0], F.lit(None).cast("float"), F.col("embedding")[1]))
    return d.select("vec_id", r6(vec.scaled_preference(F.col("embedding"), F.col("r"), 100.0)).alias("preference"), r6(known).alias("mean_known"))


@query(EMBEDDED + " SELECT vec_id, round((e[1] + e[2]) / 2, 6) AS mean, round((e[1] + 2 * e[2]) / 3, 6) AS weighted, round(e[2], 6) AS last FROM v")
def pooled_states(spark, sf):
    """Three states, of which the mask drops one."""
    e = F.col("embedding")
    states, mask = F.array(F.array(e[0]), F.array(e[1]), F.array(e[2])), F.array(F.lit(1), F.lit(1), F.lit(0))
    pool = lambda how: r6(vec.pooled(states, mask, how)[0].cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", pool("mean").alias("mean"), pool("weighted_mean").alias("weighted"), pool("last").alias("last"))


@query(
    EMBEDDED + """, s AS (SELECT vec_id, e, 0.6 * sin(0.7 * pi() / 2) AS sd FROM v),
    m AS (SELECT vec_id, e, list_transform(e, lambda x: (x - 0.8 * 0.5 * x) * (1 - 0.6) + (x + 0.5 * x * (1 - 0.8)) * sqrt(0.36 - sd * sd)) AS m FROM s)
    SELECT vec_id, round(list_avg(list_transform(list_zip(e, m), lambda z: -pow(0.9 * z[1] - z[2], 2))), 6) AS log_prob, round(m[1], 6) AS first_mean FROM m"""
)
def step_cps(spark, sf):
    """The coefficient-preserving step: mean and log-probability."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    s = vec.step_log_prob(e, F.transform(e, lambda x: x * 0.5), F.transform(e, lambda x: x * 0.9), F.lit(0.8), F.lit(0.6), F.lit(0.95), kind="cps")
    return table(spark, sf, "embeddings").select("vec_id", s.alias("s")).select("vec_id", r6(F.col("s.log_prob")).alias("log_prob"), r6(F.col("s.mean")[0]).alias("first_mean"))


@query("SELECT vec_id, len(embedding) + vec_id % 5 AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def padded_vectors(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    p = vec.pad_to(e, F.size("embedding") + F.col("vec_id") % 5)
    d = table(spark, sf, "embeddings").select("vec_id", p.alias("p"))
    return d.select("vec_id", F.size("p").cast("long").alias("n"), r6(F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("WITH d AS (SELECT item_id, string_split(text, ' ') AS a, list_reverse(string_split(text, ' '))[2:] AS b FROM benchmark), p AS (SELECT item_id, unnest(range(len(b))) AS pos, a, b FROM d) SELECT item_id, pos, 'a' AS name, a[pos + 1] AS value FROM p UNION ALL SELECT item_id, pos, 'b', b[pos + 1] FROM p")
def transposed_lists(spark, sf):
    """Words from the front beside words from the back, one fewer."""
    words = F.split("text", " ")
    d = table(spark, sf, "benchmark").select("item_id", words.alias("a"), F.slice(F.reverse(words), F.lit(2), F.size(words)).alias("b"))
    return joins.transposed(d, "item_id", ["a", "b"]).withColumn("pos", F.col("pos").cast("long"))


# -- sampling and layouts


@query("WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) SELECT c_custkey, r % 6 AS rank, CAST(CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE (n % 7) + (r - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT) AS shard FROM n")
def sharded_rows(spark, sf):
    """Round robin and contiguous shards."""
    c = table(spark, sf, "customer").select("c_custkey")
    return reward.shards(sample.round_robin(c, 6, "c_custkey"), 7, "c_custkey").select("c_custkey", "rank", "shard")


@query("WITH n AS (SELECT count(*) AS n FROM customer), b AS (SELECT n, (n + 63) // 64 AS k FROM n) SELECT CAST(i AS INT) AS batch, CASE WHEN i < n % k THEN n // k + 1 ELSE n // k END AS n FROM b, LATERAL (SELECT unnest(range(k)) AS i)")
def scorer_batches(spark, sf):
    return sample.near_equal_parts(table(spark, sf, "customer").select("c_custkey"), 64, "c_custkey").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(concat(n_nationkey, ':', 3)), n_nationkey) - 1 AS i FROM nation), d AS (SELECT CAST(concat('0x', substring(md5(concat(k, ':', 3)), 1, 8)) AS BIGINT) % 25 AS i FROM (SELECT unnest(range(200)) AS k)) SELECT n_name, count(*) AS n FROM d JOIN r USING (i) GROUP BY 1")
def sample_with_repeats(spark, sf):
    """200 draws from 25 nations."""
    return sample.sample_k(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 200, 3).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY md5(concat(c_custkey, ':', 9)), c_custkey) - 1 AS place FROM customer")
def shuffled_places(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return sample.with_row_numbers(c, sample.order_key("c_custkey", 9), "c_custkey", name="place")


@query("SELECT p_partkey, p_size AS total, true AS positive FROM part")
def composed_integers(spark, sf):
    """Random parts of an integer: positive, and with the integer as sum."""
    p = sample.composition_parts(F.col("p_size"), F.col("p_partkey"))
    d = table(spark, sf, "part").select("p_partkey", p.alias("p"))
    return d.select("p_partkey", F.aggregate("p", F.lit(0), lambda s, x: s + x).alias("total"), (F.array_min("p") > 0).alias("positive"))


@query(
    """WITH d AS (SELECT p_partkey, CAST(concat('0x', substring(md5(concat(p_partkey, ':0')), 1, 8)) AS BIGINT) AS a, CAST(concat('0x', substring(md5(concat(p_partkey, ':1')), 1, 8)) AS BIGINT) AS b,
        CAST(concat('0x', substring(md5(concat(p_partkey, ':2')), 1, 8)) AS BIGINT) AS c, CAST(concat('0x', substring(md5(concat(p_partkey, ':3')), 1, 8)) AS BIGINT) AS d FROM part), n AS (SELECT *, ['cat', 'owl', 'Emu'][a % 3 + 1] AS noun FROM d)
    SELECT p_partkey, concat(CASE WHEN noun = 'cat' THEN 'a ' ELSE 'an ' END, noun, ' ', ['riding a bike', 'reading'][b % 2 + 1]) AS activity, concat('A ', noun, ' holding a sign that says "', repeat('6', c % 9 + 1), '"') AS sign, concat(d % 8 + 2, ' ', noun, 's') AS count FROM n"""
)
def random_prompts(spark, sf):
    """Three kinds of prompts by name, drawn by the part's key."""
    d = table(spark, sf, "part").select("p_partkey")
    for kind in ("activity", "sign", "count"):
        d = sample.prompts(d, kind, "p_partkey", ["cat", "owl", "Emu"], ["riding a bike", "reading"], kind)
    return d


@query(
    """WITH p AS (SELECT p_partkey, p_size % 5 + 1 AS area FROM part) SELECT p_partkey, area, area AS regions, 0 AS overlapping, CASE area WHEN 1 THEN 0.48 WHEN 2 THEN 0.56 WHEN 3 THEN 0.48 WHEN 4 THEN 0.4 ELSE 0.44 END AS covered FROM p"""
)
def layout_tables(spark, sf):
    """Parts with as many texts as their sizes say, and their fixed layouts: regions, how many overlap, and what they cover."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("area"))
    fixed = layout.fixed_layouts(spark)
    n = fixed.groupBy("area").agg(F.count(F.lit(1)).cast("int").alias("regions"), F.round(F.sum(F.col("m_scale") * F.col("n_scale")), 6).alias("covered"))
    o = layout.overlaps(fixed).groupBy("area").agg(F.count(F.lit(1)).cast("int").alias("overlapping"))
    return p.join(n, "area").join(o, "area", "left").select("p_partkey", "area", "regions", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), "covered")


@query(
    """WITH u AS (SELECT p_partkey, list_transform([0, 1, 2, 3], lambda i: CAST(concat('0x', substring(md5(concat(p_partkey, ':', i)), 1, 8)) AS BIGINT) / 4294967296.0) AS u FROM part), r AS (SELECT p_partkey, u[1] * 0.9 AS m, u[2] * 0.9 AS n, u FROM u)
    SELECT p_partkey, round(m, 6) AS m_offset, round(n, 6) AS n_offset, round(0.1 + u[3] * (0.9 - m), 6) AS m_scale, round(0.1 + u[4] * (0.9 - n), 6) AS n_scale FROM r"""
)
def random_layouts(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", layout.random_region(F.col("p_partkey")).alias("r"))
    return d.select("p_partkey", *[r6(F.col(f"r.{c}")).alias(c) for c in ("m_offset", "n_offset", "m_scale", "n_scale")])


@query(f"SELECT item_id, round({NED.format(BYTES('t'), BYTES('reverse(t)'))}, 6) AS ned FROM (SELECT item_id, lower(regexp_replace(text, '[^a-zA-Z{text.FRENCH}]', '', 'g')) AS t FROM benchmark)")
def reversed_ned(spark, sf):
    """Items against themselves backwards: letters beyond ASCII count once."""
    t = F.lower(F.regexp_replace("text", f"[^a-zA-Z{text.FRENCH}]", ""))
    return table(spark, sf, "benchmark").select("item_id", r6(match.ned(t, F.reverse(t))).alias("ned"))


@query(
    """WITH d AS (SELECT item_id, text AS gt, CASE item_id % 3 WHEN 0 THEN reverse(text) WHEN 1 THEN concat('鱼', text) ELSE string_split(text, '.')[1] END AS rec, item_id % 2 AS zh FROM benchmark),
    t AS (SELECT item_id, zh, CASE WHEN zh = 1 THEN string_split(concat(gt, '鱼龙'), '') ELSE list_filter(string_split_regex(gt, '\\s+'), lambda x: x <> '') END AS g, CASE WHEN zh = 1 THEN string_split(rec, '') ELSE list_filter(string_split_regex(rec, '\\s+'), lambda x: x <> '') END AS q FROM d),
    w AS (SELECT item_id, zh, unnest(g) AS w, q FROM t), c AS (SELECT item_id, zh, w, count(*) AS ng, any_value(len(list_filter(q, lambda x: x = w))) AS nq FROM w GROUP BY 1, 2, 3)
    SELECT zh, CAST(sum(least(ng, nq)) AS BIGINT) AS matched, CAST(sum(ng) AS BIGINT) AS expected, round(sum(least(ng, nq)) / sum(ng), 6) AS ratio FROM c GROUP BY 1"""
)
def match_ratios(spark, sf):
    """Characters of targets with ideographs, words of the others."""
    t, zh = F.col("text"), F.col("item_id") % 2
    rec = F.element_at(F.array(F.reverse(t), F.concat(F.lit("鱼"), t), F.split(t, r"\.")[0]), (F.col("item_id") % 3 + 1).cast("int"))
    d = table(spark, sf, "benchmark").select(zh.alias("zh"), F.when(zh == 1, F.concat(t, F.lit("鱼龙"))).otherwise(t).alias("gt"), rec.alias("rec"))
    return aggregate.match_ratio(d, ["zh"], "gt", "rec").withColumn("ratio", r6(F.col("ratio")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((0.5 * l_discount + 0.5 * l_tax) / 1.0, 6) AS eval, round((0.5 * l_discount + 0.5 * l_tax) / 1.0, 6) AS amp5, round(l_tax, 6) AS \"default\" FROM lineitem")
def composite_presets(spark, sf):
    """Quality and semantics under the three presets of weights."""
    both = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[r6(vec.composite(*both, preset)).alias(preset) for preset in vec.PRESETS])


@query(
    """WITH p AS (SELECT p_partkey, p_name, p_partkey % 6 AS marks, p_partkey % 4 AS kind, length(replace(p_name, ' ', '')) + p_partkey % 6 AS n FROM part)
    SELECT p_partkey, CASE kind WHEN 3 THEN -1 ELSE CASE WHEN marks <= 0.05 * n THEN 2 WHEN marks <= 0.25 * n THEN 1 ELSE 0 END END AS quality, CASE WHEN kind = 3 THEN '<JSON_ERROR>' ELSE concat(p_name, repeat('#', marks)) END AS recognised FROM p"""
)
def scored_without_reference(spark, sf):
    """Graded responses without a reference: names with up to five marks, some in broken JSON, some no JSON at all."""
    rec = F.concat("p_name", F.repeat(F.lit("#"), (F.col("p_partkey") % 6).cast("int")))
    whole = F.to_json(F.struct(rec.alias("recognized_text")))
    response = F.element_at(F.array(whole, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```")), F.concat(F.lit("so "), whole), F.col("p_type")), (F.col("p_partkey") % 4 + 1).cast("int"))
    d = table(spark, sf, "part").select("p_partkey", parse.score_levels(response, F.lit(None).cast("string"), reference_free=True).alias("l"))
    return d.select("p_partkey", F.coalesce("l.quality", F.lit(-1)).alias("quality"), "l.recognised")
