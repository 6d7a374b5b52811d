"""Registered queries on the driver's tables, and equivalent SQL.

Every query runs over its whole tables. Floating-point results are rounded to
six digits on both sides, since engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import assign, match, parse, sequence, text, vec
from ..operators import aggregate, joins, layout, registry, report, reward, sample
from ..sources import scratch
from ..streaming import rewards as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


FR = text.FRENCH
WHITE = f"[^{text.CJK_NARROW}a-zA-Z0-9\\s{FR}]"
TIGHT = f"[^{text.CJK_NARROW}a-zA-Z0-9{FR}]"

# -- text


@query(f"SELECT item_id, lower(trim(regexp_replace(regexp_replace(text, '{WHITE}', '', 'g'), '\\s+', ' ', 'g'))) AS cleaned FROM benchmark")
def clean_text_en(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT item_id, regexp_replace(text, '{TIGHT}', '', 'g') AS cleaned FROM benchmark")
def clean_text_zh(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.clean(F.col("text"), "zh").alias("cleaned"))


@query(
    f"""WITH k AS (SELECT doc_id, text, regexp_replace(text, '{WHITE}', '', 'g') AS kept FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(kept, '[{text.CJK}]') THEN regexp_replace(text, '{TIGHT}', '', 'g') ELSE trim(regexp_replace(kept, '\\s+', ' ', 'g')) END AS cleaned FROM k"""
)
def clean_text_auto(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_auto(F.col("text")).alias("cleaned"))


@query("SELECT conv_id, turn, replace(replace(text, 'addCriterion', ''), 'No text recognized.', '') AS cleaned FROM conversations")
def strip_keywords(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.strip_keywords(F.col("text")).alias("cleaned"))


@query(
    """WITH n AS (SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n, length(text) - length(replace(text, '#', '')) AS m FROM documents)
    SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1 - 1.0 * m / n)), 6) END AS quality,
           CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1 - 5.0 * m / n)), 6) END AS quality5 FROM n"""
)
def quality_score(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", r6(match.quality(t)).alias("quality"), r6(match.quality(t, 5.0)).alias("quality5"))


@query(
    """WITH n AS (SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n, length(regexp_replace(text, '[\\s<>]+', '', 'g')) AS b, length(text) - length(replace(text, '#', '')) AS m FROM documents)
    SELECT doc_id, CASE WHEN n = 0 OR m <= 0.05 * n THEN 2 WHEN m <= 0.25 * n THEN 1 ELSE 0 END AS level, m > 0.5 * greatest(b, 1) AS bad FROM n"""
)
def quality_level(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", match.quality_level(t).alias("level"), match.is_bad(t).alias("bad"))


@query("SELECT page_id, split_part(regexp_replace(regexp_replace(url, '[?#].*', ''), '/+$', ''), '/', -1) AS name, regexp_extract(name, '^([^_.]*)', 1) AS id, regexp_replace(name, '\\.[^.]+$', '') AS stem, substring(name, 1, 3) AS lead FROM pages")
def file_id_parse(spark, sf):
    name = text.base_name(F.regexp_replace(F.regexp_replace("url", "[?#].*", ""), "/+$", ""))
    d = table(spark, sf, "pages").select("page_id", name.alias("name"))
    return d.select("page_id", "name", text.id_from_name(F.col("name")).alias("id"), text.stem(F.col("name")).alias("stem"), F.substring("name", 1, 3).alias("lead"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", parse.json_field(F.col("props"), "k").alias("k"))


RECOGNISED = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN concat(p_name, ' second') WHEN 3 THEN concat(p_name, ' ') ELSE concat(p_name, ' b') END"""
#: Names have two words, so of three recognised ones the third is left over, and of two both are matched.
LEFT_OVER = "CASE p_partkey % 5 WHEN 2 THEN 1.0 / 3 WHEN 3 THEN 0.0 WHEN 4 THEN 1.0 / 3 ELSE 0.0 END"


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN concat(p_name, chr(10), 'second') ELSE {RECOGNISED} END AS recognised, 1.0 AS quality, round(1 - {LEFT_OVER}, 6) AS semantic FROM part")
def response_parse(spark, sf):
    """Broken and whole responses made of part names: fenced, cut off, with raw newlines, not JSON."""
    name = F.col("p_name")
    wrap = F.element_at(
        F.array(
            F.concat(F.lit('{"recognized_text": "'), name, F.lit('"}')),
            F.concat(F.lit('Answer:\n```json\n{"recognized_text": "'), name, F.lit('"}\n``` done')),
            F.concat(F.lit('{"recognized_text": "'), name, F.lit('\nsecond"} trailer')),
            F.concat(F.lit('"recognized_text": "'), name, F.lit(' <#>", "duplicate_text": "')),
            F.concat(F.lit('{"recognized_text": ["'), name, F.lit('", "b"]}')),
        ),
        F.pmod("p_partkey", F.lit(5)).cast("int") + 1,
    )
    return table(spark, sf, "part").select("p_partkey", parse.recognised(wrap).alias("recognised"), parse.score(wrap, name).alias("s")).select("p_partkey", "recognised", "s.quality", r6(F.col("s.semantic")).alias("semantic"))


@query("SELECT p_partkey, concat(p_name, '|', p_type) AS quoted, list_aggregate(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda x: x <> ''), 'string_agg', ' ') AS words FROM part")
def quoted_text(spark, sf):
    prompt = F.concat(F.lit('draw "'), F.col("p_name"), F.lit('" on ‘ '), F.col("p_type"), F.lit(" ’ and “unclosed 'x'"))
    words = F.concat(F.lit("a '"), F.col("p_name"), F.lit("' b"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.quoted_spans(prompt), "|").alias("quoted"), F.array_join(text.words_in_quotes(words), " ").alias("words"))


@query("SELECT p_partkey, concat('in ', p_brand, ' ', p_name, '  it') AS target FROM part")
def nested_quotes(spark, sf):
    """Recursive extraction from prompts with nested quotes and apostrophes."""
    prompt = F.concat(F.lit("The dog's sign, the text : \""), F.col("p_name"), F.lit(" 'in' it\", and '"), F.col("p_brand"), F.lit("'"))
    return table(spark, sf, "part").select("p_partkey", parse.prompt_target(prompt, "en").alias("target"))


@query("SELECT p_partkey, p_size / 5.0 AS tag, CASE WHEN p_size BETWEEN 1 AND 5 THEN p_size / 5.0 ELSE CASE WHEN p_size = 0 THEN 0.0 ELSE CASE WHEN p_size >= 10 AND p_size < 60 THEN (p_size // 10) / 5.0 ELSE 0.0 END END END AS grade FROM part")
def score_tags(spark, sf):
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select("p_partkey", text.score_tag(F.concat(F.lit("ok <Score>"), size, F.lit("</Score>"))).alias("tag"), text.final_score(F.concat(F.lit("Final Score: "), size)).alias("grade"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 ELSE CAST(round_even(greatest(0.0, least(p_retailprice / 40.0, p_size - 1.0)) / (p_size - 1) * 1000, 0) AS INT) END AS x FROM part")
def box_normalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.normalise_coordinate(F.col("p_retailprice") / 40, F.col("p_size")).alias("x"))


@query("SELECT doc_id, (CAST(concat('0x', substring(sha256(text), 1, 8)) AS BIGINT) + 7) % 2147483648 AS seed FROM documents")
def hash_seed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sample.hash_seed(F.col("text"), 7).alias("seed"))


@query("SELECT p_partkey, round(1.0 / sqrt(p_size), 6) AS square, round(1.0 / p_size, 6) AS per_sample FROM part")
def length_weights(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(text.length_weight(F.col("p_size"))).alias("square"), r6(text.length_weight(F.col("p_size"), "sample")).alias("per_sample"))


DIVISIBLE = "greatest(16, CAST(round_even(round_even({0} * {1}, 0) / 16, 0) AS INT) * 16)"
SCALE = "greatest(least(1024.0 / greatest(w, h), 1.0), 256.0 / least(w, h))"


@query(
    f"""WITH a AS (SELECT p_partkey, p_size * 40 AS w, p_retailprice AS h FROM part), b AS (SELECT p_partkey, {DIVISIBLE.format("w", SCALE)} AS w, {DIVISIBLE.format("h", SCALE)} AS h FROM a),
    c AS (SELECT p_partkey, CASE WHEN w * h > 262144 THEN {DIVISIBLE.format("w", "(262144.0 / (w * h))")} ELSE w END AS w2, CASE WHEN w * h > 262144 THEN {DIVISIBLE.format("h", "(262144.0 / (w * h))")} ELSE h END AS h2 FROM b)
    SELECT p_partkey, CASE WHEN greatest(w2, h2) > 1024 THEN {DIVISIBLE.format("w2", "(1024.0 / greatest(w2, h2))")} ELSE w2 END AS width, CASE WHEN greatest(w2, h2) > 1024 THEN {DIVISIBLE.format("h2", "(1024.0 / greatest(w2, h2))")} ELSE h2 END AS height FROM c"""
)
def resized(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", text.resize(F.col("p_size") * 40, F.col("p_retailprice"), 1024, 256, 16, 512 * 512).alias("r"))
    return d.select("p_partkey", "r.width", "r.height")


# -- matching

PARTS = "WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)"


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"), F.lower("p_brand").alias("c"))


@query(PARTS + " SELECT p_partkey, levenshtein(a, b) AS d FROM p")
def levenshtein_pairs(spark, sf):
    return _parts(spark, sf).select("p_partkey", F.levenshtein("a", "b").cast("long").alias("d"))


@query(PARTS + " SELECT p_partkey, CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0 ELSE round(levenshtein(a, b) / greatest(length(a), length(b)), 6) END AS ned, round(1 - levenshtein(a, b) / (greatest(length(a), length(b)) + 1e-5), 6) AS similarity FROM p")
def ned_pairs(spark, sf):
    return _parts(spark, sf).select("p_partkey", r6(match.ned(F.col("a"), F.col("b"))).alias("ned"), r6(match.similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query(PARTS + " SELECT p_partkey, round(1 - (CASE WHEN contains(concat('a ', b), a) THEN 0 ELSE least(levenshtein(concat('a ', b), a), length(a)) END) / length(a), 6) AS reward, round(1 - least(levenshtein(b, a), length(a)) / length(a), 6) AS inside FROM p")
def ocr_reward(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _parts(spark, sf).select("p_partkey", r6(match.ocr_reward(a, F.concat(F.lit("a "), b))).alias("reward"), r6(match.ocr_reward(a, b)).alias("inside"))


NED = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 0.0 ELSE levenshtein({0}, {1}) / greatest(length({0}), length({1})) END"


@query(
    f"""WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS g, string_split(lower(concat(p_type, ' ', p_brand)), ' ') AS q FROM part),
    t AS (SELECT p_partkey, unnest(g) AS t, q FROM p)
    SELECT p_partkey, t, CAST(list_contains(q, t) AS INT) AS hit, round(CASE WHEN list_contains(q, t) THEN 0.0 ELSE list_min(list_transform(q, lambda x: {NED.format("x", "t")})) END, 6) AS edit FROM t"""
)
def nearest_token_ned(spark, sf):
    d = _parts(spark, sf).select("p_partkey", F.explode(F.split("a", " ")).alias("t"), F.concat(F.split("b", " "), F.split("c", " ")).alias("q"))
    return d.select("p_partkey", "t", match.token_hit(F.col("t"), F.col("q")).alias("h")).select("p_partkey", "t", "h.hit", r6(F.col("h.edit")).alias("edit"))


@query(
    f"""WITH p AS (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS a1, split_part(lower(p_name), ' ', 2) AS a2 FROM part), q AS (SELECT *, substring(a2, 1, length(a2) - 1) AS b1, substring(a1, 2) AS b2 FROM p),
    f AS (SELECT *, CASE WHEN {NED.format("b1", "a1")} <= 0.3 THEN 1 WHEN {NED.format("b2", "a1")} <= 0.3 THEN 2 ELSE 0 END AS j FROM q)
    SELECT p_partkey, ((j > 0)::INT + ((j <> 1 AND {NED.format("b1", "a2")} <= 0.3) OR (j <> 2 AND {NED.format("b2", "a2")} <= 0.3))::INT) / 2 AS recall FROM f"""
)
def greedy_recall(spark, sf):
    """Recall of a name's words among the second without its end and the first without its start."""
    w = F.split("a", " ")
    one, two = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    pred = F.array(F.substr(two, F.lit(1), F.length(two) - 1), F.substr(one, F.lit(2)))
    return _parts(spark, sf).select("p_partkey", r6(match.recall_greedy(w, pred, 0.3)).alias("recall"))


#: DuckDB's edit distance counts bytes. Cleaned texts have no capitals, so capitals stand for the accented letters in it.
LOWER_FR = "àâäéèêëîïôöùûüç"
BYTES = lambda c: f"translate({c}, '{LOWER_FR}', 'ABCDEFGHIJKLMNO')"
TURNS = """WITH u AS (SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(text, '[^一-龥a-zA-Z0-9\\s""" + FR + """]', '', 'g'), '\\s+', ' ', 'g'))) AS t, role, text AS raw FROM conversations),
    p AS (SELECT a.conv_id, a.turn, a.t AS gt, b.t AS rec FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
    w AS (SELECT *, string_split(gt, ' ') AS g, string_split(rec, ' ') AS q FROM p),
    m AS (SELECT *, list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(q, lambda y: y = x))))) AS matched FROM w)"""


def _turns(spark, sf):
    """A user's turn as target beside the assistant's next turn as recognition, both cleaned."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", text.clean(F.col("text")).alias("t"))
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("t").alias("gt"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("rec"))
    d = a.join(b, ["conv_id", "turn"])
    g, q = F.split("gt", " "), F.split("rec", " ")
    return d.select("*", g.alias("g"), q.alias("q")).withColumn("matched", match.bag_overlap(F.col("g"), F.col("q")))


@query(TURNS + f" SELECT conv_id % 8 AS bucket, count(*) AS n, round(avg({NED.format(BYTES('gt'), BYTES('rec'))}), 6) AS ned, round(sum(matched) / sum(len(g)), 6) AS overlap FROM m GROUP BY 1")
def ned_leaderboard(spark, sf):
    d = _turns(spark, sf).select((F.col("conv_id") % 8).alias("bucket"), match.ned(F.col("gt"), F.col("rec")).alias("ned"), "matched", F.size("g").alias("words"))
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ned")).alias("ned"), r6(F.sum("matched") / F.sum("words")).alias("overlap"))


@query(TURNS + " SELECT conv_id, turn, CAST(matched AS BIGINT) AS matched, round(matched / len(g), 6) AS ratio FROM m")
def bag_overlap(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.col("matched").cast("long").alias("matched"), r6(F.try_divide("matched", F.size("g"))).alias("ratio"))


@query(
    TURNS
    + """ SELECT conv_id, turn, CAST(matched AS BIGINT) AS correct,
    CAST(coalesce(list_sum(list_transform(list_distinct(q), lambda x: CASE WHEN list_contains(g, x) THEN greatest(len(list_filter(q, lambda y: y = x)) - len(list_filter(g, lambda y: y = x)), 0) ELSE 0 END)), 0) AS BIGINT) AS duplicate,
    CAST(len(list_filter(q, lambda x: NOT list_contains(g, x))) AS BIGINT) AS irrelevant, CAST(len(g) - matched AS BIGINT) AS missing FROM m"""
)
def bag_classify(spark, sf):
    d = _turns(spark, sf).select("conv_id", "turn", match.bag_classify(F.col("g"), F.col("q")).alias("b"))
    return d.select("conv_id", "turn", *[F.size(f"b.{k}").cast("long").alias(k) for k in ("correct", "duplicate", "irrelevant", "missing")])


@query(
    f"""WITH p AS (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS a1, split_part(lower(p_name), ' ', 2) AS a2 FROM part), x AS (SELECT *, substring(a2, 2) AS x1, reverse(a1) AS x2 FROM p),
    d AS (SELECT *, {NED.format("x1", "a1")} AS d11, {NED.format("x2", "a2")} AS d22, {NED.format("x1", "a2")} AS d12, {NED.format("x2", "a1")} AS d21 FROM x),
    c AS (SELECT *, abs(d11 + d22 - d12 - d21) < 1e-9 AS tie, d12 + d21 < d11 + d22 AS swapped FROM d), m AS (SELECT *, CASE WHEN swapped THEN d12 ELSE d11 END < 0.5 AS one, CASE WHEN swapped THEN d21 ELSE d22 END < 0.5 AS two FROM c)
    SELECT p_partkey, CASE WHEN tie THEN '?' ELSE concat_ws(' ', CASE WHEN one THEN x1 END, CASE WHEN two THEN x2 END) END AS typo, CASE WHEN tie THEN '?' ELSE concat_ws(' ', CASE WHEN NOT one THEN x1 END, CASE WHEN NOT two THEN x2 END) END AS irrelevant,
           CASE WHEN tie THEN '?' ELSE concat_ws(' ', CASE WHEN NOT CASE WHEN swapped THEN two ELSE one END THEN a1 END, CASE WHEN NOT CASE WHEN swapped THEN one ELSE two END THEN a2 END) END AS missing FROM m"""
)
def typo_pairs(spark, sf):
    """Two expected words, one read without its first letter and one backwards; what two assignments cost alike isn't told apart."""
    a1, a2 = F.split_part("a", F.lit(" "), F.lit(1)), F.split_part("a", F.lit(" "), F.lit(2))
    d = _parts(spark, sf).select("p_partkey", a1.alias("a1"), a2.alias("a2")).withColumn("x1", F.expr("substring(a2, 2)")).withColumn("x2", F.reverse("a1"))
    ned = lambda x, y: match.ned(F.col(x), F.col(y))
    d = d.withColumn("tie", F.abs(ned("x1", "a1") + ned("x2", "a2") - ned("x1", "a2") - ned("x2", "a1")) < 1e-9)
    d = d.select("p_partkey", "tie", match.bag_classify(F.array("a1", "a2"), F.array("x1", "x2")).alias("b")).select("p_partkey", "tie", assign.typo_pairs("b.irrelevant", "b.missing").alias("t"))
    return d.select("p_partkey", *[F.when(F.col("tie"), "?").otherwise(F.array_join(f"t.{k}", " ")).alias(k) for k in ("typo", "irrelevant", "missing")])


@query(
    f"""WITH p AS (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS a1, split_part(lower(p_name), ' ', 2) AS a2, lower(p_type) AS b1, lower(p_brand) AS b2 FROM part)
    SELECT p_partkey, round(least({NED.format("a1", "b1")} + {NED.format("a2", "b2")}, {NED.format("a1", "b2")} + {NED.format("a2", "b1")}) / 2, 6) AS gned FROM p"""
)
def gned(spark, sf):
    return _parts(spark, sf).select("p_partkey", r6(assign.gned(F.split("a", " "), F.array(F.concat_ws(" ", "b", "c")))).alias("gned"))


#: Longest common block of two texts, leftmost of equals: {n: its length, negative; i, j: its places}.
BLOCK = """list_min(list_transform(range(0, length({a}) * length({b})), lambda x: {{'n': -len(list_filter(range(1, 40), lambda l:
    x // length({b}) + l <= length({a}) AND x % length({b}) + l <= length({b}) AND substring({a}, x // length({b}) + 1, l) = substring({b}, x % length({b}) + 1, l))), 'i': x // length({b}) + 1, 'j': x % length({b}) + 1}}))"""
#: Ratios of the rows (p, a, b) of pairs.
RATIOS = f"""t AS (
        SELECT p, a, b, {BLOCK.format(a="a", b="b")} AS x FROM pairs WHERE a <> '' AND b <> ''
        UNION ALL
        SELECT p, u.a, u.b, {BLOCK.format(a="u.a", b="u.b")} FROM (
            SELECT p, unnest([{{'a': substring(a, 1, x.i - 1), 'b': substring(b, 1, x.j - 1)}}, {{'a': substring(a, x.i - x.n), 'b': substring(b, x.j - x.n)}}]) AS u FROM t WHERE x.n < 0) WHERE u.a <> '' AND u.b <> ''),
    ratios AS (SELECT p, a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * coalesce((SELECT -sum(x.n) FROM t WHERE t.p = pairs.p), 0) / (length(a) + length(b)) END AS r FROM pairs)"""


@query(
    f"""{PARTS.replace("WITH", "WITH RECURSIVE", 1)}, w AS (SELECT p_partkey, b AS w, unnest(list_append(string_split(a, ' '), lower(p_brand))) AS v FROM p JOIN part USING (p_partkey)), pairs AS (SELECT row_number() OVER () AS p, p_partkey, v AS a, w AS b FROM w), {RATIOS}
    SELECT p_partkey, arg_max(r.a, struct_pack(r := r.r, a := r.a)) AS best FROM pairs JOIN ratios r USING (p) GROUP BY 1"""
)
def seqmatch_best(spark, sf):
    words = F.concat(F.split("a", " "), F.array("c"))
    return _parts(spark, sf).select("p_partkey", sequence.closest("b", words).alias("best"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p > 0 THEN CASE WHEN 0.7 * g <= p AND p <= (1 / 0.7) * g THEN 'TP' ELSE 'FP' END ELSE CASE WHEN g = 0 THEN 'TN' ELSE 'FN' END END AS kind FROM (SELECT length(text) - length(replace(text, '#', '')) AS p, doc_id % 5 AS g FROM documents)) GROUP BY 1")
def sad_confusion(spark, sf):
    d = table(spark, sf, "documents").select(match.anomaly_confusion(match.count_marks(F.col("text")), F.col("doc_id") % 5).alias("kind"))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def anomaly_report(spark, sf):
    """Anomaly confusion and token recognition by language; rows and tokens are aggregated apart."""
    d = table(spark, sf, "documents").select("lang", F.col("text").alias("pred_text"), F.regexp_replace("text", "#", "").alias("gt_text"))
    words = lambda c: F.split(c, " ")
    return aggregate.anomaly_metrics(d, ["lang"], tokens=text.anomaly_tokens(words(F.col("gt_text"))), pred_tokens=text.anomaly_tokens(words(F.col("pred_text")))).select("lang", "tp", "fp", "fn", "tn", "hits", "tokens", r6(F.col("edit")).alias("edit"))


# -- aggregates


@query(TURNS + f", s AS (SELECT conv_id % 4 AS bucket, avg(levenshtein({BYTES('gt')}, {BYTES('rec')})) AS ed, avg(CASE WHEN gt = rec THEN 1.0 ELSE 0.0 END) AS cr, sum(matched) / sum(len(g)) AS wac FROM m GROUP BY 1) SELECT bucket, round(ed, 6) AS ed, round(cr, 6) AS cr, round(wac, 6) AS wac, round(1 - least(100.0, ed) * (1 - cr) * (1 - wac) / 100.0, 6) AS text_score FROM s")
def text_score(spark, sf):
    d = _turns(spark, sf).select((F.col("conv_id") % 4).alias("bucket"), F.levenshtein("gt", "rec").alias("d"), "matched", F.size("g").alias("words"))
    out = aggregate.text_score(d, ["bucket"], "d", "matched", "words")
    return out.select("bucket", *[r6(F.col(c)).alias(c) for c in ("ed", "cr", "wac", "text_score")])


@query("WITH j AS (SELECT lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, source, coalesce(avg(quality), 0.0) AS quality, coalesce(avg(toxic), 0.0) AS toxic FROM j GROUP BY 1, 2) SELECT lang, round(avg(round_even(quality, 3)), 6) AS quality, round(avg(round_even(toxic, 3)), 6) AS toxic FROM c GROUP BY 1")
def micro_macro(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")
    out = aggregate.macro_mean(aggregate.mean_or_zero(d, ["lang", "source"], ["quality", "toxic"]), ["lang"], ["quality", "toxic"])
    return out.select("lang", r6(F.col("quality")).alias("quality"), r6(F.col("toxic")).alias("toxic"))


@query(
    """WITH j AS (SELECT coalesce(lang, '') AS lang, quality = 1 AS g, toxic = 1 AS p FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'total' ELSE lang END AS lang, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM j GROUP BY ROLLUP (lang)),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0.0) AS re FROM c)
    SELECT lang, tp, fp, fn, tn, round(pr, 6) AS "precision", round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) AS f1 FROM r"""
)
def confusion_prf(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).join(table(spark, sf, "labels"), "doc_id")
    out = aggregate.ratios(aggregate.confusion(d, ["lang"], F.col("quality") == 1, F.col("toxic") == 1))
    return out.select("lang", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 6) AS l_discount, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY 1, 2")
def weighted_rollup(spark, sf):
    out = aggregate.weighted_mean(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_quantity")
    return out.select("l_returnflag", "l_linestatus", r6(F.col("l_discount")).alias("l_discount"), F.round("l_quantity", 2).alias("l_quantity"))


@query("SELECT event_type, " + ", ".join(f"round(avg(CASE WHEN user_id % 4 = {i} THEN CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END END), 6) AS b{i}" for i in range(4)) + " FROM events GROUP BY 1")
def group_accuracy_pivot(spark, sf):
    d = table(spark, sf, "events").select("event_type", F.concat(F.lit("b"), F.col("user_id") % 4).alias("b"), (F.col("value") > 5).cast("double").alias("ok"))
    return report.pivot_table(d.groupBy("event_type", "b").agg(r6(F.avg("ok")).alias("acc")), "event_type", "b", "acc", ["b0", "b1", "b2", "b3"])


@query("SELECT lang, CASE WHEN n_chars < 800 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS tag, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY 1, 2")
def tag_means(spark, sf):
    tag = F.when(F.col("n_chars") < 800, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    return table(spark, sf, "documents").groupBy("lang", tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars")).alias("mean_chars"))


GROUPS = {"Plain": ["ECONOMY", "SMALL", "STANDARD"], "Large": ["LARGE", "MEDIUM"], "Every": ["ECONOMY", "SMALL", "STANDARD", "LARGE", "MEDIUM", "PROMO"]}


@query("WITH b(grp, p_type) AS (VALUES " + ", ".join(f"('{g}', '{a}')" for g, x in GROUPS.items() for a in x) + ") SELECT p_brand, grp, round(avg(p_size), 6) AS p_size FROM part JOIN b USING (p_type) GROUP BY 1, 2")
def attribute_group_means(spark, sf):
    return aggregate.group_means(table(spark, sf, "part"), ["p_brand"], "p_type", "p_size", GROUPS).withColumn("p_size", r6(F.col("p_size")))


@query("SELECT lang, round(avg(m), 6) AS n_chars FROM (SELECT lang, source, avg(n_chars) AS m FROM documents GROUP BY 1, 2) GROUP BY 1")
def two_level_means(spark, sf):
    return aggregate.two_level_mean(table(spark, sf, "documents"), ["lang", "source"], ["lang"], "n_chars").withColumn("n_chars", r6(F.col("n_chars")))


@query("SELECT count(*) AS n, count(*) FILTER (n_chars < 800) AS short, count(*) FILTER (n_chars >= 800 AND n_chars < 3000) AS middle, count(*) FILTER (n_chars >= 3000) AS long, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 6) AS mean, median(n_chars) AS median FROM documents")
def length_profile(spark, sf):
    return aggregate.length_profile(table(spark, sf, "documents"), "n_chars", 800, 3000).withColumn("mean", r6(F.col("mean")))


@query(
    """WITH s AS (SELECT l_orderkey AS item, l_linenumber AS question, max(CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END) AS score FROM lineitem GROUP BY 1, 2)
    SELECT c.item, c.question, CASE WHEN p.score = 0 THEN 0 ELSE c.score END AS score FROM s c LEFT JOIN s p ON p.item = c.item AND p.question = c.question - 1 AND c.question > 1"""
)
def dependency_filter(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("question")).agg(F.max((F.col("l_quantity") >= 10).cast("int")).alias("score"))
    parents = spark.range(1, 20).select(F.col("id").cast("int").alias("question"), (F.col("id") - 1).cast("int").alias("parent"))
    return aggregate.dependency_filtered(s, parents)


@query("WITH s AS (SELECT lang, source, round(avg(n_chars), 6) AS v FROM documents GROUP BY 1, 2) SELECT lang, source, v, v = max(v) OVER (PARTITION BY lang) AS is_best FROM s")
def leaderboard_best(spark, sf):
    board = table(spark, sf, "documents").groupBy("lang", "source").agg(r6(F.avg("n_chars")).alias("v"))
    return aggregate.mark_best(board, "lang", "v").select("lang", "source", "v", "is_best")


@query("SELECT round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS mean_value, count(*) AS n FROM events")
def sentinel_mean(spark, sf):
    d = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", -10.0).otherwise(F.col("value")).alias("v"))
    return d.agg(r6(reward.known_mean("v")).alias("mean_value"), F.count(F.lit(1)).alias("n"))


# -- vectors


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
    SELECT a.label, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS mean_cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1"""
)
def pairwise_diversity(spark, sf):
    """Mean cosine of all pairs of a group, from the group's sum of unit vectors: (|sum|^2 - n) / (n (n - 1)). Linear in the rows."""
    d = table(spark, sf, "embeddings").select("label", F.posexplode(vec.normalised(F.col("embedding"))))
    s = d.groupBy("label", "pos").agg(F.sum("col").alias("s"), F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return s.filter("n > 1").select("label", r6((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


REFS = 4


def _first_of(d: DataFrame) -> DataFrame:
    """Each label's first REFS vectors: a reference set of bounded size. Spark limits each task's rows of a label before they are dealt out."""
    return d.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter(F.col("k") <= REFS)


@query(
    f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM v) WHERE k <= {REFS})
    SELECT v.vec_id, round(max(greatest(list_cosine_similarity(v.e, r.e), 0.0)), 6) AS style FROM v JOIN r USING (label) GROUP BY 1"""
)
def refset_max_cosine(spark, sf):
    d = table(spark, sf, "embeddings")
    refs = _first_of(d).groupBy("label").agg(F.collect_list("embedding").alias("refs"))
    best = F.array_max(F.transform("refs", lambda r: F.greatest(vec.cosine(F.col("embedding"), r), F.lit(0.0))))
    return d.join(refs, "label").select("vec_id", r6(best).alias("style"))


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    r AS (SELECT label, arg_min(e, vec_id) AS r FROM v GROUP BY 1)
    SELECT vec_id, round(list_cosine_similarity(e, r), 6) AS cosine, round(2.5 * greatest(list_cosine_similarity(e, r), 0.0), 6) AS clip FROM v JOIN r USING (label)"""
)
def cosine_score(spark, sf):
    d = table(spark, sf, "embeddings")
    d = d.join(d.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("r")), "label")
    return d.select("vec_id", r6(vec.cosine(F.col("embedding"), F.col("r"))).alias("cosine"), r6(vec.clip_score(F.col("embedding"), F.col("r"))).alias("clip"))


# -- rewards


@query("SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-4), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def grpo_advantage(spark, sf):
    return reward.grpo_advantage(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", r6(F.col("advantage")).alias("advantage"))


@query("SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER () + 1e-4), 6) AS advantage FROM events")
def grpo_advantage_global_std(spark, sf):
    return reward.grpo_advantage(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value", global_std=True).select("event_id", r6(F.col("advantage")).alias("advantage"))


@query("SELECT event_id, round((value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-4), 6) AS advantage FROM events")
def ungrouped_advantage(spark, sf):
    return reward.global_advantage(table(spark, sf, "events").select("event_id", "value"), "value").select("event_id", r6(F.col("advantage")).alias("advantage"))


@query("SELECT event_id, CASE WHEN value = max(value) OVER (PARTITION BY user_id) THEN 1.0 ELSE 0.0 END AS advantage FROM events")
def sft_best(spark, sf):
    return reward.best_of_group(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", "advantage")


@query(
    """WITH r AS (SELECT event_id, count(*) OVER w AS n, min(value) OVER w = max(value) OVER w AS eq, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS lo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WINDOW w AS (PARTITION BY user_id))
    SELECT event_id, CASE WHEN n = 1 THEN 0.0 WHEN eq THEN CASE k WHEN 1 THEN -1.0 WHEN 2 THEN 1.0 ELSE 0.0 END WHEN hi = 1 THEN 1.0 WHEN lo = 1 THEN -1.0 ELSE 0.0 END AS advantage FROM r"""
)
def dpo_advantage(spark, sf):
    return reward.dpo_pair(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value", "event_id").select("event_id", "advantage")


@query("SELECT user_id, first(event_id ORDER BY value DESC, event_id) AS winner, first(event_id ORDER BY value, event_id) AS loser FROM events GROUP BY 1 HAVING min(value) < max(value)")
def dpo_pairs(spark, sf):
    return reward.dpo_pairs(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value", "event_id")


@query("SELECT round(avg(CASE WHEN hi = lo THEN 1.0 ELSE 0.0 END), 6) AS zero_ratio, round(avg(sd), 6) AS mean_std, round(avg(n), 6) AS mean_size, count(*) AS groups FROM (SELECT max(l_discount) AS hi, min(l_discount) AS lo, stddev_pop(l_discount) AS sd, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def zero_std_ratio(spark, sf):
    return reward.zero_std(table(spark, sf, "lineitem"), "l_orderkey", "l_discount").select(*[r6(F.col(c)).alias(c) for c in ("zero_ratio", "mean_std", "mean_size")], "groups")


@query("SELECT event_id FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id) AS m FROM events) WHERE round(value - m, 9) <> 0")
def advantage_mask(spark, sf):
    d = reward.grpo_advantage(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value")
    return d.filter(reward.nonzero_mask(reward.over_steps(F.round("advantage", 9), 4))).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(0.3 * l_discount + 0.7 * l_tax, 6) AS total, round((0.5 * l_discount + 0.5 * l_tax) / 1.0, 6) AS composite FROM lineitem")
def composite_reward(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("both", F.struct("l_discount", "l_tax"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", r6(vec.weighted({"both": {"l_discount": 0.3, "l_tax": 0.7}})).alias("total"), r6(vec.composite(F.col("l_discount"), F.col("l_tax"), "eval")).alias("composite"))


POLICY = "SELECT (value - 10) / 10 AS a, -value / 10 + ((event_id % 7) - 3) * 0.03 AS lp, -value / 10 AS old FROM events"


@query(
    f"""WITH e AS ({POLICY}), r AS (SELECT greatest(-5.0, least(5.0, a)) AS a, exp(lp - old) AS r, lp - old AS d FROM e)
    SELECT round(0.5 * avg(d * d), 6) AS approx_kl, round(avg(CASE WHEN abs(r - 1) > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS clipfrac, round(avg(CASE WHEN r - 1 > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS clipfrac_gt_one,
    round(avg(CASE WHEN 1 - r > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS clipfrac_lt_one, round(avg(greatest(-a * r, -a * greatest(0.95, least(1.05, r)))), 6) AS policy_loss, round(avg(r), 6) AS ratio_mean, round(stddev_samp(r), 6) AS ratio_std FROM r"""
)
def policy_stats(spark, sf):
    d = table(spark, sf, "events").select(((F.col("value") - 10) / 10).alias("advantage"), (-F.col("value") / 10 + ((F.col("event_id") % 7) - 3) * 0.03).alias("log_prob"), (-F.col("value") / 10).alias("old_log_prob"))
    out = reward.policy_stats(d, 0.05, guard=True)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + exp(0.5 * 100 * ((l_discount - l_tax) - (l_tax - 0.02)))), 6) AS loss FROM lineitem")
def dpo_loss(spark, sf):
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(reward.dpo_loss(d, t, t, F.lit(0.02), 100.0)).alias("loss"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, sqrt(0.8 / (1 - 0.8)) * 0.7 AS sd FROM embeddings)
    SELECT vec_id, round(list_avg(list_transform(e, lambda x: -pow(0.9 * x - (x * (1 - sd * sd / 1.6 * 0.2) - 0.5 * x * (1 + sd * sd * 0.2 / 1.6) * 0.2), 2) / (2 * sd * sd * 0.2) - ln(sd * sqrt(0.2)) - ln(sqrt(2 * pi())))), 6) AS log_prob FROM v"""
)
def step_statistics(spark, sf):
    """Mean and log-probability of a denoising step over embeddings."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    s = vec.step_log_prob(e, F.transform(e, lambda x: x * 0.5), F.transform(e, lambda x: x * 0.9), F.lit(0.8), F.lit(0.6), F.lit(0.95))
    return table(spark, sf, "embeddings").select("vec_id", s.alias("s")).select("vec_id", r6(F.col("s.log_prob")).alias("log_prob"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x, i: {'v': CAST(x AS DOUBLE), 'i': i - 1}) AS e FROM embeddings)
    SELECT vec_id, round(list_reduce(list_prepend({'v': e[1].v, 'i': CAST(-1 AS BIGINT)}, e), lambda a, x: CASE WHEN (x.i + 1) % 2 = 0 THEN {'v': a.v + (1 - least((1.0 + x.i) / (10 + x.i), 0.9)) * (x.v - a.v), 'i': x.i} ELSE {'v': a.v, 'i': x.i} END).v, 6) AS ema FROM v"""
)
def moving_average(spark, sf):
    """Moving average with warm-up over the components of a vector."""
    return table(spark, sf, "embeddings").select("vec_id", r6(reward.ema(F.col("embedding"), 0.9, 2)).alias("ema"))


@query("SELECT p_partkey, round(0.5 * (1 - CASE WHEN contains(lower(p_name), lower(p_type)) THEN 0 ELSE least(levenshtein(lower(p_name), lower(p_type)), length(p_type)) END / length(p_type)) + 0.5 * p_size / 5, 6) AS reward FROM part")
def registered_rewards(spark, sf):
    """Rewards by their registered names, and a weighted sum of them."""
    d = table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("a"), F.lower("p_name").alias("b"), "p_size")
    d = registry.composite(registry.add_rewards(d, {"text": ("ocr", ["a", "b"]), "size": ("grade", ["p_size"])}), {"text": 0.5, "size": 0.5})
    return d.select("p_partkey", r6(F.col("reward_avg")).alias("reward"))


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), r AS (SELECT label, arg_min(e, vec_id) AS r FROM v GROUP BY 1)
    SELECT label, round(avg(greatest(list_cosine_similarity(e, r), 0.0)), 6) AS style FROM v JOIN r USING (label) GROUP BY 1"""
)
def style_scores(spark, sf):
    d = table(spark, sf, "embeddings")
    refs = d.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return aggregate.style_scores(d, refs, "label", ["embedding"]).groupBy("label").agg(r6(F.avg("style_score")).alias("style"))


@query("SELECT p_partkey, 0.1 AS m, p_size > 40 AS wide FROM part WHERE p_size > 40")
def layout_check(spark, sf):
    """Regions derived from part sizes against the layout's constraints."""
    d = table(spark, sf, "part").select("p_partkey", F.lit(0.1).alias("m_offset"), F.lit(0.1).alias("n_offset"), (F.col("p_size") / 100).alias("m_scale"), (F.col("p_size") / 200).alias("n_scale"))
    return d.filter(layout.region_ok(0.41 * 0.205 - 1e-9)).select("p_partkey", F.col("m_offset").alias("m"), (F.col("m_scale") > 0.4).alias("wide"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 4) GROUP BY 1")
def not_done(spark, sf):
    """Orders of customers that don't have four repeats yet."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    return joins.not_done(o, o, "o_custkey", 4, "o_orderpriority").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT source, CASE WHEN lang IN ('en', 'de') THEN 'germanic' WHEN lang IN ('fr', 'es') THEN 'romance' END AS grp, quality = 1 AS g, toxic = 1 AS p FROM documents JOIN labels USING (doc_id))
    SELECT grp, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM c WHERE grp IS NOT NULL GROUP BY 1"""
)
def regrouped_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    c = aggregate.confusion(d, ["lang"], F.col("quality") == 1, F.col("toxic") == 1).filter("lang <> 'total'")
    return aggregate.regroup(c, [], "lang", {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}).select("grp", "tp", "fp", "fn", "tn")


@query("SELECT user_id, round(sum(CASE WHEN lower(event_type) = 'click' THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM events GROUP BY 1")
def answer_accuracy(spark, sf):
    right = match.answers_right(F.array(F.lit(" Click "), F.lit("extra")), F.array(F.col("event_type")))
    return aggregate.accuracy(table(spark, sf, "events").select("user_id", right.alias("right")), ["user_id"], "right").select("user_id", r6(F.col("accuracy")).alias("accuracy"))


# -- sampling and sets


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")
def train_test_antijoin(spark, sf):
    return joins.minus(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), "text").select("doc_id")


@query(
    """WITH w AS (SELECT o_orderpriority, count(*) AS weight FROM orders GROUP BY 1), s AS (SELECT *, weight * 1000.0 / sum(weight) OVER () AS x FROM w),
    f AS (SELECT *, CAST(floor(x) AS BIGINT) AS fl, round(x - floor(x), 9) AS fr FROM s)
    SELECT o_orderpriority, weight, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, o_orderpriority) <= 1000 - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM f"""
)
def largest_remainder(spark, sf):
    w = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("weight"))
    return sample.largest_remainder(w, "weight", 1000, "o_orderpriority").select("o_orderpriority", "weight", "quota")


@query("SELECT c_custkey FROM customer ORDER BY md5(concat(c_custkey, ':', 42)), c_custkey LIMIT 64")
def fixed_sample(spark, sf):
    """A sample of a given size is the feature."""
    return sample.fixed_sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 64, 42)


@query(
    """WITH m AS (SELECT c_custkey FROM customer ORDER BY md5(concat(c_custkey, ':', 3)), c_custkey LIMIT 12),
    r AS (SELECT c_custkey, copy FROM m, (SELECT unnest([1, 2, 3, 4]) AS copy)),
    s AS (SELECT c_custkey, copy, row_number() OVER (ORDER BY md5(concat(c_custkey, ':', copy, ':', 3)), c_custkey, copy) - 1 AS slot FROM r)
    SELECT c_custkey, copy, CAST(slot AS INT) AS slot, CAST(slot // 24 AS INT) AS rank FROM s"""
)
def k_repeat(spark, sf):
    """A sample of a given size is the feature."""
    return sample.k_repeat(table(spark, sf, "customer"), "c_custkey", 2, 24, 4, seed=1, epoch=2)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def windowed_rewards(spark, sf):
    d = streams.windowed_means(table(spark, sf, "events"))
    return d.select("start", "event_type", "n", r6(F.col("mean_value")).alias("mean_value"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def streamed_rewards(spark, sf):
    """The same as a stream, run to its end; every batch replaces the written result, so nothing is gathered in the driver."""
    at = scratch.new_path(spark, "stream")
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/events.parquet" if _is_folder(spark, f"{sf}/events.parquet") else f"{sf}/events.parque[t]")
    done = streams.windowed_means(source).writeStream.outputMode("complete").foreachBatch(lambda d, _: d.write.mode("overwrite").parquet(f"{at}/result"))
    done.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/result").select("start", "event_type", "n", r6(F.col("mean_value")).alias("mean_value"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
