"""Registered queries that write the driver's tables in a source's format and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vec
from ..operators import report, sample
from ..sources import readers, scratch, sinks, workbooks
from .catalog import query, r6, table

PART = "p_partkey LONG, p_name STRING, p_size INT, p_retailprice DOUBLE"


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


def _texts(df, column, spark, name):
    """Lines of a column as text files."""
    at = scratch.new_path(spark, name)
    df.select(column).write.text(at)
    return at


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def jsonl_strict(spark, sf):
    at = scratch.new_path(spark, "jsonl")
    sinks.jsonl(_part(spark, sf), at)
    return readers.jsonl(spark, at, PART)


def _with_bad_lines(spark, sf):
    row = F.to_json(F.struct("p_partkey", "p_name", "p_size", "p_retailprice"))
    return _part(spark, sf).select(F.when(F.col("p_partkey") % 7 == 3, F.substring(row, 1, 9)).otherwise(row).alias("value"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_partkey % 7 <> 3")
def jsonl_skip_bad(spark, sf):
    return readers.jsonl(spark, _texts(_with_bad_lines(spark, sf), "value", spark, "bad"), PART, "skip")


@query("SELECT CASE WHEN p_partkey % 7 <> 3 THEN p_partkey ELSE -1 END AS p_partkey, CASE WHEN p_partkey % 7 <> 3 THEN p_name ELSE 'none' END AS p_name FROM part")
def jsonl_null_bad(spark, sf):
    d = readers.jsonl(spark, _texts(_with_bad_lines(spark, sf), "value", spark, "bad"), PART, "null")
    return d.select(F.coalesce("p_partkey", F.lit(-1)).alias("p_partkey"), F.coalesce("p_name", F.lit("none")).alias("p_name"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 17")
def jsonl_until_bad(spark, sf):
    """Lines of one file, in order; the one of nation 17 is cut off."""
    row = F.to_json(F.struct("n_nationkey", "n_name"))
    d = table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.when(F.col("n_nationkey") == 17, F.substring(row, 1, 9)).otherwise(row).alias("value"))
    return readers.jsonl_until_bad(spark, _texts(d, "value", spark, "until"), "n_nationkey INT, n_name STRING")


def _nations(spark, sf):
    """The nations (a table of fixed size) as one array."""
    return table(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("a"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_document(spark, sf):
    at = _texts(_nations(spark, sf).select(F.to_json("a").alias("value")), "value", spark, "document")
    return readers.json_or_jsonl(spark, at, "n_nationkey INT, n_name STRING, n_regionkey INT")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def rows_in_document(spark, sf):
    at = _texts(_nations(spark, sf).select(F.to_json(F.struct(F.col("a").alias("data_list"), F.lit(25).alias("n"))).alias("value")), "value", spark, "nested")
    return readers.rows_in_document(spark, at, "data_list ARRAY<STRUCT<n_nationkey:INT, n_name:STRING, n_regionkey:INT>>", "data_list")


@query("SELECT n_nationkey AS pos, n_name AS prompt, concat('to ', n_name) AS target FROM nation")
def columnar_json(spark, sf):
    a = _nations(spark, sf).select(F.to_json(F.struct(F.col("a.n_name").alias("prompts"), F.transform("a.n_name", lambda x: F.concat(F.lit("to "), x)).alias("targets"))).alias("value"))
    return readers.columnar_json(spark, _texts(a, "value", spark, "columnar"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS prompt FROM nation")
def json_map(spark, sf):
    m = _nations(spark, sf).select(F.to_json(F.map_from_entries(F.transform("a", lambda x: F.struct(x["n_nationkey"].cast("string"), x["n_name"])))).alias("value"))
    return readers.json_map(spark, _texts(m, "value", spark, "map"))


@query("SELECT r_regionkey, r_name, 'there' AS origin FROM region")
def optional_file(spark, sf):
    """A file that is there and one that isn't."""
    at = scratch.new_path(spark, "region") + ".jsonl"
    sinks.jsonl(table(spark, sf, "region"), at)
    schema = "r_regionkey INT, r_name STRING"
    there, missing = readers.optional(spark, at, schema), readers.optional(spark, at + "-missing", schema)
    return there.withColumn("origin", F.lit("there")).unionByName(missing.withColumn("origin", F.lit("missing")))


@query("SELECT n_nationkey AS pos, n_name AS prompt FROM nation")
def prompt_lines(spark, sf):
    d = table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    return readers.lines(spark, _texts(d, "n_name", spark, "lines")).select(F.col("pos").cast("int").alias("pos"), "prompt")


@query("SELECT n_nationkey AS pos, n_name AS prompt FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 12")
def prompt_lines_slice(spark, sf):
    d = table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    return readers.lines(spark, _texts(d, "n_name", spark, "lines"), 5, 12).select(F.col("pos").cast("int").alias("pos"), "prompt")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_strings(spark, sf):
    """Whole texts with quotes, commas and line ends, as text columns."""
    at = scratch.new_path(spark, "csv")
    sinks.csv(table(spark, sf, "documents").select("doc_id", "text", "lang"), at)
    return readers.strings_csv(spark, at)


@query("SELECT r_name, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def folder_tree(spark, sf):
    """Folders named by region, files of nations inside."""
    at = scratch.new_path(spark, "tree")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n.select("n_nationkey", "n_name", F.concat(F.lit("at "), "r_name").alias("at")).write.partitionBy("at").json(at)
    found = readers.tree(spark, f"{at}/*/*", "n_nationkey INT, n_name STRING", ("folder", "file"))
    return found.select(F.regexp_replace(F.regexp_replace("folder", "^at=at(%20| )", ""), "%20", " ").alias("r_name"), "n_nationkey", "n_name")


@query("SELECT unnest(['nation.parquet', 'region.parquet', 'supplier.parquet']) AS name")
def file_listing(spark, sf):
    return readers.files(spark, f"{sf}/{{nation,region,supplier}}.parque[t]").select(F.regexp_extract("path", "([a-z]+\\.parquet)(/|$)", 1).alias("name")).distinct()


@query("SELECT n_nationkey, n_name FROM nation")
def written_once(spark, sf):
    """The second write finds the first one's output and does nothing."""
    at = scratch.new_path(spark, "once")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    sinks.once(n, at)
    sinks.once(n.withColumn("n_name", F.lit("again")), at)
    return readers.jsonl(spark, at, "n_nationkey INT, n_name STRING")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM customer")
def resumed_output(spark, sf):
    """A run that broke off after a third, and the one that goes on."""
    at = scratch.new_path(spark, "resume")
    c = table(spark, sf, "customer").select("c_custkey")
    sinks.resume(c.filter("c_custkey % 3 = 0").withColumn("run", F.lit("first")), at, "c_custkey")
    sinks.resume(c.withColumn("run", F.lit("second")), at, "c_custkey")
    return readers.jsonl(spark, at, "c_custkey LONG, run STRING")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def merged_chunks(spark, sf):
    """Three chunks of results, read as one."""
    at = scratch.new_path(spark, "chunks")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for i in range(3):
        sinks.jsonl(o.filter(F.col("o_orderkey") % 3 == i), f"{at}/results_chunk{i}")
    return readers.jsonl(spark, f"{at}/results_chunk*", "o_orderkey LONG, o_orderstatus STRING")


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, len(embedding) AS n, DATE '2024-02-29' AS day FROM embeddings")
def json_safe_values(spark, sf):
    """Numbers, arrays and dates through JSON."""
    at = scratch.new_path(spark, "values")
    sinks.jsonl(table(spark, sf, "embeddings").withColumn("day", F.make_date(F.lit(2024), F.lit(2), F.lit(29))), at)
    d = readers.jsonl(spark, at, "vec_id LONG, label INT, embedding ARRAY<FLOAT>, day DATE")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return d.select("vec_id", "label", r6(total).alias("total"), F.size("embedding").cast("long").alias("n"), F.col("day").cast("timestamp_ntz").alias("day"))


@query("WITH s AS (SELECT coalesce(lang, 'none') AS lang, source, avg(n_chars) AS m FROM documents GROUP BY 1, 2) SELECT lang, coalesce(max(CASE WHEN source = 'src0' THEN printf('%.3f', round_even(m, 3)) END), 'NA') AS src0, coalesce(max(CASE WHEN source = 'none' THEN printf('%.3f', m) END), 'NA') AS none FROM s GROUP BY 1")
def text_table(spark, sf):
    """A table of fixed columns and digits; a data set without rows shows NA."""
    d = table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), "source").agg(F.avg("n_chars").alias("m"))
    return report.as_text(report.pivot_table(d, "lang", "source", "m", ["src0", "none"]), ["src0", "none"])


@query("WITH g AS (SELECT p_partkey, CAST(floor(p_size * 10 / 3) AS BIGINT) AS w, CAST(floor(p_retailprice / 3) AS BIGINT) AS h FROM part), i AS (SELECT unnest(range(9)) AS i) SELECT p_partkey, i // 3 AS row, i % 3 AS col, (i % 3) * w AS left, (i // 3) * h AS top, (i % 3 + 1) * w AS right, (i // 3 + 1) * h AS bottom FROM g, i")
def grid_cells(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.explode(report.grid(3, F.col("p_size") * 10, F.col("p_retailprice"))).alias("c"))
    return d.select("p_partkey", *[F.col(f"c.{n}").cast("long").alias(n) for n in ("row", "col", "left", "top", "right", "bottom")])


@query("SELECT vec_id, vec_id % 3 = 0 AS black FROM embeddings")
def black_images(spark, sf):
    pixels = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(x))
    return table(spark, sf, "embeddings").select("vec_id", vec.all_zero(pixels).alias("black"))


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(url), '[013579]([?#/]|$)')")
def image_files(spark, sf):
    """Pages as files: those with an odd or zero last digit are named as images."""
    name = F.concat(F.lit("A/b_1."), F.when(F.col("url").rlike("[013579]([?#/]|$)"), "PnG").otherwise("txt"))
    return table(spark, sf, "pages").filter(text.is_image(name)).select("page_id")


# -- loaders: prompts written from the parts in each benchmark's format, pictures from a listing with none to two of each part

IMAGES = "FROM (SELECT *, unnest(range(p_size % 3)) AS r FROM part)"


def _listing(spark, sf, name):
    """Paths of pictures, and of as many files that are none."""
    d = table(spark, sf, "part").select("p_partkey", F.explode(F.expr("filter(sequence(0, 2), i -> i < p_size % 3)")).alias("r"))
    return d.select(F.explode(F.array(*[F.concat(F.lit("out/m_EN/"), name, F.lit(f".{ext}")) for ext in ("png", "txt")])).alias("path"))


def _loaded(spark, sf, kind, prompts, name=None, suffix="", order=None, **options):
    at = scratch.new_path(spark, kind) + suffix
    if order:
        prompts = prompts.repartition(1).sortWithinPartitions(order).drop(order)  # one file, whose lines are the ids
    if suffix == ".csv":
        sinks.csv(prompts, at)
    else:
        sinks.jsonl(prompts, at)
    usual = F.concat(F.col("p_partkey").cast("string"), F.lit("_"), F.col("r").cast("string"))
    return readers.load(spark, kind, _listing(spark, sf, usual if name is None else name), at, **options)


@query(f"SELECT concat('out/m_EN/', p_partkey, '_', r, '.png') AS image, concat('paint ', p_name) AS prompt, concat(p_name, ' ', p_type) AS target, concat(p_name, ' ', p_type) AS ori_target, CAST(p_partkey AS VARCHAR) AS id {IMAGES}")
def loaded_longtext(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("prompt_id"), F.concat(F.lit("paint "), "p_name").alias("prompt"), F.array("p_name", "p_type").alias("text"))
    return _loaded(spark, sf, "longtext", p)


@query(f"SELECT concat('out/m_EN/', p_partkey, '_', r, '.png') AS image, p_type AS prompt, p_name AS target, concat(p_name, ',,,') AS ori_target, CAST(p_partkey AS VARCHAR) AS id {IMAGES}")
def loaded_gentext(spark, sf):
    """Targets that end in commas, which aren't text."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("prompt_id"), F.col("p_type").alias("prompt"), F.concat("p_name", F.lit(",,,")).alias("target"))
    return _loaded(spark, sf, "gentext", p)


@query(f"SELECT concat('out/m_EN/', p_partkey, '_', r, '.png') AS image, p_type AS prompt, concat(p_name, ' ', p_brand) AS target, concat(p_name, ' ', p_brand) AS ori_target, CAST(p_partkey AS VARCHAR) AS id {IMAGES} WHERE p_partkey % 5 <> 2")
def loaded_captions(spark, sf):
    """Some pictures have no prompt and are left out."""
    p = table(spark, sf, "part").filter("p_partkey % 5 <> 2").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("enhanced_caption"), F.array("p_name", "p_brand").alias("text"))
    return _loaded(spark, sf, "captions", p, suffix=".jsonl")


@query(f"SELECT concat('out/m_EN/', p_partkey, '_', r, '.png') AS image, p_name AS prompt, p_brand AS target, p_brand AS ori_target, CAST(p_partkey AS VARCHAR) AS id {IMAGES} WHERE p_partkey % 5 <> 2")
def loaded_annotations(spark, sf):
    p = table(spark, sf, "part").filter("p_partkey % 5 <> 2").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("annotation"), F.col("p_brand").alias("raw_text"))
    return _loaded(spark, sf, "annotations", p, suffix=".jsonl")


@query(
    f"""WITH i AS (SELECT p_partkey, r, right(concat('00', p_partkey % 1000), 3) AS id {IMAGES}), p AS (SELECT right(concat('00', p_partkey), 3) AS id, p_name, p_type, p_brand FROM part WHERE p_partkey < 1000)
    SELECT concat('out/m_EN/', id, '-', p_partkey // 1000, '-', r, '.png') AS image, concat('zh ', p_type) AS prompt, concat(p_name, ' ', p_brand) AS target, concat(p_name, ' ', p_brand) AS ori_target, id FROM i JOIN p USING (id)"""
)
def loaded_table_text(spark, sf):
    """Ids have three characters, so there are a thousand prompts; the texts are lists written as literals."""
    p = table(spark, sf, "part").filter("p_partkey < 1000")
    p = p.select(F.lpad(F.col("p_partkey").cast("string"), 3, "0").alias("id"), F.concat(F.lit("en "), "p_type").alias("prompt_en"), F.concat(F.lit("zh "), "p_type").alias("prompt_cn"), F.format_string("['%s', \"%s\"]", "p_name", "p_brand").alias("text_content"))
    name = F.concat(F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit("-"), F.floor(F.col("p_partkey") / 1000).cast("string"), F.lit("-"), F.col("r").cast("string"))
    return _loaded(spark, sf, "table_text", p, name, ".csv", mode="zh")


@query("""SELECT concat('out/m_EN/', p_partkey, '.png') AS image, concat('a sign "', p_name, '" and "', p_type, '" on it') AS prompt, concat(p_name, ' ', p_type) AS target, concat(p_name, ' ', p_type) AS ori_target, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size % 3 > 0""")
def loaded_regions(spark, sf):
    """A document for each hundred prompts; the target is what stands in quotes."""
    row = F.struct(F.col("p_partkey").cast("int").alias("index"), F.format_string('a sign "%s" and "%s" on it', "p_name", "p_type").alias("prompt"), F.array("p_name").alias("carrier_list"), F.array("p_type").alias("sentence_list"))
    p = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("n")).agg(F.collect_list(row).alias("data_list")).select("data_list")
    return _loaded(spark, sf, "regions", p, F.col("p_partkey").cast("string"), ".jsonl").distinct()  # a prompt has one picture


@query(
    f"""WITH p AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS line, CASE WHEN p_partkey % 2 = 0 THEN concat('text: "', p_name, '"') ELSE concat('on the wall one can read "', p_name, '"') END AS d FROM part)
    SELECT concat('out/m_EN/', i.p_partkey, '_', r, '.png') AS image, d AS prompt, CASE WHEN length(d) >= 2 * length(p.p_name) THEN d ELSE p.p_name END AS target, p.p_name AS ori_target, CAST(line AS VARCHAR) AS id FROM (SELECT * {IMAGES}) i JOIN p ON p.line = i.p_partkey"""
)
def loaded_instructions(spark, sf):
    """A prompt's id is its line; a target that is at most half as long as its description gives way to it."""
    short = F.when(F.col("p_partkey") % 2 == 0, F.format_string('text: "%s"', "p_name")).otherwise(F.format_string('on the wall one can read "%s"', "p_name"))
    p = table(spark, sf, "part").select("p_partkey", F.lit("t").alias("type"), F.col("p_type").alias("long_description"), short.alias("short_description"))
    return _loaded(spark, sf, "instructions", p, order="p_partkey")


# -- workbooks

BOARD = "SELECT coalesce(lang, 'none') AS lang, round(avg(n_chars), 6) AS mean, CAST(max(n_chars) AS DOUBLE) AS longest, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY 1"


def _workbook(spark, sf):
    """A workbook of a board with two header rows and a list with one, read back as cells."""
    d = table(spark, sf, "documents")
    board = d.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(r6(F.avg("n_chars")).alias("mean"), F.max("n_chars").cast("double").alias("longest"), F.count(F.lit(1)).cast("double").alias("n"))
    board = sample.with_row_numbers(board, "lang", name="row")
    heads = [("lang", ""), ("length", "mean"), ("length", "longest"), ("rows", "n")]
    regions = sample.with_row_numbers(table(spark, sf, "region").select("r_regionkey", "r_name"), "r_regionkey", name="row")
    cells = workbooks.cells_of(board, "board", ["lang", "mean", "longest", "n"], heads, ("mean", "longest", "n"))
    cells = cells.unionByName(workbooks.cells_of(regions, "regions & <all>", ["r_regionkey", "r_name"], [("key",), ("name",)]))
    at = scratch.new_path(spark, "book") + ".xlsx"
    workbooks.write(cells, at, ["board", "regions & <all>"])
    return workbooks.read(spark, at)


@query(f"WITH b AS ({BOARD}) SELECT row_number() OVER (ORDER BY lang) - 1 AS row, lang, mean AS \"length/mean\", longest AS \"length/longest\", n AS \"rows/n\" FROM b")
def workbook_table(spark, sf):
    """A sheet with two header rows as a table again."""
    return workbooks.table(_workbook(spark, sf), "board", 2)


@query(
    f"""WITH b AS ({BOARD}), c AS (SELECT lang, 'mean' AS metric, mean AS value FROM b UNION ALL SELECT lang, 'longest', longest FROM b UNION ALL SELECT lang, 'n', n FROM b)
    SELECT metric, count(*) AS cells, max(value) AS best, count(*) FILTER (value = (SELECT max(value) FROM c x WHERE x.metric = c.metric)) AS bold FROM c GROUP BY 1"""
)
def workbook_best(spark, sf):
    """The best cell of each metric is bold in the sheet."""
    d = _workbook(spark, sf).filter("sheet = 'board' AND row > 1 AND col > 0")
    name = F.element_at(F.array(F.lit("mean"), F.lit("longest"), F.lit("n")), F.col("col").cast("int"))
    return d.groupBy(name.alias("metric")).agg(F.count(F.lit(1)).alias("cells"), F.max("number").alias("best"), F.count_if("bold").alias("bold"))
