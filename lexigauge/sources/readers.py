"""Readers with declared schemas, and the loaders of benchmark record sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import parse, text
from ..operators import joins
from . import scratch

SCHEMAS = {
    "longtext": "prompt_id INT, prompt STRING, text ARRAY<STRING>",
    "gentext": "prompt_id INT, prompt STRING, target STRING",
    "regions": "data_list ARRAY<STRUCT<index:INT, prompt:STRING, carrier_list:ARRAY<STRING>, sentence_list:ARRAY<STRING>>>",
    "table_text": "id STRING, prompt_en STRING, prompt_cn STRING, text_content STRING",
    "captions": "id STRING, enhanced_caption STRING, text ARRAY<STRING>",
    "annotations": "id STRING, annotation STRING, raw_text STRING",
    "instructions": "type STRING, long_description STRING, short_description STRING, yn_question_list ARRAY<STRING>, yn_answer_list ARRAY<STRING>",
    "inference_row": "id STRING, data_source STRING, class STRING, response STRING, labels STRING",
    "converted_row": "image STRING, id STRING, data_source STRING, pred_text STRING, gt_text STRING",
    "vqa_result": "attribute STRING, desc STRING, jsonl_file STRING, line_idx INT, questions ARRAY<STRING>, gt_answers ARRAY<STRING>, model_pred ARRAY<STRING>, model_output STRING",
    "question_graph": "key STRING, question MAP<INT,STRING>, dependency MAP<INT,ARRAY<INT>>",
    "rl_prompts": "prompts ARRAY<STRING>, targets ARRAY<STRING>",
    "rl_metadata": "prompt STRING, image STRING",
}
MODES = {"error": "FAILFAST", "skip": "DROPMALFORMED", "null": "PERMISSIVE"}


def jsonl(spark: SparkSession, path: str, schema: str, on_bad: str = "error") -> DataFrame:
    """One object a line; a bad line fails the query, is skipped, or gives nulls."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("mode", MODES[on_bad]).json(path)


def jsonl_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of each file before its first bad one, as a reader gives that stops there."""
    fields = SCHEMAS.get(schema, schema)
    d = lines(spark, path).filter(F.trim("prompt") != "").select(F.col("file"), "pos", F.from_json("prompt", f"{fields}, __bad STRING", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    first = d.filter("r.__bad IS NOT NULL").groupBy("file").agg(F.min("pos").alias("end"))
    return d.join(first, "file", "left").filter(F.col("end").isNull() | (F.col("pos") < F.col("end"))).select("r.*").drop("__bad")


def json_or_jsonl(spark: SparkSession, path: str, schema: str, on_bad: str = "error") -> DataFrame:
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("mode", MODES[on_bad]).option("multiLine", not path.endswith(".jsonl")).json(path)


def optional(spark: SparkSession, path: str, schema: str, on_bad: str = "null") -> DataFrame:
    """As ``json_or_jsonl``; no rows where there is no such file."""
    try:
        return json_or_jsonl(spark, path, schema, on_bad)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMAS.get(schema, schema))


def rows_in_document(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """Rows of an array inside one JSON object; none where it is missing."""
    return json_or_jsonl(spark, path, schema).select(F.explode(field).alias("r")).select("r.*")


def columnar_json(spark: SparkSession, path: str, names: tuple[str, ...] = ("prompts", "targets")) -> DataFrame:
    """Parallel arrays as rows with their position."""
    d = json_or_jsonl(spark, path, ", ".join(f"{n} ARRAY<STRING>" for n in names))
    return d.select(F.posexplode(F.arrays_zip(*names)).alias("pos", "r")).select("pos", *[F.col(f"r.{n}").alias(n.removesuffix("s")) for n in names])


def json_map(spark: SparkSession, path: str, value: str = "prompt") -> DataFrame:
    """An object of id to value as rows (id, value)."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return d.select(F.explode("m").alias("id", value))


def strings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; an unnamed first column becomes ``row``."""
    d = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return d.withColumnRenamed("_c0", "row")


def lines(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Lines (file, pos, prompt) of text files with their number in the file, from 0, optionally a slice of them.

    A file is read in blocks by as many tasks as its size asks for. A line's place
    in its block follows from the order of reading, and a block begins behind all
    lines of the blocks before, which a table with one row a block says. Lines are
    written once before they are counted, so count and numbers come from the same
    blocks, even if executors (and with them the sizes of blocks) change in between.
    Lines end at \\n, \\r or both; an empty file has none.
    """
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("prompt"))
    d = scratch.written(d, "lines")
    blocks = d.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    begins = blocks.withColumn("ahead", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).drop("n")
    if high is not None:
        begins = begins.filter(F.col("ahead") < high)
    d = d.join(begins, ["file", "block"]).select("file", (F.col("ahead") + F.col("i") - F.col("first")).alias("pos"), "prompt")
    if low is not None:
        d = d.filter(F.col("pos") >= low)
    return d if high is None else d.filter(F.col("pos") < high)


def files(spark: SparkSession, images: str | DataFrame) -> DataFrame:
    """(path, name) of files; contents aren't read. A pattern is listed; a table with a ``path`` column, as a listing that is kept, is taken as it is."""
    d = spark.read.format("binaryFile").load(images) if isinstance(images, str) else images
    return d.select("path", text.base_name(F.col("path")).alias("name"))


def tree(spark: SparkSession, pattern: str, schema: str, levels: tuple[str, ...], multi_line: bool = False, on_bad: str = "skip") -> DataFrame:
    """JSON files in nested folders; the folders' names (outermost first, the file's name last) become columns."""
    d = spark.read.schema(SCHEMAS.get(schema, schema)).option("multiLine", multi_line).option("mode", MODES[on_bad]).json(pattern)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return d.select("*", *[F.element_at(parts, i - len(levels)).alias(n) for i, n in enumerate(levels)])


def _samples(files_: DataFrame, prompts: DataFrame, key: str, on_missing: str, prompt: str, target) -> DataFrame:
    """The common record: image, prompt, target, ori_target, id."""
    d = joins.lookup_join(files_, prompts, key, on_missing)
    return d.select(F.col("path").alias("image"), F.col(prompt).alias("prompt"), target[0].alias("target"), target[1].alias("ori_target"), F.col(key).cast("string").alias("id"))


def _with_id(files_: DataFrame, key: str, as_int: bool) -> DataFrame:
    return files_.filter(text.is_image(F.col("path"))).withColumn(key, text.id_from_name(F.col("name"), as_int))


def load_longtext(spark, images: str | DataFrame, prompts: str, mode: str = "en") -> DataFrame:
    p = jsonl(spark, prompts, "longtext").withColumn("ori", F.array_join("text", " "))
    return _samples(_with_id(files(spark, images), "prompt_id", True), p, "prompt_id", "error", "prompt", (text.target_or_original(F.col("ori"), text.process_raw_text(F.col("ori"))), F.col("ori")))


def load_gentext(spark, images: str | DataFrame, prompts: str, mode: str = "en") -> DataFrame:
    p = jsonl(spark, prompts, "gentext")
    t = text.target_or_original(F.col("target"), text.process_raw_text(F.col("target")))
    return _samples(_with_id(files(spark, images), "prompt_id", True), p, "prompt_id", "error", "prompt", (t, F.col("target")))


def load_captions(spark, images: str | DataFrame, prompts: str, mode: str = "en") -> DataFrame:
    p = json_or_jsonl(spark, prompts, "captions").withColumn("ori", F.array_join("text", " "))
    return _samples(_with_id(files(spark, images), "id", False), p, "id", "skip", "enhanced_caption", (F.col("ori"), F.col("ori")))


def load_annotations(spark, images: str | DataFrame, prompts: str, mode: str = "en") -> DataFrame:
    p = json_or_jsonl(spark, prompts, "annotations")
    return _samples(_with_id(files(spark, images), "id", False), p, "id", "skip", "annotation", (F.col("raw_text"), F.col("raw_text")))


def load_table_text(spark, images: str | DataFrame, prompts: str, mode: str = "en") -> DataFrame:
    p = strings_csv(spark, prompts).withColumn("ori", F.array_join(parse.python_list(F.col("text_content")), " "))
    f = files(spark, images).filter(text.is_image(F.col("path"))).withColumn("id", F.substring("name", 1, 3))
    return _samples(f, p, "id", "skip", "prompt_cn" if mode == "zh" else "prompt_en", (text.target_or_original(F.col("ori"), F.col("ori")), F.col("ori")))


def load_regions(spark, images: str | DataFrame, prompts: str, mode: str = "en") -> DataFrame:
    p = rows_in_document(spark, prompts, "regions", "data_list").withColumn("id", F.col("index").cast("string"))
    f = files(spark, images).filter(text.is_image(F.col("path"))).withColumn("id", text.stem(F.col("name")))
    t = parse.prompt_target(F.col("prompt"), mode)
    return _samples(f, p, "id", "skip", "prompt", (t, t))


def load_instructions(spark, images: str | DataFrame, prompts: str, mode: str = "en", description: str = "short_description") -> DataFrame:
    """The id of a prompt is its line number."""
    raw = lines(spark, prompts).select(F.col("pos").cast("string").alias("id"), F.from_json("prompt", SCHEMAS["instructions"]).alias("r")).select("id", "r.*")
    f = files(spark, images).filter(text.is_image(F.col("path"))).withColumn("id", text.id_from_name(F.col("name")))
    t = parse.prompt_target(F.col(description), mode)
    return _samples(f, raw, "id", "skip", description, (text.target_or_original(F.col(description), t), t))


LOADERS = {"longtext": load_longtext, "gentext": load_gentext, "captions": load_captions, "annotations": load_annotations, "table_text": load_table_text, "regions": load_regions, "instructions": load_instructions}


def load(spark: SparkSession, kind: str, images: str | DataFrame, prompts: str, mode: str = "en") -> DataFrame:
    """Samples (image, prompt, target, ori_target, id) of a benchmark kind."""
    return LOADERS[kind](spark, images, prompts, mode)
