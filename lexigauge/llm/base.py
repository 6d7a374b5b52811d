"""What the operators share: the shared work folder, table access, labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import let  # noqa: F401  for the operators
from ..sources.scratch import new_path


def materialise(df: DataFrame, name: str, written: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes Parquet into the shared folder and reads it again.

    Unlike an executor's cache it survives lost executors, and unlike
    ``checkpoint()`` it keeps columns apart and row counts known. The folder is
    removed when the driver's JVM ends, or by ``discard`` of what ``written`` collects.
    """
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.parquet(at)
    if written is not None:
        written.append(at)
    return spark.read.parquet(at)


def discard(spark: SparkSession, written: list[str]) -> None:
    """Removes written tables that nothing reads any more."""
    for at in written:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    written.clear()


#: Bytes up to which a table is broadcast after it was measured; beyond it, the join shuffles.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, width: Column | int = 64):
    """``broadcast`` for a table whose rows, of ``width`` bytes each, were counted and are few; else nothing is hinted."""
    size = df.agg(F.coalesce(F.sum(F.lit(width) if isinstance(width, int) else width), F.lit(0))).first()[0]
    return F.broadcast if size <= BROADCAST_BYTES else (lambda x: x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that, and faster, where a text is all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """64 bits of a text; with doc_id it tells rows apart where an id is null or repeated."""
    return F.xxhash64(F.coalesce(text, F.lit("\0null")))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``decided`` (doc_id, tkey, kept) keeps, with the columns of ``docs``.

    Texts move once, dealt by id. Of rows that repeat one (id, text) the first
    in the order of their other columns, written as JSON, stays. Null ids match
    null ids. A row travels as one struct, so its columns may have any name and type.
    """
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    rest = [F.col(q) for c, q in zip(docs.columns, quoted) if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    d = docs.select(F.struct(*quoted).alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), order.alias("o"))
    yes = decided.filter("kept").select(F.col("doc_id").alias("i"), F.col("tkey").alias("tk")).distinct()
    d = d.join(yes, d["id"].eqNullSafe(yes["i"]) & (d["k"] == yes["tk"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "k").orderBy("o"))
    return d.withColumn("n", first).filter("n = 1").select("row.*")


def labelled(spark: SparkSession, labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids, (doc_id, y), the first by hash of the id.

    The bound makes it safe to broadcast. An id whose labels differ, or whose
    label is null, is left out.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("__y"))
    return one.filter("y = __y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "y")
