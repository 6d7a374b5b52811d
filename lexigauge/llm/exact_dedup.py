"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, each chunk gets a 64-bit
identifier, and a document becomes its recipe: the ordered list of identifiers.
Identifiers are verified over the whole corpus: a dictionary with one row per
identifier holds the extremes of two further hashes and of the length, and an
identifier under which they differ names more than one chunk. Documents that
hold such an identifier are told apart by their digest alone. Documents with
equal recipes are equal; the SHA-256 of the text, which the result reports
anyway, is the exact check. Long texts are read once and never shuffled; only
recipes move (8 bytes for some 300 characters).

A null text counts as empty, an empty text has the empty recipe. Rows with a
null id take part; they stay only where their group has no id at all. Of rows
that repeat one id and text, one counts as kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ascii_lower, keep_rows, materialise, text_key

#: 256 to 2048 characters, up to the first place after the 256th where white space follows one of these characters.
CUT = r"(?s).{256,2048}?(?:(?<=[dlrt.]\s)|\z)|.{1,2048}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, text_sha256, ids, proofs): one row per input row, one pass over the texts."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    d = d.select("doc_id", "tkey", F.sha2("t", 256).alias("text_sha256"), F.regexp_extract_all("t", F.lit(CUT), F.lit(0)).alias("c"))
    return d.select(
        "doc_id", "tkey", "text_sha256",
        F.transform("c", lambda c: F.xxhash64(c)).alias("ids"),
        F.transform("c", lambda c: F.struct(F.xxhash64(F.lit("proof"), c).alias("p"), F.hash(c).alias("q"), F.length(c).alias("n"))).alias("proofs"),
    )


def ambiguous_ids(rec: DataFrame) -> DataFrame:
    """Identifiers that name more than one chunk (expected: none)."""
    c = rec.select(F.explode(F.arrays_zip("ids", "proofs")).alias("c")).select(F.col("c.ids").alias("id"), "c.proofs.p", "c.proofs.q", "c.proofs.n")
    g = c.groupBy("id").agg(*[f(x).alias(f"{k}_{x}") for x in "pqn" for k, f in (("lo", F.min), ("hi", F.max))])
    return g.filter("lo_p <> hi_p OR lo_q <> hi_q OR lo_n <> hi_n").select("id")


def _without_recipes(rec: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Empties the recipes that hold an ambiguous identifier; their digests still tell them apart."""
    bad = rec.select("text_sha256", F.explode("ids").alias("id")).distinct().join(ambiguous, "id", "left_semi").select("text_sha256").distinct()
    rec = rec.join(bad.withColumn("bad", F.lit(True)), "text_sha256", "left")
    return rec.withColumn("ids", F.when(F.col("bad"), F.array().cast("array<bigint>")).otherwise(F.col("ids"))).drop("bad")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, tkey), one row per input row.

    Equal: identical after lower-casing A-Z. The largest id of a group stays.
    """
    rec = materialise(recipes(docs, id_col, text_col), "recipes")
    ambiguous = materialise(ambiguous_ids(rec), "ambiguous")
    if not ambiguous.isEmpty():
        rec = _without_recipes(rec, ambiguous)
    one = rec.groupBy("ids", "text_sha256", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n"))
    group = one.groupBy("ids", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max(F.struct("doc_id", "tkey")).alias("best"))
    group = materialise(group, "groups")  # else both sides would be dealt alike beforehand, and a large group couldn't be split
    out = one.join(group, ["ids", "text_sha256"]).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    kept = (F.col("i") == 1) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tkey") == F.col("best.tkey"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", "tkey")


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    return keep_rows(docs, exact_dedup(docs))
