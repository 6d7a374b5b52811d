"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, quantities (a number with its unit) and names (runs of capitalised
words within a sentence) become typed placeholders, other words are
lower-cased; a benchmark item in this form is a template. Windows of ``window``
canonical tokens, or of all tokens of an item that has fewer, are hashed and
joined by hash with the windows of all documents. A window with a slot and
fewer than ``literals`` ordinary words says little as a template (lists of names
and figures are alike), so it is hashed with its values in place of
placeholders: it matches word for word. A whole item of at most ``window`` tokens
needs only ``FEW`` ordinary words beside two figures or more and no name: "What is
12 plus 30?" is found with other figures, for all its words must stand in order;
"He was in Paris" with another name is another sentence.

For the few documents that hold such a window, matches are laid side by side:
for one document, item and shift between them, the values in the item's slots
must map to the document's values one to one (the same name in the item is the
same name in the document throughout). Windows with a slot that breaks this
mapping don't count. A document is contaminated by an item when consistent
windows cover ``share`` of the item's windows or of its template windows, or
``most`` of them in any case.

The documents are tokenised once, for windows of 8 tokens and of each smaller
length that the benchmark has; the hashes of the benchmark are broadcast after
their size was measured, and joined by shuffle beyond. Texts move only for
documents with a match; their slots are a table of their own, so no list of
matches is ever gathered in a row.

Null and empty texts have no window and stay. An item of one token matches only
a text that is nothing else. Null items match nothing; repeated items count once
each. Null ids and repeated ids are told apart by their texts. A run of letters,
digits or capitalised words may be of any length; an ideograph or a kana is a
token of its own, so texts without blanks have windows too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import keep_rows, let, materialise, small_side, text_key

UNITS = "km|cm|mm|kg|mg|g|ml|l|m|mi|ft|in|lb|lbs|oz|h|hours?|min|minutes?|s|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|dollars?|euros?|cents?|percent|usd|eur"
#: Ideographs and kana, which stand without blanks between words: each is a token.
ALONE = "㐀-䶿一-鿿豈-﫿぀-ヿ"
CAPITAL = r"\s\p{Lu}\p{Ll}++(?!\p{L})"
#: A name is taken with the white space before it, which tells it from a sentence's first word.
#: Groups repeat possessively: the engine then loops where it would recurse.
TOKENS = rf"(?=\s)(?<=[\p{{Ll}},;]){CAPITAL}(?:{CAPITAL})*+|[$€£]?[0-9]++(?:[.,:/][0-9]++)*+(?:\s?(?:[%€$£]|(?:{UNITS})(?!\p{{L}})))?|[{ALONE}]|[\p{{L}}\p{{M}}&&[^{ALONE}]]++"
WINDOW, LITERALS, FEW, SHARE, MOST = 8, 5, 3, 0.5, 6
NAME, NUMBER, QUANTITY = 1, 2, 3


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))


def canonical(toks: Column) -> Column:
    """A 64-bit code for each token; slots have small codes."""
    word = lambda t: F.xxhash64(F.lower(t))
    slot = lambda n: F.lit(n).cast("long")
    figure = lambda t: (t < ":") | t.substr(1, 1).isin("€", "£")  # noqa: E731  $ and digits come before the colon
    one = lambda t: (
        F.when((t >= "A") & (t < "{"), word(t)).when(t < "!", slot(NAME)).when(~figure(t), word(t)).when(t.rlike(r"[^0-9.,:/]"), slot(QUANTITY)).otherwise(slot(NUMBER))
    )
    return F.transform(toks, one)


def is_slot(code: Column) -> Column:
    return (code >= NAME) & (code <= QUANTITY)


def verbatim(toks: Column) -> Column:
    """A 64-bit code for each token, slots with their values."""
    return F.transform(toks, lambda t: F.xxhash64(F.lower(F.trim(t))))


def windows(codes: Column, k: int) -> Column:
    """The hash of each run of k codes."""
    every = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - k + 1), lambda i: F.xxhash64(F.slice(c, i, k)))
    return let(codes, lambda c: F.when(F.size(c) >= k, every(c)).otherwise(F.array().cast("array<bigint>")))


def slots_of(toks: Column, codes: Column, at: Column | int = 0) -> Column:
    """(at, value) of each token that fills a slot."""
    every = F.transform(F.arrays_zip(toks.alias("t"), codes.alias("c")), lambda x, i: F.struct((i + at).alias("at"), F.when(is_slot(x["c"]), F.trim(x["t"])).alias("value")))
    return F.filter(every, lambda x: x["value"].isNotNull())


def benchmark_windows(bench: DataFrame, k: int, literals: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, q, size, bpos, dense, h, slots): q tells items apart; a dense window is hashed with its values and has no slots."""
    b = bench.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.xxhash64(F.col(id_col).cast("string"), text_key(F.col(text_col))).alias("q"), tokens(F.col(text_col)).alias("t"))
    b = b.filter(F.size("t") > 0).dropDuplicates(["q"])
    b = b.select("item", "q", "t", canonical(F.col("t")).alias("c"), verbatim(F.col("t")).alias("v"), F.least(F.lit(k), F.size("t")).alias("size"))
    b = b.withColumn("bpos", F.explode(F.sequence(F.lit(0), F.size("c") - F.col("size"))))
    part = lambda a: F.slice(a, F.col("bpos") + 1, F.col("size"))
    n = F.size(F.filter(part("c"), is_slot))
    figures = (F.size("c") == F.col("size")) & (n > 1) & ~F.exists("c", lambda c: c == NAME)
    b = b.withColumn("dense", (n > 0) & (F.col("size") - n < F.when(figures, FEW).otherwise(literals)))
    hashed = F.when(F.col("dense"), F.xxhash64(part("v"))).otherwise(F.xxhash64(part("c")))
    slots = slots_of(part("t"), part("c"), F.col("bpos"))
    return b.select("item", "q", "size", "bpos", "dense", hashed.alias("h"), F.when(~F.col("dense"), slots).otherwise(F.slice(slots, 1, 0)).alias("slots"))


def document_windows(codes: Column, values: Column, sizes: list[tuple[int, bool]]) -> Column:
    """Hashes of a document's windows of the (size, with values) that a benchmark has; those with values only where there is a slot."""
    none = F.array().cast("array<bigint>")

    def of(size: int, dense: bool) -> Column:
        w = F.when(F.exists(codes, is_slot), windows(values, size)).otherwise(none) if dense else windows(codes, size)
        return F.when(F.size(codes) == 1, w).otherwise(none) if size == 1 else w

    return F.concat(none, *[of(*s) for s in sizes])


def contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, literals: int = LITERALS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, tkey, n_items, item_ids, coverage, contaminated), one row per input row."""
    b = materialise(benchmark_windows(bench, window, literals), "benchmark")
    sizes = sorted((r.size, r.dense) for r in b.select("size", "dense").distinct().collect())  # at most 2 x window rows
    hashes = b.select("h").distinct()
    hashes, b_near = small_side(hashes)(hashes), small_side(b, 64 + F.octet_length(F.to_json(F.struct("slots"))))
    whole = F.col("doc_id").cast("long")
    d = docs.select(whole.alias("doc_id"), F.coalesce(whole, F.lit(-(2**63))).alias("i"), text_key(F.col("text")).alias("tkey"), F.col("text"))
    key = ["i", "tkey"]

    def coded(x: DataFrame, *also: str) -> DataFrame:
        x = x.select(*also, tokens(F.col("text")).alias("t"))
        return x.select(*also, "t", canonical(F.col("t")).alias("c")).select("*", (verbatim(F.col("t")) if any(dense for _, dense in sizes) else F.lit(None).cast("array<bigint>")).alias("v"))

    w = document_windows(F.col("c"), F.col("v"), sizes)
    hit = coded(d, *key).select(*key, F.explode(w).alias("h")).join(hashes, "h", "left_semi")
    hit = materialise(hit.select(*key).distinct(), "hits")
    few = d.join(hit, key, "left_semi").dropDuplicates(key)
    few = materialise(coded(few, *key).select(*key, "c", slots_of(F.col("t"), F.col("c")).alias("slots"), w.alias("w")), "few")
    # windows without slots: where they stand doesn't matter
    plain = few.select(*key, F.explode(F.array_distinct("w")).alias("h")).join(b_near(b.filter(F.size("slots") == 0)), "h").select(*key, "q", "bpos", "dense").distinct()
    # windows with slots, by the shift between item and document
    slotted = b.filter(F.size("slots") > 0)
    found = None
    for size in sorted({s for s, dense in sizes if not dense}):
        at = few.select(*key, F.posexplode(windows(F.col("c"), size)).alias("pos", "h")).join(b_near(slotted.filter(F.col("size") == size)), "h")
        at = at.select(*key, "q", (F.col("pos") - F.col("bpos")).alias("shift"), "bpos", "slots")
        found = at if found is None else found.unionByName(at)
    covered = plain
    if found is not None:
        found = materialise(found, "matches")
        by = [*key, "q", "shift"]
        mine = few.select(*key, F.explode("slots").alias("s")).select(*key, F.col("s.at").alias("at"), F.col("s.value").alias("d"))
        s = found.select(*by, "bpos", F.explode("slots").alias("s")).select(*by, "bpos", F.col("s.value").alias("b"), (F.col("s.at") + F.col("shift")).alias("at"))
        s = materialise(s.join(mine, [*key, "at"]), "slots")
        pairs = s.select(*by, "b", "d").distinct()
        odd = lambda c: pairs.groupBy(*by, c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by, c)
        broken = s.join(odd("b"), [*by, "b"], "left_semi").unionByName(s.join(odd("d"), [*by, "d"], "left_semi")).select(*by, "bpos").distinct()
        good = found.select(*by, "bpos").distinct().join(broken, [*by, "bpos"], "left_anti")
        covered = plain.unionByName(good.select(*key, "q", "bpos", F.lit(False).alias("dense"))).distinct()
    total = b.groupBy("q").agg(F.first("item").alias("item"), F.count(F.lit(1)).alias("of"), F.count_if(~F.col("dense")).alias("of_t"))
    per = covered.groupBy(*key, "q").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("dense")).alias("n_t")).join(small_side(total)(total), "q")
    per = per.filter((F.col("n") >= F.col("of") * share) | (F.col("n") >= most) | ((F.col("n_t") > 0) & (F.col("n_t") >= F.col("of_t") * share)))
    covers = F.greatest(F.col("n") / F.col("of"), F.coalesce(F.try_divide("n_t", "of_t"), F.lit(0.0)))
    per = per.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max(covers).alias("coverage"))
    out = d.select("doc_id", *key).join(per, key, "left")
    return out.select("doc_id", "tkey", F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"), "item_ids", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("item_ids").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` without benchmark content, with its columns; rows that repeat one id and text come once."""
    return keep_rows(docs, contaminated(docs, bench).withColumn("kept", ~F.col("contaminated")))
