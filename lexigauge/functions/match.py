"""Text-matching metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let


def ned(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty strings."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / n)


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / (F.greatest(F.length(a), F.length(b)) + 1e-5)


def quality(s: Column, amp: float = 1.0) -> Column:
    """1 less the amplified share of anomaly marks among the characters that aren't white space; 0 for none."""
    n = F.length(F.regexp_replace(s, r"(?U)\s+", ""))
    marks = F.length(s) - F.length(F.replace(s, F.lit("#"), F.lit("")))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - amp * marks / n)))


def mark_ratio(s: Column, strip_brackets: bool = False) -> Column:
    base = F.translate(s, "<>", "") if strip_brackets else s
    n = F.length(F.regexp_replace(base, r"(?U)\s+", ""))
    marks = F.length(s) - F.length(F.replace(s, F.lit("#"), F.lit("")))
    return marks / F.greatest(n, F.lit(1)) if strip_brackets else F.when(n == 0, F.lit(0.0)).otherwise(marks / n)


def is_bad(s: Column) -> Column:
    return mark_ratio(s, strip_brackets=True) > 0.5


def quality_level(s: Column) -> Column:
    r = mark_ratio(s)
    return F.when(r <= 0.05, 2).when(r <= 0.25, 1).otherwise(0)


def semantic_level(rec: Column, correct: Column, ref: Column) -> Column:
    bare = lambda c: F.length(F.regexp_replace(c, r"(?U)\s+", ""))
    r = F.try_divide(bare(correct), F.greatest(bare(rec), bare(ref)))
    return F.when(r >= 0.8, 2).when(r >= 0.5, 1).otherwise(0)


def ocr_reward(target: Column, rec: Column) -> Column:
    """1 less the distance over the target's length; 0 distance where the target is contained; null for an empty target."""
    n = F.length(target)
    d = F.when(F.contains(rec, target), 0).otherwise(F.least(F.levenshtein(rec, target), n))
    return 1 - F.try_divide(d, n)


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token lists: both sorted together, one walk over the runs of equal tokens."""
    side = lambda arr, n: F.transform(arr, lambda t: F.struct(t.alias("t"), F.lit(n).alias("side")))
    zero, none = F.lit(0), F.lit(None).cast("string")
    state = lambda t, x, y, n: F.struct(t.alias("t"), x.alias("x"), y.alias("y"), n.alias("n"))

    def step(s: Column, e: Column) -> Column:
        mine = (e["side"] == 0).cast("int")
        same = s["t"].eqNullSafe(e["t"])
        return F.when(same, state(s["t"], s["x"] + mine, s["y"] + 1 - mine, s["n"])).otherwise(state(e["t"], mine, 1 - mine, s["n"] + F.least(s["x"], s["y"])))

    return F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), state(none, zero, zero, zero), step, lambda s: s["n"] + F.least(s["x"], s["y"]))


def match_counts(gt: Column, rec: Column) -> Column:
    """struct(matched, expected) of a text: characters where the target holds an ideograph, words (cut at white space) elsewhere, as multisets."""
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    both = lambda a, b: F.struct(bag_overlap(a, b).alias("matched"), F.size(a).alias("expected"))
    return F.when(gt.rlike("[一-鿿]"), both(chars(gt), chars(rec))).otherwise(both(words(gt), words(rec)))


def bag_runs(gt: Column, pred: Column) -> Column:
    """Each different token of each list, once: {t, side (0 for gt), pos of its first occurrence, n, other: its number in the other list, 0 for none}.

    Both lists are sorted together, so equal tokens are neighbours: a run's number
    is the distance to the next run, and the other list's run is the one beside it.
    """
    side = lambda arr, n: F.transform(arr, lambda t, i: F.struct(t.alias("t"), F.lit(n).alias("side"), i.alias("pos")))

    def starts(s: Column) -> Column:
        new = lambda x, i: ~x["t"].eqNullSafe(F.get(s, i - 1)["t"]) | ~x["side"].eqNullSafe(F.get(s, i - 1)["side"])
        at = F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("at"), ((i == 0) | new(x, i)).alias("new")))
        return let(F.filter(at, lambda r: r["new"]), lambda r: F.transform(r, lambda x, i: F.struct(x["x"].alias("x"), (F.coalesce(F.get(r, i + 1)["at"], F.size(s)) - x["at"]).alias("n"))))

    def beside(r: Column) -> Column:
        mate = lambda x, i: F.get(r, F.when(x["x"]["side"] == 0, i + 1).otherwise(i - 1))
        same = lambda x, y: F.when(x["x"]["t"].eqNullSafe(y["x"]["t"]), y["n"])
        return F.transform(r, lambda x, i: F.struct(x["x"]["t"].alias("t"), x["x"]["side"].alias("side"), x["x"]["pos"].alias("pos"), x["n"].alias("n"), F.coalesce(same(x, mate(x, i)), F.lit(0)).alias("other")))

    return let(let(F.array_sort(F.concat(side(gt, 0), side(pred, 1))), starts), beside)


def bag_classify(gt: Column, pred: Column) -> Column:
    """struct of correct, duplicate, irrelevant and missing tokens by multiset frequency, in the order of their first occurrences."""

    def parts(runs: Column) -> Column:
        def many(of: int, n) -> Column:
            kept = F.array_sort(F.transform(F.filter(runs, lambda r: r["side"] == of), lambda r: F.struct(r["pos"].alias("pos"), r["t"].alias("t"), n(r).alias("n"))))
            return F.flatten(F.transform(kept, lambda r: F.array_repeat(r["t"], r["n"])))

        return F.struct(
            many(1, lambda r: F.least(r["n"], r["other"])).alias("correct"),
            many(1, lambda r: F.when(r["other"] > 0, F.greatest(r["n"] - r["other"], F.lit(0))).otherwise(0)).alias("duplicate"),
            many(1, lambda r: F.when(r["other"] > 0, 0).otherwise(r["n"])).alias("irrelevant"),
            many(0, lambda r: F.greatest(r["n"] - r["other"], F.lit(0))).alias("missing"),
        )

    return let(bag_runs(gt, pred), parts)


def recall_greedy(gt: Column, pred: Column, most: float = 0.3) -> Column:
    """Share of expected tokens, in order, that find the first unused token within ``most``; null for none expected."""
    start = F.struct(F.lit(0).alias("hits"), F.array().cast("array<int>").alias("used"))

    def step(acc: Column, g: Column) -> Column:
        fits = F.transform(pred, lambda p, i: F.when((ned(p, g) <= most) & ~F.array_contains(acc["used"], i), i))
        first = F.array_min(fits)
        return F.struct(
            F.when(first.isNull(), acc["hits"]).otherwise(acc["hits"] + 1).alias("hits"),
            F.when(first.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(first))).alias("used"),
        )

    return F.try_divide(F.aggregate(gt, start, step, lambda a: a["hits"]), F.nullif(F.size(gt), F.lit(0)))


def token_hit(t: Column, pred: Column) -> Column:
    """struct(hit, edit) of an expected token: membership; else the least distance, 1 for ideographs and without predictions."""
    hit = F.array_contains(pred, t)
    near = F.coalesce(F.array_min(F.transform(pred, lambda p: ned(p, t))), F.lit(1.0))
    return F.struct(hit.cast("int").alias("hit"), F.when(hit, 0.0).when(t.rlike("[一-鿿]"), 1.0).otherwise(near).alias("edit"))


def nearest_ned(t: Column, pred: Column) -> Column:
    """Least distance of a token to those of a list; only tokens whose length allows less than the best so far are compared."""
    n = F.length(t)

    def step(best: Column, p: Column) -> Column:
        longer = F.greatest(F.length(p), n)
        could = F.abs(F.length(p) - n) < best * longer
        return F.when(could, F.least(best, F.levenshtein(p, t) / longer)).otherwise(best)

    return F.aggregate(pred, F.lit(1.0), step)


def token_hits(gt: Column, pred: Column) -> Column:
    """struct(hits, tokens, edit) over expected tokens, as ``token_hit`` of each; a distance is computed once for each different token that isn't predicted."""
    edit = lambda t, p: F.when(t.rlike("[一-鿿]"), 1.0).otherwise(nearest_ned(t, p))

    def summed(x: Column) -> Column:
        lost = F.filter(x["runs"], lambda r: (r["side"] == 0) & (r["other"] == 0))
        known = F.transform(F.filter(x["runs"], lambda r: r["side"] == 1), lambda r: r["t"])
        gone = F.aggregate(lost, F.lit(0), lambda s, r: s + r["n"])
        far = let(known, lambda p: F.aggregate(lost, F.lit(0.0), lambda s, r: s + edit(r["t"], p) * r["n"]))
        return F.struct((x["n"] - gone).alias("hits"), x["n"].alias("tokens"), far.alias("edit"))

    return let(F.struct(bag_runs(gt, pred).alias("runs"), F.size(gt).alias("n")), summed)


def anomaly_confusion(pred_marks: Column, gt_marks: Column, ratio: float = 0.7) -> Column:
    """TP, FP, TN or FN for counts of anomaly marks."""
    within = (gt_marks * ratio <= pred_marks) & (pred_marks <= F.lit(1 / ratio) * gt_marks)
    return F.when(pred_marks > 0, F.when(within, "TP").otherwise("FP")).otherwise(F.when(gt_marks == 0, "TN").otherwise("FN"))


def count_marks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("#"), F.lit("")))


def answers_right(gt: Column, pred: Column) -> Column:
    """Booleans for answers side by side, up to the shorter list."""
    n = F.least(F.size(gt), F.size(pred))
    return F.zip_with(F.slice(gt, F.lit(1), n), F.slice(pred, F.lit(1), n), lambda a, b: F.lower(F.trim(a)) == F.lower(F.trim(b)))
