"""Responses of recognisers: tolerant JSON, fallbacks, prompt parsing, the scoring pipeline."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import assign, match, text
from .expr import let


def json_body(s: Column) -> Column:
    """The first fenced json block, or the text less one pair of quotes; cut after the last brace, or bracket."""
    fenced = F.regexp_extract(s, r"(?s)```json\s*(.*?)\s*```", 1)
    peeled = let(F.trim(s), lambda x: F.when(x.rlike(r"""(?s)^(["']).*\1$"""), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    cut = lambda x: F.when(x.contains("}"), F.regexp_replace(x, r"(?s)^(.*\}).*$", "$1")).when(x.contains("]"), F.regexp_replace(x, r"(?s)^(.*\]).*$", "$1")).otherwise(x)
    return let(F.coalesce(F.nullif(fenced, F.lit("")), peeled), cut)


LENIENT = {"allowUnquotedControlChars": "true"}


def json_field(s: Column, field: str) -> Column:
    """A field of a tolerant JSON response; a list is joined by spaces; null where there is no such object."""

    def plain(raw: Column) -> Column:
        as_list = F.array_join(F.from_json(raw, "array<string>", LENIENT), " ")
        return F.when(raw.rlike(r"(?s)^\s*\[.*\]\s*$"), F.coalesce(as_list, raw)).otherwise(raw)

    return let(F.from_json(json_body(s), f"`{field}` string", LENIENT)[field], plain)


#: Escapes undone in this order, and the key that follows the text in whole responses.
ESCAPES = (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\\\", "\\"), ("\\'", "'"), ('\\"', '"'))
NEXT_KEY = "duplicate_text"


def fallback_field(s: Column, field: str = "recognized_text", keep_marks: bool = False) -> Column:
    """A string field of a response that isn't JSON, read quote by quote; null where the field doesn't start.

    The value may hold quotes: it ends at the one before the key that usually
    follows, else at the first one before any key or a closing brace, else at the
    first; an empty value lets the next rule try. Tags go, and anomaly marks with
    them, unless ``keep_marks``.
    """
    begins = rf'"{field}"\s*:\s*"'

    def read(parts: Column) -> Column:  # what stands between quotes; the value starts the first
        later = lambda n: F.slice(parts, F.lit(n + 1), F.size(parts))
        # each part beside the three after it: an inner function may not name what an outer one was given
        rows = F.arrays_zip(*[later(n).alias(f"p{n}") for n in range(4)])
        key_after = lambda r: r["p1"].rlike(r"^\s*,\s*$") & r["p3"].isNotNull()
        first = lambda when: F.array_min(F.transform(rows, lambda r, i: F.when(when(r), i)))
        usual = first(lambda r: key_after(r) & (r["p2"] == NEXT_KEY))
        any_ = first(lambda r: key_after(r) | r["p1"].rlike(r"^\s*\}"))
        value = lambda k: let(F.array_join(F.slice(parts, F.lit(1), k + 1), '"'), lambda v: F.when(v != "", v))
        return F.coalesce(value(usual), value(any_), F.when(F.size(parts) > 1, F.get(parts, F.lit(0))))

    out = F.when(s.rlike(begins), let(F.split(F.element_at(F.split(s, begins, 2), -1), '"'), read))
    for written, meant in ESCAPES:
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out if keep_marks else F.regexp_replace(out, "<[^>]*>", "")


def recognised(s: Column, compat: bool = True) -> Column:
    return F.coalesce(json_field(s, "recognized_text"), fallback_field(s, keep_marks=not compat))


def score(response: Column, ref: Column, amp: float = 1.0) -> Column:
    """struct(quality, semantic, recognised): semantic is null without a reference; unreadable responses score 0."""
    raw = recognised(response)
    rec, failed = text.process_raw_text(raw), raw.isNull()
    words = lambda c: text.tokens(text.lower_split(c))
    g = assign.gned(words(ref), words(text.match_marks(rec, ref)))
    return F.struct(
        F.when(failed, 0.0).otherwise(match.quality(rec, amp)).alias("quality"),
        F.when(ref.isNotNull(), F.when(failed, 0.0).otherwise(1 - g)).alias("semantic"),
        F.when(failed, F.lit("<EXTRACT FAILED>")).otherwise(rec).alias("recognised"),
    )


def score_levels(response: Column, ref: Column, reference_free: bool = False) -> Column:
    """struct(semantic, quality, recognised, correct) in levels of 0 to 2.

    Unreadable responses: 0 quality where more than half of the text is marks and
    no reference is given, else nothing but the error mark.
    """
    fields = F.struct(
        json_field(response, "recognized_text").alias("j"), fallback_field(response).alias("r"),
        F.coalesce(json_field(response, "correct_text"), fallback_field(response, "correct_text")).alias("c"),
    )
    return let(fields, lambda x: _levels(response, ref, reference_free, F.coalesce(x["j"], x["r"]), x["c"], x["j"].isNotNull()))


def _levels(response: Column, ref: Column, reference_free: bool, rec_raw: Column, cor_raw: Column, is_json: Column) -> Column:
    bad = ~is_json & match.is_bad(response) & (ref.isNull() if ref is not None else F.lit(True))
    marks = lambda c: F.replace(F.replace(c, F.lit("<#>"), F.lit("#")), F.lit("<###>"), F.lit("###"))
    both = F.struct(text.process_raw_text(rec_raw).alias("rec"), marks(text.process_raw_text(cor_raw)).alias("cor"))
    return let(both, lambda x: _graded(ref, reference_free, rec_raw, cor_raw, is_json, bad, marks, x["rec"], x["cor"]))


def _graded(ref, reference_free, rec_raw, cor_raw, is_json, bad, marks, rec, cor) -> Column:
    row = lambda s, q, r, c: F.struct(s.cast("int").alias("semantic"), q.cast("int").alias("quality"), r.alias("recognised"), c.alias("correct"))
    none, error = F.lit(None).cast("string"), F.lit("<JSON_ERROR>")
    zh = text.contains_chinese(ref)
    kept = F.array_join(F.filter(F.split(cor, ""), lambda ch: (ch != "#") & F.contains(marks(rec), ch)), "")
    final = F.when(zh, kept).otherwise(F.upper(cor))
    free = row(F.lit(None), match.quality_level(marks(rec)), rec, none)
    based = row(match.semantic_level(rec, final, ref), match.quality_level(marks(rec)), rec, final)
    ok = free if reference_free else based
    out = F.when(bad, row(F.lit(None), F.lit(0), F.lit("<###> * N "), none)).when(rec_raw.isNull(), row(F.lit(None), F.lit(None), error, error))
    if not reference_free:
        out = out.when(~is_json & cor_raw.isNull() & ref.isNotNull(), row(F.lit(0), match.quality_level(rec), rec_raw, error))
    return out.otherwise(ok)


# -- nested quotes in prompts: a scanner, so a function over batches

#: Kinds of quotes, the ones that bind first in front, and words that belong to a quote they stand before.
QUOTE_KINDS = ("''", '""', "'", '"')
LEAD_IN = ("the", "text", ":")


def _is_word(s: str, i: int) -> bool:
    return 0 <= i < len(s) and (s[i].isalnum() or s[i] == "_")


def _behind(s: str, lo: int, end: int, of=str.isspace) -> int:
    """Where the run of such characters that ends at ``end`` begins."""
    while end > lo and of(s[end - 1]):
        end -= 1
    return end


def _lead_in(s: str, lo: int, end: int) -> int | None:
    """Where a lead-in begins that ends, up to white space, at ``end``."""
    at = end
    for word in reversed(LEAD_IN):
        gap = _behind(s, lo, at)
        if word == "the" and gap == at or not s.startswith(word, gap - len(word)) or gap - len(word) < lo:
            return None
        at = gap - len(word)
    return None if _is_word(s, at - 1) else at


def _without(s: str, kind: str) -> tuple[list[str], str]:
    """(texts in quotes of one kind, the rest): one walk over the places of its mark.

    A mark behind an odd number of backslashes is a character. One that follows a
    word doesn't open and one that a word follows doesn't close: apostrophes. The
    first mark that may close is looked up among those that may.
    """
    k = len(kind)
    marks = []
    i = s.find(kind)
    while i >= 0:
        start = _behind(s, 0, i, "\\".__eq__)
        if (i - start) % 2 == 0:
            marks.append((start, i))
        i = s.find(kind, i + 1)
    closing = [(j, start) for start, j in marks if not _is_word(s, j + k)]
    texts, rest, done, c = [], [], 0, 0
    for start, i in marks:
        while c < len(closing) and closing[c][0] < i + k:
            c += 1
        if c == len(closing):
            break
        if i < done or start < done:
            continue
        lead = _lead_in(s, done, start)
        if lead is None and _is_word(s, start - 1):
            continue
        j, back = closing[c]
        texts.append(s[i + k : back if back >= i + k else j])
        rest.append(s[done : start if lead is None else lead])
        done = j + k
    return texts, "".join(rest) + s[done:]


def nested_quotes(prompt: str) -> list[str]:
    """Quoted texts, the innermost of nested ones; apostrophes inside words don't quote. First occurrences, in order."""
    found: dict[str, None] = {}
    todo = [(prompt, False)]
    while todo:
        s, quoted = todo.pop()
        inside, rest = [], s
        for kind in QUOTE_KINDS:
            texts, rest = _without(rest, kind)
            inside += filter(None, map(str.strip, texts))
        if inside:
            todo += [(t, True) for t in reversed(inside)]
        elif quoted:
            found.setdefault(s)
    return list(found)


def _prompt_quotes(prompt: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else nested_quotes(p) for p in prompt], dtype="object")


def prompt_quotes(prompt) -> Column:
    """``nested_quotes`` of each prompt."""
    return F.pandas_udf(_prompt_quotes, "array<string>")(prompt)


def prompt_target(prompt: Column, mode: str) -> Column:
    """Target text of a prompt: its quoted texts joined by spaces."""
    if mode in ("zh", "cn"):
        return F.array_join(text.quoted_spans(prompt), " ")
    if mode == "en":
        return F.array_join(F.transform(prompt_quotes(prompt), lambda x: F.translate(x, "\"'“”", "")), " ")
    raise ValueError(f"unknown mode {mode}")


def _python_list(s: pd.Series) -> pd.Series:
    def one(x):
        try:
            v = ast.literal_eval(x)
        except (ValueError, SyntaxError, TypeError):
            return None
        return [str(y) for y in v] if isinstance(v, (list, tuple)) else None

    return pd.Series([one(x) for x in s], dtype="object")


def python_list(s) -> Column:
    """A list written as a Python literal; null where it isn't one."""
    return F.pandas_udf(_python_list, "array<string>")(s)
