"""Text normalisation and extraction: Column in, Column out, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

# Character ranges and keywords that results depend on.
CJK = "一-鿿"  # any ideograph (U+4E00 to U+9FFF)
CJK_NARROW = "一-龥"  # to U+9FA5, used by the whitelists
FRENCH = "àâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ"
KEYWORDS = ("addCriterion", "No text recognized.")


def contains_chinese(s: Column, narrow: bool = False) -> Column:
    return s.rlike(f"[{CJK_NARROW if narrow else CJK}]")


def characters(s: Column) -> Column:
    """The characters of a text that aren't white space, as a list."""
    return F.regexp_extract_all(strip_whitespace(s), F.lit("(?s)."), F.lit(0))


def strip_whitespace(s: Column) -> Column:
    """All white space out; (?U) for Unicode white space."""
    return F.regexp_replace(s, r"(?U)\s+", "")


def strip_to_marks(s: Column) -> Column:
    """Only ideographs, ASCII letters and digits, and the anomaly mark # stay."""
    return F.regexp_replace(s, f"[^{CJK_NARROW}a-zA-Z0-9#]", "")


def clean(s: Column, mode: str = "en") -> Column:
    """Whitelist cleaning for long texts: ``en`` collapses white space and lower-cases, ``zh`` drops it."""
    if mode == "zh":
        return F.regexp_replace(s, f"[^{CJK_NARROW}a-zA-Z0-9{FRENCH}]", "")
    kept = F.regexp_replace(s, f"(?U)[^{CJK_NARROW}a-zA-Z0-9\\s{FRENCH}]", "")
    return F.lower(F.trim(F.regexp_replace(kept, r"(?U)\s+", " ")))


def clean_auto(s: Column) -> Column:
    """As ``clean``, the language found in the text, case kept."""
    kept = F.regexp_replace(s, f"(?U)[^{CJK_NARROW}a-zA-Z0-9\\s{FRENCH}]", "")
    return F.when(contains_chinese(kept), F.regexp_replace(s, f"[^{CJK_NARROW}a-zA-Z0-9{FRENCH}]", "")).otherwise(F.trim(F.regexp_replace(kept, r"(?U)\s+", " ")))


def strip_keywords(s: Column, keywords=KEYWORDS, compat: bool = False) -> Column:
    """Removes recogniser boilerplate. ``compat``: only the last keyword is removed."""
    out = s
    for k in keywords[-1:] if compat else keywords:
        out = F.replace(out, F.lit(k), F.lit(""))
    return out


def unescape(s: Column) -> Column:
    r"""\\ \n \" \' as the characters they stand for, in this order."""
    pairs = (("\\\\", "\\"), ("\\n", "\n"), ('\\"', '"'), ("\\'", "'"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, s)


OPENERS, CLOSERS = "\"“‘'〝", "\"”’'〞"
SOFT = "，。！？, "


def process_raw_text(s: Column) -> Column:
    """Unescapes, then takes punctuation for white space; inside balanced quotes it stays and the quotes go."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("close"))

    def step(acc: Column, ch: Column) -> Column:
        at = F.instr(F.lit(OPENERS), ch)
        opener = (at > 0) & (ch != "")
        outside = acc["close"] == ""
        state = lambda out, close: F.struct(out.alias("out"), close.alias("close"))
        closer = F.substr(F.lit(CLOSERS), at, F.lit(1))
        add = lambda c: F.concat(acc["out"], c)
        return (
            F.when(opener & outside, state(acc["out"], closer))
            .when(opener & (ch == acc["close"]), state(acc["out"], F.lit("")))
            .when(outside & (F.instr(F.lit(SOFT), ch) > 0), state(add(F.lit(" ")), acc["close"]))
            .otherwise(state(add(ch), acc["close"]))
        )

    def whole(t: Column) -> Column:
        quotes = F.length(t) - F.length(F.translate(t, OPENERS, ""))
        # a closing mark that isn't an opener too (” ’ 〞) is an ordinary character and leaves the quote open
        quoted = F.aggregate(F.split(t, ""), start, step, lambda a: a["out"])
        return F.when(quotes >= 2, quoted).otherwise(F.regexp_replace(t, "[，。！？,]+", " "))

    return F.trim(F.regexp_replace(let(unescape(F.coalesce(s, F.lit(""))), whole), r"(?U)\s+", " "))


def words_in_quotes(s: Column) -> Column:
    """Lower-cased words of every '...' group."""
    groups = F.regexp_extract_all(s, F.lit(r"'(.*?)'"), F.lit(1))
    words = F.flatten(F.transform(groups, lambda g: F.split(F.trim(F.lower(g)), r"(?U)\s+")))
    return F.filter(words, lambda w: w != "")


def between_last_quotes(s: Column) -> Column:
    """Lower-cased text between the last two double quotes, null where there are fewer than one."""
    parts = F.split(s, '"')
    return F.when(F.size(parts) >= 2, F.lower(F.element_at(parts, -2)))


def after_first_quote(s: Column) -> Column:
    """Text from the first double quote to the next, null without a quote."""
    parts = F.split(s, '"')
    return F.when(F.size(parts) >= 2, F.element_at(parts, 2))


QUOTES = {"“": "”", "‘": "’", '"': '"', "'": "'", "《": "》"}


def quoted_spans(s: Column) -> Column:
    """Top-level quoted texts, trimmed, empties dropped; what an unclosed mark opens is left out."""
    # a second alternative takes an unclosed opener and all that follows, which no later quote may use
    closed = "|".join(f"{a}[^{b}]*{b}" for a, b in QUOTES.items())
    found = F.regexp_extract_all(s, F.lit(f"(?s)(?:{closed})|[{''.join(QUOTES)}].*"), F.lit(0))
    whole = F.filter(found, lambda x: x.rlike(f"(?s)^(?:{closed})$"))
    texts = F.transform(whole, lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"(?U)^\s+|\s+$", ""))
    return F.filter(texts, lambda x: x != "")


def tokens(words: Column, compat: bool = False) -> Column:
    """Ideographs one by one, other runs whole; words without ideographs stay as they are.

    ``compat`` emits a run after the ideograph behind it and loses a run at a word's end.
    """

    def cut(w: Column) -> Column:
        if not compat:
            return F.regexp_extract_all(w, F.lit(f"[{CJK}]|[^{CJK}]+"), F.lit(0))
        pairs = F.regexp_extract_all(w, F.lit(f"[^{CJK}]*[{CJK}]"), F.lit(0))
        return F.flatten(F.transform(pairs, lambda p: F.filter(F.array(F.right(p, F.lit(1)), F.substr(p, F.lit(1), F.length(p) - 1)), lambda x: x != "")))

    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"[{CJK}]"), cut(w)).otherwise(F.array(w))))


def anomaly_tokens(words: Column) -> Column:
    """Ideographs of words that have any; other words whole unless they hold an anomaly mark."""
    return F.flatten(
        F.transform(words, lambda w: F.when(w.rlike(f"[{CJK}]"), F.regexp_extract_all(w, F.lit(f"[{CJK}]"), F.lit(0))).when(w.contains("#"), F.array().cast("array<string>")).otherwise(F.array(w)))
    )


def match_marks(rec: Column, ref: Column) -> Column:
    """The recognised text, its anomaly marks changed for a character by what the reference holds."""
    r = F.translate(rec, "<>", "")
    put = lambda c: F.replace(r, F.lit("#"), F.lit(c))
    has = lambda c: F.contains(ref, F.lit(c))
    return F.when(~has("#"), r).when(~has("$"), put("$")).when(has("&"), put("&")).when(has("￥"), put("￥")).otherwise(r)


def lower_split(s: Column) -> Column:
    """Lower-cased and split at single spaces; empties count."""
    return F.split(F.lower(s), " ", -1)


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def yes_no_lines(s: Column, n_questions: Column) -> Column:
    """Leading yes or no of each line that isn't blank; null unless there is one for each question."""
    found = F.transform(F.regexp_extract_all(s, F.lit(r"(?im)^[ \t]*(yes|no)\b"), F.lit(1)), F.lower)
    return F.when(F.size(found) == n_questions, found)


def score_tag(s: Column) -> Column:
    """<Score>n</Score> over 5, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"<Score>(\d+)</Score>", 1), F.lit("")).try_cast("double"), F.lit(0.0)) / 5


def final_score(s: Column) -> Column:
    """'Final Score: n' with n from 1 to 5, over 5, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"Final Score:\s*([1-5](?:\.\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.0)) / 5


def merge_lines(lines: Column, sep: str = "") -> Column:
    """Texts of recognised lines (struct with text and conf) whose confidence is positive."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["conf"] > 0), lambda x: x["text"]), sep)


def target_or_original(original: Column, parsed: Column) -> Column:
    """The parsed target, unless it is empty or less than half as long as the original."""
    return F.when((F.length(parsed) == 0) | (F.length(original) >= 2 * F.length(parsed)), original).otherwise(parsed)


def recognition_prompt(box: Column | None = None) -> Column:
    """Instruction for an external recogniser, for a box or the whole image."""
    where, of = (F.lit("the whole image"), F.lit("the image")) if box is None else (F.concat(F.lit("the area "), box), box)
    return F.format_string(
        'Recognise all text visible in %s. Write <#> for a malformed, unreadable character or letter and <###> for a malformed, unreadable word. Answer as JSON: {"recognized_text": "text in %s, with these marks"}', where, of
    )


# -- file names and boxes


def id_from_name(name: Column, as_int: bool = False) -> Column:
    """What stands before the first _, or else before the first dot."""
    out = F.when(name.contains("_"), F.regexp_extract(name, "^([^_]*)_", 1)).otherwise(F.regexp_extract(name, r"^([^.]*)", 1))
    return out.try_cast("int") if as_int else out


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(png|jpe?g)$")


def language_mode(name: Column) -> Column:
    return F.when(name.contains("_ZH"), "zh").otherwise("en")


def normalise_coordinate(x: Column, extent: Column) -> Column:
    """A pixel coordinate on a scale of 0 to 1000, halves to even; 0 where the extent is 1 or less."""
    clamped = F.greatest(F.lit(0.0), F.least(x.cast("double"), extent.cast("double") - 1))
    return F.when(extent <= 1, F.lit(0)).otherwise(F.bround(clamped / (extent - 1) * 1000, 0).cast("int"))


def level_of_id(id_: Column) -> Column:
    return F.when(id_.contains("box"), "box").otherwise("image")


# Sources that count, and the category of each.
SOURCE_CATEGORY = {
    "anno v1_box": "anno_box",
    "anno v1_image": "anno_image",
    "anno advs_box": "anno_box",
    "anno advs_image": "anno_image",
    "sythetic_zaozi_box": "zaozi_box",
    "sythetic_zaozi_image": "zaozi_image",
    "sythetic_box": "render_box",
    "sythetic_image": "render_image",
}
CATEGORY_GROUP = {"anno_box": "anno", "anno_image": "anno", "zaozi_box": "zaozi", "zaozi_image": "zaozi", "render_box": "sythentic", "render_image": "sythentic"}


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value, null for an unknown key."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def length_weight(x: Column, reduction: str = "square") -> Column:
    by = {"token": F.lit(1.0), "sample": 1 / x, "square": F.pow(x, F.lit(-0.5))}[reduction]
    return F.when(x == 0, F.lit(0.0)).otherwise(by)


def resize(width: Column, height: Column, max_size: float, min_size: float, stride: int, max_pixels: float, images: Column | int = 1) -> Column:
    """struct(width, height): scaled into [min_size, max_size], divisible by stride, within max_pixels per image."""
    divisible = lambda v: F.greatest(F.lit(stride), F.bround(v / stride, 0).cast("int") * stride)
    scaled = lambda w, h, s: F.struct(divisible(F.bround(w * s, 0)).alias("width"), divisible(F.bround(h * s, 0)).alias("height"))
    scale = F.greatest(F.least(F.lit(float(max_size)) / F.greatest(width, height), F.lit(1.0)), F.lit(float(min_size)) / F.least(width, height))
    one = scaled(width, height, scale)
    room = F.lit(float(max_pixels)) / images
    pixels = one["width"] * one["height"]
    two = F.when(pixels > room, scaled(one["width"], one["height"], room / pixels)).otherwise(one)
    edge = F.greatest(two["width"], two["height"])
    return F.when(edge > max_size, scaled(two["width"], two["height"], F.lit(float(max_size)) / edge)).otherwise(two)


def style_key(class_: Column) -> Column:
    """A class name as the key of its reference set."""
    return F.lower(F.replace(class_, F.lit(" "), F.lit("_")))
