"""Personal data replaced by surrogates, in DataFrame functions only.

Detected: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, card numbers,
social security numbers, IBANs, and people named after a title or a chain of
titles ("Frau Prof. Dr."), with any number of names, initials and particles; in
the same document each later or earlier capitalised mention of such a name,
without a title, too. Titles are no names. Where all is in capitals, a name ends
with the line or at punctuation. Every entity gets a
surrogate that a key (HMAC-SHA-256) and the entity's own content determine, of
the same type and format: digits for digits, letters of the same script and case
for letters, separators and lengths as they were, octets of as many digits, card
numbers with an equally valid check digit, IBANs of the same country with right
check digits where the real ones are right.

A name is replaced word by word, and a word has one surrogate in the whole
corpus, so "Dr Anna Smith", "Ms Smith" and a bare "Anna" stay one person. Its
ending follows what the word mostly is, counted over all documents: a family
name, or a given name after titles of one gender or of none. Particles stay;
initials become other initials. Other spellings of one entity (a number with
other separators, an address in capitals) have the same surrogate in their own
spelling, here and in every other document.

Surrogates are drawn for the distinct entities of the corpus and checked: one
that equals a real entity, an accepted surrogate, or another's draw is drawn
again, all but the first of those that met. So distinct entities stay distinct.
Draws repeat until none is left, over ever fewer rows. A format that leaves too
few is widened for those left after ``SAME_FORMAT`` draws, by one more character
a draw (three digits in each octet), so the draws come to an end.

Only documents with an entity are moved; the others pass through their scan. A
mention meets its surrogate in a join on document and mention, so a document may
have any number of them.

Null texts stay null and texts without an entity stay as they are. Null and
repeated ids are told apart by their texts; repeated rows come out repeated.
Words that are names and common words alike ("Will") are replaced wherever they
are capitalised in a document that has the name after a title.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import let, materialise, text_key

FEMALE = "Mrs|Ms|Miss|Madam|Frau|Frl|Fräulein|Mme|Madame|Mlle|Mademoiselle|Sra|Señora|Srta|Señorita|Signora|Doctora|Profesora|Professorin|MRS|MISS|FRAU|MME|г-жа|госпожа"
MALE = "Mr|Mister|Sir|Herr|Herrn|Monsieur|Sr|Señor|Signor|MR|HERR|г-н|господин"
NEUTRAL = "Dr|Prof|Doctor|Doktor|Docteur|Professor|Professeur|Profesor|DR|PROF|PROFESSOR"
TITLES = f"{FEMALE}|{MALE}|{NEUTRAL}"
FIRST_LETTERS = "".join(sorted({t[0] for t in TITLES.split("|")}))
#: Words inside a name that stay as they are.
PARTICLES = "de|la|las|los|del|der|den|van|von|vom|zu|zur|da|das|di|do|dos|du|le|el|al|bin|ibn|ben|y|e|und|af|av|ter|ten"
#: One name, or an initial, but no title. Groups repeat possessively: the engine then loops where it would recurse.
WORD = rf"(?!(?:{TITLES})(?!\p{{L}}))\p{{Lu}}(?:['’]\p{{Lu}})?+(?:\p{{L}}++|\.)"
#: Titles one after the other, with any blanks on the line.
TITLED = rf"(?:(?:{TITLES})\.?\h++)++"
HEX4 = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]*[A-Za-z0-9]\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:])(?:(?:{HEX4}:){{7}}{HEX4}|(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:{HEX4}(?::{HEX4}){{0,6}})?::(?:{HEX4}(?::{HEX4}){{0,6}})?)(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])(?:1-)?[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9.])(?:1\.)?[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9])(?!\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])",
    "person": rf"(?<![\p{{L}}-]){TITLED}{WORD}(?:(?:\h++|-)(?:(?:{PARTICLES})\h++)*+{WORD})*+",
}
ANY = "|".join(PATTERNS.values())
#: In documents with a name: every capitalised word too, which may be one.
ANY_WORD = rf"{ANY}|(?<!\p{{L}})(?<!\p{{L}}['’])\p{{Lu}}(?:['’]\p{{Lu}})?+\p{{L}}++"
BARE = r"^\p{Lu}[\p{L}'’]*+$"
#: A cheap test that every text with an entity passes; the look-ahead spares most places the titles.
HINT = rf"[0-9@]|(?=[{FIRST_LETTERS}])(?:{TITLES})\.?\h++\p{{Lu}}"
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
ONSETS = {"latin": "b d f g h k l m n p r s t v z br dr gr kl tr st".split(), "cyrillic": "б в г д ж з к л м н п р с т ф".split()}
VOWELS = {"latin": "a e i o u".split(), "cyrillic": "а е и о у".split()}
ENDINGS = {
    ("latin", "given_f"): "na la ria sia lena dora".split(), ("latin", "given_m"): "n r k las ton mar".split(), ("latin", "given"): "ny ley lin ry".split(), ("latin", "family"): "ner sel ling man dor wick".split(),
    ("cyrillic", "given_f"): "на ля рия сия".split(), ("cyrillic", "given_m"): "н р к мир".split(), ("cyrillic", "given"): "ша ля".split(), ("cyrillic", "family"): "нко рин лич дар".split(),
}
SAME_FORMAT = 12
ROLES = ("family", "given", "given_f", "given_m")


def kind_of(raw: Column) -> Column:
    whole = lambda k: raw.rlike(rf"^(?:{PATTERNS[k]})$")
    first, *others = list(PATTERNS)
    return reduce(lambda w, k: w.when(whole(k), k), others, F.when(whole(first), first))


def parts_of(raw: Column, kind: Column) -> Column:
    """Array of (kind, role, piece); pieces without a kind stay as they are."""
    piece = lambda k, r, s: F.struct(k.cast("string").alias("kind"), r.cast("string").alias("role"), s.alias("piece"))
    none = F.lit(None)
    title = F.regexp_extract(raw, f"^{TITLED}", 0)
    of = lambda titles: title.rlike(rf"(?:^|\h)(?:{titles})(?!\p{{L}})")
    given = F.when(of(FEMALE), "given_f").when(of(MALE), "given_m").otherwise("given")
    rest = F.split(F.substr(raw, F.length(title) + 1), r"(?<=[\h-])(?=[^\h-])|(?<=[^\h-])(?=[\h-])")

    def name(x: Column) -> Column:  # words and separators by turns, the titles first
        kind_ = lambda w, i: F.when((i < 2) | (i % 2 == 1) | w.rlike(rf"^(?:{PARTICLES})$"), none).when(w.endswith("."), "initial").otherwise("name")
        return F.transform(x["words"], lambda w, i: piece(kind_(w, i), F.when(i == x["n"] - 1, "family").otherwise(x["given"]), w))

    # bound once: what a lambda names is computed for each of its elements
    words = let(F.concat(F.array(title, F.lit("")), rest), lambda w: F.struct(w.alias("words"), F.size(w).alias("n"), given.alias("given")))
    return F.when(kind == "person", let(words, name)).otherwise(F.array(piece(kind, none, raw)))


def canon_of(kind: Column, piece: Column) -> Column:
    return F.when(kind.isin("phone", "ssn", "card", "iban"), F.regexp_replace(F.lower(piece), r"[^a-z0-9+]", "")).otherwise(F.lower(piece))


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 as hex."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _hex_stream(key: str, attempt: int) -> Column:
    """Blocks of 64 hex digits, as many as the entity's length asks for."""
    seed = _hmac(key, F.concat_ws("|", "kind", "canon", F.lit(attempt)))
    blocks = F.sequence(F.lit(0), F.floor((F.length("canon") + attempt) / 16).cast("int") + 1)
    return let(seed, lambda x: F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", x, b), 256)))


def _number(h: Column, i: Column | int) -> Column:
    """The i-th number (16 bits) of a stream of blocks."""
    i = F.lit(i) if isinstance(i, int) else i
    block = F.element_at(h, (F.floor(i / 16) + 1).cast("int"))
    return F.conv(F.substr(block, (i % 16 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: list[str] | str, v: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, alphabet)), (v % len(alphabet) + 1).cast("int"))


def _like(ch: Column, v: Column) -> Column:
    """A character of the same kind and script."""
    from_ = lambda a: F.substr(F.lit(a), (v % len(a) + 1).cast("int"), F.lit(1))
    wide = F.decode(F.unhex(F.lpad(F.hex(F.lit(0x4E00) + v % 20000), 4, "0")), "UTF-16BE")
    return F.when(ch.rlike("[0-9]"), from_("0123456789")).when(ch.rlike("[一-鿿]"), wide).when(ch.rlike("[Ѐ-ӿ]"), from_(CYRILLIC)).when(ch.rlike("[Ͱ-Ͽ]"), from_(GREEK)).when(ch.rlike(r"\p{L}"), from_(LATIN)).otherwise(ch)


def _replaced(text: Column, h: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda ch, i: _like(ch, _number(h, i))), "")


def _luhn(digits: Column) -> Column:
    """The check digit that ``digits`` asks for."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda ch, i: F.when((n - i) % 2 == 1, F.when(ch.cast("int") > 4, ch.cast("int") * 2 - 9).otherwise(ch.cast("int") * 2)).otherwise(ch.cast("int")))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(canon: Column, h: Column) -> Column:
    n, real = F.length(canon), F.length("canon")
    own, last = F.substr("canon", F.lit(1), real - 1), F.substr("canon", real).cast("int")
    new = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _replaced(F.substr(canon, F.lit(2), n - 2), h))
    return let(new, lambda x: F.concat(x, ((_luhn(x) + last - _luhn(own) + 10) % 10).cast("string")))


def _mod97(text: Column) -> Column:
    """The number that digits and letters (a is 10) make, modulo 97."""
    value = lambda ch: F.when(ch < ":", F.ascii(ch) - 48).otherwise(F.ascii(ch) - 87)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda m, ch: (m * F.when(ch < ":", 10).otherwise(100) + value(ch)) % 97)


def _iban(canon: Column, h: Column) -> Column:
    """Country and, where the real one's check digits are right, right ones."""
    new = let(_replaced(F.substr(canon, F.lit(3)), h), lambda x: F.concat(F.substr(canon, F.lit(1), F.lit(2)), x))
    rest = lambda c: F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))
    land, body = F.substr(canon, F.lit(1), F.lit(2)), lambda x: F.substr(x, F.lit(5))
    checked = lambda x: F.concat(land, F.lpad((98 - _mod97(F.concat(body(x), land, F.lit("00")))).cast("string"), 2, "0"), body(x))
    return let(new, lambda x: F.when(_mod97(rest(F.col("canon"))) == 1, checked(x)).otherwise(x))


def _groups(h: Column, extra: int) -> Column:
    """Hexadecimal digits for digits; widened by digits in its last group, where there is room for them."""
    each = F.transform(F.split(F.concat("canon", F.lit("0" * extra)), ""), lambda ch, i: F.when(ch == ":", ch).otherwise(_pick("0123456789abcdef", _number(h, i))))
    return F.array_join(each, "")


def _octets(h: Column, wide: bool) -> Column:
    three = lambda v: v % 155 + 100
    size = lambda o, v: three(v) if wide else F.when(F.length(o) == 1, v % 9 + 1).when(F.length(o) == 2, v % 90 + 10).otherwise(three(v))
    return F.array_join(F.transform(F.split("canon", r"\."), lambda o, i: size(o, _number(h, i)).cast("string")), ".")


def _name(h: Column, extra: int) -> Column:
    def of(script: str, role: str) -> Column:
        syllable = lambda i: F.concat(_pick(ONSETS[script], _number(h, 2 * i)), _pick(VOWELS[script], _number(h, 2 * i + 1)))
        more = [syllable(5 + i) for i in range(extra)]
        return F.concat(syllable(0), syllable(1), F.when(_number(h, 8) % 3 == 0, syllable(2)).otherwise(""), *more, _pick(ENDINGS[script, role], _number(h, 9)))

    in_script = lambda s: reduce(lambda w, k: w.when(F.col("role") == k, of(s, k)), ROLES[1:], F.when(F.col("role") == ROLES[0], of(s, ROLES[0])))
    wide = F.concat("canon", F.repeat(F.substr("canon", F.lit(1), F.lit(1)), F.lit(extra)))
    return F.when(F.col("canon").rlike("^[Ѐ-ӿ]+$"), in_script("cyrillic")).when(F.col("canon").rlike(r"^\p{IsLatin}+$"), in_script("latin")).otherwise(_replaced(wide, h))


def draw(key: str, attempt: int) -> Column:
    """The surrogate of (kind, role, canon) at an attempt; later ones are longer than the entity."""
    kind, extra = F.col("kind"), max(0, attempt - SAME_FORMAT)
    canon = F.concat("canon", F.lit("0" * extra))

    def by_kind(h: Column) -> Column:
        tail = F.regexp_extract("canon", r"(\.example\.[a-z]+|(?<=@)example\.[a-z]+|\.[a-z]+)$", 1)
        head = F.concat(F.lit("x" * extra), F.substr("canon", F.lit(1), F.length("canon") - F.length(tail)))
        lead = F.regexp_extract("canon", r"^\+[0-9]", 0)
        return (
            F.when(kind == "email", F.concat(_replaced(head, h), tail))
            .when(kind == "ip", _octets(h, extra > 0))
            .when(kind == "ip6", _groups(h, extra))
            .when(kind == "card", _card(canon, h))
            .when(kind == "iban", _iban(canon, h))
            .when(kind == "phone", F.concat(lead, _replaced(F.substr(canon, F.length(lead) + 1), h)))
            .when(kind == "ssn", _replaced(canon, h))
            .otherwise(_name(h, extra))
        )

    return let(_hex_stream(key, attempt + (64 if extra else 0)), by_kind)


def surrogates(entities: DataFrame, key: str, draw_=draw) -> DataFrame:
    """(kind, canon, sub) for the distinct (kind, canon) of ``entities``, whose ``role`` shapes names; no two of a kind alike, none a real one."""
    todo = real = materialise(entities.groupBy("kind", "canon").agg(F.min("role").alias("role")), "entities")
    done, attempt = None, 0
    while True:
        drawn = todo.withColumn("sub", draw_(key, attempt))
        taken = real.select("kind", F.col("canon").alias("sub"))
        if done is not None:
            taken = taken.union(done.select("kind", "sub"))
        # only what is drawn is looked up, so the smaller side can be broadcast
        taken = taken.join(drawn.select("kind", "sub").distinct(), ["kind", "sub"]).distinct().withColumn("taken", F.lit(True))
        drawn = drawn.join(taken, ["kind", "sub"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("kind", "sub").orderBy("canon")))
        drawn = materialise(drawn.select("kind", "role", "canon", "sub", (F.col("taken").isNull() & (F.col("nth") == 1)).alias("ok")), "surrogates")
        good = drawn.filter("ok").select("kind", "canon", "sub")
        done = good if done is None else done.union(good)
        todo = drawn.filter("NOT ok").select("kind", "role", "canon")
        if todo.isEmpty():
            return done
        attempt += 1


def cased_by_char(piece: Column, sub: Column) -> Column:
    """The surrogate of an address in the capitals of this spelling, place by place; a longer one has its extra characters first."""
    more = F.length(sub) - F.length(piece)
    each = F.zip_with(F.split(piece, ""), F.split(F.substr(sub, more + 1), ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b))
    return F.concat(F.substr(sub, F.lit(1), more), F.array_join(each, ""))


def spelt_like(piece: Column, sub: Column) -> Column:
    """The surrogate with the separators and capitals of this spelling; what a longer one has besides comes last. For the short kinds."""
    plain = F.regexp_replace(sub, r"[^\p{L}\p{N}]", "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(acc: Column, ch: Column) -> Column:
        c = F.substr(plain, acc["k"], F.lit(1))
        cased = F.when(ch.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)
        mine = ch.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc["s"], F.when(mine, cased).otherwise(ch)).alias("s"), F.when(mine, acc["k"] + 1).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.split(piece, ""), start, step, lambda acc: F.concat(acc["s"], F.substr(plain, acc["k"])))


def cased_like(piece: Column, name: Column) -> Column:
    return F.when((F.upper(piece) == piece) & (F.length(piece) > 1), F.upper(name)).otherwise(F.initcap(name))


def roles(pieces: DataFrame, mentions: DataFrame) -> DataFrame:
    """(kind, canon, role) of the distinct pieces; a name's role is that of most (document, mention) pairs."""
    many = mentions.groupBy("rid").agg(F.count(F.lit(1)).alias("many"))
    p = pieces.filter("kind IS NOT NULL AND kind <> 'initial'").join(many, "rid")
    count = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("many"))), F.lit(0)).alias(r)
    n = p.groupBy("kind", "canon").agg(*map(count, ROLES))
    given = F.when(F.col("given_f") > F.col("given_m"), "given_f").when(F.col("given_f") < F.col("given_m"), "given_m").otherwise("given")
    return n.select("kind", "canon", F.when(F.col("family") >= F.col("given") + F.col("given_f") + F.col("given_m"), "family").otherwise(given).alias("role"))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities) of each row, the text with surrogates; names without a title don't count as entities."""
    t = F.col("text")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    has = F.coalesce(t.rlike(HINT) & t.rlike(ANY), F.lit(False))
    found_in = lambda p: F.struct(F.split(t, p, -1).alias("between"), F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("e"))
    some = d.filter(has).select("doc_id", "tkey", F.when(t.rlike(PATTERNS["person"]), found_in(ANY_WORD)).otherwise(found_in(ANY)).alias("x"))
    some = materialise(some.select(F.monotonically_increasing_id().alias("row"), "doc_id", "tkey", "x.*"), "texts")
    # a mention is known by its digest, since a long one has many pieces
    found = some.select("doc_id", "tkey", F.explode(F.array_distinct("e")).alias("raw")).filter(~F.col("raw").rlike(BARE))
    found = materialise(found.select("doc_id", "tkey", F.sha2("raw", 256).alias("rid"), "raw").distinct(), "mentions")
    raws = found.select("rid", "raw").distinct().select("rid", "raw", kind_of(F.col("raw")).alias("k"))
    raws = raws.select("rid", F.posexplode(parts_of(F.col("raw"), F.col("k"))).alias("i", "p")).select("rid", "i", "p.*")
    raws = materialise(raws.withColumn("canon", canon_of(F.col("kind"), F.col("piece"))), "pieces")
    table = surrogates(roles(raws, found), key)
    piece, sub = F.col("piece"), F.col("sub")
    letter = _like(F.col("canon").substr(1, 1), _number(F.array(_hmac(key, F.concat_ws("|", "kind", "canon"))), 0))
    spelt = F.when(F.col("kind") == "initial", F.concat(F.upper(letter), F.lit("."))).when(sub.isNull(), piece).when(F.col("kind") == "name", cased_like(piece, sub)).when(F.col("kind") == "ip", sub).when(F.col("kind").isin("email", "ip6"), cased_by_char(piece, sub)).otherwise(spelt_like(piece, sub))
    new = materialise(raws.join(table, ["kind", "canon"], "left").withColumn("s", spelt), "spelt")
    whole = new.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("a")).select("rid", F.array_join(F.col("a.s"), "").alias("new"))
    names = new.filter("kind = 'name'").select("rid", "canon", "sub").distinct()
    # what a document's mentions become, and its names, in lower case, for mentions without a title
    pairs = found.join(whole, "rid").select("doc_id", "tkey", "raw", "new").unionByName(found.drop("raw").join(names, "rid").select("doc_id", "tkey", F.col("canon").alias("raw"), F.col("sub").alias("new")).distinct())
    e = F.col("p.e")
    each = some.select("row", "doc_id", "tkey", F.posexplode(F.arrays_zip(F.col("between").alias("b"), F.col("e").alias("e"))).alias("at", "p"))
    each = each.withColumn("bare", e.rlike(BARE)).select("row", "doc_id", "tkey", "at", "p", "bare", F.when(F.col("bare"), F.lower(e)).otherwise(e).alias("raw"))
    same = [each["doc_id"].eqNullSafe(pairs["doc_id"]), each["tkey"] == pairs["tkey"], each["raw"] == pairs["raw"]]
    new = F.when(F.col("bare"), cased_like(e, F.col("new"))).otherwise(F.col("new"))
    each = each.join(pairs, same, "left").select("row", each["doc_id"], "at", F.concat("p.b", F.coalesce(new, e, F.lit(""))).alias("s"), (~F.col("bare")).cast("long").alias("is"))
    both = each.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.array_join(F.array_sort(F.collect_list(F.struct("at", "s")))["s"], "").alias("text"), F.coalesce(F.sum("is"), F.lit(0)).alias("n_entities")).drop("row")
    return both.unionByName(d.filter(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))
