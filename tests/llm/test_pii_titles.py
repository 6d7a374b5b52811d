"""Chains of titles, spellings of titles and numbers, and planted people in the documents of the tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lexigauge.llm import pii

SF = "/root/testdata/sf0.001"


def changed(spark, texts, key="k"):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.pseudonymise(d, key).collect()}
    return [got[i] for i in range(len(texts))]


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_titles(spark):
    texts = [
        "Herr Dr. Müller kam an. Dr. Weber auch.", "Frau Prof. Dr. Anna Meyer sprach, Meyer ging.", "MR JOHN SMITH", "Mr  John  Smith", "Professor Anna Smith", "Mr Smith Dr Weber", "Mr. Dr.", "Dr Prof", "Sir John", "Then Dr. and no name",
    ]
    got = changed(spark, texts)
    names = {n for n in re.findall(r"\w+", " ".join(texts)) if n not in {"Herr", "Dr", "kam", "an", "auch", "Frau", "Prof", "sprach", "ging", "MR", "Mr", "Professor", "Sir", "Then", "and", "no", "name"}}
    for (text, _), old in zip(got, texts):
        left = set(re.findall(r"\w+", text))
        assert not left & names, (old, text)
        for word in ("Herr", "Dr", "Frau", "Prof", "Mr", "MR", "Professor", "Sir"):
            assert len(re.findall(rf"\b{word}\b", text)) == len(re.findall(rf"\b{word}\b", old))
    one, two = got[0][0], got[1][0]
    assert re.fullmatch(r"Herr Dr\. (\w+) kam an\. Dr\. (\w+) auch\.", one) and got[0][1] == 2
    m = re.fullmatch(r"Frau Prof\. Dr\. (\w+) (\w+) sprach, (\w+) ging\.", two)
    assert m[2] == m[3] and any(m[1].lower().endswith(e) for e in pii.ENDINGS["latin", "given_f"])
    smith = got[2][0].split()[2]
    assert smith.isupper() and got[3][0].split()[2] == smith.capitalize() == got[4][0].split()[2] == got[5][0].split()[1]
    assert [got[i][0] for i in (6, 7, 9)] == [texts[i] for i in (6, 7, 9)]


def test_numbers(spark):
    texts = ["call 555.123.4567 or 1-555-123-4567", "2001:0db8:85a3::8a2e:0370:7334, fe80::1, ::1", "std::vector a::b 10:30:00 1.2.3", "DE89 3704 0044 0532 0130 00 DE88370400440532013000 GB82WEST12345698765432", "FE80::1 and fe80::1"]
    got = [t for t, _ in changed(spark, texts)]
    assert re.fullmatch(r"call \d{3}\.\d{3}\.\d{4} or \d-\d{3}-\d{3}-\d{4}", got[0]) and "123" not in got[0][:15]
    assert re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4}::[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4}, [0-9a-f]{4}::[0-9a-f], ::[0-9a-f]", got[1]) and not set(got[1].split(", ")) & set(texts[1].split(", "))
    assert got[2] == texts[2]
    ibans = re.findall(r"[A-Z]{2}\d{2}(?: ?\w{4})+(?: ?\d\d)?", got[3])
    assert len(ibans) == 3 and mod97(ibans[0].replace(" ", "")) == 1 == mod97(ibans[2]) and ibans[0].startswith("DE") and ibans[2].startswith("GB") and "3704" not in got[3]
    assert got[4].split(" and ")[0].lower() == got[4].split(" and ")[1]


def test_many_mentions_in_a_document(spark):
    text = " ".join(f"u{i % 700}@h{i % 700}.org" for i in range(6000))
    ((new, n),) = changed(spark, [text])
    table = dict(zip(text.split(), new.split()))
    assert n == 6000 and len(set(table.values())) == 700 and new.split() == [table[x] for x in text.split()]


def test_odd_rows(spark):
    rows = [(1, "Dr Aa"), (1, "Dr Aa"), (None, "Dr Aa"), (None, None), (2, ""), (3, "Dr Aa, Aa, and a@b.org")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("mine")).withColumn("e", F.lit(1))
    got = sorted(map(repr, map(tuple, pii.pseudonymise(d, "k").collect())))
    name = next(g for g in got if g.startswith("(1,"))[8:-5]
    mail = re.search(r"\S+@b?\S+", next(g for g in got if g.startswith("(3,")))[0]
    assert got == sorted(map(repr, [(1, f"Dr {name}", 1), (1, f"Dr {name}", 1), (None, f"Dr {name}", 1), (None, None, 0), (2, "", 0), (3, f"Dr {name}, {name}, and {mail[:-2]}", 2)]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_planted_people_do_not_leak(spark):
    """Each document of the tables gets a titled person and later mentions; none is left, and a person is one throughout."""
    names = ["Quorvath", "Zelmunda", "Ixthorpe", "Vandrell", "Okuvane"]
    titles = ["Dr.", "Herr Prof.", "Frau Dr.", "MR", "Mme", "Professor", "Sir", "Señora"]
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id").cast("int")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    first, last = pick(names, i), pick(names[::-1], i + 1)
    planted = d.withColumn("text", F.concat(pick(titles, i), F.lit(" "), first, F.lit(" "), last, F.lit(" wrote:\n"), "text", F.lit(" So "), last, F.lit(" said.")))
    got = pii.pseudonymise(planted, "k").collect()
    assert len(got) == d.count()
    assert not [r.doc_id for r in got if any(n.lower() in r.text.lower() for n in names)]
    ends = {r.doc_id: (r.text.split(" wrote:\n")[0].split(" ")[-1], r.text.rsplit(" So ", 1)[1][:-6]) for r in got}
    assert all(a == b for a, b in ends.values()) and len({a for a, _ in ends.values()}) == len(names)
