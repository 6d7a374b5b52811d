"""Every registered query against its SQL on the smallest tables, and plans without Python or products."""

import os
import re
from pathlib import Path

import duckdb
import pytest

from lexigauge.functions import assign
from lexigauge.plans import catalog, distributed, evaluations, files  # noqa: F401  they register queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
WITH_PYTHON = {"response_parse", "nested_quotes", "typo_pairs", "gned", "seqmatch_best", "list_literals", "prompt_targets", "gned_three", "typo_of_word", "closest_of_list", "nearest_words", "placed_regions", "workbook_table", "workbook_best", "loaded_table_text", "loaded_regions", "loaded_instructions", "scored_samples", "classified_tokens"}
ONE_ROW_PRODUCTS = {"grpo_advantage_global_std", "ungrouped_advantage", "largest_remainder"}


def rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.toPandas()
    assert len(got)
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name in WITH_PYTHON or "Python" not in plan
    assert name in ONE_ROW_PRODUCTS or "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("weighted_rollup", {"l_quantity", "l_discount", "l_returnflag", "l_linestatus"}),
        ("tag_means", {"lang", "n_chars"}),
        ("zero_std_ratio", {"l_orderkey", "l_discount"}),
        ("sad_confusion", {"doc_id", "text"}),
    ],
)
def test_scans_read_what_is_used(spark, name, columns):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = {c.split(":")[0] for part in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in part.split(",")}
    assert read == columns


def test_filters_reach_the_scan(spark):
    plan = catalog._turns(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in plan and "EqualTo(role,assistant)" in plan


def test_anomaly_report_reads_whole_texts(spark, tmp_path):
    rows = [(1, " ".join(f"w{i}" for i in range(40)), "en"), (2, " ".join(f"w{i}" for i in range(9)) + " la#st", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = catalog.QUERIES["anomaly_report"](spark, str(tmp_path)).collect()
    assert r.tokens == 50


def test_anomaly_report_by_hand(spark):
    """Every token of whole texts, against plain loops."""
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect():
        if r.text is None:
            continue
        pred, gt = ([w for w in t.split(" ") if "#" not in w] for t in (r.text, r.text.replace("#", "")))
        n = want.setdefault(r.lang, [0, 0, 0.0])
        n[0] += sum(t in pred for t in gt)
        n[1] += len(gt)
        n[2] += sum(min((assign.ned(p, t) for p in set(pred)), default=1.0) for t in gt if t not in pred)
    got = {r.lang: [r.hits, r.tokens, r.edit] for r in catalog.QUERIES["anomaly_report"](spark, SF).collect()}
    assert got == {k: [a, b, pytest.approx(c, abs=1e-5)] for k, (a, b, c) in want.items() if b}


def test_turns_are_whole(spark, duck):
    """No pair is left out, whatever its letters."""
    pairs = duck.execute("SELECT count(*) FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'").fetchone()[0]
    assert catalog.QUERIES["bag_overlap"](spark, SF).count() == pairs
