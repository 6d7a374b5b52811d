"""Registered queries: SQL where there is some, shapes of the contracts, the pipeline against plain Python."""

import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Row

import corpus_pipeline
from lexigauge.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
COLUMNS = {
    1: {"page_id", "url", "text", "n_chars"}, 2: {"doc_id", "held_out", "lang_pred", "score"}, 4: {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    5: {"doc_id", "held_out", "score", "predicted"}, 11: {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    12: {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}, 13: {"doc_id", "n_bytes", "n_tokens", "over_limit"}, 9: {"doc_id", "n_shingles", "component_id", "kept"}, 10: {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
}


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = int(name[2:].split("_")[0])
    assert COLUMNS.get(n, set()) <= set(df.columns)
    got = df.toPandas()
    if n == 12:
        assert len(got) == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    elif n != 11:
        assert len(got) == spark.read.parquet(f"{SF}/{'pages' if n == 1 else 'documents'}.parquet").count()
    if name in queries.SQL:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.execute(queries.SQL[name])
        cols = [c[0] for c in want.description]
        assert sorted(map(repr, df.select(*cols).collect())) == sorted(repr(Row(**dict(zip(cols, r)))) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op3_pii_surrogates", "op7_decontam", "op10_exact_dedup"])
def test_native(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[4] == ids[5]
    low = lambda i: text[i].translate({c: c + 32 for c in range(65, 91)})
    last = {}
    for i in ids[1]:
        last[low(i)] = max(i, last.get(low(i), i))
    assert ids[2] == set(last.values())
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i in ids[2] if (w := low(i).split()) is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert ids[3] == {i for i in sets if top(i) == i}
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[4] == {i for i in ids[3] if not any(x in flat(text[i]) for x in items)}
    assert all(r.round_trip for r in seen[5].collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids[5]
