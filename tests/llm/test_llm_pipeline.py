"""The pipeline against brute-force stages, and the registered queries against their SQL."""

import os
import re

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from clusterlens.llm import packing, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_stages_in_order_against_brute_force(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "secrets", "pack"]
    extra = [(10_001, None), (10_002, "12345 !!!"), (10_003, "password=abcdef123456 the and of"), (10_003, "password=abcdef123456 the and of")]
    real = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in extra], real.schema)
    docs, out = real.union(more), []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.collect())
        if k < 4:
            assert docs.columns == real.columns
    start = real.union(more).collect()
    letters = [r for r in start if r.text and any(map(str.isalpha, r.text))]
    assert {r.doc_id for r in letters} - {r.doc_id for r in out[0]} <= {10_003}

    best = {}
    for r in out[0]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in out[1]) == sorted(d for _, d in best.values())

    sets = {r.doc_id: shingles(r.text) for r in out[1]}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 100 >= 80 * max(1, len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert sorted(r.doc_id for r in out[2]) == sorted({root(d) for d in sets})

    assert sorted(r.doc_id for r in out[3]) == sorted(r.doc_id for r in out[2])
    before = {r.doc_id: r.text for r in out[2]}
    for r in out[3]:
        assert r.n_chars == len(r.text)
        assert not re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text)
        if r.text != before[r.doc_id]:
            assert "[SECRET]" in r.text

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = {}
    for r in sorted(out[4], key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, []) + r.ids
    assert got == {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [1] for r in out[3]}


def test_empty_table_goes_through(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(
        map(str, want[columns].itertuples(index=False, name=None)))


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert "pipeline" in names
