import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlens.llm import resampling as rs

SCHEMA = "doc_id long, text string, score string, rank string"


def corpus():
    good = [(i, "calm river stones under the bridge " * (1 + i % 5), "s", "r") for i in range(60)]
    bad = [(100 + i, "BUY NOW !!! $$$ click " * (1 + i % 7), "s", "r") for i in range(60)]
    return good + bad + [(500, None, "s", "r"), (501, "", "s", "r"), (502, " \n", "s", "r"), (None, "river stones", "s", "r")]


def test_model_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    target = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(9999,), (None,), (0,)], "doc_id long")
    got = rs.fit(docs, target)
    raw = sum(rs.ngram_counts(t) for _, t, *_ in rows)
    good = sum(rs.ngram_counts(t) for i, t, *_ in rows if i is not None and i < 60 and i % 2 == 0)
    assert np.allclose(got, rs.log_ratios(good, raw))


def test_sample_prefers_target_like_text(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    target = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    out = rs.resample(docs, target, share=0.5).collect()
    assert len(out) == 124
    kept = {r.doc_id for r in out if r.kept}
    assert len(kept) == math.ceil(0.5 * 121)
    assert kept <= {*range(60), None}
    ranked = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 122))
    assert all(a.score >= b.score for a, b in zip(ranked, ranked[1:], strict=False))
    assert {r.doc_id for r in out if r["rank"] is None} == {500, 501, 502}


def test_gumbel_top_one_draws_in_proportion(spark):
    noise = spark.range(40_000).select(*[(rs.gumbel(F.col("id"), F.lit(k)) + math.log(w)).alias(f"g{k}")
                                         for k, w in enumerate([1, 2, 5])])
    won = noise.select((F.col("g2") > F.greatest("g0", "g1")).cast("int").alias("w")).agg(F.avg("w")).first()[0]
    assert won == pytest.approx(5 / 8, abs=0.02)


def test_no_target_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")] * 4 + [(2, "word " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    out = rs.resample(docs, none, share=0.6).collect()
    assert sum(r.kept for r in out) == 3
    assert sorted(r["rank"] for r in out) == [1, 2, 3, 4, 5]
    assert rs.resample(docs.limit(0), none).count() == 0


def test_repeated_ids_draw_noise_of_their_own(spark):
    docs = spark.createDataFrame([(7, "a b c")] * 6 + [(8, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    out = rs.resample(docs, none, share=0.5).collect()
    assert len({r.score for r in out}) == 7
    alone = rs.resample(docs.where("doc_id = 8"), none).first()
    assert alone.score - alone.log_weight == pytest.approx(next(r.score - r.log_weight for r in out if r.doc_id == 8))
