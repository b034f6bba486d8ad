import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clusterlens.llm import near_dedup as nd
from clusterlens.llm.common import stage
from clusterlens.llm.components import components
from clusterlens.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, node string, kept int"


def sets(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    n = min(words, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, words, percent=80):
    s = [sets(r[1], words) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((str(r[0]), len(s[i]), str(least), r[0] == least))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "the", "THE", "é"]
    texts = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 40, 120]))]
        for _ in range(rnd.choice([1, 2, 9])):
            copy = [rnd.choice(vocabulary) if rnd.random() < rnd.choice([0, 0.03, 0.08]) else x for x in base]
            texts.append(rnd.choice([" ", "\t", " \n "]).join(copy))
    texts += [None, "", " \n ", "one", "One", "ONE two", "one TWO", "x y", "x Y"]
    rnd.shuffle(texts)
    return [(i, t, "extra", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,words", [(1, 2), (2, 5)])
def test_equals_brute_force(spark, seed, words):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = nd.near_duplicates(docs, words)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == brute(rows, words)
    kept = nd.keep_rows(docs, got)
    assert kept.columns == docs.columns
    assert kept.count() == sum(x[3] for x in brute(rows, words))


def test_large_group_of_unlinked_and_linked_copies(spark, monkeypatch):
    """One bucket with many members, cut into blocks, in which most pairs miss the threshold."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    rnd = random.Random(5)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(90):
        copy = list(base)
        for k in rnd.sample(range(150), rnd.choice([1, 4, 9, 12])):
            copy[k] = f"n{i}_{k}"
        rows.append((i, " ".join(copy), "", 0))
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == brute(rows, 2)


def test_unlike_members_of_a_bucket_send_no_full_set(spark, monkeypatch):
    """A bucket of unlike members is compared by signatures; sets are fetched for the one pair that is alike."""
    n, asked = 4000, []
    rnd = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 10**6, 12)) for _ in range(n)]
    texts[9] = texts[8] + " " + texts[8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = stage(nd.features(docs, 2).selectExpr("node", "sig", "doc_id AS least"), "nodes")
    members = nodes.selectExpr("0 AS band", "7L AS key", "node", "node AS component", "node AS main", "1L AS inside",
                               f"{n - 1}L AS apart").withColumn("main", F.first("node").over(Window.partitionBy(F.lit(1))))
    fetched = nd._texts

    def counted(wanted, *rest):
        asked.append(wanted.distinct().count())
        return fetched(wanted, *rest)

    monkeypatch.setattr(nd, "_texts", counted)
    links = nd._across(members, nodes, docs, 2, 80).collect()
    ids = {bytes(r.node): r.least for r in nodes.collect()}
    assert [sorted((ids[bytes(r.a)], ids[bytes(r.b)])) for r in links] == [[8, 9]]
    assert asked == [2]


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c d e f g", "", 0), (1, "a b c d e f g", "", 0), (1, "other text here", "", 0),
            (None, "A b c d e f g", "", 0), (None, "zz yy", "", 0), (None, "zz  yy", "", 0), (7, "OTHER text here", "", 0)]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got.collect()) == sorted([
        ("1", "1", True), ("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "None", True),
        ("None", "None", True), ("7", "1", False)])
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA), 2).count() == 0
    long = "word " * 300_000 + "end"
    assert len(shingle_set(long, 2)) == 2


def test_posterior_bounds_prune_far_pairs_only():
    bounds = nd.posterior_bounds(0.8, 160)
    assert [n for n, _ in bounds] == [32, 64, 96, 128, 160]
    assert all(0 < m < 0.8 * n for n, m in bounds)
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 1 << 30, (4000, 160))
    near, far = a.copy(), a.copy()
    near[rnd.random(a.shape) > 0.82] = -1
    far[rnd.random(a.shape) > 0.4] = -1
    assert len(nd._survive(a, near, bounds)) == 4000
    assert len(nd._survive(a, far, bounds)) == 0


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {x: got.get(x, x) for x in linked} == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_stays_of_near_copies_that_repeat_or_lack_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a", 1), (5, text + " x", "b", 2), (None, text + " y", "c", 3), (None, text, "d", 4),
            (None, "other words stand here alone", "e", 5), (None, None, "f", 6), (9, "", "g", 7)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, component_id long"), "docs")
    got = nd.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r["component_id"] for r in got.collect()) in ([1, 5, 6, 7], [2, 5, 6, 7])
    assert nd.keep_one(docs.limit(0)).count() == 0


def test_hot_key_is_not_shuffled(spark):
    """A third of all rows on one key: its rows meet their least by a broadcast, the others by a join."""
    from clusterlens.llm.components import with_least
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, -1, id) AS u", "id AS v", "id AS extra")
    out = with_least(rows, "u", "v", 9000)
    assert sorted(map(tuple, out.collect())) == sorted((-1, i, i, 0) if i % 3 == 0 else (i, i, i, i) for i in range(9000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert with_least(rows.limit(0), "u", "v", 0).count() == 0


def test_hub_of_links(spark):
    from clusterlens.llm.components import components
    links = spark.range(5000).selectExpr("5000L AS a", "id AS b")
    got = components(links)
    assert got.where("component = 0").count() == got.count() == 5000
