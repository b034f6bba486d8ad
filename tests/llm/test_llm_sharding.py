"""Rendezvous sharding: against a plain version, minimal moves, weights, slots, written shards."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from clusterlens.llm import sharding
from clusterlens.session import new_path

SCHEMA = "doc_id long, text string"


def _shard(key, weights):
    def score(s):
        bits = int(hashlib.md5(f"{'' if key is None else key}|{s}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2 ** 52) / weights[s], s
    return min(map(score, weights))[1]


def _shards(spark, keys, weights):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    return {r.k: r.s for r in df.select("k", sharding.shard_of(sharding.key_text(F.col("k")), weights).alias("s")).collect()}


def test_equals_a_plain_version(spark, tmp_path):
    rows = [(i, f"text {i % 5}" * (i % 7)) for i in range(600)]
    rows += [(None, None), (None, "é"), (-4, ""), (3, "again"), (3, "again"), (9, "x" * 300_000)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op13_sharding(spark, str(tmp_path)).collect()
    want, seen = [], {}
    for k, t in rows:
        body = (t or "").encode()
        want.append((k, len(body) + 8, zlib.crc32(body), "key", _shard(k, sharding.SHARDS), _shard(k, sharding.GROWN)))
    want.sort(key=lambda w: (w[4], w[0] is not None, w[0] or 0, w[1], w[2]))
    for i, w in enumerate(want):
        slot = seen[w[4]] = seen.get(w[4], -1) + 1
        want[i] = (*w[:5], slot, w[5])
    assert sorted(map(tuple, got), key=lambda w: (w[4], w[5])) == want


def test_a_further_shard_only_takes_and_a_dropped_one_only_gives(spark):
    keys = [str(i) for i in range(6000)]
    base = {s: 1.0 + s % 3 for s in range(10)}
    now = _shards(spark, keys, base)
    more = _shards(spark, keys, {**base, 17: 2.0})
    assert {more[k] for k in keys if more[k] != now[k]} == {17}
    share = sum(more[k] == 17 for k in keys) / len(keys)
    assert abs(share - 2 / (sum(base.values()) + 2)) < 0.02
    less = _shards(spark, keys, {s: w for s, w in base.items() if s != 4})
    assert all(less[k] == now[k] for k in keys if now[k] != 4)
    heavy = _shards(spark, keys, {**base, 2: 9.0})
    assert all(heavy[k] in (now[k], 2) for k in keys)


def test_shares_follow_the_weights(spark):
    weights = {0: 1.0, 1: 2.0, 2: 5.0}
    got = list(_shards(spark, [f"key{i}" for i in range(8000)], weights).values())
    for s, w in weights.items():
        assert abs(got.count(s) / 8000 - w / 8) < 0.02


def test_slots_of_a_repeated_key_are_cut_into_ranges(spark):
    rows = [(7, "hot")] * 900 + [(i, "t") for i in range(900)]
    out = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(6), {0: 1.0, 1: 1.0})
    for s, n in out.groupBy("shard").count().collect():
        assert sorted(r.slot for r in out.where(F.col("shard") == s).collect()) == list(range(n))
    sizes = {r.shard: (r.n_rows, r.bytes) for r in sharding.shard_sizes(out).collect()}
    assert sum(n for n, _ in sizes.values()) == 1800 and sum(b for _, b in sizes.values()) == 900 * (11 + 9)


def test_moves_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(500)], SCHEMA)
    out = sharding.assign(docs, {0: 1.0, 1: 1.0}, {0: 1.0, 1: 1.0, 2: 1.0})
    moved = sharding.moves(out).collect()
    assert {r.grown_shard for r in moved} == {2} and 100 < sum(r.n_rows for r in moved) < 230
    assert sharding.assign(docs.limit(0), {0: 1.0}).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.assign(docs, {0: 0.0})


def test_written_shards_keep_all_columns(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "x", "y") for i in range(300)], SCHEMA + ", `a.b` string, slot string")
    path = new_path(spark, "shards")
    weights = {0: 1.0, 5: 3.0}
    with pytest.raises(ValueError, match="column"):
        sharding.write_shards(docs, path, weights, column="Slot")
    sharding.write_shards(docs, path, weights)
    back = spark.read.parquet(path)
    assert back.columns == ["doc_id", "text", "a.b", "slot", "shard"]
    assert sorted((r[0], r[1], r[4]) for r in back.collect()) == [(i, f"t{i}", _shard(i, weights)) for i in range(300)]
