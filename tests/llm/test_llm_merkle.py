"""Merkle manifest against a plain tree: every size of tree, nulls, tampering, reopening."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clusterlens.llm import merkle
from clusterlens.llm.common import stage
from clusterlens.session import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(r, text):
    return _h("".join(_field(v) for v in (r[0], r[3], r[2], r[4], text)))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def _path(levels, at):
    """(left, right) siblings of leaf ``at``, level by level."""
    for nodes in levels[:-1]:
        begin = at - at % 3
        yield nodes[begin:at], nodes[at + 1:begin + 3]
        at //= 3


def _brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, _leaf(r, r[1]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(trees[s], key=lambda x: x[:3]) for s in names}
    lower = {s: _levels([x[2] for x in trees[s]]) for s in names}
    upper = _levels([lower[s][-1][0] for s in names])
    root = upper[-1][0]
    for k, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(trees[s]):
            steps = list(_path(lower[s], at)) + list(_path(upper, k))
            bare = r[1].replace("\n", "") if r[1] is not None else None
            node = _leaf(r, bare if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1])
            for left, right in steps:
                node = _h("".join([*left, node, *right]))
            proof = _h("".join(x for left, right in steps for x in left + right))
            yield (r[0], leaf, lower[s][-1][0], root, proof, node, node == root)


def _got(spark, tmp_path, rows, name="documents"):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return [tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()]


def _key(t):
    return tuple(str(x) for x in t)


def _rows(sizes, rnd):
    n = 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            text = rnd.choice([None, "", "-", "one line", f"line {n}\nnext\n", "é\nü" * rnd.randrange(4)])
            yield (n, text, rnd.choice([None, "en", "de"]), source, rnd.choice([None, 1, n]))


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 3, "b": 1, None: 2}, {"a": 81, "b": 82, "": 80, None: 4},
    {"hot": 260, "é": 5, "z": 1, "~": 2, "A": 30, **{f"s{i}": 1 for i in range(90)}}])
def test_equals_a_plain_tree(spark, tmp_path, sizes):
    rows = list(_rows(sizes, random.Random(sum(sizes.values()))))
    random.Random(1).shuffle(rows)
    assert sorted(_got(spark, tmp_path, rows), key=_key) == sorted(_brute(rows), key=_key)


def test_null_and_repeated_ids_and_rows(spark, tmp_path):
    rows = [(None, "a\nb", "en", "s", 1), (None, "a\nb", "en", "s", 1), (5, "x", None, "s", None)]
    rows += [(7, "same\ntext", "en", "s", 2)] * 100 + [(7, "other\ntext", "en", "s", 2)]
    assert sorted(_got(spark, tmp_path, rows), key=_key) == sorted(_brute(rows), key=_key)


def test_empty_table(spark, tmp_path):
    assert _got(spark, tmp_path, []) == []


def test_long_text_and_clashing_names(spark):
    text = "word\n" * 200_000
    docs = spark.createDataFrame([(4, text, "en", "s", len(text), "x", 1, "t")],
                                 SCHEMA + ", position string, n long, `a.b` string")
    row = merkle.document_leaves(docs).first()
    assert row.node == _leaf((4, text, "en", "s", len(text)), text)
    assert row.claimed is None or row.claimed != row.node


def test_manifest_is_stored_and_reopened(spark):
    rows = list(_rows({"a": 700, "b": 2}, random.Random(9)))
    leaves = stage(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)), "leaves")
    path = new_path(spark, "manifest")
    built = merkle.build(leaves, path, "source", [F.col("doc_id").asc(), F.col("node").asc()])
    again = merkle.Manifest(spark, path)
    want = list(_brute(rows))
    assert again.heights() == {"leaves": 2, "top": 1}
    assert again.root() == built.root() == want[0][3]
    assert {(r.tree, r.node) for r in again.roots().collect()} == {
        (rows[i][3], w[2]) for i, w in enumerate(sorted(want, key=lambda w: w[0]))}
    # levels between checkpoints are not stored: 700 leaves, then 9 nodes
    assert [again.checkpoint("leaves", k).agg(F.sum(F.size("members"))).first()[0] for k in (0, 1)] == [702, 10]
    # no stored subtree is larger than its span, and none is repeated
    sizes = again.checkpoint("leaves", 0).agg(F.max(F.size("members")), F.count_distinct("tree", "block"),
                                              F.count(F.lit(1))).first()
    assert sizes[0] == merkle.SPAN and sizes[1] == sizes[2]
    proofs = merkle.verified(again.proofs())
    tampered = proofs.where("claimed IS NOT NULL")
    assert tampered.count() > 100 and tampered.where("verified").count() == 0
    assert proofs.where("claimed IS NULL AND NOT verified").count() == 0


def test_fold_refuses_a_wrong_place(spark):
    rows = list(_rows({"a": 9}, random.Random(2)))
    leaves = stage(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)), "leaves")
    proofs = merkle.build(leaves, new_path(spark, "manifest"), "source", [F.col("doc_id").asc()]).proofs()
    moved = proofs.withColumn("position", (F.col("position") + 1) % 9)
    at = merkle.folded(F.col("node"), F.col("position"), F.col("proof"))
    assert proofs.select((at == F.col("subroot")).alias("ok")).where("ok").count() == 9
    assert moved.select((at == F.col("subroot")).alias("ok")).where("ok").count() == 0
