import random
from array import array

import pytest
import sentencepiece

from clusterlens.llm import pieces as sp


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.default_model())


def texts():
    rnd = random.Random(2)
    letters = "  ▁\n\tabcdeéß中文字😀.,!?0123456789<s></s>ABTheinstor"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(1500)] + [
        "", " ", "\n", "the " * 40_000, "q" * 3000]


def test_equals_the_library_and_restores_texts(library):
    own = sp.Pieces.load(sp.default_model())
    for t in texts():
        ids = list(array("i", own.encode(t)))
        assert ids == library.encode(t)
        if sp.MARK not in t:
            assert own.decode(ids) == t


def test_whole_documents(spark, library, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in sp.op8_pieces(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        assert got[r.doc_id].ids == library.encode(r.text)
        assert got[r.doc_id].restored and got[r.doc_id].n_ids == len(got[r.doc_id].ids)


def best_sum(pieces, word):
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        ways = [(best[s][0] + pieces[word[s:end]][1], s) for s in range(end) if s in best and word[s:end] in pieces]
        if ways:
            top = max(x for x, _ in ways)
            s = min(s for x, s in ways if x == top)
            best[end] = (top, [*best[s][1], pieces[word[s:end]][0]])
    return best[len(word)][1]


def test_unigram_equals_brute_force_viterbi():
    rnd = random.Random(7)
    strings = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(60)} | set("abc")
    pieces = {p: (i + 256, rnd.choice([-1.0, -2.5, -4.0, -7.0]) - len(p) / 8) for i, p in enumerate(sorted(strings))}
    own = sp.Pieces(pieces, {b: b for b in range(256)}, "unigram")
    for _ in range(800):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 25)))
        assert own._ids(word) == best_sum(pieces, word)


def test_bpe_equals_merging():
    rnd = random.Random(9)
    strings = set("abc") | {"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 7))) for _ in range(40)}
    pieces = {p: (i + 256, -float(k)) for i, (p, k) in enumerate(zip(sorted(strings), rnd.sample(range(99), len(strings)), strict=True))}
    own = sp.Pieces(pieces, {b: b for b in range(256)}, "bpe")
    for _ in range(800):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 25)))
        assert own._ids(word) == [pieces[p][0] for p in own._merged(word)]


def test_nulls_repeats_empty_table_and_bad_bytes(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    out = docs.withColumn("ids", sp.encoded("text")).withColumn("back", sp.decoded("ids")).collect()
    assert sorted((str(r.doc_id), r.text, r.back) for r in out if r.text is not None) == [("1", "a b", "a b")] * 2 + [("None", "", "")]
    assert [(r.ids, r.back) for r in out if r.text is None] == [(None, None)]
    table = sp.encode_table(docs.withColumn("ids", sp.F.lit("x")).withColumn("n_ids", sp.F.lit(1))).collect()
    assert sorted(str(tuple(r)) for r in table) == sorted(str(x) for x in [
        (1, [264, 287], 2, True), (1, [264, 287], 2, True), (2, None, None, None), (None, [], 0, True)])
    assert sp.encode_table(docs.limit(0)).count() == 0
    assert docs.limit(0).withColumn("ids", sp.encoded("text")).count() == 0
    assert sp.Pieces.load(sp.default_model()).decode([3 + 0xFF]) == "�"
    with pytest.raises(ValueError):
        sp.Pieces({}, {}, "words")
