import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from clusterlens.llm import packing as pk

SCHEMA = "doc_id long, text string, ids string, length string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(pk.default_tokenizer())


def texts():
    rnd = random.Random(4)
    letters = "aZé ÉßİΣς\x1c\x85\xa0　\n\t'sST12.,!?中文ﬁ𝒳​- ÷×ŒœÿŸ\x0b"
    odd = ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "n't", "word.", "Été,", "...", "Straße"]
    out = ["".join(rnd.choice(odd) if rnd.random() < 0.1 else rnd.choice(letters) for _ in range(rnd.randrange(30)))
           for _ in range(400)]
    return out + ["word other " * 3000, "x" * 5000, "", " "]


def test_pieces_hold_each_document_once(spark, tokenizer):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(9000, None, "x", "y")]
    got = {}
    for r in pk.pack(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r)
    sequences = [r.sequence_id for p in got.values() for r in p]
    assert len(set(sequences)) == len(sequences)
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(got[i], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == ids
        at = 0
        for r in pieces:
            assert (r.start, r.length, r.doc_tokens, r.offset) == (at, len(r.ids), len(ids), 0)
            assert r.length <= 2048 and r.length & (r.length - 1) == 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length


def test_digest_form_has_the_same_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts()[:50])], SCHEMA)
    whole, narrow = pk.pack(docs), pk.pack(docs, with_ids=False)
    assert set(whole.columns) - set(narrow.columns) == {"ids"}
    assert sorted(map(str, whole.select(narrow.columns).collect())) == sorted(map(str, narrow.collect()))


def test_many_segments_of_one_batch(spark, tokenizer, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(pk, "SEGMENT", 300)
    batch, tokens, seen = pa.array([*texts(), None]), pk.WordTokens(pk.default_tokenizer()), []
    for at, part in pk._segments(batch):
        assert at == len(seen)
        ids, ends = tokens.encode(part)
        seen += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert seen == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in batch.to_pylist()]


def test_cuts():
    assert pk.cuts(5000) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 256), (4864, 128), (4992, 8)]
    for n in range(0, 70):
        assert sum(size for _, size in pk.cuts(n, 16)) == n
    with pytest.raises(ValueError):
        pk.pack(None, longest=100)


def test_small_memory_gives_the_same(tokenizer, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(pk, "HELD", 8)
    tokens = pk.WordTokens(pk.default_tokenizer())
    for t in texts()[:60]:
        ids, ends = tokens.encode(pa.array([t, None]))
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert ends.tolist() == [len(ids)] * 2


def test_empty_table_repeats_and_buckets(spark, tmp_path):
    assert pk.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "", ""), (1, "a b c", "", ""), (None, "d", "", "")], SCHEMA)
    pk.write_buckets(pk.pack(docs), f"{tmp_path}/b")
    got = spark.read.parquet(f"{tmp_path}/b")
    assert sorted((str(r.doc_id), r.start, r.length) for r in got.collect()) == [("1", 0, 4), ("1", 0, 4), ("None", 0, 2)]


def test_other_tokenizer_files_are_applied_to_whole_texts(spark, tmp_path):
    import json

    import public_tokenizers
    other = public_tokenizers.path("byte_bpe_50k.json")
    with open(pk.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    assert pk._splits_words(spec)
    spec["normalizer"] = None
    cased = str(tmp_path / "cased.json")
    with open(cased, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    rows = [(i, t) for i, t in enumerate(texts())]
    for path in (other, cased):
        tokenizer = Tokenizer.from_file(path)
        got = {}
        for r in pk.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=path).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, t in rows:
            ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
            assert [x for r in sorted(got[i], key=lambda r: r.start) for x in r.ids] == ids


def test_texts_are_split_a_megabyte_at_a_time():
    import pyarrow as pa
    batch = pa.array(["word " * 2000] * 500)  # 5 MB
    sizes = [len(part) for _, part in pk._segments(batch)]
    assert sum(sizes) == 500 and len(sizes) >= 5
