"""Packing by power-of-two decomposition (operator 7).

A document's token ids, with the end id, are cut into as many pieces of the
full sequence length as fit, and the rest into pieces whose lengths are the
powers of two of its binary form, longest first. Every piece is a sequence of
its own: none crosses documents, and none needs padding, because all lengths
are powers of two. Pieces of equal length form a bucket.

Tokenising and cutting need one document at a time, so nothing is shuffled.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.session import ship_package

MAX_LENGTH = 2048
END_ID = 1
#: Bytes of text split into words at once, and words kept by a worker.
SEGMENT, HELD = 1 << 20, 600_000
#: Fixed value: the pattern by which the default tokenizer splits a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that need no normalising but lower case: Latin letters, then punctuation.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153]*)([.,!?;:]*)")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbol(b: int) -> str:
    """The character that byte-level vocabularies write for a byte: itself where
    it is printable, else the next free one from U+0100 on."""
    def printable(x: int) -> bool:
        return 33 <= x <= 126 or 161 <= x <= 255 and x != 173
    return chr(b) if printable(b) else chr(256 + sum(not printable(x) for x in range(b)))


def _splits_words(spec: dict) -> bool:
    """Whether a tokenizer file normalises and splits in the way that remembered words need.

    Lower case, and white space dropped; letters, single digits and other marks apart,
    each merged by itself as bytes; special tokens that begin with ``<|``.
    """
    def kinds(part: dict | None, inner: str) -> list[dict]:
        return (part or {}).get(inner) or ([part] if part else [])

    normal = [(x["type"], x.get("pattern"), x.get("content")) for x in kinds(spec["normalizer"], "normalizers")]
    split = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"),
              x.get("use_regex")) for x in kinds(spec["pre_tokenizer"], "pretokenizers")]
    model = spec["model"]
    return (normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and split == [("Split", {"Regex": WORD_PATTERN}, "Removed", True, None, None),
                          ("ByteLevel", None, None, None, False, False)]
            and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix"))
            and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback",
                                               "ignore_merges"))
            and all(x["content"].startswith("<|") for x in spec["added_tokens"]))


class WordTokens:
    """Token ids of texts through a tokenizer file, by remembered words.

    A file of which what follows may not hold (see ``_splits_words``) is applied
    to whole texts instead. The tokenizer never joins characters over white space and drops it, so a
    text's ids are the ids of its words in a row. Words are cut at ASCII white
    space only; the tokenizer itself sees to any other. It also never joins
    letters with punctuation, so a word of Latin letters with punctuation
    behind it goes to the library's merge model in these two parts; any other
    word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _splits_words(spec)
        if not self.by_word:
            return
        model = spec["model"]
        self.merges = BPE(vocab=model["vocab"], cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"],
                          merges=[tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.symbols = {c: "".join(map(byte_symbol, chr(c).encode()))
                        for c in (*range(0xC0, 0x100), 0x152, 0x153)}
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if not plain:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        letters, marks = plain.groups()
        if not letters.isascii():
            letters = letters.lower().translate(self.symbols)
        elif not letters.islower():
            letters = letters.lower()
        found = self.merges.tokenize(letters)
        if marks:
            found += self.merges.tokenize(marks)
        return array("I", [t.id for t in found]).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; the less lately used half of the memory goes when it is full."""
        if 2 * len(self.known) > HELD:
            self.known, self.older = {"": b""}, self.known
        for w in words:
            if w not in self.known:
                self.known[w] = self.older.get(w) or self._ids(w)
        return [self.known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and for each text where its own end; null counts as empty."""
        # a copy, since kernels misread a cast slice whose first offset isn't 0
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "")
        if not self.by_word:
            found = [x.ids for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), "<u4"), np.cumsum([len(x) for x in found], dtype=np.int64)
        # lower-casing early makes fewer words, but must not make special tokens
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        found = self._words(words.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in found], np.int64)
        flat = np.frombuffer(b"".join(found), "<u4")
        start = np.cumsum(size) - size
        ends = np.concatenate(([0], np.cumsum(size[at])))
        ids = flat[np.repeat(start[at] - ends[:-1], size[at]) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy()
        return ids, ends[offsets[1:] - offsets[0]]


@lru_cache(maxsize=2)
def _worker_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _segments(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in slices of about SEGMENT bytes, with their places."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + SEGMENT, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def cuts(n: int, longest: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; ``longest`` is a power of two."""
    out, at = [], 0
    while at < n:
        size = min(longest, 1 << ((n - at).bit_length() - 1))
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = True, text: str = "text",
         doc_id: str = "doc_id", longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start (ids of the document before it),
    length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    doc_tokens, sequence_id, offset (always 0), and with ``with_ids`` ids.

    A null or empty text has the end id alone. Rows that repeat a doc_id are
    documents of their own, a null doc_id stays null, other columns are not
    read, and an empty table gives no rows. Texts of any length are cut whole.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    ship_package(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(path)
        for batch in batches:
            for at, texts in _segments(batch.column("text")):
                ids, ends = tokens.encode(texts)
                ids = np.insert(ids, ends, np.uint32(end_id))  # behind each document's own
                ends = ends + np.arange(1, len(ends) + 1)
                rows, data, begin = [], ids.tobytes(), 0
                for doc, end in enumerate(ends.tolist()):
                    rows += [(at + doc, start, size, zlib.crc32(data[4 * (begin + start):4 * (begin + start + size)]),
                              end - begin) for start, size in cuts(end - begin, longest)]
                    begin = end
                made = np.array(rows, np.int64).reshape(-1, 5).T
                out = [batch.column("doc_id").take(pa.array(made[0])), *map(pa.array, made[1:])]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(made[2])), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, columns + ["ids"] * with_ids)
            pa.default_memory_pool().release_unused()  # else the worker, which lives on, keeps it

    schema = ", ".join(f"{c} long" for c in columns) + ", ids array<int>" * with_ids
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, schema)
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces with their ids as Parquet, one folder for each length."""
    pieces.write.partitionBy("length").parquet(path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
