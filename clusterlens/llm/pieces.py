"""SentencePiece encoding and decoding (operator 8).

One automaton (Aho-Corasick) holds all pieces. A word goes through it once; at
every position the output links list the pieces that end there, and each of
them relaxes the best way to reach the position.

What "best" means is the model's own rule:

- ``unigram``: the greatest sum of piece scores (Viterbi), ties to the longer
  last piece;
- ``bpe``: the way that merging by score would take. Sums of scores don't give
  that, so here a piece relaxes a position only if merging it with the last
  piece of the way it continues would leave these two as they are. At most one
  piece can, and the scores count through the order of merges.

Characters outside the vocabulary become byte pieces. White space is marked as
the model marks it, and no piece goes on from a character over a mark, so
words are encoded by themselves and remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.session import ship_package

MARK = "▁"
HELD = 800_000
NEVER = 1 << 62
#: Documents encoded at once.
SLICE = 256


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Encoder and decoder over pieces: text to (id, score), byte to id."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int], kind: str):
        if kind not in ("bpe", "unigram"):
            raise ValueError("kind must be bpe or unigram")
        self.kind, self.byte_ids = kind, byte_ids
        self.raw = {i: bytes([b]) for b, i in byte_ids.items()} | {i: p.encode() for p, (i, _) in pieces.items()}
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.id = {p: i for p, (i, _) in pieces.items()}
        # single characters NEVER merge; other pieces merge in the order of falling scores
        order = sorted((p for p in pieces if len(p) > 1), key=lambda p: -self.score[p])
        self.when = {p: k + 1 for k, p in enumerate(order)}
        usable = list(pieces)
        if kind == "bpe":
            usable = [p for p in pieces if len(p) == 1 or self._merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces that go on over white space are not supported")
        inside = {p[k:k + 2] for p in pieces for k in range(len(p) - 1)}
        apart = "".join(c for c in ".,!?;:" if all(x[1] != c or not x[0].isalpha() for x in inside))
        # where no piece goes on from a letter to a mark of punctuation, a word of letters ends there too
        self.words = re.compile((f" *[^\\W\\d_]+(?=[{apart}])|" if apart else "") + " *[^ \n]+| +|\n")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seams: dict[tuple[str, str], bool] = {}

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Pieces:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, byte_ids = {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain[sp.id_to_piece(i)] = (i, sp.get_score(i))
        return cls(plain, byte_ids, kind)

    def _merged(self, word: str) -> list[str]:
        """Merging by score, one pair at a time, of equal pairs the left one first."""
        parts, when = list(word), self.when
        times = [when.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while times and (first := min(times)) < NEVER:
            k = times.index(first)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del times[k]
            if k < len(times):
                times[k] = when.get(parts[k] + parts[k + 1], NEVER)
            if k:
                times[k - 1] = when.get(parts[k - 1] + parts[k], NEVER)
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` leaves these two pieces."""
        return self._merged(left + right) == [left, right]

    def _run(self, word: str) -> list[int]:
        """Ids of a word whose characters are all covered."""
        n = len(word)
        back: list[str] = [""] * (n + 1)
        if self.kind == "unigram":
            best = [0.0] + [float("-inf")] * n
            for end, piece in self.automaton.iter(word):  # longer pieces of one end come first
                sum_ = best[end + 1 - len(piece)] + self.score[piece]
                if sum_ > best[end + 1]:
                    best[end + 1], back[end + 1] = sum_, piece
        else:
            seams, follows = self.seams, self.follows
            for end, piece in self.automaton.iter(word):
                if back[end + 1]:
                    continue
                start = end + 1 - len(piece)
                if start:
                    before = back[start]
                    if not before:
                        continue
                    good = seams.get((before, piece))
                    if good is None:
                        good = seams[before, piece] = follows(before, piece)
                    if not good:
                        continue
                back[end + 1] = piece
        out = []
        while n:
            out.append(self.id[back[n]])
            n -= len(back[n])
        return out[::-1]

    def _ids(self, word: str) -> list[int]:
        word = word.replace(" ", MARK)
        if self.id.keys() >= set(word):
            return self._run(word)
        ids, run = [], ""
        for c in word:
            if c in self.id:
                run += c
                continue
            ids += self._run(run)
            run = ""
            ids += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
        return ids + self._run(run)

    def _learned(self, word: str) -> bytes:
        if 2 * len(self.known) > HELD:  # the half that wasn't used lately goes
            self.known, self.older = {}, self.known
        if len(self.seams) > HELD:
            self.seams.clear()
        out = self.known[word] = self.older.get(word) or array("i", self._ids(word)).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as 32-bit integers; nothing for an empty text."""
        if not text:
            return b""
        words = self.words.findall(" " + text.replace(MARK, " "))
        return b"".join([self.known.get(w) or self._learned(w) for w in words])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no character become replacement characters."""
        out = b"".join(map(self.raw.__getitem__, ids))
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _worker_pieces(path: str, kind: str) -> Pieces:
    return Pieces.load(path, kind)


def encoded(text: str | Column = "text", model: str | None = None, kind: str = "bpe") -> Column:
    """array<int>: the ids of the whole text; null for null, empty for empty."""
    path = model or default_model()

    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _worker_pieces(path, kind)
        for texts in batches:
            yield pd.Series([None if t is None else np.frombuffer(pieces.encode(t), np.int32) for t in texts],
                            dtype=object)

    return run(text)


def decoded(ids: str | Column, model: str | None = None, kind: str = "bpe") -> Column:
    """string: the text of an array of ids; null for null. Text that holds the
    white space mark itself comes back with blanks in its place."""
    path = model or default_model()

    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _worker_pieces(path, kind)
        for lists in batches:
            yield pd.Series([None if x is None else pieces.decode(x.tolist()) for x in lists], dtype=object)

    return run(ids)


def encode_table(docs: DataFrame, model: str | None = None, kind: str = "bpe", text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids, n_ids, restored (whether decoding gives the text back): one row
    for each row of ``docs``, made a slice of documents at a time.

    A null text has null in all three, an empty text no ids. Other columns are
    not read, rows that repeat are rows of their own, and an empty table gives
    no rows.
    """
    ship_package(docs.sparkSession)
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker_pieces(path, kind)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column("text").to_pylist()
                found = [None if t is None else pieces.encode(t) for t in texts]
                ids = [None if x is None else np.frombuffer(x, np.int32) for x in found]
                back = [None if x is None else pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(back, pa.bool_())],
                    ["doc_id", "ids", "n_ids", "restored"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id long, ids array<int>, n_ids long, restored boolean"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
