"""Language identification (operator 5).

Multinomial logistic regression on TF-IDF values of hashed character n-grams
(one to three letters or blanks of the lower-cased text), fitted by
follow-the-regularised-leader with elastic-net penalties, which leaves most
weights at zero, and calibrated by a temperature on rows the fit has not seen.

Document frequencies are counted over every document that may be learned from.
The weights are fitted on a bounded sample of them: about ``PER_LANG``
different texts of each language, chosen by a hash of the text, so that a text
counts once however many rows hold it. The sample is fitted in one task, and
its size does not depend on that of the corpus, but like the dense weights it
grows with the number of different languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import free_name
from clusterlens.session import ship_package

BUCKETS = 1 << 15
#: Bound of the fitted sample: different texts expected from each language.
PER_LANG = 1500
EPOCHS = 3
UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+")


@dataclass
class Model:
    """languages in the order of the columns of ``weights`` (BUCKETS + 1 rows, the
    last one the intercept); idf by bucket; temperature."""
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def learnable(doc_id: str = "doc_id") -> Column:
    """True for documents outside the held-out quarter; a null doc_id is held in."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(True))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the whole text, and how often each occurs.

    Letters count, in lower case; whatever lies between two words (digits,
    marks, white space) is one blank, so numbers don't speak for a language.
    """
    c = np.frombuffer(_GAP.sub(" ", f" {text.lower()} ").encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    ids = np.concatenate((one, two + np.uint32(1), three + np.uint32(2)))
    ids = (ids ^ (ids >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = np.bincount(ids >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _values(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF values, TF being 1 + log of the count."""
    v = (1.0 + np.log(counts)) * idf[at]
    return v / np.sqrt((v * v).sum())


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """bucket, df: how many of the texts hold an n-gram of the bucket, and at
    bucket -1 the number of texts; null and empty texts don't count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    df[ngrams(t)[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(df[at], n)})

    return (docs.select(F.col(text).alias("text")).mapInPandas(run, "bucket long, df long")
            .groupBy("bucket").agg(F.sum("df").alias("df")))


def _proximal(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


class Rows(Sequence):
    """(positions, values) of the given texts with the intercept behind, made from the counts when
    asked for: kept for all texts they take twice the memory of the counts."""

    def __init__(self, at: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray):
        self.at, self.counts, self.idf = at, counts, idf

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a = self.at[k]
        return np.append(a, BUCKETS), np.append(_values(a, self.counts[k], self.idf), 1.0)


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.5,
        beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal, one pass over (positions, values) rows for each epoch."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, v = rows[k]
            w = _proximal(z[at], n[at], alpha, beta, l1, l2)
            p = _softmax(v @ w)
            p[labels[k]] -= 1.0
            g = v[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return _proximal(z, n, alpha, beta, l1, l2)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden section on its
    logarithm within 0.05 and 20; 1 without rows. One row's worth of the loss
    is spread evenly over the classes, so that rows without any error don't
    ask for certainty."""
    if not len(scores):
        return 1.0
    even = 1.0 / (len(scores) + 1)

    def loss(log_t: float) -> float:
        p = np.log(np.maximum(_softmax(scores / np.exp(log_t)), 1e-12))
        return -((1 - even) * p[np.arange(len(labels)), labels] + even * p.mean(axis=1)).mean()

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          per_lang: int = PER_LANG) -> Model | None:
    """The model of the learnable documents (those with text and lang, outside
    the held-out quarter); None without any."""
    ship_package(docs.sparkSession)
    known = (docs.where(learnable(doc_id) & F.col(lang).isNotNull() & (F.char_length(text) > 0))
             .select(F.col(text).alias("text"), F.col(lang).alias("lang")))
    sizes = {r["lang"]: r["n"] for r in known.select("lang", F.xxhash64("text").alias("mark")).distinct()
             .groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    df = {r["bucket"]: r["df"] for r in frequencies(known).collect()}
    total = df.pop(-1)
    idf = np.full(BUCKETS, 1.0 + np.log(1.0 + total))
    idf[list(df)] = 1.0 + np.log((1.0 + total) / (1.0 + np.array(list(df.values()))))

    share = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    bound = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_lang / sizes[k]))])
    sample = known.where(share < bound[F.col("lang")]).distinct().withColumn("mark", F.xxhash64("text"))

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grams = [ngrams(t) for t in pdf["text"]]
            yield pd.DataFrame({"one": 1, "mark": pdf["mark"], "lang": pdf["lang"],
                                "at": [a.astype(np.int32) for a, _ in grams],
                                "counts": [c.astype(np.int32) for _, c in grams]})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mark", "lang"], kind="stable")
        labels = np.searchsorted(languages, pdf["lang"].to_numpy(str))
        checked = np.arange(len(pdf)) % 5 == 4
        fitted, others = (Rows(pdf["at"][x].tolist(), pdf["counts"][x].tolist(), idf) for x in (~checked, checked))
        w = fit(fitted, labels[~checked], len(languages))
        scores = np.array([v @ w[at] for at, v in others])
        t = temperature(scores, labels[checked])
        used = np.flatnonzero(np.abs(w).sum(axis=1))
        return pd.DataFrame({"at": np.append(used, -1), "w": [*w[used], np.array([t])]})

    found = (sample.mapInPandas(shrink, "one int, mark long, lang string, at array<int>, counts array<int>")
             .groupBy("one").applyInPandas(learn, "at int, w array<double>").collect())
    weights, t = np.zeros((BUCKETS + 1, len(languages))), 1.0
    for r in found:
        if r["at"] < 0:
            t = r["w"][0]
        else:
            weights[r["at"]] = r["w"]
    return Model(languages, idf, weights, t)


def prediction(model: Model | None, text: str = "text") -> Column:
    """struct(lang_pred, score): the language of the whole text and its
    calibrated probability.

    A null text, a text without a letter, and every text when there is no
    model, get ``und`` and score 0. Ties go to the first language in order.
    """
    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if model is None or t is None or not any(map(str.isalpha, t)):
                out.append((UNKNOWN, 0.0))
                continue
            at, counts = ngrams(t)
            s = _values(at, counts, model.idf) @ model.weights[at] + model.weights[BUCKETS]
            p = _softmax(s / model.temperature)
            best = int(p.argmax())
            out.append((model.languages[best], float(p[best])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return run(F.col(text))


def keep_known(docs: DataFrame, model: Model | None, min_score: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is
    recognised with ``min_score`` or more. Without a model (no labelled document to
    learn from) all rows stay whose text has a letter. An empty table gives no rows."""
    if model is None:
        return docs.where(F.col(text).rlike("\\p{L}"))
    own = free_name(docs, "_language")
    return (docs.withColumn(own, prediction(model, text))
            .where((F.col(own)["lang_pred"] != UNKNOWN) & (F.col(own)["score"] >= min_score)).drop(own))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return (docs.select("doc_id", (~learnable()).alias("held_out"), prediction(model).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))
