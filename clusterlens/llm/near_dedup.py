"""MinHash near-dedup with sequential Bayesian verification (operator 9).

Documents with equal shingle sets share a node, named by a 128-bit digest of
the set, so copies never multiply the work. Candidates come from banded
MinHash signatures. A candidate pair's signatures are compared batch by batch;
it is pruned as soon as the posterior probability (uniform prior) that its
similarity reaches the threshold falls below ``MISS``. Survivors are verified
on their full shingle sets.

A band's bucket may hold any number of nodes, so its pairs are never listed:

1. each node is compared with one centre of the bucket; the links found
   already join most of a group of near copies into one component;
2. only buckets whose other members still lie in different components are
   looked at again, in blocks of about ``BLOCK`` members, by signatures alone
   at first, and only pairs across components that no earlier band holds are
   candidates. Full sets are fetched for members with such a candidate left.

A pair at the threshold of 0.8 shares no band with probability
(1 - 0.8^5)^32 = 3e-6, a more similar pair with less; each of the five
posterior tests drops it with 1e-6 at most.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import free_name, stage
from clusterlens.llm.components import components, with_least
from clusterlens.llm.shingles import shingle_set, signature, signature_seeds, similarity
from clusterlens.session import ship_package

BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-6
BLOCK = 512


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, words: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, node (null without words), sig (array of BANDS * ROWS values)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = signature_seeds(BANDS * ROWS)
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                s = shingle_set(t, words)
                out.append((len(s), _name(s), signature(s, seeds).view(np.int32)) if len(s) else (0, None, None))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": [x[0] for x in out],
                                "node": [x[1] for x in out], "sig": [x[2] for x in out]})

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInPandas(run, "doc_id long, n_shingles long, node binary, sig array<int>"))


def posterior_bounds(threshold: float, total: int, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, least matches among the first n values) to go on after each batch.

    With a uniform prior the posterior of the similarity after m matches in n
    is Beta(m + 1, n - m + 1); it exceeds t with the probability that a
    binomial variable of n + 1 trials and chance t is at most m.
    """
    out = []
    for n in range(batch, total + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _survive(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the rows of two signature matrices that no batch prunes."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in bounds:
        matches = matches + (a[alive, at:n] == b[alive, at:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        alive, matches, at = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, BANDS * ROWS), np.int32)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _pruned(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) whose signatures don't rule them out."""
    bounds = posterior_bounds(percent / 100, BANDS * ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = _survive(_matrix(pdf["sig_a"]), _matrix(pdf["sig_b"]), bounds)
            yield pdf[["a", "b"]].iloc[at]

    return (pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
            .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
            .select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a binary, b binary"))


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full shingle sets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: OrderedDict[bytes, np.ndarray] = OrderedDict()
        held = 0

        def full(node: bytes, text: str) -> np.ndarray:
            nonlocal held
            if node not in seen:
                s = seen[node] = shingle_set(text, words)
                held += len(s)
                while held > 2_000_000 and len(seen) > 2:
                    held -= len(seen.popitem(last=False)[1])
            return seen[node]

        for pdf in batches:
            keep = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"], strict=True):
                both, union = similarity(full(bytes(a), ta), full(bytes(b), tb))
                keep.append(100 * both >= percent * union)
            yield pdf[["a", "b"]][np.array(keep, bool)]

    return (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b").mapInPandas(run, "a binary, b binary"))


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, text: a text for each of the wanted nodes."""
    owner = nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("least").alias("owner"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # of rows that share a doc_id, those whose set the node is
            yield pdf[[_name(shingle_set(t, words)) == bytes(n) for n, t in zip(pdf["node"], pdf["text"], strict=True)]]

    return (docs.join(owner, docs["doc_id"].eqNullSafe(owner["owner"])).select("node", "text")
            .mapInPandas(own, "node binary, text string").groupBy("node").agg(F.first("text").alias("text")))


def _buckets(nodes: DataFrame) -> DataFrame:
    """band, key, node: a row for each band of each node."""
    keys = F.array(*[F.xxhash64(F.lit(j), F.slice("sig", j * ROWS + 1, ROWS)) for j in range(BANDS)])
    return nodes.select(F.posexplode(keys).alias("band", "key"), "node")


def _across(members: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members(band, key, node, component, main, apart, inside) of different components.

    ``main`` is the component with most members of the bucket, ``inside`` their
    number, ``apart`` that of the others. Members of the main component need no
    comparison with each other: both sorts are dealt into blocks by hash, and
    each block of the others makes one group with every block of either sort. Groups are first compared by signatures alone; only members
    with a candidate that no batch prunes come back with their full shingle
    sets. A pair that shares an earlier band is left to that band, and once a
    link joins two components, their other pairs in the group are passed over,
    so a group gives fewer links than members.
    """
    bounds = posterior_bounds(percent / 100, BANDS * ROWS)

    def candidates(pdf: pd.DataFrame, component: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each member of the first block the places of those it may be linked with."""
        band, i, j = (pdf[c].iloc[0] for c in ("band", "i", "j"))
        sig, nodes, early = _matrix(pdf["sig"]), pdf["node"].to_numpy(), slice(0, int(band) * ROWS)
        block = pdf["block"].to_numpy()
        for k in np.flatnonzero(block == i):
            at = np.flatnonzero((block == j) & (component != component[k]) & ((nodes > nodes[k]) if i == j else True))
            at = at[_survive(np.broadcast_to(sig[k], (len(at), BANDS * ROWS)), sig[at], bounds)]
            shared = (sig[at, early] == sig[k, early]).reshape(len(at), int(band), ROWS).all(axis=2).any(axis=1)
            yield k, at[~shared]

    def numbered(pdf: pd.DataFrame) -> np.ndarray:
        return np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]

    def survivors(pdf: pd.DataFrame) -> pd.DataFrame:
        alive = np.zeros(len(pdf), bool)
        for k, at in candidates(pdf, numbered(pdf)):
            alive[at] = True
            alive[k] |= len(at) > 0
        return pdf.loc[alive, ["band", "key", "i", "j", "block", "node", "component"]]

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = signature_seeds(BANDS * ROWS)
        for pdf in batches:
            made = [shingle_set(t, words) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "sig": [signature(x, seeds).view(np.int32) for x in made],
                                "shingles": [x.tobytes() for x in made]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        component, nodes = numbered(pdf), pdf["node"].to_numpy()
        full = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        found = []
        for k, at in candidates(pdf, component):
            for other in at:
                if component[other] == component[k]:
                    continue
                both, union = similarity(full[k], full[other])
                if 100 * both >= percent * union:
                    found.append((nodes[k], nodes[other]))
                    component[component == component[other]] = component[k]
        return pd.DataFrame(found, columns=["a", "b"])

    stays, mark = F.col("component") == F.col("main"), F.xxhash64("node")
    first, second = F.ceil(F.col("apart") / BLOCK), F.ceil(F.col("inside") / BLOCK)
    block = F.when(stays, first + F.pmod(mark, second)).otherwise(F.pmod(mark, first))
    others = F.sequence(F.lit(0).cast("long"), F.when(stays, first).otherwise(first + second) - 1)
    paired = (members.select("band", "key", "node", "component", block.alias("block"), F.explode(others).alias("other"))
              .join(nodes.select("node", "sig"), "node")
              .select("band", "key", F.least("block", "other").alias("i"),
                      F.greatest("block", "other").alias("j"), "block", "node", "component", "sig"))
    alive = stage(paired.groupBy("key", "i", "j").applyInPandas(
        survivors, "band int, key long, i long, j long, block long, node binary, component binary"), "survivors")
    texts = _texts(alive.select("node"), nodes, docs, words)
    return (alive.join(texts.mapInPandas(sets, "node binary, sig array<int>, shingles binary"), "node")
            .groupBy("key", "i", "j").applyInPandas(compare, "a binary, b binary"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Two documents are linked when 100 * intersection >= percent * union holds
    for their sets of distinct ``words``-word shingles (A-Z lower-cased, words
    separated by white space; a shorter text is one shingle). component_id is
    the least doc_id that can be reached over links, itself included, and kept
    says whether that is the document's own. Null, empty and white texts have
    an empty set and are linked with nothing. Rows that repeat a doc_id are
    documents of their own; a null doc_id is never a component_id unless all
    of its component are null. An empty table gives no rows, and other
    columns of ``docs`` are not read.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = stage(features(docs, words), "features")
    # documents of one node have one signature; copies end here, before any band is dealt out
    nodes = stage(found.where("node IS NOT NULL").groupBy("node")
                  .agg(F.first("sig").alias("sig"), F.min("doc_id").alias("least")), "nodes")
    several = (_buckets(nodes).groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
               .where("centre < last").select("key", "centre"))
    rows = stage(_buckets(nodes).join(several, "key").where("node != centre"), "buckets")

    star = rows.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    sigs = nodes.select("node", "sig").join(_ends(star).distinct(), "node", "left_semi")
    left = stage(_pruned(star, sigs, percent), "pruned")
    links = stage(_linked(left, _texts(_ends(left), nodes, docs, words), words, percent), "links")
    labels = components(links)

    rest = (rows.join(labels, "node", "left")
            .select("band", "key", "node", F.coalesce("component", "node").alias("component")))
    split = (rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
             .select("key", F.col("most.component").alias("main"), F.col("most.n").alias("inside"),
                     (F.col("n") - F.col("most.n")).alias("apart")).where("apart > 0"))
    members = stage(rest.join(split, "key"), "members")
    more = stage(_across(members, nodes, docs, words, percent), "more-links")
    if not more.isEmpty():
        labels = components(links.union(more))

    whole = (nodes.select("node", "least").join(labels, "node", "left")
             .select("node", "least", F.coalesce("component", "node").alias("component")))
    by_node = (with_least(whole, "component", "least", nodes.count())
               .select("node", F.col("m").alias("component_id")))
    return (found.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
            .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def keep_rows(docs: DataFrame, decided: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose doc_id ``near_duplicates`` kept, with the columns of ``docs``."""
    kept = decided.where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[doc_id].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")


def keep_one(docs: DataFrame, words: int = 5, doc_id: str = "doc_id") -> DataFrame:
    """One row of each component of ``docs``, with all columns: the smallest doc_id
    (null last), then the first in the table.

    Rows count each, so of near copies that repeat a doc_id or have none one stays, too.
    ``docs`` must be a written table: its rows are numbered by their place in it
    when components are found, and once more when they are picked.
    """
    own = free_name(docs, "_row")
    placed = docs.withColumn(own, F.monotonically_increasing_id())
    found = near_duplicates(placed, words, doc_id=own)
    ids = placed.select(F.col(own).alias("doc_id"), F.col(doc_id).cast("long").alias("id"))
    ranked = found.select("doc_id", "component_id").join(ids, "doc_id")
    kept = ranked.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id"))["doc_id"].alias("_kept"))
    return placed.join(kept.select("_kept"), placed[own] == kept["_kept"], "left_semi").drop(own)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE
           WHEN len(ws) = 0 THEN []
           WHEN len(ws) = 1 THEN [ws[1]]
           ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS shingle FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL),
l AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT s.doc_id, any_value(len(sh)) AS n_shingles, min(r.c) AS component_id,
       s.doc_id = min(r.c) AS kept
FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id
"""
