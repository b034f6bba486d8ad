"""Exact top-k search by inner product with a pivot table (operator 1).

Each vector's distances to many pivots are computed once and stored. For a
query q and a vector x, |d(q, p) - d(x, p)| bounds d(q, x) from below for every
pivot p, and with <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2 the largest of these
bounds gives an upper bound of the score. Candidates are scored in the order of
their bounds until no bound left reaches the k-th best score found.

Vectors are kept in cells (by nearest pivot), and cells are cut into shards of
about ``SHARD`` rows by a hash, so that a vector that many rows share is spread
out too. A cell's least and greatest distance to each pivot bound all its
scores: a query is sent only to the shards of cells that may hold a score as
good as its k-th best among the pivots. Queries meet shards in blocks of about
``QUERY_BLOCK``; a task holds one block and one shard. The pivots and the
bounds of the cells (``PIVOTS`` times ``PIVOTS`` numbers) are the only things
that every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterlens.llm.common import stage
from clusterlens.session import ship_package

PIVOTS, POOL = 48, 512
SHARD, QUERY_BLOCK, CHUNK = 2048, 2048, 512


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component; null where the vector is null or holds a
    null or non-finite component."""
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0.0))


def choose_pivots(pool: np.ndarray, n: int) -> np.ndarray:
    """Positions of ``n`` rows (or fewer distinct ones), each the farthest from those before it."""
    if not len(pool):
        return np.empty(0, int)
    picked, far = [0], _distances(pool, pool[:1])[:, 0]
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, _distances(pool, pool[picked[-1:]])[:, 0])
    return np.array(picked)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def scan_in_bound_order(q: np.ndarray, own: int, tau: float, bounds: np.ndarray, slack: float, x: np.ndarray,
                        ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of q's k best rows of x with scores of tau or more.

    ``x`` and ``q`` are integers, or floats that hold integers whose products
    add up exactly.
    """
    order = np.flatnonzero((bounds >= tau - slack) & (rows != own))
    order = order[np.argsort(-bounds[order], kind="stable")]
    at, scores, least = np.empty(0, int), np.empty(0, np.int64), tau
    for begin in range(0, len(order), CHUNK):
        part = order[begin:begin + CHUNK]
        if bounds[part[0]] < least - slack:
            break
        found = x[part] @ q
        good = np.flatnonzero(found >= least)
        if not len(good):
            continue
        at, scores = np.append(at, part[good]), np.append(scores, found[good].astype(np.int64))
        top = best(ids[at], scores, k)
        at, scores = at[top], scores[top]
        if len(at) == k:
            least = max(least, float(scores[-1]))
    return at, scores


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row where ``queries`` is true:
    query_id, rank (from 1), vec_id, score.

    Every row but the query's own is a candidate; ties go to the smaller
    vec_id. Fewer than k candidates give fewer ranks. Vectors that are null or
    hold a null or non-finite component take no part, nor do rows without a
    vec_id. Missing components of shorter vectors count as zero. Rows that
    repeat a vec_id are rows of their own, as queries too. Scores are exact
    while they fit into 64 bits. An empty table gives no rows, and other
    columns are not read.
    """
    ship_package(vectors.sparkSession)
    sound = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("v"),
                            F.coalesce(queries, F.lit(False)).alias("query"))
             .where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    sound = stage(sound, "vectors")
    width, n_queries = sound.agg(F.max(F.size("v")), F.sum(F.col("query").cast("long"))).first()
    if not width:
        width = 1
    pool = sound.orderBy(F.xxhash64("vec_id", "row"), "row").limit(POOL).collect()
    points = _padded([r["v"] for r in pool], width)
    picked = choose_pivots(points, PIVOTS)
    pivots, pivot_rows = points[picked], np.array([pool[i]["row"] for i in picked], np.int64)

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _padded(pdf["v"], width)
            d = _distances(x, pivots)
            yield pdf.assign(norm=(x * x).sum(1), cell=d.argmin(1), dist=list(d))

    table = stage(sound.mapInPandas(
        tabulate, "vec_id long, v array<long>, query boolean, row long, norm long, cell int, dist array<double>"),
        "pivot-table")

    def extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                d = np.stack(part["dist"].to_numpy())
                yield pd.DataFrame({"cell": cell, "pivot": np.arange(d.shape[1]), "lo": d.min(0), "hi": d.max(0),
                                    "n": len(part), "norm": part["norm"].max()})

    extents = (table.select("cell", "norm", "dist")
               .mapInPandas(extent, "cell int, pivot int, lo double, hi double, n long, norm long")
               .groupBy("cell", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                             F.sum("n").alias("n"), F.max("norm").alias("norm"))
               .orderBy("cell", "pivot").toPandas())
    cells = extents["cell"].unique()
    lo, hi = (extents[c].to_numpy().reshape(len(cells), len(pivots)) for c in ("lo", "hi"))
    first = extents.drop_duplicates("cell")
    longest, shards = first["norm"].to_numpy(float), -(-first["n"].to_numpy() // SHARD)
    query_blocks = max(1, -(-(n_queries or 0) // QUERY_BLOCK))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                known = np.sort((pivots @ _padded([r.v], width)[0])[pivot_rows != r.row])[::-1]
                tau = float(known[k - 1]) if len(known) >= k else -np.inf
                gap = np.maximum(np.maximum(lo - r.dist, r.dist - hi), 0.0).max(1)
                may = np.flatnonzero((r.norm + longest - gap * gap) / 2 >= tau - _slack(r.norm, longest))
                cell, shard = np.repeat(cells[may], shards[may]), [s for c in may for s in range(shards[c])]
                yield pd.DataFrame({"cell": cell, "shard": shard, "row": r.row, "vec_id": r.vec_id, "v": [r.v] * len(cell),
                                    "norm": r.norm, "dist": [r.dist] * len(cell), "tau": tau})

    n_shards = F.element_at(F.create_map(*[F.lit(int(x)) for c in zip(cells, shards, strict=True) for x in c]), F.col("cell")) \
        if len(cells) else F.lit(1)
    block = F.pmod(F.xxhash64("row"), F.lit(query_blocks)).alias("block")
    asked = (table.where("query").select("row", "vec_id", "v", "norm", "dist")
             .mapInPandas(send, "cell int, shard long, row long, vec_id long, v array<long>, norm long, dist array<double>, tau double")
             .select("*", block))
    asked = stage(asked, "asked")
    # a vector is copied once for each block with a query that asked for its shard, not for all blocks
    wanted = asked.select(*[F.col(a).alias(b) for a, b in (("cell", "cell"), ("shard", "shard"), ("block", "to"))]).distinct()
    held = (table.select("cell", F.pmod(F.xxhash64("row", F.lit("shard")), n_shards.cast("long")).alias("shard"),
                         "row", "vec_id", "v", "norm", "dist").join(wanted, ["cell", "shard"]).withColumnRenamed("to", "block"))

    def search(_: tuple, data: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(data) and len(asking):
            x, far, norms = _padded(data["v"], width), np.stack(data["dist"].to_numpy()), data["norm"].to_numpy(float)
            ids, rows, asked = data["vec_id"].to_numpy(), data["row"].to_numpy(), _padded(asking["v"], width)
            if float(np.abs(x).max(initial=0)) * float(np.abs(asked).max(initial=0)) * width < 2.0 ** 53:
                x, asked = x.astype(float), asked.astype(float)  # sums stay exact, and products are faster
            far = np.ascontiguousarray(far.T)
            for q, r in zip(asked, asking.itertuples(index=False), strict=True):
                gap = np.abs(far - r.dist[:, None]).max(0)
                bounds = (r.norm + norms - gap * gap) / 2
                at, scores = scan_in_bound_order(q, r.row, r.tau, bounds, _slack(r.norm, norms.max()), x, ids, rows, k)
                found += [(r.row, r.vec_id, ids[i], rows[i], s) for i, s in zip(at, scores, strict=True)]
        return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "row", "score"])

    tile = ["cell", "shard", "block"]
    hits = held.groupBy(*tile).cogroup(asked.groupBy(*tile)).applyInPandas(
        search, "query_row long, query_id long, vec_id long, row long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _slack(a: float, b: float | np.ndarray):
    """More than rounding can add to a bound of vectors with these squared lengths."""
    return 1e-6 + 1e-9 * (a + b)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
