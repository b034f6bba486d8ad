"""Merkle manifest of a dataset by checkpoint and recompute (operator 12).

The leaves of a tree are the digests of its rows; runs of ``FAN`` neighbours
are hashed into their parent until one node is left. There is one tree for
each source, and one more over their roots.

Only every ``LEVELS``-th level is stored. A stored row is an aligned subtree: up to
``FAN ** LEVELS`` neighbouring nodes of a checkpoint level in one bounded array, so no
task ever holds a whole tree and a hot source is many rows. The levels between
are never written. To extract proofs, each subtree computes its missing
interior nodes again from the stored row, emits the siblings on its members'
paths, appends those of the path above, which came down from the checkpoint
before, and drops the nodes again.

A proof is one text for each level: the digests (hex) of the other members of
the run, left to right. The place within the run follows from the leaf's
position, so a proof needs no side flags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import picked, stage
from clusterlens.operators.positions import numbered
from clusterlens.session import new_path

FAN, LEVELS = 3, 4
SPAN = FAN ** LEVELS
#: Hex digits of a digest.
DIGITS = 64


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` if null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The leaf of a row: the digest of its fields. Null, empty and ``-`` values differ."""
    return digest(F.concat(*[field(v) for v in values]))


def raised(nodes: Column) -> Column:
    """One level up: the digest of every run of FAN nodes (the last may be shorter)."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "")))


def siblings(nodes: Column, at: Column) -> Column:
    """The digests of the run of the node at 0-based ``at``, without its own."""
    place = at % FAN
    return F.concat(F.array_join(F.slice(nodes, at - place + 1, place), ""),
                    F.array_join(F.slice(nodes, at + 2, FAN - 1 - place), ""))


def folded(start: Column, position: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def step(below: Column, others: Column) -> Column:
        left = (below["at"] % FAN * DIGITS).cast("int")
        node = F.concat(F.substring(others, F.lit(1), left), below["node"],
                        F.substring(others, left + 1, F.lit(DIGITS * FAN)))
        return F.struct(digest(node).alias("node"), F.floor(below["at"] / FAN).cast("long").alias("at"))

    return F.aggregate(proof, F.struct(start.alias("node"), position.cast("long").alias("at")), step)["node"]


def _nodes_at(n: Column, level: int) -> Column:
    """Nodes of a tree of n leaves after ``level`` levels."""
    return F.ceil(n / (FAN ** level)).cast("long")


def _with_interior(blocks: DataFrame) -> DataFrame:
    """Columns level0 .. level<LEVELS> of the nodes of each subtree; at the top of its
    tree a level is that below, as nothing is hashed once one node is left."""
    df = blocks.withColumn("level0", F.transform("members", lambda m: m["node"]))
    for k in range(LEVELS):
        up = F.when(_nodes_at(F.col("n"), k) > 1, raised(F.col(f"level{k}"))).otherwise(F.col(f"level{k}"))
        df = df.withColumn(f"level{k + 1}", up)
    return df


class Manifest:
    """The stored checkpoints of a forest: trees by ``tree``, and one tree over them.

    Below ``path``: ``leaves-<k>`` and ``top-<k>``, k counting checkpoints from the
    leaves of each, with rows (tree, block, n nodes of this level of the tree,
    members); ``heights``, the number of checkpoints of both.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def checkpoint(self, name: str, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}-{k}")

    def heights(self) -> dict[str, int]:
        return {r["name"]: r["checkpoints"] for r in self.spark.read.parquet(f"{self.path}/heights").collect()}

    def _store(self, rows: DataFrame, name: str, k: int) -> DataFrame:
        """rows (tree, position, n, node, more): one stored row for each aligned subtree."""
        members = F.struct("position", "node", *[c for c in rows.columns if c not in ("tree", "position", "n", "node")])
        (rows.groupBy("tree", F.floor(F.col("position") / SPAN).cast("long").alias("block"), "n")
         .agg(F.sort_array(F.collect_list(members)).alias("members"))
         .write.mode("overwrite").parquet(f"{self.path}/{name}-{k}"))
        return self.checkpoint(name, k)

    def _build(self, rows: DataFrame, name: str) -> int:
        """Store checkpoints of ``rows`` until every tree has one node; their number."""
        k = 0
        while True:
            blocks = self._store(rows, name, k)
            if not (blocks.agg(F.max("n")).first()[0] or 0) > SPAN:
                return k + 1
            rows = _with_interior(blocks).select(
                "tree", F.col("block").alias("position"), _nodes_at(F.col("n"), LEVELS).alias("n"),
                F.get(f"level{LEVELS}", F.lit(0)).alias("node"))
            k += 1

    def roots(self, name: str = "leaves") -> DataFrame:
        """tree, node: the root of each tree."""
        last = self.checkpoint(name, self.heights()[name] - 1)
        return _with_interior(last).select("tree", F.get(f"level{LEVELS}", F.lit(0)).alias("node"))

    def root(self) -> str | None:
        """The digest of the whole dataset, None if it has no rows."""
        row = self.roots("top").first()
        return row["node"] if row else None

    def _paths(self, name: str, carried: DataFrame | None) -> DataFrame:
        """One row for each leaf: tree, n, its member struct, proof (within its tree)
        and ``carried`` (struct by tree, given with the tree's own node)."""
        above = None
        for k in reversed(range(self.heights()[name])):
            blocks = self.checkpoint(name, k)
            if above is None:
                # a tree's last checkpoint is one block: no tree is a hot key here
                blocks = blocks.withColumn("above", F.array().cast("array<string>"))
                if carried is not None:
                    blocks = _join_tree(blocks, carried, ["tree"])
            else:
                blocks = _join_tree(blocks, above, ["tree", "block"])
            inside = _with_interior(blocks)
            one = inside.select("*", F.explode("members").alias("member"))
            at = F.col("member.position") - F.col("block") * SPAN
            own = F.array(*[F.when(_nodes_at(F.col("n"), i) > 1,
                                   siblings(F.col(f"level{i}"), F.floor(at / FAN ** i).cast("int")))
                            for i in range(LEVELS)])
            extra = [] if carried is None else ["carried"]
            rows = one.select("tree", "n", "member", F.concat(F.array_compact(own), "above").alias("above"), *extra)
            above = rows.select("tree", F.col("member.position").alias("block"), "above", *extra)
        return rows.withColumnRenamed("above", "proof")

    def proofs(self) -> DataFrame:
        """One row for each leaf: tree, position in it, node, the further columns given
        to ``build``, proof, subroot, tree_position, tree_proof, root.

        ``proof`` leads from the leaf to its tree's root, ``tree_proof`` from there to
        ``root``. An empty manifest gives no rows.
        """
        top = self._paths("top", None).select(
            F.col("member.of").alias("tree"), F.struct(
                F.col("member.node").alias("subroot"), F.col("member.position").alias("tree_position"),
                F.col("proof").alias("tree_proof"), F.lit(self.root()).alias("root")).alias("carried"))
        rows = self._paths("leaves", stage(top, "tree-proofs"))
        return rows.select("tree", "member.*", "proof", "carried.*")


def _join_tree(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which the null tree meets the null tree."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = left[keys[0]].eqNullSafe(right[f"_{keys[0]}"])
    for k in keys[1:]:
        same = same & (left[k] == right[f"_{k}"])
    return left.join(right, same).drop(*[f"_{k}" for k in keys])


def build(leaves: DataFrame, path: str, tree: str, order: Sequence[Column]) -> Manifest:
    """Store the manifest of ``leaves`` (node, ``tree``, further columns, none of them
    named position, n, proof or like a column of ``proofs``) at ``path``.

    Leaves of a tree stand in ``order``; rows that are equal in it stand in any
    order, so it should end with the node. The trees' roots are ordered by tree,
    null first, then by UTF-8 bytes. ``leaves`` should be a written table; it is
    read twice. No rows give a manifest without a root.
    """
    spark = leaves.sparkSession
    out = Manifest(spark, path)
    named = leaves.withColumnRenamed(tree, "tree")
    heights = [("leaves", out._build(numbered(named, order, by=["tree"], size="n"), "leaves"))]
    last = out.checkpoint("leaves", heights[0][1] - 1)
    roots = stage(_with_interior(last).select("tree", F.get(f"level{LEVELS}", F.lit(0)).alias("node")), "subroots")
    ranked = numbered(roots, [F.col("tree").asc_nulls_first()], size="n")
    top = ranked.select(F.lit(0).alias("tree"), "position", "n", "node", F.col("tree").alias("of"))
    heights.append(("top", out._build(top, "top")))
    spark.createDataFrame(heights, "name string, checkpoints int").write.mode("overwrite").parquet(f"{out.path}/heights")
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_leaves(docs: DataFrame, columns: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """doc_id, source, node and claimed of every row of ``docs``.

    ``claimed`` is the leaf after tampering, null where the row isn't tampered with:
    rows whose decimal doc_id has an even CRC-32 lose their text's line feeds. A
    null doc_id isn't tampered with; a null text stays null.
    """
    rows = picked(docs, **{c: c for c in columns})
    values = [F.col(c) for c in columns]
    bare = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in columns]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return rows.select("doc_id", "source", leaf(values).alias("node"),
                       F.when(even & F.contains("text", F.lit("\n")), leaf(bare)).alias("claimed"))


def verified(proofs: DataFrame, claimed: str = "claimed") -> DataFrame:
    """Adds folded_root, the root that the claimed leaf (the stored one where null) and
    the proof lead to, and verified, whether it is the root."""
    start = F.coalesce(F.col(claimed), F.col("node"))
    fold = folded(folded(start, F.col("position"), F.col("proof")), F.col("tree_position"), F.col("tree_proof"))
    return proofs.withColumn("folded_root", fold).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = stage(document_leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("node").asc(), F.col("row").asc()]
    manifest = build(leaves, new_path(spark, "manifest"), "source", order)
    return verified(manifest.proofs()).select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root",
        digest(F.array_join(F.concat("proof", "tree_proof"), "")).alias("proof_sha256"), "folded_root", "verified")


def _sql_leaf(text: str) -> str:
    def enc(v: str) -> str:
        return f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"

    return "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"


def _sql_tree(name: str, base: str, key: str) -> str:
    """Levels (key, level, pos, node) of trees over ``base`` (key, pos, node), and the
    text left and right of each node within its run."""
    return f"""
{name} AS (
  SELECT {key} AS tree, 0 AS level, pos, node, count(*) OVER (PARTITION BY {key}) AS n FROM {base}
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)),
         CAST(ceil(any_value(n) / 3.0) AS BIGINT)
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3),
{name}_side AS (
  SELECT tree, level, pos, node, n,
         coalesce(lag(node, 2) OVER w, '') || coalesce(lag(node) OVER w, '') AS before,
         coalesce(lead(node) OVER w, '') || coalesce(lead(node, 2) OVER w, '') AS after
  FROM {name} WINDOW w AS (PARTITION BY tree, level, pos // 3 ORDER BY pos))"""


def _sql_fold(name: str, side: str, start: str) -> str:
    """Leaves of ``start`` (id, tree, pos, node, claimed) carried up through ``side``."""
    return f"""
{name} AS (
  SELECT id, tree, 0 AS level, pos, claimed, '' AS proof FROM {start}
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.pos // 3, sha256(s.before || f.claimed || s.after),
         f.proof || s.before || s.after
  FROM {name} f JOIN {side} s ON s.tree IS NOT DISTINCT FROM f.tree AND s.level = f.level AND s.pos = f.pos
  WHERE s.n > 1)"""


OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS step FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) t(i)) x),
d AS (
  SELECT doc_id, source, {_sql_leaf('text')} AS node, {_sql_leaf("replace(text, chr(10), '')")} AS bare,
         xor(list_reduce(list_prepend(4294967295, list_transform(
               regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) AS code
  FROM documents, crc),
base AS (
  SELECT row_number() OVER () AS id, doc_id, source, node,
         CASE WHEN code % 2 = 0 THEN bare ELSE node END AS claimed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos
  FROM d),
{_sql_tree('lower_tree', 'base', 'source')},
subroots AS (
  SELECT tree AS source, node, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM lower_tree WHERE n = 1),
{_sql_tree('upper_tree', '(SELECT 0 AS whole, * FROM subroots) x', 'whole')},
inner_start AS (SELECT id, source AS tree, pos, claimed FROM base),
{_sql_fold('inner_fold', 'lower_tree_side', 'inner_start')},
reached AS (SELECT * FROM inner_fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
outer_start AS (
  SELECT r.id, 0 AS tree, s.pos, r.claimed FROM reached r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.tree),
{_sql_fold('outer_fold', 'upper_tree_side', 'outer_start')},
landed AS (SELECT * FROM outer_fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
root AS (SELECT node FROM upper_tree WHERE n = 1)
SELECT b.doc_id, b.node AS leaf, s.node AS subroot, root.node AS root,
       sha256(r.proof || l.proof) AS proof_sha256, l.claimed AS folded_root, l.claimed = root.node AS verified
FROM base b JOIN reached r USING (id) JOIN landed l USING (id)
JOIN subroots s ON s.source IS NOT DISTINCT FROM b.source, root
"""
