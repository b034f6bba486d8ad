"""Secret scan with multipart credential linking (operator 6, native).

Base kinds stand by themselves: assign, access and hex. Weak kinds mean little
alone and are reported only when complementary parts co-occur:

- ``key``: a run of 20 or more of A-Z a-z 0-9 + / = _ - with a digit, a lower
  and an upper case letter (a possible secret);
- ``login``: a named account or client identifier;
- ``host``: a named host or endpoint, or an address with a scheme.

A weak part is reported when its scope, the interval from ``SCOPE`` code points
before its start to as many after it, holds the start of a part of each of the
complementary roles: for a ``key`` an access identifier (``access`` or
``login``) and an endpoint (``host``); for a ``login`` and a ``host`` a secret
(``key`` or a base ``assign``) and the third role. With ``either``, one of the
two, an access identifier or an endpoint, is enough for a ``key`` that overlaps
none of them: credentials often stand without an endpoint or without a login. The join of parts with
scopes is an interval join within the document: running last values over the
parts in order of their starts, forwards and backwards, say how near the
closest part of each role is. No pairs are made, so a document with many parts
costs no more than a sort of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterlens.llm.common import free_name, quoted, text_or_empty

#: Code points between the starts of parts that belong together.
SCOPE = 256
PLACEHOLDER = "[SECRET]"

#: The kinds in the order of listing, with patterns. The first
#: three are the base; ``_holds`` says which matches count.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "key": r"[A-Za-z0-9+/=_-]{20,}",
    "login": r"""(?i:user_?name|user|login|account_?id|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+_.-]{3,}""",
    "host": r"""(?i:(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[a-z0-9][a-z0-9_.:/-]{3,}|[a-z][a-z0-9+]{1,15}://[a-z0-9][a-z0-9_.:@/-]{3,})""",
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
#: The head of an assignment, up to its value.
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


def _holds(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.char_length(F.regexp_replace(match, ASSIGN_HEAD, "")) >= 8
    if kind == "access":
        return F.char_length(match) >= 16
    if kind == "key":
        return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def _pieces(text: Column, kind: str) -> Column:
    """array of (kind, before, own, holds): lengths of the text before each match
    and of the match, in order; empty where nothing matches."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.split(text, PATTERNS[kind], -1)
    made = F.transform(
        F.arrays_zip(parts.alias("p"), matches.alias("m")),
        lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"),
                           F.char_length(x["p"]).cast("long").alias("before"),
                           F.char_length(x["m"]).cast("long").alias("own"),
                           _holds(kind, x["m"]).alias("holds")))
    none = F.array().cast("array<struct<kind:int,before:bigint,own:bigint,holds:boolean>>")
    return F.when(text.rlike(PATTERNS[kind]), F.filter(made, lambda x: x["own"].isNotNull())).otherwise(none)


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, either: bool = False,
         found: str = "found") -> DataFrame:
    """One row for each row of ``docs``: the ``carry`` columns (default: all) and
    ``found`` (or the name given), the array of struct(start, kind, end, name) of all reported
    spans in order of start, then kind as listed; ``start`` counts code
    points, ``end`` is exclusive. ``either`` reports keys by one other role.

    Null text counts as empty and has no spans. Matches are leftmost and
    non-overlapping for each kind over the whole text, whatever its length;
    spans of different kinds may overlap. Rows that repeat are scanned each by
    itself; an empty table gives no rows. A carried column with the name of the
    result, in any spelling, raises; others may have any name, dots included.
    """
    carry = docs.columns if carry is None else carry
    if found.lower() in (c.lower() for c in carry):
        raise ValueError(f"the column name {found!r} is taken by the result")
    t = text_or_empty(quoted(text))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*map(quoted, carry)).alias("own_columns"),
        F.concat(*[_pieces(t, k) for k in KINDS]).alias("pieces"))
    rows = rows.select(
        "row", F.posexplode_outer("pieces").alias("at", "piece"), "own_columns")
    rows = rows.select(
        "row", F.coalesce("at", F.lit(0)).alias("at"), "piece.*",
        F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own_columns")).alias("own_columns")).repartition("row")

    in_kind = W.partitionBy("row", "kind").orderBy("at")
    by_start = W.partitionBy("row").orderBy("start", "kind")
    back = W.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc())
    end = F.sum(F.col("before") + F.col("own")).over(in_kind.rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("own"))
    role = {"id": ["access", "login"], "secret": ["assign", "key"], "place": ["host"]}
    near = {}
    for r, kinds in role.items():
        is_role = F.col("holds") & F.col("kind").isin([KINDS.index(k) for k in kinds])
        at = F.when(is_role, F.col("start"))
        before = F.last(at, True).over(by_start.rowsBetween(W.unboundedPreceding, 0))
        after = F.last(at, True).over(back.rowsBetween(W.unboundedPreceding, 0))
        near[r] = F.coalesce(F.col("start") - before <= SCOPE, F.lit(False)) | F.coalesce(
            after - F.col("start") <= SCOPE, F.lit(False))
    together = near["id"] & near["secret"] & near["place"]
    if either:
        # a key that is no more than the value of an identifier or the path of an address stands alone
        is_other = F.col("holds") & F.col("kind").isin([KINDS.index(k) for k in role["id"] + role["place"]])
        reached = F.max(F.when(is_other, F.col("end"))).over(by_start.rowsBetween(W.unboundedPreceding, 0))
        ahead = F.last(F.when(is_other, F.col("start")), True).over(back.rowsBetween(W.unboundedPreceding, 0))
        apart = F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True))
        together |= (F.col("kind") == KINDS.index("key")) & apart & (near["id"] | near["place"])
    weak = F.col("kind") >= len(BASE)
    linked = placed.withColumn("reported", F.col("holds") & (~weak | together))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.when(F.col("reported"), F.struct("start", "kind", "end", name.alias("name")))
    return (linked.groupBy("row")
            .agg(F.first("own_columns", ignorenulls=True).alias("own_columns"),
                 F.sort_array(F.collect_list(span)).alias("spans"))
            .select("own_columns.*", F.col("spans").alias(found)))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["name"] == kind)).cast("long")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", either: bool = False) -> DataFrame:
    """``docs`` with every reported span of the text replaced by a placeholder;
    overlapping and touching spans are replaced together. Rows without spans
    keep their text, null included; all columns stay, whatever their names.
    ``either`` as for ``scan``."""
    name = free_name(docs, "found")
    spans, own = F.col(name), F.col(quoted(text))
    cut = F.aggregate(
        spans, F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.when(x["end"] <= s["at"], s["done"])
            .when((x["start"] <= s["at"]) & (s["at"] > 0), s["done"])
            .otherwise(F.concat(s["done"], F.substring(own, s["at"].cast("int") + 1,
                                                       (x["start"] - s["at"]).cast("int")), F.lit(PLACEHOLDER)))
            .alias("done"),
            F.greatest(s["at"], x["end"]).alias("at")))
    new = F.concat(cut["done"], F.substring(own, cut["at"].cast("int") + 1, F.char_length(own)))
    made = F.when(F.size(spans) > 0, new).otherwise(own).alias(text)
    return scan(docs, text, either=either, found=name).select(
        *[made if c == text else F.col(quoted(c)) for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = F.col("found")
    count = [_count(spans, k).alias(f"n_{k}") for k in BASE]
    base = F.filter(spans, lambda x: x["kind"] < len(BASE))
    return scan(docs, carry=["doc_id"], either=True).select(
        "doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"))


_SQL_PATTERNS = ",\n  ".join("({}, '{}', '{}')".format(i, k, p.replace("'", "''")) for i, (k, p) in enumerate(PATTERNS.items()))
_SQL_HEAD = ASSIGN_HEAD.replace("'", "''")
OP6_SQL = rf"""
WITH p(kind, name, pattern) AS (VALUES
  {_SQL_PATTERNS}),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, kind, name, unnest(range(len(string_split_regex(text, pattern)))) AS i,
         unnest(string_split_regex(text, pattern)) AS before,
         unnest(regexp_extract_all(text, pattern)) AS own
  FROM t, p),
n AS (
  SELECT r, kind, name, own,
         CAST(sum(length(before) + length(own)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop
  FROM m WHERE own IS NOT NULL),
h AS (
  SELECT r, kind, name, stop - length(own) AS start, stop FROM n
  WHERE CASE name
    WHEN 'assign' THEN length(regexp_replace(own, '{_SQL_HEAD}', '')) >= 8
    WHEN 'access' THEN length(own) >= 16
    WHEN 'key' THEN regexp_matches(own, '[0-9]') AND regexp_matches(own, '[a-z]') AND regexp_matches(own, '[A-Z]')
    ELSE TRUE END),
f AS (
  SELECT * FROM h
  WHERE kind < {len(BASE)} OR (
    EXISTS (SELECT 1 FROM h x WHERE x.r = h.r AND abs(x.start - h.start) <= {SCOPE} AND x.name IN ('access', 'login'))
    AND EXISTS (SELECT 1 FROM h x WHERE x.r = h.r AND abs(x.start - h.start) <= {SCOPE} AND x.name IN ('assign', 'key'))
    AND EXISTS (SELECT 1 FROM h x WHERE x.r = h.r AND abs(x.start - h.start) <= {SCOPE} AND x.name = 'host'))
  OR (name = 'key'
    AND EXISTS (SELECT 1 FROM h x WHERE x.r = h.r AND abs(x.start - h.start) <= {SCOPE}
                AND x.name IN ('access', 'login', 'host'))
    AND NOT EXISTS (SELECT 1 FROM h x WHERE x.r = h.r AND x.name IN ('access', 'login', 'host')
                    AND x.start < h.stop AND x.stop > h.start))),
g AS (
  SELECT r, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access,
         count(*) FILTER (name = 'hex') AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON t.r = g.r
"""
