"""Line dedup with a log-template tree (operator 3).

A line's place in a tree of fixed depth is its number of tokens and its first
``DEPTH`` tokens, tokens with a digit counting as a variable. Within a leaf,
a token that fewer than ``min_docs`` line-documents have at its position is a
variable field too. Line and variables give the line's template; a template
that at least ``min_docs`` documents hold, with at least half of its tokens
constant, is recurring, and its lines are dropped. Numbers don't make a line
less recurring: half of the tokens without a digit are enough if a constant
stands beyond the first ``DEPTH`` tokens, and a line more than half of digits
goes too if it stands word for word in ``min_docs`` documents. With ``by_text``, rows whose
texts are equal but for white space (the copies of operator 10) are one document.

A constant of a recurring template has itself at least ``min_docs`` at its
position, so the generalisation loses none; it needs counts only, no order of
arrival, and no leaf is ever gathered in one place. Lines are first reduced to
distinct masked lines with their numbers of documents, and only leaves with
``min_docs`` or more of these go on to their tokens.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import SPACES, quoted, stage, text_or_empty

DEPTH = 2
MIN_DOCS = 10
VARIABLE = "<*>"


def masked(line: Column) -> Column:
    """The line's tokens, separated by blanks, with tokens that hold a digit as variables.

    One look at a line tells whether there is anything to replace; most have nothing.
    """
    uneven = F.contains(line, F.lit("  ")) | line.rlike(r"[\x09-\x0D]")
    even = F.when(uneven, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)
    other = F.when(line.rlike("[0-9]"), F.regexp_replace(even, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)).otherwise(even)
    plain = ~(F.contains(line, F.lit("  ")) | line.rlike(r"[\x09\x0A\x0B\x0C\x0D0123456789]"))  # listed: faster than ranges
    return F.trim(F.when(plain, line).otherwise(other))


def _evened(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def _digest(c: Column) -> Column:
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def _unspaced(text: Column) -> Column:
    """The text without white space; blanks and newlines go without a look at every character."""
    rest = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    others = [c for c in SPACES if c not in " \n"]
    return F.when(reduce(or_, [F.contains(rest, F.lit(c)) for c in others]),
                  F.translate(rest, "".join(others), "")).otherwise(rest)


def _times(part: str, c: Column) -> Column:
    """How often the text holds ``part``, by bytes."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _lines(rows: DataFrame, text: str, depth: int) -> DataFrame:
    """row, doc, line (from 0), raw, mask, blanks, leaf: the lines of rows(row, doc, own) that aren't white."""
    lines = rows.select("row", "doc", F.posexplode(F.split(text_or_empty(F.col("own")[text]), "\n")).alias("line", "raw"))
    lines = lines.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    made = lines.select("row", "doc", "line", "raw", masked(F.col("raw")).alias("mask"))
    return (made.withColumn("blanks", _times(" ", F.col("mask")))
            .withColumn("leaf", F.xxhash64("blanks", F.substring_index("mask", " ", depth))))


def _recurring(rows: DataFrame, seen: DataFrame, text: str, min_docs: int, depth: int) -> DataFrame:
    """shape, template, docs: the masked lines (by digest) of recurring templates."""
    counts = seen.select("doc", "shape").distinct().groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
    leaves = (seen.select("doc", "leaf").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_docs).select("leaf"))
    masks = (_lines(rows, text, depth).select("leaf", "mask")
             .join(stage(leaves, "leaves"), "leaf").distinct().withColumn("shape", _digest(F.col("mask"))))
    masks = stage(masks.join(counts, "shape"), "open-lines")

    at = masks.select("leaf", "shape", "n", F.posexplode(F.split("mask", " ")).alias("pos", "token"))
    common = (at.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
              .select("leaf", "pos", "token", F.lit(True).alias("constant")))
    kept = F.when(F.col("constant") & (F.col("token") != VARIABLE), F.col("token")).otherwise(F.lit(VARIABLE))
    shaped = (at.join(common, ["leaf", "pos", "token"], "left")
              .groupBy("shape").agg(F.sort_array(F.collect_list(F.struct("pos", kept.alias("token")))).alias("t"),
                                    F.count_if(F.col("token") != VARIABLE).alias("words"))
              .select("shape", "words", F.transform("t", lambda x: x["token"]).alias("t")))
    solid = F.size(F.filter("t", lambda x: x != VARIABLE))
    beyond = F.exists(F.slice("t", depth + 1, F.greatest(F.size("t") - depth, F.lit(0))), lambda x: x != VARIABLE)
    shaped = shaped.where((2 * solid >= F.size("t")) | (2 * solid >= F.col("words")) & beyond).select("shape", F.array_join("t", " ").alias("template"))
    shaped = stage(shaped.withColumn("id", _digest(F.col("template"))), "shapes")
    often = (seen.select("doc", "shape").join(shaped, "shape").select("doc", "id").distinct()
             .groupBy("id").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs))
    return shaped.join(often, "id").select("shape", "template", "docs")


def _staged(docs: DataFrame, text: str, depth: int, by_text: bool) -> tuple[DataFrame, DataFrame]:
    """rows(row, doc, own) with a number for each row and for what counts as its document,
    and a narrow row (row, doc, line, shape, leaf, exact) for each line that isn't white;
    ``exact`` is the digest of a line of which more than half is digits, else null."""
    row = F.monotonically_increasing_id()
    doc = F.xxhash64(_unspaced(text_or_empty(F.col(quoted(text))))) if by_text else row
    rows = stage(docs.select(row.alias("row"), doc.alias("doc"), F.struct(*map(quoted, docs.columns)).alias("own")), "rows")
    exact = F.when(2 * _times(VARIABLE, F.col("mask")) > F.col("blanks") + 1, _digest(_evened(F.col("raw"))))
    seen = _lines(rows, text, depth).select(
        "row", "doc", "line", _digest(F.col("mask")).alias("shape"), "leaf", exact.alias("exact"))
    return rows, stage(seen, "lines")


def templates(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH,
              by_text: bool = False) -> DataFrame:
    """template, docs: the recurring templates, and how many rows (``by_text``: different
    texts) of ``docs`` hold each."""
    rows, seen = _staged(docs, text, depth, by_text)
    return _recurring(rows, seen, text, min_docs, depth).select("template", "docs").distinct()


def drop_recurring(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH,
                   by_text: bool = False) -> DataFrame:
    """``docs`` without the lines of recurring templates, and the number of them in
    ``lines_dropped``.

    Lines end at newlines; white lines are no template and stay, and so does
    the order of lines. Null text stays null, empty text stays empty. Every
    row counts as a document, repeated rows too, so what ``min_docs`` copies
    of a document hold is dropped from all of them, unless ``by_text`` counts
    texts that are equal but for white space once; the lines go from every row
    either way. A text of which all lines go becomes empty. A column named
    ``lines_dropped`` is replaced, others may have any name; an empty table
    gives no rows.
    """
    base = docs.drop("lines_dropped")
    rows, seen = _staged(base, text, depth, by_text)
    known = _recurring(rows, seen, text, min_docs, depth).select("shape")
    heavy = seen.where("exact IS NOT NULL").select("row", "doc", "line", "exact")
    repeated = (heavy.select("doc", "exact").distinct().groupBy("exact").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= min_docs).select("exact"))
    found = seen.join(known, "shape").select("row", "line").union(heavy.join(repeated, "exact").select("row", "line"))
    gone = found.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    own = F.col("own")

    def left(lines: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(stays, lambda at: F.get(lines, at)), "\n")

    # the text is split once, as the only entry of an array
    new = F.get(F.transform(F.array(F.split(own[text], "\n")), left), F.lit(0))
    return rows.join(gone, "row", "left").select(
        *[(F.when(F.col("gone").isNotNull(), new).otherwise(own[c]) if c == text else own[c]).alias(c)
          for c in base.columns],
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring(docs, by_text=True)
