import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clusterlens.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, own string, row string, lines_dropped string"


def brute(texts, min_docs, depth=2):
    def mask(line):
        return tuple(ld.VARIABLE if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", line) if t)

    holds = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if mask(line):
                holds[mask(line)].add(i)
    tokens, leaf_docs = Counter(), defaultdict(set)
    for m, rows in holds.items():
        leaf = (len(m), *m[:depth])
        leaf_docs[leaf] |= rows
        for pos, t in enumerate(m):
            tokens[leaf, pos, t] += len(rows)
    template, docs = {}, defaultdict(set)
    for m, rows in holds.items():
        leaf = (len(m), *m[:depth])
        t = tuple(x if tokens[leaf, p, x] >= min_docs and x != ld.VARIABLE else ld.VARIABLE for p, x in enumerate(m))
        if len(leaf_docs[leaf]) >= min_docs and 2 * sum(x != ld.VARIABLE for x in t) >= len(t):
            template[m] = t
            docs[t] |= rows
    gone = {m for m, t in template.items() if len(docs[t]) >= min_docs}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if not mask(x) or mask(x) not in gone]
        out.append((t if len(left) == len(lines) else "\n".join(left), len(lines) - len(left)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = "alpha beta gamma delta eps zeta eta".split()

    def line():
        kind = rnd.randrange(5)
        if kind == 0:
            return f"User {rnd.choice(words)} logged in from host{rnd.randrange(9)} ok"
        if kind == 1:
            return f"All rights  reserved {rnd.randrange(1990, 2020)}"
        if kind == 2:
            return rnd.choice(["", " ", "\t"])
        return " ".join(rnd.choice(words) + rnd.choice(["", "x", "y", "zz"]) for _ in range(rnd.randrange(1, 9)))

    return ["\n".join(line() for _ in range(rnd.randrange(1, 9))) for _ in range(60)] + [None, "", "\n", "\n\n"]


@pytest.mark.parametrize("seed,min_docs", [(1, 5), (2, 12)])
def test_equals_brute_force(spark, seed, min_docs):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "o", "r", "l") for i, t in enumerate(texts)], SCHEMA)
    got = ld.drop_recurring(docs, min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "own", "row", "lines_dropped"]
    assert [(r.text, r.lines_dropped) for r in got.orderBy("doc_id").collect()] == brute(texts, min_docs)
    assert any(n for _, n in brute(texts, min_docs))


def test_variable_fields_are_generalised(spark):
    docs = spark.createDataFrame([(i, f"Login of user name{chr(97 + i)} was fine\nrow {i}") for i in range(12)], "doc_id long, text string")
    assert {(r.template, r.docs) for r in ld.templates(docs).collect()} == {
        ("Login of user <*> was fine", 12), ("row <*>", 12)}


def test_empty_table_repeats_nulls_and_long_lines(spark):
    assert ld.drop_recurring(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word " * 50_000
    docs = spark.createDataFrame([(1, "same line")] * 10 + [(2, long), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, r.text, r.lines_dropped) for r in ld.drop_recurring(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 1)] * 10 + [(2, long, 0), (None, None, 0)], key=str)


def test_copies_of_a_text_are_one_document(spark, tmp_path):
    copied = "An ordinary line\nand another one"
    texts = [copied] * 12 + [copied.replace("\n", "\n \n")] * 3
    texts += [f"Read more on our site\nbody of document {chr(97 + i)} {chr(97 + i) * 3}" for i in range(9)]
    texts += ["Read more on our site\n" + copied]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.lines_dropped) for r in ld.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(15)] == [(t, 0) for t in texts[:15]]
    assert all(got[i][1] >= 1 and "Read more" not in got[i][0] for i in range(15, 25))
    assert got[24] == (copied, 1)
    assert {(r.template, r.docs) for r in ld.templates(docs, by_text=True).collect()} == {("Read more on our site", 10)}


def test_lines_of_numbers_recur_too(spark):
    texts = [f"Tel 030 1234  5678\n2024-05-01 12:00:{i} 10.0.0.{i} GET 200\nTel 040 {i} {i}{i}\nIt is {chr(97 + i)} the {'xyz'[i % 3] * i} {i} {i}1"
             for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for by_text in (False, True):
        got = {r.doc_id: (r.text, r.lines_dropped) for r in ld.drop_recurring(docs, by_text=by_text).collect()}
        assert [got[i][0].split("\n")[0] for i in range(10)] == [f"Tel 040 {i} {i}{i}" for i in range(10)]
    few = ld.drop_recurring(docs.where("doc_id < 9"))
    assert {r.lines_dropped for r in few.collect()} == {0}


def test_many_dropped_lines_and_dotted_names(spark):
    """A long text that loses every second line keeps the others in order."""
    from clusterlens.llm import line_dedup as ld
    long = "\n".join(line for i in range(20_000) for line in ("shared footer line of all", f"own{'abcdefghij'[i % 10] * (i // 10 + 1)}"[:40]))
    rows = [(i, f"shared footer line of all\nword{'abcdefghijklmnop'[i]}", 1) for i in range(12)] + [(99, long, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    out = ld.drop_recurring(docs)
    assert out.columns == ["doc_id", "text", "a.b", "lines_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert "shared footer" not in got[99].text and got[99].lines_dropped >= 20_000
    assert got[3].text == "wordd"
    left = got[99].text.split("\n")
    assert left == [x for x in long.split("\n") if x in set(left)]


def test_common_lines_are_looked_at_once_and_get_the_same_masks(spark):
    rnd = random.Random(5)
    parts = ["a", "é", "b7", "9", "<*>", " ", "  ", "\t", "\x0b", "\x0c", "\r", "\n", "x\x1cy", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(9))) for _ in range(600)] + ["", " ", None]
    t = F.col("t")
    even = F.regexp_replace(t, r"[\x20\x09-\x0D]+", " ")
    plain = F.trim(F.regexp_replace(even, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", ld.VARIABLE))
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("u", F.translate("t", ld.SPACES, ""))
    assert df.where(~ld.masked(t).eqNullSafe(plain)).collect() == []
    assert df.where(~ld._unspaced(t).eqNullSafe(F.col("u"))).collect() == []
    blanks = F.char_length("t") - F.char_length(F.replace("t", F.lit(" "), F.lit("")))
    assert df.where(~ld._times(" ", t).eqNullSafe(blanks)).collect() == []

    text = df.select("u", ld.masked(t))._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < text.find("0123456789])") < text.find("[0-9]")  # the other patterns only behind this one
    rows = spark.createDataFrame([(1, 1, ("one line",))], "row long, doc long, own struct<text: string>")
    text = ld._lines(rows, "text", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("replace(mask") == 1 and "char_length" not in text and "length(mask" in text
