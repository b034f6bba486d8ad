"""Parser: tokenizer property test against the split rule written out in
Python, every status, group folding, and the worked examples."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clusterlens.functions.tokens import has_empty_segment, quoted_tokens, strip_quotes
from clusterlens.operators import parse as P
from clusterlens.templates import TEMPLATES, snake_case, unique_snake_names

def py_segments(line):
    """Split at every space behind which an even number of quotes is left."""
    out, left = [""], line.count('"')
    for c in line:
        left -= c == '"'
        if c == " " and left % 2 == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def test_snake_names():
    cols = TEMPLATES["JOB_FINISH"].columns
    assert len(cols) == 133
    assert cols[:4] == ["event_type", "version_number", "event_time", "job_id"]
    assert cols[60] == "rsv_id" and cols[77] == "rsv_id2"
    assert snake_case("numGPURusages") == "num_gpu_rusages"
    assert snake_case("submitEXT_Num") == "submit_ext_num"
    assert snake_case("indexRangeStartN") == "index_range_start_n"
    assert snake_case("maxRMem") == "max_r_mem"
    assert snake_case("gRusage_numKVP") == "g_rusage_num_kvp"
    assert snake_case("Event.Time") == "event_time"
    assert unique_snake_names(["a", "A", "b"]) == ["a", "a2", "b"]


def _random_lines(n, seed):
    rnd = random.Random(seed)
    alphabet = ['"', " ", "a", "b", "1", '"', " "]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_tokenizer_matches_split_rule(spark):
    lines = _random_lines(3000, 7)
    df = spark.createDataFrame([(s,) for s in lines], "l string")
    got = (df.select("l", quoted_tokens(F.col("l")).alias("t"))
             .select("l", "t", has_empty_segment(F.col("l"), F.col("t")).alias("e"))
             .collect())
    for r in got:
        segs = py_segments(r.l)
        empty = any(len(s) == 0 for s in segs)
        assert bool(r.e) == empty, (r.l, segs, r.t)
        if not empty:
            assert list(r.t) == segs, (r.l, segs, r.t)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(['"', " ", "x", "7", "\"\"", "a b"]), max_size=12))
def test_tokenizer_property(spark, parts):
    line = "".join(parts)
    r = spark.createDataFrame([(line,)], "l string").select(
        quoted_tokens(F.col("l")).alias("t"),
        has_empty_segment(F.col("l"), quoted_tokens(F.col("l"))).alias("e")).first()
    segs = py_segments(line)
    if any(len(s) == 0 for s in segs):
        assert r.e
    else:
        assert not r.e and list(r.t) == segs


def test_strip_quotes(spark):
    r = spark.createDataFrame([(['"a"', '""b""', 'c"', '"run ""a b"" --x"'],)], "t array<string>") \
        .select(strip_quotes(F.col("t")).alias("s")).first()
    assert list(r.s) == ["a", "b", 'c"', 'run ""a b"" --x']


def _finish_line(ex_hosts=("h1",), gpu=0, extra="", idx="0", rtype="JOB_FINISH", host_count=None):
    tpl = TEMPLATES["JOB_FINISH"]
    spec = dict(tpl.group_spec())
    arrays = tpl.array_columns()
    toks = []
    for t, name in enumerate(tpl.columns):
        if t in arrays:
            continue
        if t in spec:
            if name == "num_ex_hosts":
                toks.append(host_count if host_count is not None else str(len(ex_hosts)))
                toks += [f'"{h}"' for h in ex_hosts]
            elif name == "num_gpu_rusages":
                toks.append(str(gpu))
                for m in range(gpu):
                    toks += [f'"gpu{m}"', "2", '"k"', '"v w"']
            else:
                toks.append("0")
            continue
        kind = tpl.kind(t)
        if name == "event_type":
            toks.append(f'"{rtype}"')
        elif name == "idx":
            toks.append(idx)
        elif name == "queue":
            toks.append('"normal"')
        elif name == "job_id":
            toks.append("42")
        else:
            toks.append("0" if kind in ("bigint", "double") else '""')
    return " ".join(toks) + extra


def _parse(spark, lines):
    df = spark.createDataFrame([(s,) for s in lines], "value string")
    return P.parse_log(df)


def test_statuses(spark):
    good = _finish_line()
    lines = [
        good,
        good[1:],                                   # missing leading quote -> repaired
        good.replace(" ", "  ", 1),                 # empty segment
        _finish_line(rtype="JOB_NEW"),              # unknown type
        _finish_line(rtype="EVENT_ADRSV_FINISH"),   # known, unsupported
        _finish_line(extra=' "x"'),                 # bad width
        _finish_line(idx='""'),                     # bad type (missing int)
        _finish_line(idx="1.5"),                    # bad type (not an int)
        _finish_line(host_count='"two"'),           # group count not a number
        _finish_line(host_count="9"),               # count larger than fields left -> width
        "",                                         # empty line
    ]
    got = [r.status for r in _parse(spark, lines).select("status").collect()]
    assert got == ["ok", "ok", "empty_segment", "unknown_type", "unsupported_type",
                   "bad_width", "bad_type", "bad_type", "bad_group", "bad_group",
                   "empty_segment"]


def test_group_count_past_end(spark):
    line = _finish_line()
    toks = line.split(" ")
    # Cut the line right after a large last-group count.
    cut = " ".join(toks[:-1] + ["50"])
    r = _parse(spark, [cut]).select("status").first()
    assert r.status == "bad_group"


def test_groups_fold(spark):
    line = _finish_line(ex_hosts=("n1", "n 2", "n3"), gpu=2)
    r = P.parsed_rows(_parse(spark, [line])).first()
    assert r.num_ex_hosts == 3 and list(r.exec_hosts) == ["n1", "n 2", "n3"]
    assert list(r.g_rusage_hostname) == ["gpu0", "gpu1"]
    assert list(r.g_rusage_num_kvp) == ["2", "2"]
    assert list(r.g_rusage_value) == ["v w", "v w"]
    assert r.asked_hosts is None and r.job_id == 42 and r.queue == "normal"
    assert r.res_req is None  # empty string -> absent


def test_zero_groups_and_negative_count(spark):
    line = _finish_line(ex_hosts=(), gpu=0)
    r = P.parsed_rows(_parse(spark, [line])).first()
    assert r.exec_hosts is None and r.num_ex_hosts == 0
    neg = _finish_line(ex_hosts=(), host_count="-2")
    r = _parse(spark, [neg]).select("status", "num_ex_hosts", "exec_hosts").first()
    # A negative count folds no value, like a count of zero.
    assert r.status == "ok" and r.num_ex_hosts == -2 and r.exec_hosts is None


def test_resize_record(spark):
    line = '"JOB_RESIZE" 1682116121 7 0 1682110000 5 "alice" 1 0 2 "h1" "h2" 0 1 "4" 0'
    r = P.parse_log(spark.createDataFrame([(line,)], "value string"), "JOB_RESIZE").first()
    assert r.status == "ok"
    assert list(r.exec_hosts) == ["h1", "h2"] and list(r.alloc_slots) == ["4"]
    assert r.resize_hosts is None and r.user_name == "alice"


def test_other_type_and_where_type(spark):
    lines = [_finish_line(), '"JOB_RESIZE" 1 2 3', 'JOB_FINISH" 1', '"JOB_NEW" 1']
    df = spark.createDataFrame([(s,) for s in lines], "value string")
    kept = P.where_type(df, "JOB_FINISH").count()
    assert kept == 2  # the second one only after quote repair
    st = [r.status for r in P.parse_log(df).select("status").collect()]
    assert st[1] == "other_type" and st[3] == "unknown_type"


def test_audit_and_quarantine(spark):
    parsed = _parse(spark, [_finish_line(), _finish_line(extra=' "x"')])
    audit = {r.status: r.n_lines for r in P.parse_audit(parsed).collect()}
    assert audit == {"ok": 1, "bad_width": 1}
    q = P.quarantine(parsed).collect()
    assert len(q) == 1 and q[0].line.endswith('"x"')


def test_engines_agree(spark):
    from clusterlens.plans import fixtures as fx
    extra = [_finish_line(), _finish_line(host_count="9"), _finish_line(host_count="-2"),
             _finish_line(extra=' "x"'), "", '"A" "B', 'x"y z"w "q', "   ", '"JOB_FINISH"  1',
             _finish_line(ex_hosts=("a b", 'c""d')), _finish_line(gpu=3)]
    lines = fx.lines(spark, "/root/testdata/sf0.001").unionByName(
        spark.createDataFrame([(s,) for s in extra], "value string"))
    a = P.parse_log(lines, engine="arrow")
    b = P.parse_log(lines, engine="sql")
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    assert a.count() == b.count()
    # Same status for every line; same values for every accepted line.
    sa, sb = a.select("line", "status"), b.select("line", "status")
    assert sa.exceptAll(sb).count() == 0 and sb.exceptAll(sa).count() == 0
    oa, ob = a.filter("status = 'ok'"), b.filter("status = 'ok'")
    assert oa.count() > 800
    assert oa.exceptAll(ob).count() == 0 and ob.exceptAll(oa).count() == 0


def _model_status(line):
    """Brute-force model of the status rules, one line at a time."""
    tpl = TEMPLATES["JOB_FINISH"]
    s = line.strip()
    if not s:
        return "empty_segment"
    if s[0] != '"':
        s = '"' + s
    segs = py_segments(s)
    if any(len(x) == 0 for x in segs):
        return "empty_segment"
    segs = [x.strip('"') if x.startswith('"') else x for x in segs]
    if segs[0] == "EVENT_ADRSV_FINISH":
        return "unsupported_type"
    if segs[0] not in TEMPLATES:
        return "unknown_type"
    if segs[0] != "JOB_FINISH":
        return "other_type"
    spec = tpl.group_spec()
    shift, shifts = 0, []
    for i, w in spec:
        p = i + shift
        try:
            c = int(segs[p])
        except (IndexError, ValueError):
            return "bad_group"
        n = max(c, 0)
        if p + n * w >= len(segs):
            return "bad_group"
        shifts.append(shift)
        shift += (n - 1) * w
    shifts.append(shift)
    if len(segs) - shift != len(tpl.fields):
        return "bad_width"
    for t in range(len(tpl.fields)):
        kind = tpl.kind(t)
        if kind not in ("bigint", "double"):
            continue
        v = segs[t + shifts[sum(1 for i, _ in spec if i < t)]]
        try:
            int(v) if kind == "bigint" else float(v)
        except ValueError:
            return "bad_type"
        if v == "":
            return "bad_type"
    return "ok"


def test_random_damage_against_model(spark):
    rnd = random.Random(11)
    lines = []
    for k in range(400):
        toks = _finish_line(ex_hosts=tuple(f"h {m}" for m in range(rnd.randint(0, 3))),
                            gpu=rnd.randint(0, 2)).split(" ")
        for _ in range(rnd.randint(0, 3)):
            op = rnd.random()
            pos = rnd.randrange(len(toks))
            if op < 0.25:
                toks.pop(pos)
            elif op < 0.5:
                toks.insert(pos, rnd.choice(['"x"', "0", '""', "7"]))
            elif op < 0.75:
                toks[pos] = rnd.choice(["-1", "2", "abc", '"3"', "1.5", "99"])
            else:
                toks[pos] = toks[pos] + rnd.choice(['"', " ", ""])
        lines.append(" ".join(toks))
    want = [_model_status(s) for s in lines]
    assert len(set(want)) >= 4
    df = spark.createDataFrame([(s,) for s in lines], "value string")
    for engine in ("arrow", "sql"):
        got = [r.status for r in P.parse_log(df, engine=engine).select("status").collect()]
        diffs = [(s, g, w) for s, g, w in zip(lines, got, want) if g != w]
        assert not diffs, (engine, diffs[:3])


NUMBERS = ["0", "-0", "007", "+5", " 12 ", "", "1.5", "1.5d", "1e3", "nan", "-inf", "abc", "9" * 18, "-" + "9" * 18,
           "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809",
           "9000000000000000001", "0009223372036854775807", "9" * 20, "--5"]


def test_engines_agree_on_numbers(spark):
    """64-bit limits for whole numbers; no type suffixes for others."""
    lines = []
    for n in NUMBERS:
        for name in ("user_id", "host_factor"):
            cells = py_segments(_finish_line())
            cells[TEMPLATES["JOB_FINISH"].columns.index(name) if name == "user_id" else _place("host_factor")] = f'"{n}"'
            lines.append(" ".join(cells))
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    arrow, sql = (P.parse_log(df, engine=e, fields=["user_id", "host_factor"]).collect() for e in ("arrow", "sql"))
    key = [(r.status, str(r.user_id), str(r.host_factor), r.line) for r in arrow if r.status == "ok"]
    assert sorted(key) == sorted((r.status, str(r.user_id), str(r.host_factor), r.line) for r in sql if r.status == "ok")
    assert sorted(r.status for r in arrow) == sorted(r.status for r in sql)
    whole = {n: int(n) for n in NUMBERS if re.fullmatch(r" *[+-]?[0-9]+ *", n) and -(1 << 63) <= int(n) < 1 << 63}
    assert sorted(r.user_id for r in arrow if r.status == "ok" and r.user_id not in (None,))[0] == -(1 << 63)
    assert {r.user_id for r in arrow if r.status == "ok"} >= set(whole.values())


def _place(name):
    """Field position of a plain column of a finish line without group values before it."""
    line = py_segments(_finish_line())
    tpl = TEMPLATES["JOB_FINISH"]
    arrays = tpl.array_columns()
    shift, spec, counts = 0, dict(tpl.group_spec()), {}
    for t, col in enumerate(tpl.columns):
        if col == name:
            return t - sum(1 for x in arrays if x < t) + shift
        if t in arrays:
            continue
        if t in spec:
            at = t - sum(1 for x in arrays if x < t) + shift
            counts[t] = int(line[at].strip('"') or 0)
            shift += counts[t] * spec[t]
    raise KeyError(name)


def test_raw_line_only_for_rejects(spark):
    lines = spark.createDataFrame([(_finish_line(),), (_finish_line(extra=' "x"'),)], "value string")
    for engine in ("arrow", "sql"):
        got = {r.status: r.line for r in P.parse_log(lines, engine=engine, fields=["job_id"]).collect()}
        assert got["ok"] is None
        assert [v for k, v in got.items() if k != "ok"] == [_finish_line(extra=' "x"')]
