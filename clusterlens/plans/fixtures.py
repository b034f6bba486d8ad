"""Job-accounting inputs derived by Spark from the driver tables.

The test data holds no scheduler logs, so the inputs of the engine are
derived from the given tables; every derived row comes from a source row,
so the work grows with the tables:

* ``jobs``  - one job per ``events`` row (queue = event_type, user = user_id,
  times from ``ts``, ``props.k`` and ``value``), with never-started jobs,
  -1 "missing" sentinels, jobs without a queue, jobs that end before they
  start, and array jobs that share an id and differ in ``idx``.
* ``lines`` - every job rendered as a finished-job accounting-log line
  (133 fields, variable groups, quoted strings), a known share of them
  damaged in a known way, so the parser can be checked line by line.
* ``hosts`` - queue -> group -> node lists from region / nation / supplier,
  in the ragged ``key,v1,v2,...`` text form the capacity lists use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import ntz_to_epoch
from ..templates import TEMPLATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Setting that names how many partitions the derived tables are dealt into;
#: unset, they keep the splits of the input. For benches over one-file tables.
PARTITIONS = "spark.clusterlens.partitions"


def jobs(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Finished-job rows: the report input and the source of every series."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", "props")
    partitions = partitions or int(spark.conf.get(PARTITIONS, "0"))
    if partitions:
        ev = ev.repartition(partitions)
    ep = ntz_to_epoch(F.col("ts"))
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    run = F.floor(F.col("value") * 100).cast("bigint")
    eid = F.col("event_id")
    array_job = eid % 10 == 3
    base = ev.select(
        "event_id", F.when(array_job, eid - eid % 100 + 3).otherwise(eid).alias("job_id"), "user_id",
        F.when(eid % 31 != 4, F.col("event_type")).alias("queue"),
        F.when(array_job, F.floor(eid % 100 / 10)).otherwise(0).cast("bigint").alias("idx"),
        ep.alias("ep"), k.alias("k"), run.alias("run"))
    start = F.col("ep") + F.col("k") * 60
    return base.select(
        "job_id", "user_id",
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
        "queue",
        F.col("ep").alias("submit_time"),
        F.when(eid % 29 == 0, F.lit(0).cast("bigint")).otherwise(start).alias("start_time"),
        F.when(eid % 37 == 5, start - 5000).otherwise(start + F.col("run")).alias("event_time"),
        F.col("run").alias("run_time"),
        (eid % 8 + 1).alias("num_processors"),
        F.when(eid % 13 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("k") * 1024).alias("avg_mem"),
        F.when(eid % 5 == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("num_gpu_rusages"),
        F.lit(0).cast("bigint").alias("max_r_mem"),
        "idx",
        F.lit(0).cast("bigint").alias("requeue_time"),
        F.when(eid % 29 == 0, F.lit(-1).cast("bigint"))
         .otherwise(start - F.col("ep")).alias("ineligible_pend_time"),
    )


# ---------------------------------------------------------------------------
# log lines
# ---------------------------------------------------------------------------

# Damage applied by job_id % 50 (the expected status is in brackets).
DAMAGE = {
    7: "extra field at the end [bad_width]",
    8: "two spaces after the first field [empty_segment]",
    9: "record type JOB_NEW [unknown_type]",
    10: "idx written as an empty string [bad_type]",
    11: "leading quote missing [ok, repaired]",
    12: "execution-host count written as text [bad_group]",
}


#: Rows of ``events`` whose jobs one task renders as log lines, some 30 MB of text.
LOG_ROWS = 50_000


def log_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jobs`` for lines: rows of a few bytes each become lines of hundreds, so the splits of
    the table, which go by its bytes, are dealt into tasks of so many rows each."""
    rows = table(spark, sf_dir, "events").count()
    needed = -(-rows // LOG_ROWS) if rows > LOG_ROWS else 0
    return jobs(spark, sf_dir, max(needed, int(spark.conf.get(PARTITIONS, "0"))))


def _q(c: Column) -> Column:
    """Quote a string field, doubling inner quotes."""
    return F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))


def _group_values(cnt: Column, width: int, value) -> Column:
    """Interleaved ``cnt x width`` values of one group as an array of tokens."""
    items = F.flatten(F.transform(F.sequence(F.lit(1), cnt),
                                  lambda m: F.array(*[value(m, j) for j in range(width)])))
    return F.when(cnt > 0, items).otherwise(F.array().cast("array<string>"))


def _group_text(cnt: Column, width: int, value) -> Column:
    """The values of one group with spaces between. Those of up to three entries are constants,
    which are computed once, not line by line."""
    def text(m: int) -> Column:
        return F.array_join(F.array(*[value(F.lit(k), j) for k in range(1, m + 1) for j in range(width)]), " ")

    few = F.when(cnt == 1, text(1)).when(cnt == 2, text(2)).when(cnt == 3, text(3))
    return few.when(cnt > 3, F.array_join(_group_values(cnt, width, value), " ")).otherwise(F.lit(""))


def render_lines(jobs_df: DataFrame) -> DataFrame:
    """Render each job row as one finished-job log line (column ``value``)."""
    tpl = TEMPLATES["JOB_FINISH"]
    names = tpl.columns
    jid = F.col("job_id")
    dmg = jid % 50
    num = lambda c: F.col(c).cast("string")
    known = {
        "event_type": F.when(dmg == 9, _q(F.lit("JOB_NEW"))).otherwise(_q(F.lit("JOB_FINISH"))),
        "version_number": _q(F.lit("10.1")),
        "event_time": num("event_time"), "job_id": num("job_id"), "user_id": num("user_id"),
        "num_processors": num("num_processors"), "submit_time": num("submit_time"),
        "start_time": num("start_time"), "user_name": _q(F.col("user_name")),
        "queue": _q(F.coalesce("queue", F.lit(""))),
        "command": _q(F.lit('run "a b" --x')),
        "idx": F.when(dmg == 10, F.lit('""')).otherwise(num("idx")),
        "avg_mem": num("avg_mem"), "run_time": num("run_time"),
        "ineligible_pend_time": num("ineligible_pend_time"),
        "requeue_time": num("requeue_time"), "max_r_mem": num("max_r_mem"),
    }
    spec = dict(tpl.group_spec())
    counts = {
        "num_ex_hosts": jid % 4,
        "num_host_rusage": jid % 3,
        "num_gpu_rusages": F.col("num_gpu_rusages"),
    }
    # each of the other groups has values in every seventh job, on its own turn
    others = [names[t] for t in spec if names[t] not in counts]
    counts |= {name: F.when(jid % 7 == k, jid % 3).otherwise(0) for k, name in enumerate(others)}
    arrays = tpl.array_columns()
    # Runs of fixed tokens are plain strings; only groups with a count that
    # varies by job need an array expression.
    pieces: list[Column] = []
    run: list[Column] = []
    for t, name in enumerate(names):
        if t in arrays:
            continue
        if t in spec:
            cnt = counts[name]
            tok = cnt.cast("string")
            if name == "num_ex_hosts":
                tok = F.when(dmg == 12, _q(F.lit("many"))).otherwise(tok)
            run.append(tok)
            pieces.append(F.concat_ws(" ", *run))
            run = []
            pieces.append(_group_text(cnt, spec[t],
                                      lambda m, j, _n=name: _q(F.concat(F.lit(f"{_n}.{j} "), m.cast("string")))))
            continue
        if name in known:
            run.append(known[name])
        else:
            run.append(F.lit("0") if tpl.kind(t) in ("bigint", "double") else F.lit('""'))
    if run:
        pieces.append(F.concat_ws(" ", *run))
    head, rest = pieces[0], pieces[1:]
    # concat_ws skips empty groups' empty strings only when NULL: map '' -> NULL.
    body = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in rest])
    staged = jobs_df.select(dmg.alias("_d"), head.alias("_h"), body.alias("_b"))
    line = (F.when(F.col("_d") == 8, F.concat_ws("  ", "_h", "_b"))
            .otherwise(F.concat_ws(" ", "_h", "_b")))
    line = F.when(F.col("_d") == 7, F.concat(line, F.lit(' "extra"'))).otherwise(line)
    line = F.when(F.col("_d") == 11, F.substring(line, F.lit(2), F.length(line))).otherwise(line)
    return staged.select(line.alias("value"))


def resize_lines(jobs_df: DataFrame) -> DataFrame:
    """Render each job row as one resize record (column ``value``)."""
    jid = F.col("job_id")

    def group(count: Column, name: str) -> list[Column]:
        text = _group_text(count, 1, lambda m, j: _q(F.concat(F.lit(f"{name} "), m.cast("string"))))
        return [count.cast("string"), F.nullif(text, F.lit(""))]

    return jobs_df.select(F.concat_ws(
        " ", _q(F.lit("JOB_RESIZE")), "event_time", jid, "idx", "start_time", "user_id", _q(F.col("user_name")),
        F.lit("1"), "submit_time", *group(jid % 4, "exec host"), *group(jid % 3, "new host"),
        *group(jid % 2, "slots"), *group((jid + 1) % 3, "new slots")).alias("value"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_lines(log_jobs(spark, sf_dir))


def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as CSV lines (column ``value``) with quotes and commas in the command;
    the memory of every 17th event is no number."""
    j = jobs(spark, sf_dir)
    command = F.concat(F.lit('sh -c "x,'), F.col("job_id").cast("string"), F.lit('" z'))
    mem = F.when(F.col("user_id") % 17 == 0, F.lit("abc")).otherwise(F.col("avg_mem").cast("string"))
    return j.select(F.concat_ws(",", F.col("job_id").cast("string"), "idx", _q(command),
                                F.coalesce("queue", F.lit("")), mem).alias("value"))


# ---------------------------------------------------------------------------
# hosts
# ---------------------------------------------------------------------------

def hosts_text(spark: SparkSession, sf_dir: str,
               per_line: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Ragged ``group,node,...`` and ``queue,group,...`` lines (column ``value``).

    A key with many members is written over several lines of at most
    ``per_line`` members (chunked by member key), so no line - and no task
    building it - has to hold an unbounded list. Readers union the lines.

    Every fifth supplier belongs to the next nation's group too, and the group
    of nation 7 has no nodes, so that shared nodes and orphan groups exist.
    """
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    region = table(spark, sf_dir, "region")
    own = F.array(F.col("s_nationkey"), F.when(F.col("s_suppkey") % 5 == 0, (F.col("s_nationkey") + 1) % 25))
    member = (supplier.select("s_suppkey", "s_name", F.explode(F.array_compact(own)).alias("n_nationkey"))
              .where("n_nationkey <> 7"))
    group_nodes = (nation.join(member, "n_nationkey")
                   .groupBy("n_name", F.floor(F.col("s_suppkey") / per_line).alias("_chunk"))
                   .agg(F.array_sort(F.collect_list("s_name")).alias("nodes"))
                   .select(F.concat_ws(",", "n_name", "nodes").alias("value")))
    queue_groups = (region.join(nation, region.r_regionkey == nation.n_regionkey)
                    .groupBy("r_name", F.floor(F.col("n_nationkey") / per_line).alias("_chunk"))
                    .agg(F.array_sort(F.collect_list("n_name")).alias("groups"))
                    .select(F.concat_ws(",", "r_name", "groups").alias("value")))
    return group_nodes, queue_groups
