"""Runs of constant usage against the series by the second; totals over windows; pools of queues."""

import random

from clusterlens.operators import pools, runs
from clusterlens.operators import series as S

COLS = ("job_id long, queue string, approx_start long, approx_end long, num_processors long, avg_mem long, "
        "run_time long, ineligible_pend_time long, num_gpu_rusages long")


def _jobs(spark, n=80):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", None]), s, s + rnd.choice([0, 1, 7, 300, -4]), rnd.randrange(4), -1, 2, 3, 0)
            for i, s in ((i, rnd.randrange(4000)) for i in range(n))]
    return spark.createDataFrame(rows, COLS)


def _plain(df):
    """queue and second -> cpus, by marking every second of every job."""
    out = {}
    for r in df.collect():
        for t in range(r.approx_start, r.approx_end + 1):
            out[r.queue, t] = out.get((r.queue, t), 0) + r.num_processors
    return out


def test_runs_expand_to_the_series_by_the_second(spark):
    df = _jobs(spark)
    found = runs.usage_runs(df, clamp=False)
    want = _plain(df)
    got = {(r.queue, r.second): r.cpus for r in runs.run_ticks(found).collect()}
    assert got == want
    series = S.usage_series(df, step=1, clamp=False)
    ticks = runs.run_ticks(found).select(*series.columns)
    assert sorted(map(str, series.collect())) == sorted(map(str, ticks.collect()))
    coarse = {(r.queue, r.second): r.cpus for r in runs.run_ticks(found, step=7, offset=3).collect()}
    assert coarse == {k: v for k, v in want.items() if k[1] % 7 == 3}
    assert found.count() <= 2 * df.count()


def test_clamped_runs_and_no_jobs(spark):
    df = _jobs(spark)
    first = spark.createDataFrame([(2000,)], "first_event long")
    got = {(r.queue, r.second): r.cpus for r in runs.run_ticks(runs.usage_runs(df, first=first)).collect()}
    assert got == {k: v for k, v in _plain(df).items() if k[1] >= 2000}
    assert runs.usage_runs(df.limit(0)).count() == 0


def test_a_job_of_years_is_one_run(spark):
    df = spark.createDataFrame([(1, "q", 0, 10 ** 9, 5, 1, 1, 1, 1), (2, "q", 0, 9 * 10 ** 18, 1, 1, 1, 1, 1)], COLS)
    found = runs.usage_runs(df, clamp=False)
    assert [(r["from"], r["to"], r.jobs, r.cpus) for r in found.collect()] == [(0, 10 ** 9 + 1, 1, 5)]
    windows = spark.createDataFrame([("q", 10, 10 + 10 ** 8)], 'queue string, `from` long, `to` long')
    assert [(r.seconds, int(r.cpus)) for r in runs.usage_at(found, windows).collect()] == [(10 ** 8, 5 * 10 ** 8)]


def test_totals_of_windows(spark):
    df, rnd = _jobs(spark), random.Random(2)
    want = _plain(df)
    spans = [(rnd.choice(["a", "b", None, "none"]), f, f + rnd.choice([0, 1, 50, 3000, -7]))
             for f in (rnd.randrange(-100, 4500) for _ in range(40))]
    spans += [spans[0], ("a", None, 5)]
    windows = spark.createDataFrame(spans, 'queue string, `from` long, `to` long').repartition(3)
    for width in (86_400, 60):
        got = runs.usage_at(runs.usage_runs(df, clamp=False), windows, bin_seconds=width).collect()
        key = lambda t: tuple(map(str, t))
        assert sorted(((r.queue, r["from"], r["to"], r.seconds, int(r.cpus)) for r in got), key=key) == sorted((
            (q, f, t, sum((q, x) in want for x in range(f or 0, t if f is not None else 0)),
             sum(want.get((q, x), 0) for x in range(f or 0, t if f is not None else 0))) for q, f, t in spans), key=key)


def _components(pairs):
    label = {q: q for q, _ in pairs}
    while True:
        node = {}
        for q, n in pairs:
            node[n] = min(node.get(n, label[q]), label[q])
        new = {q: min(node[n] for q2, n in pairs if q2 == q) for q in label}
        if new == label:
            return label
        label = new


def test_pools_of_chains_and_shared_nodes(spark):
    rnd = random.Random(6)
    pairs = {(f"q{i:02}", f"n{i}") for i in range(20)} | {(f"q{i:02}", f"n{i + 1}") for i in range(19) if i != 8}
    pairs |= {(f"z{rnd.randrange(6)}", f"m{rnd.randrange(12)}") for _ in range(10)}
    df = spark.createDataFrame([*pairs, *pairs, (None, "n3"), ("lone", None)], "queue string, node string")
    got = {r.queue: r.pool for r in pools.pools(df).collect()}
    assert got == _components(sorted(pairs))
    assert got["q08"] == "q00" and got["q19"] == "q09"
    assert pools.pools(df.limit(0)).count() == 0


def test_a_shared_node_counts_once(spark):
    qn = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "3")], "queue string, node string")
    pool_of = pools.pools(qn)
    cores = pools.pool_cores(qn, pool_of, 10)
    assert {r.pool: (r.n_queues, r.n_nodes, r.total_cores) for r in cores.collect()} == {"a": (2, 2, 20), "c": (1, 1, 10)}
    series = spark.createDataFrame([("a", 0, 6), ("b", 0, 9), ("c", 0, 5), (None, 0, 1)], "queue string, second long, cpus long")
    got = {r.pool: (r.cpus, r.utilisation) for r in pools.pool_utilisation(series, pool_of, cores).collect()}
    assert got == {"a": (15, 0.75), "c": (5, 0.5)}
