"""Line numbers of rejected lines: files cut into many blocks, several files, both parse engines."""

import pytest

from clusterlens.operators import parse as P
from clusterlens.plans import fixtures as fx
from clusterlens.sources.logs import PLACE, read_placed
from clusterlens.sources.tables import compute


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_every_reject_has_its_file_and_line(spark, tmp_path, engine):
    lines = [r.value for r in compute(fx.lines(spark, "/root/testdata/sf0.001"), "lines").collect()]
    lines[17] = ""
    (tmp_path / "logs").mkdir()
    files = {"a.log": lines[:400], "b.log": lines[400:520], "empty.log": []}
    for name, part in files.items():
        (tmp_path / "logs" / name).write_text("".join(x + "\n" for x in part))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # many blocks in each file
    try:
        placed = read_placed(spark, str(tmp_path / "logs"))
        assert placed.select("file", "block").distinct().count() > 5
        parsed = compute(P.parse_log(placed, fields=["job_id"], carry=PLACE, engine=engine), "parsed")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r.file.rsplit("/", 1)[1], r.line_number): (r.status, r.line) for r in P.reject_places(parsed).collect()}
    plain = P.parse_log(spark.createDataFrame([(x,) for part in files.values() for x in part], "value string"), fields=[])
    assert len(got) == plain.where("status <> 'ok'").count() > 30
    assert all(files[name][n - 1] == line for (name, n), (_, line) in got.items())
    assert ("a.log", 18) in got
    assert sorted(s for s, _ in got.values()) == sorted(r.status for r in plain.where("status <> 'ok'").collect())
