"""The jobs: against SQL, over growing input on copies, again after a failure, and with configs."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from oracle import assert_same, views
from pyspark.sql import functions as F

from jobs import neighbour_blocks, queries, term_matrix
from jobs.common import config

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    settings = lambda: {k: v for k, v in ((r["key"], r["value"]) for r in spark.sql("SET").collect()) if k.startswith("spark.sql.")}
    before = settings()
    assert_same(queries.queries()[name](spark, SF).toPandas(), views(SF).sql(queries.oracle_sql()[name]).df())
    assert settings() == before


def rows(df):
    return Counter(map(tuple, df.collect()))


def expected(texts):
    """(row, word) counts of rows (doc_id, text)."""
    out = Counter()
    for i, t in texts:
        for w in (t or "").encode().split():
            out[i, bytes(b + 32 if 65 <= b <= 90 else b for b in w).decode()] += 1
    return out


def matrix(spark, target):
    return {(r["row"], r["col"]): r["val"] for r in spark.read.parquet(f"{target}/matrix").collect()}


def add(spark, folder, texts, files=2):
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(files).write.mode("append").parquet(folder)


def test_growing_input(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))
    settings = {"rows_per_block": 10, "files_per_batch": 2}
    first = [(1, "A a b"), (2, "b\tc\x0bB"), (25, "far é É away"), (3, None), (4, "")]
    second = [(1, "a new"), (None, "nobody's words words"), (26, "far"), (2, "\x85 \xa0x")]
    add(spark, source, first)
    got = term_matrix.run(spark, source, target, checkpoint, settings)
    assert got["documents"] == 5 and matrix(spark, target) == expected(first)
    untouched = sorted(p.name for p in (tmp_path / "target/matrix/block=2").iterdir())
    assert term_matrix.run(spark, source, target, checkpoint, settings) == {"batches": 0, "documents": 0, "entries": 0, "blocks": 0}
    add(spark, source, [second[0], second[1]])
    got = term_matrix.run(spark, source, target, checkpoint, settings)
    assert got["documents"] == 2 and got["blocks"] == 2
    assert sorted(p.name for p in (tmp_path / "target/matrix/block=2").iterdir()) == untouched  # no new rows in that block
    add(spark, source, second[2:], files=5)  # several batches
    assert term_matrix.run(spark, source, target, checkpoint, settings)["batches"] > 1
    whole = expected(first + second)
    assert matrix(spark, target) == whole
    columns = {r["col"]: (r["n_rows"], r["total"], r["norm2"]) for r in spark.read.parquet(f"{target}/columns").collect()}
    for word in {w for _, w in whole}:
        mine = [v for (_, w), v in whole.items() if w == word]
        assert columns[word] == (len(mine), sum(mine), sum(v * v for v in mine))
    assert len(columns) == len({w for _, w in whole})
    with pytest.raises(ValueError, match="another checkpoint"):
        term_matrix.run(spark, source, target, str(tmp_path / "other"), settings)


@pytest.mark.parametrize("step", ["assemble_blocks", "add_up_columns"])
def test_failure_within_a_batch(spark, tmp_path, monkeypatch, step):
    """What a failed run has written is written again, not twice."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))
    texts = [(i, f"word{i % 3} common Common") for i in range(40)]
    add(spark, source, texts)
    real = getattr(term_matrix, step)

    def failing(*args):
        real(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(term_matrix, step, failing)
    with pytest.raises(Exception, match="lost"):
        term_matrix.run(spark, source, target, checkpoint)
    monkeypatch.undo()
    term_matrix.run(spark, source, target, checkpoint)
    assert matrix(spark, target) == expected(texts)
    assert {r["col"]: r["total"] for r in spark.read.parquet(f"{target}/columns").collect()}["common"] == 80


@pytest.mark.parametrize("texts", [[], [(1, None), (2, " \n"), (None, "")]])
def test_nothing_to_assemble(spark, tmp_path, texts):
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))
    add(spark, source, texts, files=1)
    for _ in range(2):
        term_matrix.run(spark, source, target, checkpoint)
    assert term_matrix.output(spark, target).count() == 0
    add(spark, source, [(5, "now")], files=1)
    term_matrix.run(spark, source, target, checkpoint)
    assert term_matrix.output(spark, target).count() == 2


def test_points_of_other_formats(spark, tmp_path):
    table = [(i, float(i % 7), float(i // 7), None) for i in range(60)] + [(3, 3.0, 0.0, None), (None, 1.0, 1.0, None), (99, None, 1.0, None), (98, float("nan"), 1.0, None)]
    df = spark.createDataFrame(table, "node long, x double, y double, cluster string")
    results = []
    for form in ("csv", "json", "orc"):
        df.write.format(form).option("header", True).save(str(tmp_path / form))
        settings = {"format": form, "id": "node", "coordinates": ["x", "y"], "neighbours": 5, "leaf_size": 10}
        got = neighbour_blocks.run(spark, str(tmp_path / form), str(tmp_path / "out" / form), settings)
        assert got["rows"] == 64 and got["points"] == 60 and got["clusters"] > 4
        results.append(rows(neighbour_blocks.output(spark, str(tmp_path / "out" / form))))
        neighbour_blocks.run(spark, str(tmp_path / form), str(tmp_path / "out" / form), settings)
        assert rows(neighbour_blocks.output(spark, str(tmp_path / "out" / form))) == results[-1]
    assert results[0] == results[1] == results[2]
    empty = df.limit(0)
    empty.write.parquet(str(tmp_path / "none"))
    assert neighbour_blocks.run(spark, str(tmp_path / "none"), str(tmp_path / "out/none"), {"id": "node", "coordinates": ["x", "y"]})["blocks"] == 0
    assert neighbour_blocks.output(spark, str(tmp_path / "out/none")).count() == 0


def test_configs(spark, tmp_path):
    here = Path(__file__).parents[1] / "jobs"
    for job in (term_matrix, neighbour_blocks):
        assert config(spark, str(here / f"{job.__name__.split('.')[1]}.json"), job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "odd.json").write_text(json.dumps({"rows": 3}))
    with pytest.raises(ValueError, match="rows"):
        config(spark, str(tmp_path / "odd.json"), term_matrix.DEFAULTS)
    (tmp_path / "type.json").write_text(json.dumps({"rows_per_block": "3"}))
    with pytest.raises(ValueError, match="rows_per_block"):
        config(spark, str(tmp_path / "type.json"), term_matrix.DEFAULTS)


def test_command_line(spark, tmp_path):
    add(spark, str(tmp_path / "source"), [(7, "one two two")], files=1)
    here = Path(__file__).parents[1]
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.term_matrix", *(str(tmp_path / n) for n in ("source", "target", "checkpoint")), "--config", str(here / "jobs/term_matrix.json")], cwd=here, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr
        assert "contributed" in done.stderr
    assert matrix(spark, str(tmp_path / "target")) == {(7, "one"): 1, (7, "two"): 2}
