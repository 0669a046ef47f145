"""The registered queries on the smallest tables: against SQL where there is any, and the pipeline stage by stage."""

import pytest
from oracle import assert_same, views

from gridloom.llm import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF).toPandas(), views(SF).sql(SQL[name]).df())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts[1] > 0.7 * counts[0] and counts[2] > 0.7 * counts[1] and counts[3] == counts[2]
    assert corpus_pipeline.run(spark, SF).count() > 0


ODD = [(1, "a b c d e f g " * 9, "en", "a", 126), (1, "a b c d e f g " * 9, "en", "a", 126), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id here at all", "en", "a", 17), (4, "été " * 30000, "fr", "a", 120000), (5, "x", None, "b", 1)]


@pytest.mark.parametrize("rows, labels", [(ODD, [(1, 0, 0), (4, 1, None), (99, 0, 1), (None, 0, 1)]), (ODD, []), ([], [])])
def test_pipeline_on_odd_tables(spark, tmp_path, rows, labels):
    """Nulls in any column, empty and long texts, repeated rows, labels of nobody or none, and empty tables."""
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} <= {r[0] for r in rows}
    for s in {r["sequence_id"] for r in pieces}:
        mine = sorted((r["offset"], r["length"]) for r in pieces if r["sequence_id"] == s)
        assert [o for o, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))] and sum(n for _, n in mine) <= 2048
