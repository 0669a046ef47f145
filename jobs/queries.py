"""The jobs as registered queries: each runs twice over the whole tables into one new folder, and gives what stands there then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.session import shared_folder

from . import neighbour_blocks, term_matrix


def job1_term_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        term_matrix.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/target", f"{folder}/checkpoint")
    return term_matrix.output(spark, f"{folder}/target")


def job2_neighbour_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        neighbour_blocks.run(spark, f"{sf_dir}/embeddings.parquet", f"{folder}/target")
    return neighbour_blocks.output(spark, f"{folder}/target")


_TERMS = r"""
WITH words AS (SELECT doc_id AS row, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')) AS term FROM documents),
entries AS (SELECT row, term, CAST(count(*) AS DOUBLE) AS val FROM words WHERE term <> '' GROUP BY row, term)
SELECT 'entry' AS part, CAST(coalesce(floor(row / 500.0), -1) AS BIGINT) AS block, row, term, CAST(1 AS BIGINT) AS n_rows, val AS total, val * val AS norm2 FROM entries
UNION ALL SELECT 'column', -1, -1, term, count(*), sum(val), sum(val * val) FROM entries GROUP BY term
"""


def _blocks_sql() -> str:
    s = neighbour_blocks.DEFAULTS
    cuts = "n0 AS (SELECT id, x[1] AS x, x[2] AS y, CAST(1 AS BIGINT) AS node FROM p)"
    for i in range(s["levels"]):
        cuts += f""", b{i} AS (SELECT node, count(*) AS n, max(x) - min(x) AS ex, max(y) - min(y) AS ey, (max(x) + min(x)) * 0.5 AS mx, (max(y) + min(y)) * 0.5 AS my FROM n{i} WHERE node >= {1 << i} GROUP BY node),
        n{i + 1} AS (SELECT id, x, y, CASE WHEN b.node IS NULL OR n <= {s["leaf_size"]} OR greatest(ex, ey) <= 0 THEN q.node
            ELSE 2 * q.node + CASE WHEN ex >= ey THEN CASE WHEN x >= mx THEN 1 ELSE 0 END ELSE CASE WHEN y >= my THEN 1 ELSE 0 END END END AS node FROM n{i} q LEFT JOIN b{i} b USING (node))"""
    return f"""
WITH p AS (SELECT vec_id AS id, [CAST(e AS DOUBLE) FOR e IN embedding] AS x FROM embeddings),
d AS (SELECT a.id, b.id AS nbr, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.x, b.x)]) AS d2 FROM p a, p b),
k AS (SELECT id, nbr FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nbr) AS r FROM d) WHERE r <= {s["neighbours"]} AND id <> nbr),
g AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT id AS src, nbr AS dst FROM k UNION ALL SELECT nbr, id FROM k) GROUP BY src, dst),
{cuts},
c AS (SELECT id, node AS cluster, row_number() OVER (ORDER BY node, id) - 1 AS pos FROM n{s["levels"]}),
e AS (SELECT a.pos AS row, b.pos AS col, w AS val, a.cluster AS row_cluster, b.cluster AS col_cluster FROM g JOIN c a ON a.id = src JOIN c b ON b.id = dst),
l AS (SELECT row AS pos, count(*) AS n_linked, bool_or(row_cluster <> col_cluster) AS interface FROM e GROUP BY row),
m AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster),
t AS (SELECT row_cluster, col_cluster, count(*) AS n_entries, count(DISTINCT row) AS n_rows, count(DISTINCT col) AS n_cols FROM e GROUP BY ALL),
f AS (SELECT t.*, (a.n * b.n) // (2 * (a.n + b.n)) AS rank_limit FROM t JOIN m a ON a.cluster = row_cluster JOIN m b ON b.cluster = col_cluster)
SELECT 'node' AS part, cluster AS row_cluster, cluster AS col_cluster, pos AS row, id AS col, coalesce(n_linked, 0) AS n, CAST(0 AS BIGINT) AS rank_limit, coalesce(interface, false) AS flag FROM c LEFT JOIN l USING (pos)
UNION ALL SELECT 'entry', row_cluster, col_cluster, row, col, CAST(val AS BIGINT), 0, row_cluster <> col_cluster FROM e
UNION ALL SELECT 'block', row_cluster, col_cluster, n_rows, n_cols, n_entries, rank_limit, least(n_rows, n_cols) < rank_limit AND least(n_rows, n_cols) <= {s["most_rank"]} FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_term_matrix": job1_term_matrix, "job2_neighbour_blocks": job2_neighbour_blocks}


def oracle_sql() -> dict[str, str]:
    return {"job1_term_matrix": _TERMS, "job2_neighbour_blocks": _blocks_sql()}
