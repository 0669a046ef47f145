"""Queries over order-dependent operators: orders as singular values, events as series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ordered as od
from ..session import table


def _sigmas(s, d):
    o = table(s, d, "orders").select((F.col("o_custkey") % 200).alias("key"), F.round(F.col("o_totalprice")).alias("sigma"), "o_orderkey")
    return o.select("key", "sigma", (F.row_number().over(W.partitionBy("key").orderBy(F.desc("sigma"), "o_orderkey")) - 1).alias("ord"))


_S = "(SELECT o_custkey % 200 AS key, round(o_totalprice) AS sigma, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY round(o_totalprice) DESC, o_orderkey) - 1 AS ord FROM orders)"


def _values(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("re"), ((F.col("event_id") * 37) % 101 - 50).cast("double").alias("im"))


_V = "(SELECT event_id AS id, value AS re, CAST((event_id * 37) % 101 - 50 AS DOUBLE) AS im FROM events)"
_MEASURE = {"magn": "sqrt(re * re + im * im)", "real": "re", "imag": "abs(im)", "alge": "re"}


def _rule(rule: str):
    end, _, m = rule.partition("_")
    way = "DESC" if end == "largest" else "ASC"
    return (
        lambda s, d: od.select_values(_values(s, d), rule, 12),
        f"SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY {_MEASURE[m]} {way}, id) - 1 AS INT) AS ord, id, re, im FROM {_V}) WHERE ord < 12",
    )


QUERIES = {
    "truncation_rank_euclid": (lambda s, d: od.truncation_rank(_sigmas(s, d), 0.5), f"SELECT key, count(*) FILTER (sigma > 0.5 * m) AS rank FROM (SELECT *, max(sigma) OVER (PARTITION BY key) AS m FROM {_S}) GROUP BY key"),
    "truncation_rank_frobenius": (
        lambda s, d: od.truncation_rank(_sigmas(s, d), 0.5, frobenius=True),
        f"SELECT key, count(*) FILTER (tail > 0.25 * total) AS rank FROM (SELECT *, sum(sigma * sigma) OVER (PARTITION BY key ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail, sum(sigma * sigma) OVER (PARTITION BY key) AS total FROM {_S}) GROUP BY key",
    ),
    **{f"eigenvalue_select_{r}": _rule(r) for r in ("largest_magn", "largest_real", "largest_imag", "largest_alge", "smallest_magn", "smallest_real", "smallest_imag", "smallest_alge")},
    "eigenvalue_select_both_ends": (
        lambda s, d: od.select_values(_values(s, d), "both_ends", 12),
        f"SELECT * FROM (SELECT CAST(2 * (row_number() OVER (ORDER BY re DESC, id) - 1) AS INT) AS ord, id, re, im FROM {_V} UNION ALL SELECT CAST(2 * row_number() OVER (ORDER BY re, id) - 1 AS INT), id, re, im FROM {_V}) WHERE ord < 12",
    ),
    "topk_per_key": (
        lambda s, d: od.top_per_key(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", [F.desc("value"), F.col("event_id")], 3),
        "SELECT * FROM (SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS INT) AS ord FROM events) WHERE ord < 3",
    ),
    "lagged_history": (
        lambda s, d: od.lagged(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 2).select("user_id", "event_id", F.col("history")[0].alias("h1"), F.col("history")[1].alias("h2")),
        "SELECT * FROM (SELECT user_id, event_id, lag(value, 1) OVER w AS h1, lag(value, 2) OVER w AS h2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE h2 IS NOT NULL",
    ),
    "pivot_selection": (
        lambda s, d: _pivot(s, d),
        "SELECT l_partkey AS row, CAST(sum(l_quantity) AS DOUBLE) AS val FROM lineitem WHERE l_suppkey = 3 GROUP BY l_partkey ORDER BY val DESC, row LIMIT 1",
    ),
    "checkpoint_durations": (
        lambda s, d: od.history_durations(table(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").cast("string").alias("label"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))),
        "SELECT user_id AS run, CAST(event_id AS VARCHAR) AS label, epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)), epoch_us(ts)) AS lap, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS total FROM events",
    ),
}


def _pivot(s, d):
    from .linalg_queries import matrix

    return od.pivot_row(matrix(s, d), 3)
