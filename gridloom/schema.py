"""Schemas of the engine's data model.

A sparse matrix is a table of (row, col, val), a vector of (idx, v), points are
(id, x array), graphs are (src, dst, w), cluster trees and block trees are
tables of nodes with parent links.
"""

from __future__ import annotations

COO = "row long, col long, val double"
VECTOR = "idx long, v double"
POINTS = "id long, x array<double>"
NEIGHBOURS = "id long, ord int, nbr long, d2 double"
NODES = "id long, x array<double>, type int, normal array<double>"
WEIGHTS = "op string, node long, ord int, nbr long, w double"
EDGES = "src long, dst long, w double"
TREE = "node_id long, parent long, level int, size long, bmin array<double>, bmax array<double>, leaf boolean"
BLOCKS = "block_id long, row_node long, col_node long, level int, admissible boolean, leaf boolean"
