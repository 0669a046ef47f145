"""gridloom: a PySpark-native engine for scientific and geometric analytics.

Sparse and block-structured linear algebra, neighbour joins, clustering,
admissibility statistics, interpolation, stencil weights and iterative
solvers, all expressed over DataFrames.
"""

from .blas import single_threaded

single_threaded()
