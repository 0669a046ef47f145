"""One thread for numpy's linear algebra: Spark runs a task on each core, and BLAS threads don't survive the fork that starts a JVM or a worker."""

from __future__ import annotations

import ctypes
import os
from pathlib import Path


def single_threaded() -> None:
    """Takes effect whether or not numpy has been imported; nothing happens where its library isn't found."""
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    import numpy

    for path in sorted((Path(numpy.__file__).parent.parent / "numpy.libs").glob("*openblas*")):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break
