"""One BLAS thread per process: tasks already use every core, and small solves on the driver gain nothing from more."""

from __future__ import annotations

import ctypes
import re
import sys

NAMES = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


def single_thread() -> None:
    """Tell a loaded OpenBLAS to use one thread; without one, nothing happens."""
    if sys.__dict__.get("_corpusloom_blas"):
        return
    sys.__dict__["_corpusloom_blas"] = True
    try:
        with open("/proc/self/maps") as f:
            paths = {m.group() for m in re.finditer(r"/\S*openblas\S*\.so\S*", f.read())}
        for path in paths:
            lib = ctypes.CDLL(path)
            for name in NAMES:
                if hasattr(lib, name):
                    getattr(lib, name)(ctypes.c_int(1))
                    break
    except OSError:
        pass
