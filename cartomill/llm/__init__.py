"""Training-data operators.  Nothing outside this subpackage imports it."""

import os

# Tasks share the cores; matrix products here are too small to gain from further threads.
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
