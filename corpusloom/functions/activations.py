"""Activations of hidden layers as column expressions and as functions of arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

COLUMNS = {
    "identity": lambda x: x,
    "tanh": F.tanh,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
}
ARRAYS = {
    "identity": lambda x: x,
    "tanh": np.tanh,
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "relu": lambda x: np.maximum(x, 0.0),
}
#: Numeric codes under which activations are also known.
CODES = {1: "tanh", 2: "sigmoid", 3: "relu"}


def activation(name: str | int, x: Column) -> Column:
    return COLUMNS[CODES.get(name, name)](x)
