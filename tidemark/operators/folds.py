"""Per-key computations that walk rows in order, on chunks with a halo.

A recursion over a key's whole history (an average that forgets geometrically, an object that lives a
bounded number of rows) is started ``before`` rows ahead of the chunk. What the missing past would
still weigh there is below a double's precision, or nothing, so chunks of a key run in different tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.scan import with_halo

#: Rows after which a Wilder average over 50 rows has forgotten its start to 1e-16.
FORGET = 2048
CHUNK = 1 << 15


def chunk_fold(rows: DataFrame, keys: list[str], number: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, before: int = FORGET, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Apply ``fn`` to each chunk of a key's rows, sorted by ``number`` (1, 2, ...), halo included.

    ``fn`` gets the rows of one chunk and returns rows with a column ``number`` and the columns of
    ``schema``; only those that fall on the chunk's own rows are kept, the keys are added. The first
    chunk of a key starts at its first row. Arrow carries the batches; a chunk has at most
    ``chunk + before + after`` rows whatever the key's size.
    """
    d = with_halo(rows, keys, number, before=before, after=after, chunk=chunk)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(number, kind="stable").reset_index(drop=True)
        out = fn(pdf)
        lo, hi = pdf.loc[pdf["_own"] == pdf["_chunk"], number].agg(["min", "max"])
        out = out[(out[number] >= lo) & (out[number] <= hi)]
        head = pd.DataFrame({k: [pdf[k].iloc[0]] * len(out) for k in keys})
        return typed(pd.concat([head, out[[number, *names]].reset_index(drop=True)], axis=1), full)

    full = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{number} {kinds[number]}", schema])
    # a chunk that is only halo (a key of exactly one chunk's length) has no own rows
    return d.groupBy(*keys, "_chunk").applyInPandas(lambda pdf: run(pdf) if (pdf["_own"] == pdf["_chunk"]).any() else _none(full), full)


#: Types of columns that frames are given before they leave a task; nulls are allowed in all of them.
_KINDS = {"string": object, "long": "Int64", "bigint": "Int64", "int": "Int32", "double": "float64", "boolean": object}


def typed(d: pd.DataFrame, schema: str) -> pd.DataFrame:
    """``d`` with the columns and types of ``schema`` ("name type, ..."), text as plain objects."""
    kinds = dict(c.strip().split(" ") for c in schema.split(","))
    return pd.DataFrame({c: pd.Series(d[c].to_numpy(object) if k in ("string", "boolean") else d[c].to_numpy(), dtype=_KINDS[k]) for c, k in kinds.items()})


def _none(schema: str) -> pd.DataFrame:
    return typed(pd.DataFrame({c.strip().split(" ")[0]: [] for c in schema.split(",")}), schema)


def linear_recursion(x: np.ndarray, a: float, b: float, start: float) -> np.ndarray:
    """y[i] = a * y[i - 1] + b * x[i] with y[-1] = ``start``, in blocks of matrix products."""
    n, size = len(x), 64
    if not n:
        return np.zeros(0)
    k = np.arange(size)
    toeplitz = np.where(k[:, None] >= k[None, :], b * a ** np.maximum(k[:, None] - k[None, :], 0.0), 0.0)
    local = np.pad(x, (0, -n % size)).reshape(-1, size) @ toeplitz.T
    decay, out, last = a ** (k + 1.0), np.empty_like(local), start
    for i, row in enumerate(local):
        out[i] = row + decay * last
        last = out[i, -1]
    return out.reshape(-1)[:n]


def seeded(x: np.ndarray, n: int, a: float) -> np.ndarray:
    """Average that starts with the mean of the first ``n`` values and then forgets by ``a`` a row.

    Values before the first ``n`` are NaN.
    """
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        out[n:] = linear_recursion(x[n:], a, 1 - a, out[n - 1])
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, n, 1 - 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, n, 1 - 1 / n)
