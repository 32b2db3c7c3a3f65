"""Whole tickers in Arrow batches: what is computed by ticker in Python pays for conversions once a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def starts(t: pa.Table, key: str = "ticker") -> np.ndarray:
    """Where each key's rows begin; equal keys stand together."""
    codes = pc.fill_null(pc.dictionary_encode(t[key].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.diff(codes, prepend=codes[0] - 1)) if len(codes) else np.array([], int)


def whole(batches: Iterable[pa.RecordBatch], key: str = "ticker") -> Iterator[pa.Table]:
    """The batches cut anew: no key's rows lie in two. At most one batch and one key's rows are held."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if rest and rest[-1][key][-1].as_py() != b[key][0].as_py():
            yield pa.Table.from_batches(rest)
            rest = []
        cut = int(starts(pa.Table.from_batches([b]), key)[-1])
        if cut:
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def numbers(t: pa.Table, column: str) -> np.ndarray:
    """A column as doubles; null is NaN."""
    return t[column].cast(pa.float64()).to_numpy()


def day_numbers(t: pa.Table, column: str = "date") -> np.ndarray:
    """A column of dates without nulls as days since 1970."""
    return t[column].cast(pa.int32()).to_numpy().astype("int64")


def by_ticker(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` over tables of whole tickers, each ticker's rows in order of their dates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches):
            yield from f(t.combine_chunks()).to_batches()

    return df.repartition("ticker").sortWithinPartitions("ticker", "date").mapInArrow(run, schema)
