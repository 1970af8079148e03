"""Arrow functions for what no built-in expression does."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lectern.shipping import ship

#: What a function over Arrow batches gets at once, if a single row is not more.
SLICE_ROWS, SLICE_BYTES = 1000, 1 << 20


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def slices(columns: list[pa.Array]) -> Iterator[list[pa.Array]]:
    """Columns of a batch cut by halves until a part has few rows and bytes, whatever its longest rows are."""
    n = len(columns[0])
    if n > 1 and (n > SLICE_ROWS or sum(c.nbytes for c in columns) > SLICE_BYTES):
        yield from slices([c.slice(0, n // 2) for c in columns])
        yield from slices([c.slice(n // 2) for c in columns])
    else:
        yield columns


def _as_arrow(values: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pd.DataFrame):
        return pa.StructArray.from_arrays([_as_arrow(values[f.name], f.type) for f in kind], fields=list(kind))
    return pa.Array.from_pandas(values, type=kind)


def sliced(function: Callable, returns: str) -> Callable:
    """``function`` of pandas columns as one over an iterator of Arrow batches, which it gets and gives slice by slice."""

    kind = to_arrow_type(T.DataType.fromDDL(returns))

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(list(batch) if isinstance(batch, tuple) else [batch]):
                yield _as_arrow(function(*[c.to_pandas() for c in part]), kind)

    return run


def arrow_udf(function: Callable, returns: str, *columns: Column) -> Column:
    """``function`` of this package over Arrow batches; it goes along to the workers of the active session.

    Spark's batches have 10,000 rows or 64 MB, of which a worker would hold its objects and results many times over; the function
    sees slices of them, and results leave slice by slice.
    """
    ship(SparkSession.active())
    return F.arrow_udf(sliced(function, returns), returns, F.ArrowUDFType.SCALAR_ITER)(*columns)


def nfc_udf(text: Column) -> Column:
    """Unicode normalisation form C."""
    return arrow_udf(_nfc, "string", text)


def fixed_1(count: Column, unit: int) -> Column:
    """An integer over ``unit`` (a multiple of 20) with one decimal, halves of the quotient's exact binary value rounded up.

    Only a quotient of an odd number of twentieths can be a half. Whether the nearest double lies below it is seen
    from its rest, which doubles give exactly up to 2^53: both differences are of numbers within a factor of two.
    """
    step = unit // 10
    whole, rest = F.floor(count / step), count % step
    odd, near = (whole * 2 + 1).cast("double"), count.cast("double") / unit
    up = (rest * 2 > step) | ((rest * 2 == step) & ((odd - near * 16) - near * 4 <= 0))
    tenths = whole + up.cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once, whatever is done with them later.

    A filter on a plain column is moved below it, where the column's expression, and Python functions in it, would run
    a second time; nothing is moved below a generator.
    """
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
