"""Arrow UDFs made from plain functions: one call for a whole batch of values, never one for each row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def arrow_type(ddl: str) -> pa.DataType:
    return to_arrow_type(_parse_datatype_string(ddl))


#: Bytes of arguments whose results are Python objects at a time, and their rows at most: results may be many times as large.
PIECE_BYTES, PIECE_ROWS = 256 << 10, 1024


def _pieces(arrays: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    n, size = len(arrays[0]), sum(a.nbytes for a in arrays)
    step = max(1, min(PIECE_ROWS, n * PIECE_BYTES // max(1, size)))
    for at in range(0, n, step):
        yield [a.slice(at, step) for a in arrays]


def _results(fn: Callable[..., object], arrays: list[pa.Array], kind: pa.DataType, distinct: bool) -> pa.Array:
    rows = zip(*(a.to_pylist() for a in arrays))
    if not distinct:
        return pa.array([fn(*row) for row in rows], kind)
    known: dict[tuple, object] = {}
    out = []
    for row in rows:
        if row not in known:
            known[row] = fn(*row)
        out.append(known[row])
    return pa.array(out, kind)


def batched(fn: Callable[..., object], ddl: str, distinct: bool = False) -> Callable[..., Column]:
    """fn of plain values (null as None) as a function of columns; it has to be deterministic.

    The types are read from the DDL at the first use, which needs a session.  A batch is
    worked off in pieces, so that the memory for Python objects doesn't grow with it.
    distinct: equal arguments (which have to be hashable) of a piece are worked out once.
    """

    def call(*columns: Column) -> Column:
        kind = arrow_type(ddl)

        def run(*arrays: pa.Array) -> pa.Array:
            return pa.concat_arrays([_results(fn, p, kind, distinct) for p in _pieces(arrays)] or [pa.array([], kind)])

        # Spark takes the number of arguments from the signature.
        shapes = [lambda a: run(a), lambda a, b: run(a, b), lambda a, b, c: run(a, b, c)]
        return F.arrow_udf(shapes[len(columns) - 1], ddl)(*columns)

    return call


def streamed(fn: Callable[[object], object], ddl: str) -> Callable[[Column], Column]:
    """As batched, of one column, for results much larger than it: each piece's leave as a batch of their own."""

    def call(column: Column) -> Column:
        kind = arrow_type(ddl)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                for p in _pieces((b,)):
                    yield _results(fn, p, kind, False)

        return F.arrow_udf(run, ddl)(column)

    return call
