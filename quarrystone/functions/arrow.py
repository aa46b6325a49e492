"""Arrow functions that are made when they are first used, so that modules load without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

#: Rows of a batch that are Python values at one time; the others stay as Arrow holds them.
SLICE = 256


def slices(batch, rows: int = SLICE):
    """Parts of an Arrow batch or array, without copies."""
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def arrow_function(returns: str) -> Callable:
    """A function of pandas columns with return type ``returns``, called with slices of a batch; ``made()`` gives the UDF itself, to be registered."""

    def over(f: Callable) -> Callable:
        def made():
            return _made(f, returns)

        @wraps(f)
        def call(*columns) -> Column:
            return made()(*columns)

        call.made = made
        return call

    return over


def _made(f: Callable, returns: str):
    declared = DataType.fromDDL(returns)
    kind = to_arrow_type(declared)
    fields = declared.names if isinstance(declared, StructType) else None

    def array(values, own):
        import pyarrow as pa

        if pa.types.is_map(own):
            values = [None if x is None else list(x.items()) for x in values]
        return pa.array(values, own, from_pandas=True)

    def sliced(*columns):
        import pyarrow as pa

        out = []
        for parts in zip(*map(slices, columns), strict=True):
            found = f(*(part.to_pandas() for part in parts))
            if fields is None:
                out.append(array(found, kind))
            else:
                out.append(pa.StructArray.from_arrays([array(found[name], kind.field(name).type) for name in fields], fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return F.arrow_udf(sliced, declared, F.ArrowUDFType.SCALAR)
