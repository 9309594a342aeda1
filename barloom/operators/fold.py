"""Ordered folds: state machines over each key's rows in order.

Operators whose state resets by what they have seen (accumulating bars, CUSUM) are inherently
sequential within a key.  ``fold`` sorts each key's rows inside its partition and streams
Arrow batches through a machine, so memory is one batch and one state, not a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.columns import KEYS, ORDER


def fold(df: DataFrame, machine: Callable[[], Callable], inputs: Sequence[str], outputs: dict[str, str], keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """``df`` with the machine's output columns.

    ``machine()`` starts a key; the callable it returns gets lists of the input columns of
    the key's next rows and returns one list for each output (in the same order)."""
    names = df.columns
    key_at, in_at = [names.index(k) for k in keys], [names.index(c) for c in inputs]
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = [arrow[k] for k in outputs.values()]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{c}` {k}" for c, k in outputs.items())])

    def run(batches):
        current, state = None, None
        for b in batches:
            ids = list(zip(*(b.column(i).to_pylist() for i in key_at), strict=True))
            values = [b.column(i).to_pylist() for i in in_at]
            out, at = [[] for _ in kinds], 0
            for key, group in groupby(ids):
                n = sum(1 for _ in group)
                if state is None or key != current:
                    current, state = key, machine()
                for o, v in zip(out, state(*(v[at : at + n] for v in values)), strict=True):
                    o += v
                at += n
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=[*names, *outputs])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
