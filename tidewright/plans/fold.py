"""Per-key ordered folds: one pure step over each key's rows in order, streamed through sorted partitions.

State machines whose next state depends on the last one row by row have no window form. Rows are shuffled by
key and sorted by key and order, and a task steps through them with the state of one key in hand, so a long
key needs no more memory than a short one and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], Any], step: Callable[[Any, dict], dict | None], schema: str, end: Callable[[Any], dict | None] | None = None) -> DataFrame:
    """What step returns for each row (None: nothing), and what end returns for each key, with the key first.

    step(state, row) may change the state that start() made for the key. order must be total within a key.
    """
    kinds = T.StructType([df.schema[key], *T._parse_datatype_string(schema).fields])
    arrow, names = to_arrow_schema(kinds), kinds.names[1:]
    columns = df.columns

    def run(parts):
        held, state, out = None, None, []
        for part in parts:
            for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                row = dict(zip(columns, row))
                at = (row[key],)
                if at != held:
                    if held is not None and end is not None and (got := end(state)) is not None:
                        out.append((held[0], *(got[n] for n in names)))
                    held, state = at, start()
                if (got := step(state, row)) is not None:
                    out.append((held[0], *(got[n] for n in names)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        if held is not None and end is not None and (got := end(state)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((held[0], *(got[n] for n in names)), arrow)], schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kinds)
