"""Order-dependent work over many short sequences: rows of a key come sorted, a task walks through them and holds one group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def walk(df: DataFrame, key: str | list[str], order: list[str], group: list[str], start: Callable[[], Callable[[list[tuple]], list[tuple]]], schema: str) -> DataFrame:
    """One function for each ``key`` (made by ``start``) is called with the rows of each of its ``group``s in ``order``.

    Rows have the columns of ``df``. Only one group's rows are held at once, whatever the length of a key's sequence;
    many keys share a task. Output rows have the columns of ``schema``.
    """
    keys = [key] if isinstance(key, str) else key
    at = [df.columns.index(c) for c in keys]
    to = [df.columns.index(c) for c in [*keys, *group]]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, now, held = None, None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                here = tuple(row[i] for i in to)
                if here != now:
                    if held:
                        out += call(held)
                    if now is None or here[: len(at)] != now[: len(at)]:
                        call = start()
                    now, held = here, []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(call(held), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
