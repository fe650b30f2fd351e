"""Top N items within every group, by a mergeable bounded heap.

The state of a group is its N best distinct items, each with its best score.
Two states merge by uniting them, keeping the best score of each item and the
N best of the rest, so that states may be built anywhere in any order: an item
of the final N is among the N best of the part that holds its best score.

States are built on each partition before the shuffle, batch by batch over
Arrow columns. So a group of millions of rows sends N rows from each task,
and what is left is merged in the JVM under one exchange on the group.

Order: the higher score first; on equal scores the item smaller in byte order.

Defined results
---------------
* Null items, null scores and NaN scores do not count; a null group is a group.
* An item occurring several times in a group counts once, with its best score.
* Groups of fewer than N items give all of them. Empty tables give no row.
* Only the named columns are read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows gathered before a state is compacted.
STATE_ROWS = 1 << 18


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each row of a sorted column differs from the row before it."""
    codes = pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def heap_state(table: pa.Table, groups: list[str], item: str, score: str, n: int) -> pa.Table:
    """The state of every group of ``table``: its n best distinct items."""
    if not table.num_rows:
        return table
    best = table.group_by([*groups, item], use_threads=False).aggregate([(score, "max")]).rename_columns([*groups, item, score])
    best = best.sort_by([*((g, "ascending") for g in groups), (score, "descending"), (item, "ascending")])
    fresh = np.zeros(best.num_rows, bool)
    for g in groups:
        fresh |= _starts(best.column(g))
    at = np.arange(best.num_rows)
    first = np.maximum.accumulate(np.where(fresh, at, 0))
    return best.filter(pa.array(at - first < n))


def top_n(df: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """The n best items of each group: groups, item, score and ``rank`` from 1."""
    source = df.select(*groups, F.col(item).cast("string").alias(item), F.col(score).cast("double").alias(score))
    source = source.where(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    names = source.columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= STATE_ROWS:
                state = heap_state(pa.Table.from_batches(held), groups, item, score, n)
                if state.num_rows > STATE_ROWS // 2:  # many groups: pass their states on, they merge later
                    yield from state.select(names).to_batches(max_chunksize=50_000)
                    held, rows = [], 0
                else:
                    held, rows = state.select(names).to_batches(), state.num_rows
        if held:
            yield from heap_state(pa.Table.from_batches(held), groups, item, score, n).select(names).to_batches(max_chunksize=50_000)

    states = source.mapInArrow(build, source.schema).repartition(*groups)
    merged = states.groupBy(*groups, item).agg(F.max(score).alias(score))
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(item).asc())
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
