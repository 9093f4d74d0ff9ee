"""Groups of rows that lie one after the other in Arrow batches, many at a time: a Python call for a batch, not for a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row's keys differ from those of the row before; nulls are equal. The first row counts as a change."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        if pa.types.is_struct(c.type):
            out |= changes([c.is_valid(), *c.flatten()])
        else:
            code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            out[1:] |= code[1:] != code[:-1]
    return out


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in which a key's rows are neighbours: what may go on in the next batch waits."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        start = np.flatnonzero(changes([batch.column(key)]))
        if held:
            last = held[-1].column(key).slice(len(held[-1]) - 1).combine_chunks()
            joined = not changes([pa.concat_arrays([last, batch.column(key).slice(0, 1)])])[1]
            if not joined or len(start) > 1:
                done = int(start[1]) if joined else 0
                yield pa.concat_tables([*held, now.slice(0, done)]).combine_chunks()
                held, now, start = [], now.slice(done), start[start >= done] - done
        if len(start) > 1:
            yield now.slice(0, int(start[-1])).combine_chunks()
            now = now.slice(int(start[-1]))
        held.append(now)
    if held:
        yield pa.concat_tables(held).combine_chunks()
