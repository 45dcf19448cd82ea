"""Running totals over sorted keys without bringing a key's rows into one task.

Rows are range-partitioned by the whole sort order, so the rows of one key may
fill many partitions.  Each task scans its own rows in numpy; the totals that a
partition hands on to its successor come to the driver, one row a partition, and
are added in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from . import arrays as A
from .tables import stored

U = np.uint64
#: Base of the rolling polynomial; odd, so that all its powers differ from zero modulo 2**64.
BASE = 0xD6E8FEB86659FD93
WRAP = 1 << 64


class _Scan:
    """The state of one task: the key at hand, its rows so far and their totals."""

    def __init__(self, sums: int) -> None:
        self.opening: int | None = None
        self.key: int | None = None
        self.rows, self.roll, self.totals = 0, 0, [0] * sums

    def add(self, key: np.ndarray, values: list[np.ndarray], turns: np.ndarray | None) -> list[np.ndarray]:
        """place, opening, one running sum for each of ``values``, then the polynomial before and with each row."""
        n = len(key)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, n])
        same = self.key is not None and int(key[0]) == self.key
        if self.opening is None:
            self.opening = int(key[0])
        within = np.arange(n) - np.repeat(starts, sizes)
        first = slice(0, sizes[0])
        place = within + 1
        if same:
            place[first] += self.rows
        out = [place, key == self.opening]
        for i, value in enumerate(values):
            total = np.cumsum(value)
            run = total - np.repeat(total[starts] - value[starts], sizes)
            if same:
                run[first] += self.totals[i]
            self.totals[i] = int(run[-1])
            out.append(run)
        if turns is not None:
            term = turns.view(U) * A.powers(BASE, n)[within]
            if same:
                term[first] *= U(pow(BASE, self.rows, WRAP))
            total = np.cumsum(term)
            run = total - np.repeat(total[starts] - term[starts], sizes)
            if same:
                run[first] += U(self.roll)
            self.roll = int(run[-1])
            out += [(run - term).view(np.int64), run.view(np.int64)]
        self.key, self.rows = int(key[-1]), int(place[-1])
        return out


def running(frame: DataFrame, key: str, ranges: list[Column], order: list[Column], sums: tuple[str, ...] = (), roll: str | None = None) -> DataFrame:
    """``frame`` with place (from 1 within ``key``), run_x for each x of ``sums``, and with ``roll`` the columns before and fp.

    fp is the polynomial sum of roll * BASE ** (place - 1) modulo 2**64 over the
    key's rows so far, before is the one without this row.  ``order`` starts with
    ``key`` (a long without nulls) and ``ranges`` is the same order or a coarser one.
    The names above, block, opening and tail are not allowed in ``frame``.
    """
    extra = [T.StructField("place", T.LongType()), T.StructField("opening", T.BooleanType()), *(T.StructField(f"run_{c}", T.LongType()) for c in sums)]
    if roll:
        extra += [T.StructField("before", T.LongType()), T.StructField("fp", T.LongType())]
    schema = T.StructType([*frame.schema.fields, *extra, T.StructField("block", T.IntegerType()), T.StructField("tail", T.BooleanType())])
    names = schema.fieldNames()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state, held = TaskContext.get().partitionId(), _Scan(len(sums)), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            column = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in {key, *sums, *([roll] if roll else [])}}
            found = state.add(column[key], [column[c] for c in sums], column[roll] if roll else None)
            ends = [np.full(batch.num_rows, block, np.int32), np.zeros(batch.num_rows, bool)]
            held = pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, [*found, *ends])], names=names)
        if held is not None:
            last = np.zeros(held.num_rows, bool)
            last[-1] = True
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], names=names)
        A.release()

    done = stored(frame.repartitionByRange(*ranges).sortWithinPartitions(*order).mapInArrow(scan, schema))
    handed, carry = {}, None
    columns = ["place", *(f"run_{c}" for c in sums), *(["fp"] if roll else [])]
    for row in sorted(done.where("tail").select("block", key, "opening", *columns).collect()):  # one row a partition
        if carry is not None:
            handed[row["block"]] = carry
        grown = carry is not None and row["opening"] and carry[0] == row[key]
        values = [row[c] + (carry[1][i] if grown else 0) for i, c in enumerate(columns)]
        if roll and grown:
            values[-1] = (carry[1][-1] + pow(BASE, carry[1][0], WRAP) * row["fp"]) % WRAP
        carry = (row[key], values)
    outs = [f for f in schema.fields if f.name not in ("opening", "block", "tail")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {f.name: batch.column(i) for i, f in enumerate(schema.fields)}
            block, opening, keys = (got[c].to_numpy(zero_copy_only=False) for c in ("block", "opening", key))
            new = {c: got[c].to_numpy().copy() for c in [*columns, *(["before"] if roll else [])]}
            for b in np.unique(block[opening]).tolist():
                if b not in handed:
                    continue
                value, add = handed[b]
                rows = opening & (block == b) & (keys == value)
                for i, c in enumerate(columns[: 1 + len(sums)]):
                    new[c][rows] += add[i]
                if roll:
                    factor, start = U(pow(BASE, add[0], WRAP)), U(add[-1] % WRAP)
                    for c in ("before", "fp"):
                        new[c][rows] = (start + factor * new[c][rows].view(U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name]) if f.name in new else got[f.name] for f in outs], names=[f.name for f in outs])

    return done.mapInArrow(join, T.StructType(outs))
