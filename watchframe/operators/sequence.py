"""Order-dependent work per key, safe for keys that hold a large part of all rows.

A plain window over a key puts all of that key's rows in one task.  The
helpers here number the rows of a key without doing so and cut long keys into
blocks of bounded size:

* :func:`number_rows` ranks rows inside short time slots of a key and adds the
  running total of earlier slots, which is computed on pre-aggregated counts.
* :func:`with_blocks` cuts the numbered rows into blocks and copies the last
  rows of each block in front of the next one, so that look-back windows stay
  inside one block.
* :func:`fold_blocks` runs a small state machine over a key.  Blocks of keys
  that need more than one are first turned into tables "state before ->
  state after", which are chained per key; then every block runs on its own
  from its known starting state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 500_000
SLOT_SECONDS = 300


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def number_rows(df: DataFrame, keys: list[str], order: list[str], ts: str = "ts",
                slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Add ``_seq`` (1-based position per key) and ``_total`` (rows of the key).

    ``order`` is a total order whose first column is ``ts``.
    """
    slotted = df.withColumn("_slot", F.call_function("div", micros(F.col(ts)), F.lit(slot_seconds * 1_000_000)))
    per_key = Window.partitionBy(*keys)
    offsets = (
        slotted.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
        .withColumns({
            "_before": F.coalesce(F.sum("_n").over(
                per_key.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_total": F.sum("_n").over(per_key)})
        .drop("_n"))
    ranked = slotted.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order)))
    return (ranked.join(offsets, [*keys, "_slot"])
            .withColumn("_seq", F.col("_before") + F.col("_rn"))
            .drop("_slot", "_rn", "_before"))


def with_blocks(numbered: DataFrame, look_back: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_blk`` and ``_halo``; halo rows are copies that give look-back only."""
    if block_rows < look_back:
        raise ValueError("a block must be at least as long as the look-back")
    own = F.call_function("div", F.col("_seq") - 1, F.lit(block_rows))
    is_tail = ((F.col("_seq") - 1) % block_rows >= block_rows - look_back) & (
        (own + 1) * block_rows < F.col("_total"))
    copies = F.when(is_tail, F.array(F.struct(own.alias("b"), F.lit(False).alias("h")),
                                     F.struct((own + 1).alias("b"), F.lit(True).alias("h")))
                    ).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("h"))))
    return (numbered.withColumn("_copy", F.explode(copies))
            .withColumns({"_blk": F.col("_copy.b"), "_halo": F.col("_copy.h")}).drop("_copy"))


def look_back_window(keys: list[str], start: int, end: int) -> Window:
    """Row frame over a block of a key."""
    return Window.partitionBy(*keys, "_blk").orderBy("_seq").rowsBetween(start, end)


@dataclass(frozen=True)
class StateMachine:
    """A machine whose state is the number of latest rows it still holds.

    ``step(t, i, held)`` takes the times of a key in microseconds, the current
    row and how many rows right before it are held; it returns the new count
    (the current row included) and whether the row fires.  ``report(columns,
    t, i, held)`` gives the extra output columns of a firing row from the
    payload columns of the rows it held.  With ``marks`` the times come as pairs
    with the values of that payload column.
    """

    most_held: int
    step: Callable
    report: Callable
    report_schema: str
    marks: str | None = None

    def times(self, frame: pd.DataFrame) -> list:
        t = frame["_t"].tolist()
        return list(zip(t, frame[self.marks].tolist())) if self.marks else t


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]
                 ) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches regrouped so that no group is cut, with the group starts.

    Only the rows of the group that is still open are kept back.
    """
    def starts(frame: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(frame), dtype=bool)
        new[0] = True
        for c in by:
            values = frame[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)

    open_parts: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        at = starts(batch)
        if open_parts and all(open_parts[-1][c].iloc[-1] == batch[c].iloc[0] for c in by):
            at = at[1:]
        if len(at):
            done = [*open_parts, batch.iloc[:at[-1]]] if at[-1] else open_parts
            if done:
                frame = joined(done)
                yield frame, starts(frame)
            open_parts = [batch.iloc[at[-1]:]]
        else:
            open_parts.append(batch)
    if open_parts:
        frame = joined(open_parts)
        yield frame, starts(frame)


def spans(begin: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    edges = [*begin.tolist(), size]
    return zip(edges, edges[1:])


def _run_from(machine: StateMachine, t: list[int], first: int, end: int, held: int) -> list:
    fired, step = [], machine.step
    for i in range(first, end):
        before = held
        held, fires = step(t, i, held)
        if fires:
            fired.append((i, before))
    return fired


def _state_table(machine: StateMachine, t: list[int], begin: int, first: int, end: int) -> list[int]:
    """State after the block for every possible state before it."""
    alive = {h: [h] for h in range(min(first - begin, machine.most_held) + 1)}
    for i in range(first, end):
        after: dict[int, list[int]] = {}
        for held, entries in alive.items():
            after.setdefault(machine.step(t, i, held)[0], []).extend(entries)
        alive = after
    table = [0] * (machine.most_held + 1)
    for held, entries in alive.items():
        for e in entries:
            table[e] = held
    return table


def fold_blocks(numbered: DataFrame, keys: list[str], machine: StateMachine, payload: list[str],
                ts: str = "ts", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows on which the machine fires, with ``payload`` and the report columns.

    ``numbered`` comes from :func:`number_rows`; key columns must not be null.
    """
    schema = numbered.schema
    by = [*keys, "_blk"]
    blocks = (with_blocks(numbered, machine.most_held, block_rows)
              .withColumn("_t", micros(F.col(ts))).withColumn("_enter", F.lit(None).cast("int")))

    def states(batches):
        for frame, begin in whole_groups(batches, by):
            t = machine.times(frame)
            halo = np.add.reduceat(frame["_halo"].to_numpy().astype(int), begin).tolist()
            heads = frame.iloc[begin][by].reset_index(drop=True)
            yield heads.assign(table=[_state_table(machine, t, b, b + h, e) for (b, e), h in
                                      zip(spans(begin, len(t)), halo)])

    key_fields = [schema[k] for k in keys]
    table_schema = T.StructType([*key_fields, T.StructField("_blk", T.LongType()),
                                 T.StructField("table", T.ArrayType(T.IntegerType()))])
    needed = [*by, "_seq", "_halo", "_t", "_enter",
              *[c for c in payload if c not in keys and c != ts]]
    # same columns as the main pass below, so that both share one exchange
    tables = (blocks.where(F.col("_total") > block_rows).select(*needed)
              .repartition(*by).sortWithinPartitions(*by, "_seq")
              .mapInPandas(states, table_schema))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_blk")
        state, enter = 0, []
        for table in group["table"]:
            enter.append(state)
            state = int(table[state])
        return group[by].assign(_enter=enter)

    # per key: one array of a few numbers for each block_rows rows
    entered = tables.groupBy(*keys).applyInPandas(
        chain, T.StructType([*key_fields, T.StructField("_blk", T.LongType()),
                             T.StructField("_enter", T.IntegerType())]))

    carried_columns = [c for c in payload if c not in keys and c != ts]
    report_fields = T.StructType.fromDDL(machine.report_schema).fields
    extra = [f.name for f in report_fields]
    out_schema = T.StructType([*key_fields, T.StructField("_t", T.LongType()),
                               *[schema[c] for c in carried_columns], *report_fields])

    def run(batches):
        for frame, begin in whole_groups(batches, by):
            t = machine.times(frame)
            halo = np.add.reduceat(frame["_halo"].to_numpy().astype(int), begin).tolist()
            enter = frame["_enter"].to_numpy(dtype=float, na_value=np.nan)[begin].tolist()
            fired = []
            for (b, e), h, state in zip(spans(begin, len(t)), halo, enter):
                known = state == state  # a state row leads the block
                fired += _run_from(machine, t, b + h + known, e, int(state) if known else 0)
            if fired:
                columns = {c: frame[c].tolist() for c in carried_columns}
                out = frame.iloc[[i for i, _ in fired]][[*keys, "_t", *carried_columns]].reset_index(drop=True)
                reports = [machine.report(columns, t, i, before) for i, before in fired]
                for n, name in enumerate(extra):
                    out[name] = [r[n] for r in reports]
                yield out

    # the starting state travels as a first row of its block
    carried = entered.where(F.col("_blk") > 0).withColumn("_seq", F.lit(0).cast("bigint"))
    rows = blocks.select(*needed).unionByName(
        carried.withColumns({"_t": F.lit(0).cast("bigint"), "_halo": F.lit(False)}),
        allowMissingColumns=True)
    return (rows.repartition(*by).sortWithinPartitions(*by, "_seq")
            .mapInPandas(run, out_schema)
            .withColumn(ts, F.timestamp_micros("_t")).drop("_t"))
