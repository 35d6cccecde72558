"""Folds with carried state over series of any size.

A rule sees the state that the row before left and the row itself, gives the state for the next row and says whether the row
starts a new group. Such a rule has no parallel form in general, but most forget: after a reset, what came earlier no longer
matters. So every slab of a series (see ``scan``) is folded at once from a guess, the initial state. A slab hands the state it
ends with to the next one, and those that were folded from another state than they are handed are folded again, until none is.
A rule that forgets inside a slab settles in two rounds; one that does not is folded slab after slab in the end.

Where the possible states are few and known, a slab is folded from each of them in one round, and the slabs' maps from state to
state are then put one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidegrid.operators.scan import SLAB_BITS, slab_of
from tidegrid.session import materialize, share_package

#: Rounds in which all slabs with a wrong guess are folded again. What is wrong after them rarely forgets, so the states after
#: the first wrong slab of a series will change too. From there on RUN slabs are folded in their order in one task, row after row
#: and without holding them, and again the next RUN: work stays in proportion to the rows, and no task reads a whole series.
EAGER_ROUNDS, RUN = 3, 64


@dataclass(frozen=True)
class Fold:
    """A rule with state.

    ``step(state, row)`` gives the next state, a tuple of the columns of the schema ``state``, and whether the row starts a new
    group; ``row`` is a tuple of the values of the columns in ``needs``, null as None. The first row of a series is taken in
    from ``initial`` and never starts another group. ``states`` may list all states that can occur.
    """

    needs: Sequence[str]
    state: str
    initial: tuple
    step: Callable[[tuple, tuple], tuple[tuple, bool]]
    states: Sequence[tuple] | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.state)


def _rows(table: pa.Table, fold: Fold) -> list[tuple]:
    return list(zip(*(table[c].to_pylist() for c in fold.needs))) if fold.needs else [()] * len(table)


def _run(rows: list[tuple], state: tuple, fold: Fold) -> tuple[tuple, int, int]:
    """The last state, how many rows start a group, and whether the first one does."""
    starts, first, step = 0, 0, fold.step
    for i, row in enumerate(rows):
        state, split = step(state, row)
        if split:
            starts += 1
            if i == 0:
                first = 1
    return state, starts, first


def fold_scan(df: DataFrame, keys: Sequence[str], order: str, fold: Fold, group: str = "group",
              bits: int = SLAB_BITS) -> DataFrame:
    """``df`` with ``group``, numbered from 0 in each series, and the state after each row, in columns named as ``fold.state`` says.

    ``order`` is a BIGINT column, unique inside ``keys``; rows with a null key or order are refused. No task holds more than a
    slab of a series. The rule runs once for each row and round, in Python; only the columns it needs are read before the last
    round. Names of the state's columns must be new.
    """
    if clash := {group, *fold.schema.names} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    keys = list(keys)
    in_slab = [*keys, "_slab"]
    missing = F.lit(False)
    for c in [*keys, order]:
        missing = missing | F.col(f"`{c}`").isNull()
    held = df.withColumn("_slab", F.when(missing, F.raise_error(F.lit("a fold needs keys and order"))).otherwise(
        slab_of(F.col(order), bits)))
    share_package(df.sparkSession)
    slim = materialize(held.select(*dict.fromkeys([*in_slab, order, *fold.needs])), "fold-rows")
    edges = _finite(slim, keys, order, fold) if fold.states is not None else _relaxed(slim, keys, order, fold)
    slabs = Window.partitionBy(*keys).orderBy("_slab")
    starts = F.col("_starts") - F.when(F.row_number().over(slabs) == 1, F.col("_first")).otherwise(0)
    edges = edges.withColumn("_own", starts)
    edges = edges.select(*in_slab, "_in", (F.sum("_own").over(slabs) - F.col("_own")).alias("_base"),
                         (F.row_number().over(slabs) == 1).alias("_is_first"))
    schema = T.StructType([*df.schema.fields, T.StructField(group, T.LongType()), *fold.schema.fields])
    names, states_named, kinds = df.columns, fold.schema.names, pa_types(fold.schema)

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        state = tuple(table["_in"][0].as_py().values())
        at, numbers, states = table["_base"][0].as_py(), [], []
        ignore = table["_is_first"][0].as_py()
        for row in _rows(table, fold):
            state, split = fold.step(state, row)
            at += bool(split) and not ignore
            ignore = False
            numbers.append(at)
            states.append(state)
        columns = [table[c] for c in names] + [pa.array(numbers, pa.int64())]
        columns += [pa.array([s[i] for s in states], kind) for i, kind in enumerate(kinds)]
        return pa.table(columns, names=[*names, group, *states_named])

    share_package(df.sparkSession)

    return held.join(edges, in_slab).groupBy(*in_slab).applyInArrow(number, schema)


def pa_types(schema: T.StructType) -> list[pa.DataType]:
    return [to_arrow_type(f.dataType) for f in schema.fields]


def _edge_schema(slim: DataFrame, keys: Sequence[str], fold: Fold) -> T.StructType:
    kept = [slim.schema[c] for c in [*keys, "_slab"]]
    state = fold.schema
    return T.StructType([*kept, T.StructField("_in", state), T.StructField("_out", state),
                         T.StructField("_starts", T.LongType()), T.StructField("_first", T.LongType())])


def _relaxed(slim: DataFrame, keys: Sequence[str], order: str, fold: Fold) -> DataFrame:
    """For each slab the state it is handed, after rounds in which slabs handed another state than before are folded again."""
    in_slab, state = [*keys, "_slab"], fold.schema
    names, kind = state.names, pa.struct(list(zip(state.names, pa_types(state))))

    def edge(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        begin = tuple(table["_given"][0].as_py().values())
        end, starts, first = _run(_rows(table, fold), begin, fold)
        return pa.table([*(table[c][:1] for c in in_slab), pa.array([dict(zip(names, begin))], kind),
                         pa.array([dict(zip(names, end))], kind), pa.array([starts]), pa.array([first])],
                        names=[*in_slab, "_in", "_out", "_starts", "_first"])

    schema = _edge_schema(slim, keys, fold)
    initial = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(state.fields, fold.initial)))

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of slabs that come one after the other, rows in order; a series begins with the state it is given."""
        found: list[list] = []  # slab, state before, state after, starts, first
        for batch in batches:
            table = pa.table(batch)
            at = list(zip(*(table[c].to_pylist() for c in in_slab)))
            for slab, given, row in zip(at, table["_given"].to_pylist(), _rows(table, fold), strict=True):
                if not found or found[-1][0] != slab:
                    same = found and found[-1][0][:-1] == slab[:-1]
                    begin = found[-1][2] if same else tuple(given.values())
                    if len(found) > 1000:
                        yield edges_of(found)
                        found = []
                    found.append([slab, begin, begin, 0, None])
                now = found[-1]
                now[2], split = fold.step(now[2], row)
                now[3] += bool(split)
                if now[4] is None:
                    now[4] = int(bool(split))
        if found:
            yield edges_of(found)

    def edges_of(found: list[list]) -> pa.RecordBatch:
        keys_of = [pa.array([f[0][i] for f in found], to_arrow) for i, to_arrow in enumerate(key_types)]
        states = [pa.array([dict(zip(names, f[i])) for f in found], kind) for i in (1, 2)]
        return pa.RecordBatch.from_arrays([*keys_of, *states, pa.array([f[3] for f in found], pa.int64()),
                                           pa.array([f[4] for f in found], pa.int64())],
                                          names=[*in_slab, "_in", "_out", "_starts", "_first"])

    key_types = pa_types(T.StructType([slim.schema[c] for c in in_slab]))
    edges = materialize(slim.withColumn("_given", initial).groupBy(*in_slab).applyInArrow(edge, schema), "fold-edges")
    before = Window.partitionBy(*keys).orderBy("_slab")
    turn = 0
    while True:
        handed = edges.withColumn("_given", F.coalesce(F.lag("_out").over(before), initial))
        handed = handed.withColumn("_i", F.row_number().over(before)).select(*in_slab, "_in", "_given", "_i")
        wrong = handed.filter(~F.col("_given").eqNullSafe(F.col("_in"))).drop("_in")
        if turn >= EAGER_ROUNDS:
            first = wrong.groupBy(*keys).agg(F.min("_i").alias("_from"))
            run = handed.join(first, keys).filter(F.col("_i").between(F.col("_from"), F.col("_from") + RUN - 1))
            wrong = run.select(*in_slab, F.when(F.col("_i") == F.col("_from"), F.col("_given")).alias("_given"))
        wrong = materialize(wrong.select(*in_slab, "_given"), "fold-wrong")
        if not wrong.take(1):
            return edges
        rows = slim.join(wrong, in_slab)
        if turn < EAGER_ROUNDS:
            again = rows.groupBy(*in_slab).applyInArrow(edge, schema)
        else:
            again = rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(in_order, schema)
        again = materialize(again, "fold-again")
        edges = materialize(edges.join(wrong.select(*in_slab), in_slab, "left_anti").unionByName(again), "fold-edges")
        turn += 1


def _finite(slim: DataFrame, keys: Sequence[str], order: str, fold: Fold) -> DataFrame:
    """The same in one round: each slab is folded from every state, and the slabs' maps are put one after the other."""
    in_slab, state = [*keys, "_slab"], fold.schema
    states = [tuple(s) for s in fold.states]
    number = {s: i for i, s in enumerate(states)}
    if tuple(fold.initial) not in number:
        raise ValueError("the initial state is not among the states")

    def mapped(table: pa.Table) -> pa.Table:
        rows = _rows(table.sort_by(order), fold)
        ends = [_run(rows, s, fold) for s in states]
        return pa.table([*(table[c][:1] for c in in_slab), pa.array([[number[e] for e, _, _ in ends]]),
                         pa.array([[n for _, n, _ in ends]]), pa.array([[f for _, _, f in ends]])],
                        names=[*in_slab, "_to", "_starts", "_first"])

    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in in_slab)
    maps = slim.groupBy(*in_slab).applyInArrow(
        mapped, f"{kinds}, _to array<bigint>, _starts array<bigint>, _first array<bigint>")
    names, kind = state.names, pa.struct(list(zip(state.names, pa_types(state))))

    def chained(table: pa.Table) -> pa.Table:  # a row for each slab of a series
        table = table.sort_by("_slab")
        at, found = number[tuple(fold.initial)], {"_in": [], "_out": [], "_starts": [], "_first": []}
        for to, starts, first in zip(*(table[c].to_pylist() for c in ("_to", "_starts", "_first"))):
            found["_in"].append(dict(zip(names, states[at])))
            found["_starts"].append(starts[at])
            found["_first"].append(first[at])
            at = to[at]
            found["_out"].append(dict(zip(names, states[at])))
        return pa.table([*(table[c] for c in in_slab), pa.array(found["_in"], kind), pa.array(found["_out"], kind),
                         pa.array(found["_starts"], pa.int64()), pa.array(found["_first"], pa.int64())],
                        names=[*in_slab, "_in", "_out", "_starts", "_first"])

    return materialize(maps.groupBy(*keys).applyInArrow(chained, _edge_schema(slim, keys, fold)), "fold-edges")
