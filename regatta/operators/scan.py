"""Scans in order of a key and a time, where one key may hold any share of all rows.

Rows are dealt by ranges of (key, order), so that a key with many rows lies in
many chunks, one after the other.  Only the first key of a chunk can go on
from the chunk before: what is carried between chunks is one value a chunk,
however many keys there are.  Each chunk is scanned by itself, and then the
carried values are put in.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.operators.storage import checkpointed

Step = Callable[[Any, float], tuple[Any, bool]]


def _chunks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def chunked(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The rows with ``_key`` and ``_part``, the number of their chunk; chunks follow each other in order of key and ``order``.

    Written once, as the ranges come from a sample that another run would
    draw anew.  There are as many chunks as shuffle partitions.
    """
    dealt = rows.withColumn("_key", key).repartitionByRange(_chunks(rows), F.col("_key"), *order)
    return checkpointed(dealt.withColumn("_part", F.spark_partition_id()))


def with_previous(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """The rows with the values of the row before in the same key, named by ``values`` (new name: column), and ``_turn``, their number from 1.

    The same as ``lag`` and ``row_number`` over a window of the key, but no
    task gets more of a key than a chunk.  ``order`` must tell the rows of a
    key apart; nulls come first.  Rows whose keys are null are a key.
    """
    placed = chunked(rows, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), [F.col(c) for c in order])
    inside = Window.partitionBy("_part", "_key").orderBy(*order)
    held = F.struct(*(F.col(c).alias(new) for new, c in values.items()))
    scanned = placed.withColumns({"_turn": F.row_number().over(inside).cast("bigint"), "_before": F.lag(held).over(inside)})
    # One row a chunk and key; those that go on from another chunk are at most one a chunk.
    place = F.struct(*order)
    ends = placed.groupBy("_key", "_part").agg(F.count("*").alias("n"), F.max_by(held, place).alias("last"))
    chain = Window.partitionBy("_key").orderBy("_part")
    carried = ends.select(
        "_key", "_part", F.lag("last").over(chain).alias("carried"), F.sum("n").over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("gone")
    ).where("gone is not null")
    met = scanned.join(F.broadcast(carried), ["_key", "_part"], "left")
    # A row that is not its chunk's first of the key has a row before it, though all its values may be null.
    before = F.when(F.col("_turn") > 1, F.col("_before")).otherwise(F.col("carried"))
    out = met.withColumns({new: before[new] for new in values})
    return out.withColumn("_turn", F.col("_turn") + F.coalesce("gone", F.lit(0))).select(*rows.columns, *values, "_turn")


def _states(step: Step, carried: dict[int, bytes]):
    """Per chunk: its first and last key, and the state after its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, key, state = None, None, None, None
        done: list[tuple] = []
        for batch in batches:
            for p, k, us in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", "_us"))):
                if p != part:
                    if part is not None:
                        done.append((part, first, key, pickle.dumps(state)))
                    part, first, key = p, k, k
                    state = pickle.loads(carried[p]) if p in carried else None
                elif k != key:
                    key, state = k, None
                state, _ = step(state, _seconds(us))
        if part is not None:
            done.append((part, first, key, pickle.dumps(state)))
        names = ["_part", "first", "last", "state"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 4, (pa.int32(), pa.string(), pa.string(), pa.binary()))], names=names)

    return run


def _seconds(us: int | None) -> float:
    return float("-inf") if us is None else us / 1e6


def _flags(step: Step, carried: dict[int, bytes], columns: list[str], flag: str):
    """The rows of chunks with what ``step`` says of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, state = None, None, None
        for batch in batches:
            flags = []
            for p, k, us in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", "_us"))):
                if p != part:
                    part, key = p, k
                    state = pickle.loads(carried[p]) if p in carried else None
                elif k != key:
                    key, state = k, None
                state, said = step(state, _seconds(us))
                flags.append(said)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(flags, pa.bool_())], names=[*columns, flag])

    return run


def in_turn(rows: DataFrame, keys: list[str], step: Step, flag: str) -> DataFrame:
    """The rows (with ``ts`` and ``event_id``) with a boolean ``flag`` that ``step`` gives from a key's state and the time in seconds.

    Rows of a key take their turn by time and event.  Chunks are first scanned
    as if every key began in them; the state at the end of a chunk is then the
    start of the next one, if it goes on with the same key, and chunks whose
    start has changed are scanned again, until none has.  A state that does
    not depend on the distant past settles after one more round; at worst
    there are as many rounds as a key has chunks.  The driver holds one state
    a chunk.
    """
    order = [F.asc_nulls_last("ts"), F.asc("event_id")]
    timed = rows.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    placed = chunked(timed, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), order)
    carried, _ = settled(placed, step, order)
    return _sorted(placed, order).mapInArrow(_flags(step, carried, rows.columns, flag), T.StructType([*rows.schema.fields, T.StructField(flag, T.BooleanType())]))


def _sorted(placed: DataFrame, order: list[Column]) -> DataFrame:
    return placed.repartition(_chunks(placed), "_part").sortWithinPartitions("_part", "_key", *order)


def settled(placed: DataFrame, step: Step, order: list[Column]) -> tuple[dict[int, bytes], int]:
    """The state at the start of each chunk that goes on with a key, and how many rounds it took to know them."""
    carried: dict[int, bytes] = {}
    known: dict[int, tuple[str, str, bytes]] = {}
    changed, rounds = None, 0
    while changed is None or changed:
        some = placed if changed is None else placed.where(F.col("_part").isin(changed))
        found = _sorted(some, order).mapInArrow(_states(step, carried), "_part int, first string, last string, state binary")
        known |= {r["_part"]: (r["first"], r["last"], bytes(r["state"])) for r in found.collect()}  # a row a chunk
        parts, now = sorted(known), {}
        for before, part in zip(parts, parts[1:]):
            if known[before][1] == known[part][0]:
                now[part] = known[before][2]
        changed = [p for p in parts if now.get(p) != carried.get(p)]
        carried, rounds = now, rounds + 1
    return carried, rounds
