"""Expressions that several of the operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import prepare

#: Runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, also where lambdas in body use it often."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; of null: none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def map_batches(df: DataFrame, schema: str | T.StructType, run: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]]) -> DataFrame:
    """df through run, which takes Arrow batches and gives columns by name: lists, NumPy or Arrow arrays.

    Values go as they are: a long next to a null stays a long.
    """
    prepare(df.sparkSession)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(struct)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(batches):
            columns = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    return df.mapInArrow(go, struct)


def running(xs: Column, zero: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """The state before each element of xs: zero, step(zero, x0) and so on. An array that grows is
    copied each time, so states are gathered in blocks and the time stays nearly linear."""
    none = F.slice(F.array(zero), 1, 0)
    gather = lambda a, x, to: F.struct(to(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def over(blocks: Column) -> Column:
        whole = lambda at, b: F.aggregate(b, at, step)
        starts = F.aggregate(blocks, F.struct(zero.alias("at"), none.alias("out")), lambda a, b: gather(a, b, whole), lambda a: a["out"])
        inside = lambda b, s: F.aggregate(b, F.struct(s.alias("at"), none.alias("out")), lambda a, x: gather(a, x, step), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, starts, inside))

    last = F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
    return let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(xs, k * block + 1, F.lit(block))), over)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def columns_of(df: DataFrame) -> list[Column]:
    return [df[f"`{c}`"] for c in df.columns]


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of largest count, all of a count or none, at most `most` of them.

    The bound of the count is found by two sums over the table, so tasks hand on no more
    rows than the result has; a sorted limit would have every task send `most` rows.
    """
    c = F.col(count)
    powers = [1 << k for k in range(62)]
    n = counts.agg(*(F.count_if(c >= p).alias(f"n{k}") for k, p in enumerate(powers))).first()
    k = next((k for k in range(len(powers)) if n[f"n{k}"] <= most), len(powers) - 1)
    if not k:
        return counts.where(c >= 1)
    steps = sorted({powers[k - 1] + (powers[k] - powers[k - 1]) * j // 64 for j in range(1, 65)})
    n = counts.agg(*(F.count_if(c >= s).alias(f"n{j}") for j, s in enumerate(steps))).first()
    return counts.where(c >= next(s for j, s in enumerate(steps) if n[f"n{j}"] <= most))
