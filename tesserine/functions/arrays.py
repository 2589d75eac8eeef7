"""Array expressions whose work stays near proportion to the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once even where then uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What a fold by join gives at each item of an array of integers (0 or more), from 0 on, as array<int>.

    Folds that append to an array copy it at each step, so they run over blocks of BLOCK items,
    each starting at the total of the blocks before.
    """
    empty = F.array().cast("array<int>")
    zero = lambda start: F.struct(start.cast("int").alias("at"), empty.alias("all"))

    def append(acc: Column, value: Column) -> Column:
        at = join(acc["at"], value).cast("int")
        return F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))

    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: join(a, x).cast("int"))
    numbers = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
    cut = lambda v: F.when(F.size(v) > BLOCK, F.transform(numbers(v), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array(v))
    before = lambda blocks: F.aggregate(F.transform(blocks, total), zero(F.lit(0)), append)["all"]
    start = lambda ends, k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
    each = lambda blocks, ends: F.flatten(F.transform(blocks, lambda b, k: F.aggregate(b, zero(start(ends, k)), append)["all"]))
    return let(let(values, cut), lambda blocks: let(before(blocks), lambda ends: each(blocks, ends)))


def running_ends(sizes: Column) -> Column:
    """The running totals of an array of integers."""
    return _running(sizes, lambda a, x: a + x)


def running_max(values: Column) -> Column:
    """The largest item so far of an array of integers that are 0 or more."""
    return _running(values, lambda a, x: F.greatest(a, x))
