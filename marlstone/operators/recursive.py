"""WITH RECURSIVE … UNION: the fixpoint of a step over distinct rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexer import SqlError
from ..sources.shared import stored

MOST_ROUNDS = 100_000
FOLD = 8


def new_rows(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct rows of found that aren't in seen, nulls being equal."""
    a, b = found.distinct().alias("a"), seen.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in found.columns])
    return a.join(b, same, "left_anti")


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = MOST_ROUNDS) -> DataFrame:
    """base and everything that step() makes of newly found rows, each row once.

    Each round's rows are written to the shared folder, so plans stay short and
    lost executors cost a round at most.  ``FOLD`` parts of one age are written
    together as an older one, so a round reads a number of folders that grows with
    the logarithm of the rounds.  Over ``most`` rounds end with 54001, so that a
    step that never ends says so.
    """
    work = stored(base.distinct(), "fixpoint")
    parts = [(0, work)]
    for _ in range(most):
        if work.isEmpty():
            return reduce(DataFrame.unionAll, [p for _, p in parts])
        made = step(work)
        made = made.toDF(*base.columns).select([F.col(f"`{c}`").cast(base.schema[c].dataType).alias(c) for c in base.columns])
        work = stored(new_rows(made, reduce(DataFrame.unionAll, [p for _, p in parts])), "fixpoint")
        parts.append((0, work))
        while len(parts) >= FOLD and len({age for age, _ in parts[-FOLD:]}) == 1:
            parts[-FOLD:] = [(parts[-1][0] + 1, stored(reduce(DataFrame.unionAll, [p for _, p in parts[-FOLD:]]), "fixpoint"))]
    raise SqlError("54001", f"a recursive query took over {most} rounds")
