"""Running values over long ordered groups, in two levels.

A window over a whole recording sorts it in one task.  Here the group is cut into blocks along its order; each block is
scanned by itself, the blocks' totals - one row each - are scanned in turn, and what came before a block is joined to
its rows.  Rows are shuffled once, by group and block, and that is the partitioning of the join too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """kind: sum, max, last (the latest that is not null); own: whether a row's own value counts."""

    kind: str
    value: Column
    own: bool = True


def running(rows: DataFrame, keys: list[str], block: Column, order: list[str], columns: dict[str, Running]) -> DataFrame:
    """rows with running values by key in the order given.

    block: a number for each row that does not fall along the order; rows of equal keys, block and order come in any
    order among themselves.  Sums of nothing are 0, other values of nothing null.
    """
    rows = rows.withColumn(_BLOCK, block)
    local = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    place = F.struct(*order)
    scan = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place))}
    here = {f"__here_{n}": scan[x.kind](x.value).over(local.rowsBetween(Window.unboundedPreceding, 0 if x.own else -1)) for n, x in columns.items()}
    totals = rows.groupBy(*keys, _BLOCK).agg(*(total[x.kind](x.value).alias(f"__all_{n}") for n, x in columns.items()))
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, _BLOCK, *(scan[x.kind](F.col(f"__all_{n}")).over(earlier).alias(f"__before_{n}") for n, x in columns.items()))
    joined = rows.withColumns(here).join(before, [*keys, _BLOCK])

    def both(n: str, x: Running) -> Column:
        own, past = F.col(f"__here_{n}"), F.col(f"__before_{n}")
        if x.kind == "sum":
            return F.coalesce(own, F.lit(0)) + F.coalesce(past, F.lit(0))
        return F.greatest(own, past) if x.kind == "max" else F.coalesce(own, past)

    return joined.withColumns({n: both(n, x) for n, x in columns.items()}).drop(_BLOCK, *here, *(f"__before_{n}" for n in columns))
