"""Price grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ULP = 2.0**-52


def price_to_tick(price: Column, tick_size: Column) -> Column:
    """The integer tick of a price that lies on the grid, else null.

    A price is on the grid if its nearest tick (halves to even) gives it back within
    eight units in the last place, scaled by the tick number, or 1e-12 of a tick.
    """
    tick = F.rint(price / tick_size)
    back = tick * tick_size
    bound = F.greatest(8 * _ULP * F.abs(price), 8 * _ULP * F.abs(back), 8 * _ULP * F.abs(tick) * F.abs(tick_size), tick_size * 1e-12)
    good = (price > 0) & (tick_size > 0) & ~F.isnan(price) & (F.abs(back - price) <= bound)
    return F.when(good, tick.cast("long"))
