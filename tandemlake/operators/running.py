"""Running aggregates over positions in two levels, so that no key is one task's work.

A key's rows are dealt to tiles of its positions. A window runs within each tile; another runs over one row for each tile
and carries what stands before it (or behind it). The rows move once, by key and tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a tile.
TILE = 1 << 20
_MERGE = {"max": F.greatest, "min": F.least, "sum": lambda a, b: a + b}


def running(df: DataFrame, keys: list[str], position: str, order: list[Column | str], out: dict[str, tuple[str, Column]], tile: int = TILE, behind: bool = False, inclusive: bool = False) -> DataFrame:
    """df with a column for each of out: name -> (max, min or sum, of what), over the rows before each row of its key.

    behind: over the rows behind instead. inclusive: with the row itself. order decides within a tile and must refine
    the position's order. Null where no row has a value; for sum, 0.
    """
    merge = {name: _MERGE[kind] for name, (kind, _) in out.items()}
    functions = {"max": F.max, "min": F.min, "sum": F.sum}
    mark = "".join(sorted(df.columns, key=len)[-1:]) + "_"  # longer than any column's name
    tiled = df.withColumn(f"{mark}tile", F.floor(F.col(position) / tile))
    # what lies behind comes before in falling order: a frame that ends at the row is kept up, one that begins there is
    # made anew for each row
    turned = (lambda c: (F.col(c) if isinstance(c, str) else c).desc()) if behind else (lambda c: c)
    frame, far = (Window.unboundedPreceding, 0 if inclusive else -1), (Window.unboundedPreceding, -1)
    near = Window.partitionBy(*keys, f"{mark}tile").orderBy(*map(turned, order)).rowsBetween(*frame)
    tiles = tiled.groupBy(*keys, f"{mark}tile").agg(*[functions[kind](what).alias(f"{mark}{name}") for name, (kind, what) in out.items()])
    over = Window.partitionBy(*keys).orderBy(turned(f"{mark}tile")).rowsBetween(*far)
    tiles = tiles.select(*keys, f"{mark}tile", *[functions[kind](f"{mark}{name}").over(over).alias(f"{mark}far_{name}") for name, (kind, _) in out.items()])
    placed = tiled.select("*", *[functions[kind](what).over(near).alias(f"{mark}near_{name}") for name, (kind, what) in out.items()])
    joined = placed.join(tiles, [*keys, f"{mark}tile"])
    zero = lambda name, c: F.coalesce(c, F.lit(0)) if out[name][0] == "sum" else c
    made = [merge[name](zero(name, F.col(f"{mark}near_{name}")), zero(name, F.col(f"{mark}far_{name}"))).alias(name) for name in out]
    return joined.select(*df.columns, *made)
