"""Values of the preceding row, without one task for a long ordered group.

Rows are cut into chunks (days, unless said otherwise). Inside a chunk a window gives the
preceding row; only the first row of a chunk needs the tail of an earlier chunk, and the tails
are one row per key and chunk. A window without partition columns thus runs over days, not rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F


def with_previous(df, keys, chunk, order, cols):
    """Adds ``prev_<col>`` of the preceding row, per key in the given order (NULL at the first)."""
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(*order)
    numbered = df.withColumns({
        "row_in_chunk": F.row_number().over(in_chunk),
        "is_tail": F.lead(F.lit(True)).over(in_chunk).isNull(),
        **{f"prev_{c}": F.lag(c).over(in_chunk) for c in cols},
    })
    if len(order) == 1:
        # A plain ordering lets the tails be aggregated by hash ahead of their shuffle.
        tails = df.groupBy(*keys, chunk).agg(*[F.max_by(c, order[0]).alias(c) for c in cols])
    else:
        # Otherwise they are picked behind the window, whose shuffle is then used twice.
        tails = numbered.filter("is_tail").select(*keys, chunk, *cols)
    by_chunk = Window.partitionBy(*keys).orderBy(chunk)
    seeds = tails.select(*keys, chunk, *[F.lag(c).over(by_chunk).alias(f"seed_{c}") for c in cols])
    at_head = F.col("row_in_chunk") == 1
    return numbered.join(seeds, [*keys, chunk], "left").withColumns(
        {f"prev_{c}": F.when(at_head, F.col(f"seed_{c}")).otherwise(F.col(f"prev_{c}")) for c in cols}
    ).drop("row_in_chunk", "is_tail", *[f"seed_{c}" for c in cols])


def fill_gaps(df, keys, chunk, order, cols, fill="previous_row"):
    """NULLs of ``cols`` replaced from the preceding row, or (``locf``) from the last non-NULL."""
    if fill == "previous_row":
        # The filled columns travel as one, so there is one window function however many they are.
        rest = [c for c in df.columns if c not in cols]
        packed = df.select(*rest, F.struct(*cols).alias("row"))
        known = with_previous(packed, keys, chunk, order, ["row"])
        filled = [F.coalesce(f"row.{c}", f"prev_row.{c}").alias(c) for c in cols]
        return known.select(*rest, *filled)
    if fill != "locf":
        raise ValueError(f"unknown fill: {fill!r}")
    in_order = Window.partitionBy(*keys, chunk).orderBy(*order)
    up_to_row = in_order.rowsBetween(Window.unboundedPreceding, 0)
    carried = df.withColumns({
        **{c: F.last(c, ignorenulls=True).over(up_to_row) for c in cols},
        "is_tail": F.lead(F.lit(True)).over(in_order).isNull(),
    })
    # The last row of a filled chunk has the chunk's last values; of those, the last ones before count.
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    seeds = carried.filter("is_tail").select(
        *keys, chunk, *[F.last(c, ignorenulls=True).over(before).alias(f"seed_{c}") for c in cols]
    )
    joined = carried.join(seeds, [*keys, chunk], "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"seed_{c}")) for c in cols}
    ).drop("is_tail", *[f"seed_{c}" for c in cols])
