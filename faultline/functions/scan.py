"""Running computations whose groups may be very large.

A window over ``PARTITION BY key`` puts a whole key into one task, and a key
may hold a third of all rows.  Queries therefore scan in two levels
(``wide=True``): rows are cut into chunks ``(key, order div chunk)``, each
chunk is scanned on its own, one summary row per chunk is scanned per key, and
the carried-in value is joined back to the chunk.  The plain window stays for
keys that are bounded by nature, such as the text of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536
_CHUNK = "__chunk"


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    """The right side of a join back to its own source: keys under other names."""
    for i, k in enumerate(keys):
        df = df.withColumnRenamed(k, f"__k{i}")
    return df


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return cond


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    sums: dict[str, Column] | None = None,
    lows: dict[str, str] | None = None,
    lasts: dict[str, Column] | None = None,
    prevs: dict[str, Column] | None = None,
    peaks: dict[str, Column] | None = None,
    wide: bool = False,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Add inclusive running values over ``keys`` in the order of a whole number.

    ``sums``   name -> summand, the running sum.
    ``lows``   name -> name of one of ``sums``: the lowest that sum has been
               before the row, the start of the key (0) included.
    ``lasts``  name -> value, the latest value that is not null, own row included.
    ``prevs``  name -> value, the same without the own row.
    ``peaks``  name -> value, the running maximum.

    ``order`` must be a whole-number column; rows of one key with the same
    order value must be alike or absent.
    """
    sums, lows, lasts, prevs, peaks = sums or {}, lows or {}, lasts or {}, prevs or {}, peaks or {}
    part = [*keys, _CHUNK] if wide else keys
    rows = df.withColumn(_CHUNK, F.floor(F.col(order) / F.lit(chunk))) if wide else df
    inside = (
        Window.partitionBy(*part).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for name, value in sums.items():
        rows = rows.withColumn(f"__s_{name}", F.sum(value).over(inside))
    for name, source in lows.items():
        earlier = F.col(f"__s_{source}") - sums[source]
        rows = rows.withColumn(f"__b_{name}", earlier)
        rows = rows.withColumn(f"__l_{name}", F.min(f"__b_{name}").over(inside))
    for name, value in lasts.items():
        rows = rows.withColumn(f"__v_{name}", F.last(value, ignorenulls=True).over(inside))
    above = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for name, value in prevs.items():
        rows = rows.withColumn(f"__q_{name}", value)
        rows = rows.withColumn(f"__v_{name}", F.last(f"__q_{name}", ignorenulls=True).over(above))
    for name, value in peaks.items():
        rows = rows.withColumn(f"__p_{name}", F.max(value).over(inside))

    if not wide:
        return rows.select(
            *df.columns, *[F.col(f"__s_{n}").alias(n) for n in sums], *[F.col(f"__l_{n}").alias(n) for n in lows],
            *[F.col(f"__v_{n}").alias(n) for n in [*lasts, *prevs]], *[F.col(f"__p_{n}").alias(n) for n in peaks],
        )

    summary = [F.max_by(f"__s_{n}", order).alias(f"__ts_{n}") for n in sums]
    summary += [F.min(f"__l_{n}").alias(f"__tl_{n}") for n in lows]
    summary += [
        F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__tv_{n}")
        for n in lasts
    ]
    summary += [
        F.max_by(f"__q_{n}", F.when(F.col(f"__q_{n}").isNotNull(), F.col(order))).alias(f"__tv_{n}")
        for n in prevs
    ]
    summary += [F.max(f"__p_{n}").alias(f"__tp_{n}") for n in peaks]
    chunks = rows.groupBy(*keys, _CHUNK).agg(*summary)

    over = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        *keys, _CHUNK,
        *[F.coalesce(F.sum(f"__ts_{n}").over(before), F.lit(0)).alias(f"__cs_{n}") for n in sums],
        *[F.col(f"__tl_{n}") for n in lows],
        *[F.last(f"__tv_{n}", ignorenulls=True).over(before).alias(f"__cv_{n}") for n in [*lasts, *prevs]],
        *[F.max(f"__tp_{n}").over(before).alias(f"__cp_{n}") for n in peaks],
    )
    if lows:
        lifted = {n: F.col(f"__tl_{n}") + F.col(f"__cs_{s}") for n, s in lows.items()}
        carried = carried.select(
            "*", *[F.min(v).over(before).alias(f"__cl_{n}") for n, v in lifted.items()]
        )

    carried = _renamed(carried, keys).withColumnRenamed(_CHUNK, "__kc")
    joined = rows.join(carried, _same(keys) & (F.col(_CHUNK) == F.col("__kc")), "left")
    out = [F.col(c) for c in df.columns]
    out += [(F.col(f"__s_{n}") + F.col(f"__cs_{n}")).alias(n) for n in sums]
    for n, s in lows.items():
        out.append(F.least(F.col(f"__l_{n}") + F.col(f"__cs_{s}"), F.col(f"__cl_{n}")).alias(n))
    out += [F.coalesce(f"__v_{n}", f"__cv_{n}").alias(n) for n in [*lasts, *prevs]]
    out += [F.greatest(f"__p_{n}", f"__cp_{n}").alias(n) for n in peaks]
    return joined.select(*out)


def number_rows(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str, wide: bool = False
) -> DataFrame:
    """Dense 1-based numbering per key.

    ``bucket`` must grow with ``order`` (a time truncated to the minute, say):
    rows are numbered inside their bucket, and buckets are offset by the rows
    before them, so no task has to sort a whole key.
    """
    if not wide:
        return df.withColumn(
            name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
        )
    rows = df.withColumn("__b", bucket)
    sizes = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = (
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    numbered = rows.withColumn("__r", F.row_number().over(inside))
    offsets = _renamed(offsets, keys).withColumnRenamed("__b", "__kb")
    joined = numbered.join(offsets, _same(keys) & F.col("__b").eqNullSafe(F.col("__kb")), "left")
    return joined.select(
        *df.columns, (F.col("__r") + F.col("__off")).cast("bigint").alias(name)
    )


def nearest_rank(
    df: DataFrame, keys: list[str], value: str, points: dict[str, int], wide: bool = False, weight: str | None = None
) -> DataFrame:
    """Exact percentiles per key at 0-based index ``round(p/100 * (n-1))``, half to even.

    Works on the histogram ``(key, value, n)``: the shuffle carries distinct
    values rather than rows, and a key has at most as many of them as the
    measure has values.  ``wide`` chunks the running count for measures with
    many millions of values.  ``weight`` names the number of times a row counts.
    """
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("bigint").alias("__val"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    )
    totals = hist.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    running = scan(hist, keys, "__val", sums={"__upto": F.col("__n")}, wide=wide, chunk=4096)
    placed = running.join(_renamed(totals, keys), _same(keys), "inner")
    picks = []
    for name, p in points.items():
        index = F.bround(F.lit(p / 100.0) * (F.col("__total") - 1)).cast("bigint")
        hit = (index < F.col("__upto")) & (index >= F.col("__upto") - F.col("__n"))
        picks.append(F.min(F.when(hit, F.col("__val"))).alias(name))
    return placed.groupBy(*keys).agg(*picks)
