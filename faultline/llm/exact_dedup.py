"""Exact duplicates by distributed most-significant-digit radix partitioning.

Documents are split by the next bytes of their text, level by level, until a
group holds one document or its texts have ended.  A digit is a run of bytes;
runs get longer (512 bytes, then up to 4,096, 32,768, ... in all), so the number of
levels grows with the logarithm of the longest text.  Two texts are equal when
they agree in every digit and end together: bytes are compared, never digests.

Each level counts the groups first (partial counts before the shuffle, so a
group of copies of any size costs one row per task) and joins the counts to the
documents that are still undecided.  A document whose first bytes are its own
leaves at the first level; only groups of at least two go on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import stored, whole_text

FIRST_BYTES = 512
GROWTH = 8


def _digit(start: int, width: int) -> Column:
    return F.substring("__bytes", start + 1, width)


def _ended(end: int) -> Column:
    return F.octet_length("__bytes") <= end


def radix_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (), first_bytes: int = FIRST_BYTES
) -> DataFrame:
    """One row per row of ``docs``: ``key``, keep_id, group_size, kept, and the columns in ``carry``.

    keep_id is the largest key among the rows with the same text; group_size is
    the number of those rows; exactly one row of a group has kept = true.

    A null text counts as empty, so null and empty texts form one group.  A
    null key is smaller than any other; a group of null keys only has a null
    keep_id.  Rows repeated with key and text are rows of their group like any
    other, and one of them is kept.  Texts of any length are compared whole.
    An empty table gives no rows.  Other columns of ``docs``, whatever their
    names, take no part unless named in ``carry``.
    """
    rows = docs.select(
        F.col(key).alias("__key"), F.struct(*[F.col(c) for c in carry]).alias("__carry") if carry else F.lit(None).cast("int").alias("__carry"),
        F.monotonically_increasing_id().alias("__uid"), F.lit(0).cast("bigint").alias("__gid"), whole_text(text).cast("binary").alias("__bytes"),
    )
    start, width, level, finished = 0, first_bytes, 0, []
    while True:
        end = start + width
        split = rows.select("__key", "__gid", _digit(start, width).alias("__digit"), _ended(end).alias("__end"))
        groups = stored(
            split.groupBy("__gid", "__digit", "__end").agg(F.count(F.lit(1)).alias("__n"), F.max("__key").alias("__keep")).filter("__n > 1")
            .select(F.col("__gid").alias("__g"), F.col("__digit").alias("__d"), F.col("__end").alias("__e"), "__n", "__keep", F.monotonically_increasing_id().alias("__new")),
            f"radix-groups-{level}",
        )
        same = (F.col("__gid") == F.col("__g")) & (_digit(start, width) == F.col("__d")) & (_ended(end) == F.col("__e"))
        undecided = F.col("__n").isNotNull() & ~F.col("__e")
        placed = stored(
            # the groups grow with the documents: merged at every size, never broadcast
            rows.join(groups.hint("merge"), same, "left").select(
                "__key", "__carry", "__uid", F.coalesce("__new", F.lit(-1)).alias("__gid"), F.coalesce("__n", F.lit(1)).alias("__n"),
                F.when(F.col("__n").isNull(), F.col("__key")).otherwise(F.col("__keep")).alias("__keep"),
                undecided.alias("__open"), F.when(undecided, F.col("__bytes")).alias("__bytes"),
            ),
            f"radix-level-{level}",
        )
        finished.append(placed.filter("NOT __open").select("__key", "__carry", "__uid", F.lit(level).alias("__level"), "__gid", "__n", "__keep"))
        rows = placed.filter("__open").select("__key", "__carry", "__uid", "__gid", "__bytes")
        if rows.isEmpty():
            break
        start, width, level = end, end * (GROWTH - 1), level + 1

    found = reduce(DataFrame.unionByName, finished)
    # of the rows that share text and largest key, the first one read stays
    tied = (F.col("__n") > 1) & F.col("__key").eqNullSafe(F.col("__keep"))
    first = found.filter(tied).groupBy(F.col("__level").alias("__l"), F.col("__gid").alias("__g")).agg(F.min("__uid").alias("__first"))
    chosen = found.filter(tied).join(first, (F.col("__level") == F.col("__l")) & (F.col("__gid") == F.col("__g")))
    out = [F.col("__key").alias(key), F.col("__keep").alias("keep_id"), F.col("__n").cast("bigint").alias("group_size")]
    extra = [F.col(f"__carry.{c}").alias(c) for c in carry]
    return found.filter(~tied).select(*out, (F.col("__n") == 1).alias("kept"), *extra).unionByName(
        chosen.select(*out, (F.col("__uid") == F.col("__first")).alias("kept"), *extra)
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``; rules as in ``radix_groups``."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    kept = radix_groups(whole, "key", "text", carry=["row"]).filter("kept")
    return kept.select("row.*")
