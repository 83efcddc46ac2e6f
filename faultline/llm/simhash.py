"""SimHash near duplicates, linked by multi-index hashing.

1. A text's fingerprint has 64 bits, each the majority of that bit over the
   hashes of the text's word n-grams.  Equal fingerprints are one from here on.
2. A fingerprint is cut into segments.  When two fingerprints differ in at most
   ``distance`` bits, some segment of theirs differs in at most its radius (1 in
   the first segments, 0 in the others), so a table by segment value holds the
   one within a small Hamming ball around the other's value.  Of two values that
   differ in one bit, one has that bit set: the ball that is enumerated holds the
   value itself and the values with one set bit cleared, which meets every pair
   from one of its sides.
3. Rows of one table entry ("slot"), fingerprints at home there and probes, are
   compared over all 64 bits.  Where one slot holds many, only what connects
   them goes on (a forest), not every link; slots too large for one task are
   cut into blocks, first each against one common block, then everything
   outside the largest class so found against all blocks.
4. Links connect fingerprints to components; documents take that of theirs.

Nothing is sampled and no candidate list is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import release, short_batches, spark_hash_partitions, stored
from faultline.llm.components import components

WORDS = 4
DISTANCE = 4
SEGMENTS = 3
SEED = 42
BITS = 64
# rows of one slot compared in one task; rows of one bin of slots; slots up to this size give every link
BLOCK = 2_048
BIN_ROWS = 200_000
PAIRS = 16
# hashes unpacked to bits at once, rows compared at once
_UNPACK = 65_536
_ROWS = 256
_SIGN = 1 << 63
_LINK = "a bigint, b bigint"


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words.

    A-Z are lower-cased, words end at ASCII white space, fewer words than
    ``words`` make one n-gram.  A bit is 1 if it is set in over half of the
    n-grams' hashes, repeats counted.
    """
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return 0
    take = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(found) - take + 1
    grams = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[take - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _UNPACK):
        part = hashes[at : at + _UNPACK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = sum(1 << bit for bit in np.flatnonzero(2 * counts > n).tolist())
    return value - (1 << 64) if value >= _SIGN else value


def hexadecimal(fp: Column) -> Column:
    """16 lowercase digits of a fingerprint read as unsigned."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp) for every row; a null text counts as empty and has fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = [fingerprint(t if isinstance(t, str) else None, words) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "fp": np.array(fps, np.int64)})

    short_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, fp bigint")


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment that is searched.

    With distance = count * q + a, a pair within it has one of the first a + 1
    segments within q bits or one of the others within q - 1.
    """
    q, a = divmod(distance, count)
    if q > 1 or count < 2:
        raise ValueError("two segments at least, and more than half of the distance: larger balls are not enumerated")
    edges = [BITS * i // count for i in range(count + 1)]
    cut = [(edges[i], edges[i + 1] - edges[i], q if i <= a else q - 1) for i in range(count)]
    return [s for s in cut if s[2] >= 0]


def _slots(fps: DataFrame, distance: int, count: int) -> DataFrame:
    """(slot, home, fp): each fingerprint where its segments lie, and as a probe where their balls reach."""
    entries = []
    for i, (first, width, radius) in enumerate(segments(distance, count)):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        # two segments at least, so a value leaves room for its segment's number
        slot = value + F.lit(i << 58)
        entries.append(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("home"))))
        if radius:
            powers = F.array(*[F.lit(1 << b) for b in range(width)])
            cleared = F.filter(powers, lambda p: value.bitwiseAND(p) != 0)
            entries.append(F.transform(cleared, lambda p: F.struct((slot - p).alias("slot"), F.lit(False).alias("home"))))
    return fps.select("fp", F.explode(F.concat(*entries)).alias("e")).select("e.slot", "e.home", "fp")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ; counted on unsigned numbers, since numpy counts the absolute value's bits."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _near(a: np.ndarray, home_a: np.ndarray, b: np.ndarray, home_b: np.ndarray, distance: int) -> np.ndarray:
    return (_apart(a[:, None], b[None, :]) <= distance) & (home_a[:, None] | home_b[None, :])


def forest(fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs that connect what links of at most ``distance`` connect, one less than each class has members."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        root, queue, left = int(fps[left[0]]), left[:1], left[1:]
        while len(queue) and len(left):
            part, queue = queue[:_ROWS], queue[_ROWS:]
            hit = _near(fps[part], home[part], fps[left], home[left], distance).any(axis=0)
            new, left = left[hit], left[~hit]
            out += [(root, int(x)) for x in fps[new]]
            queue = np.concatenate([queue, new])
    return out


def _bin_links(slot: np.ndarray, home: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """What connects the rows of every slot of a bin."""
    order = np.argsort(slot, kind="stable")
    slot, home, fps = slot[order], home[order], fps[order]
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([starts, [len(slot)]]))
    useful = (lengths > 1) & np.logical_or.reduceat(home, starts) if len(starts) else np.zeros(0, bool)
    out: list[tuple[int, int]] = []
    few = useful & (lengths <= PAIRS)
    member = np.repeat(few, lengths)
    ends = np.repeat(starts + lengths, lengths)
    rows = np.flatnonzero(member)
    for step in range(1, PAIRS):
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            break
        other = rows + step
        near = (_apart(fps[rows], fps[other]) <= distance) & (home[rows] | home[other])
        out += zip(fps[rows[near]].tolist(), fps[other[near]].tolist(), strict=True)
    for at, size in zip(starts[useful & ~few].tolist(), lengths[useful & ~few].tolist(), strict=True):
        out += forest(fps[at : at + size], home[at : at + size], distance)
    return list(set(out))


def _upto(count: str) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.col(count).cast("bigint") - 1)


def _large_links(rows: DataFrame, distance: int) -> DataFrame:
    """What connects rows (slot, home, fp, blocks) of slots too large for one task."""

    def within(group: pd.DataFrame) -> pd.DataFrame:
        found = forest(group["fp"].to_numpy(np.int64), group["home"].to_numpy(bool), distance)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def across(group: pd.DataFrame) -> pd.DataFrame:
        loose, found = group[group["probing"]], set()
        fps, home, label = (group[c].to_numpy() for c in ("fp", "home", "label"))
        for at in range(0, len(loose), _ROWS):
            part = loose.iloc[at : at + _ROWS]
            own = part["label"].to_numpy()
            near = _near(part["fp"].to_numpy(), part["home"].to_numpy(), fps, home, distance) & (own[:, None] != label[None, :])
            i, j = np.nonzero(near)
            found |= set(zip(own[i].tolist(), label[j].tolist(), strict=True))
        return pd.DataFrame(list(found), columns=["a", "b"], dtype="int64")

    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("bigint"))
    # the first block is compared with every other, so large classes meet there
    common = rows.filter("block = 0 AND home").withColumn("block", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
    first = stored(rows.unionByName(common).groupBy("slot", "block").applyInPandas(within, _LINK), "simhash-block-links")
    known = components(first, "simhash-block-classes").withColumnRenamed("component", "class")
    labelled = rows.join(known, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("class", "fp")).drop("node", "class")
    labelled = stored(labelled, "simhash-labelled")
    top = labelled.groupBy("slot", "label").agg(F.count(F.lit(1)).alias("k")).groupBy(F.col("slot").alias("s")).agg(F.max(F.struct("k", "label")).alias("top"))
    placed = labelled.join(top, F.col("slot") == F.col("s")).withColumn("loose", F.col("label") != F.col("top.label")).drop("s", "top")
    sides = placed.filter("loose").groupBy(F.col("slot").alias("s")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("sides"))
    placed = placed.join(sides, F.col("slot") == F.col("s")).drop("s")
    columns = ["slot", "side", "block", "fp", "home", "label", "probing"]
    probes = placed.filter("loose").withColumn("side", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("sides")).cast("bigint"))
    probes = probes.withColumn("block", F.explode(_upto("blocks"))).withColumn("probing", F.lit(True))
    field = placed.withColumn("side", F.explode(_upto("sides"))).withColumn("probing", F.lit(False))
    last = probes.select(columns).unionByName(field.select(columns)).groupBy("slot", "side", "block").applyInPandas(across, _LINK)
    return first.unionByName(stored(last, "simhash-cell-links"))


def links(fps: DataFrame, distance: int = DISTANCE, count: int = SEGMENTS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) that connect all that lie within ``distance`` bits."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = _bin_links(group["slot"].to_numpy(np.int64), group["home"].to_numpy(bool), group["fp"].to_numpy(np.int64), distance)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    spark = fps.sparkSession
    rows = _slots(fps, distance, count)
    sizes = rows.groupBy(F.col("slot").alias("s")).agg(F.count(F.lit(1)).alias("k"), F.max("home").alias("homes"))
    large = stored(sizes.filter((F.col("k") > BLOCK) & F.col("homes")).select("s", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "simhash-large-slots")
    one_task = rows if large.isEmpty() else rows.join(large, F.col("slot") == F.col("s"), "left_anti")
    reach = sum(1 + width * radius for _, width, radius in segments(distance, count))
    bins = max(spark_hash_partitions(spark), -(-fps.count() * reach // BIN_ROWS))
    binned = one_task.withColumn("bin", F.pmod(F.xxhash64("slot"), F.lit(bins)))
    found = stored(binned.groupBy("bin").applyInPandas(run, _LINK), "simhash-links")
    if large.isEmpty():
        return found
    return found.unionByName(_large_links(rows.join(large, F.col("slot") == F.col("s")).drop("s"), distance))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, count: int = SEGMENTS) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hexadecimal digits), component_id (smallest key reachable).

    Fingerprints link when they differ in at most ``distance`` bits.  Texts that
    are null, empty or without words have fingerprint 0 and link like any
    other.  Equal fingerprints always link.  A null key is no component's
    smallest unless the component has no other.  Rows repeated with key and
    text get the same answer each; an empty table gives no rows; other columns
    take no part.  Texts of any length are read whole, their hashes counted in
    portions.
    """
    spark = docs.sparkSession
    base = stored(fingerprints(docs, key, text, words), "simhash-base")
    distinct = stored(base.groupBy("fp").agg(F.min("key").alias("least")), "simhash-distinct")
    found = links(distinct.select("fp"), distance, count)
    of_fp = stored(components(found, "simhash-components"), "simhash-classes")
    release(spark)
    # what grows with the documents is merged, never broadcast
    linked = distinct.join(of_fp.hint("merge"), F.col("fp") == F.col("node")).select("fp", "least", "component")
    lowest = linked.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("cid"))
    answer = linked.join(lowest.hint("merge"), F.col("component") == F.col("c")).select(F.col("fp").alias("f"), "cid")
    single = distinct.join(of_fp.hint("merge"), F.col("fp") == F.col("node"), "left_anti").select(F.col("fp").alias("f"), F.col("least").alias("cid"))
    out = base.join(answer.unionByName(single).hint("merge"), F.col("fp") == F.col("f"))
    return out.select(F.col("key").alias(key), hexadecimal(F.col("fp")).alias("fingerprint"), F.col("cid").alias("component_id"))
