"""Streams over many batches: results equal the batch job's, increments stay few, state ends."""

import os
import random
import shutil

from pyspark.sql import functions as F

from faultline.sources import snapshots
from faultline.streaming import intake


def batches(spark, tmp_path, schema, parts):
    """A stream that takes one file, and so one part, per batch."""
    folder = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / f"p{i:03d}"))
    files = sorted(folder.glob("p*/*.json"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, f in enumerate(files):
        shutil.copy(f, flat / f"{i:03d}.json")
        # files are taken by time of change
        os.utime(flat / f"{i:03d}.json", (1_600_000_000 + i, 1_600_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(flat))


def test_increments_are_merged_by_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(intake, "FAN", 3)
    rnd = random.Random(5)
    parts = [[(rnd.choice("abc"), f"2024-01-0{rnd.randint(1, 3)}", rnd.randint(1, 9)) for _ in range(20)] for _ in range(14)]
    schema = "username string, day string, total_tokens long"
    got = intake.daily_tokens(batches(spark, tmp_path, schema, parts), str(tmp_path / "out"))
    want = {}
    for u, d, n in (r for part in parts for r in part):
        want[u, d] = want.get((u, d), 0) + n
    assert {(r.username, r.day): r.tokens for r in got.collect()} == want
    folder = str(tmp_path / "out" / "increments")
    state = snapshots.current(spark, folder)
    assert sorted(p[2] for p in state.parts) == ["span=0-8", "span=12-12", "span=13-13", "span=9-11"]
    # a replay of a committed batch changes nothing
    again = spark.createDataFrame([("a", "2024-01-01", 100)], "username string, day string, tokens long")
    intake.keep_increment(again, 13, folder, lambda df: df)
    intake.keep_increment(again, 4, folder, lambda df: df)
    assert snapshots.current(spark, folder).number == state.number


def test_burst_windows_over_ten_batches(spark, tmp_path, monkeypatch):
    rnd = random.Random(9)
    parts = [[(f"k{b}_{rnd.randint(0, 3)}" if rnd.random() < 0.7 else "steady", b * 1_000 + rnd.randint(0, 999)) for _ in range(40)] for b in range(10)]
    progress = []
    plain = intake.drain

    def watched(*args, **kwargs):
        query = plain(*args, **kwargs)
        progress.extend(query.recentProgress)
        return query

    monkeypatch.setattr(intake, "drain", watched)
    stream = batches(spark, tmp_path, "key string, second long", parts).withColumn("ts", F.timestamp_seconds("second").cast("timestamp_ntz"))
    got = {(r.key, r.window_start): (r.events, r.allowed, r.denied) for r in intake.burst_windows(stream, "key", "ts", 3, 300, str(tmp_path / "out")).collect()}
    want, start = {}, {}
    for key, second in sorted((r for part in parts for r in part), key=lambda r: r[1]):
        if key not in start or second - start[key] >= 300:
            start[key] = second
        want[key, start[key]] = want.get((key, start[key]), 0) + 1
    assert got == {k: (n, min(n, 3), n - min(n, 3)) for k, n in want.items()}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # every batch has keys of its own; those of batches long past are gone
    assert len(held) >= 10 and max(held) <= 15
