"""Files in, tables out, retention and removal."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.operators import debug_logs
from faultline.sources import files, ledger, snapshots, stores


def test_day_files(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-05"):
        rec = {"at": f"{day}T10:00:00Z", "username": "u", "total_tokens": 12.7, "prompt_tokens": "bad", "cost": "0.5"}
        (tmp_path / f"{day}.jsonl").write_text(json.dumps(rec) + "\n{broken\n")
    raw = ledger.read_days(spark, str(tmp_path), ledger.USAGE_SCHEMA, "2024-01-05", 4)
    rows = ledger.conform_usage(raw).orderBy("at").collect()
    assert [str(r.day) for r in rows] == ["2024-01-02", "2024-01-05"]
    assert rows[0].total_tokens == 12 and rows[0].prompt_tokens == 0 and rows[0].cost == 0.5


def test_retention_and_removal(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    data = [("2024-01-01", "a", 1), ("2024-01-01", "b", 2), ("2024-01-02", "a", 3), ("2024-01-03", "b", 4)]
    df = spark.createDataFrame(data, "d string, username string, n int").withColumn("day", F.to_date("d")).drop("d")
    ledger.append(df, folder)
    ledger.append(df.filter("n = 4"), folder)
    assert ledger.forget_user(spark, folder, "a") == 2
    assert sorted(r.n for r in ledger.read(spark, folder).collect()) == [2, 4, 4]
    assert ledger.forget_user(spark, folder, "nobody") == 0
    assert ledger.prune(spark, folder, "2024-01-03", 1) == ["2024-01-01"]
    assert sorted(r.n for r in ledger.read(spark, folder).collect()) == [4, 4]


def test_a_broken_run_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "ledger")
    data = [("2024-01-01", "a", 1), ("2024-01-01", "b", 2), ("2024-01-02", "a", 3), ("2024-01-03", "b", 4)]
    df = spark.createDataFrame(data, "d string, username string, n int").withColumn("day", F.to_date("d")).drop("d")
    ledger.append(df, folder)
    state = snapshots.current(spark, folder)

    def broken(*_):
        raise OSError("lost")

    rows = lambda: sorted(r.n for r in ledger.read(spark, folder).collect())
    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", broken)
        for step in (lambda: ledger.forget_user(spark, folder, "a"), lambda: ledger.prune(spark, folder, "2024-01-03", 1), lambda: ledger.append(df, folder)):
            with pytest.raises(OSError):
                step()
            assert rows() == [1, 2, 3, 4]
    assert ledger.forget_user(spark, folder, "a") == 2 and rows() == [2, 4]
    # a writer that read the state before is refused
    with pytest.raises(snapshots.Overtaken):
        snapshots.commit(spark, state, [], folder)
    assert rows() == [2, 4] and ledger.vacuum(spark, folder) > 0 and rows() == [2, 4] and ledger.vacuum(spark, folder) == 0
    assert ledger.forget_user(spark, folder, "b") == 2 and rows() == []


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=HYPERLINK(1)", "u")], "event_id int, client string, username string")
    for name in ("kind", "role", "channel", "action", "category", "org_id", "tool", "token_kind"):
        rows = rows.withColumn(name, F.lit("x"))
    rows = rows.withColumn("at_ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).withColumn("status", F.lit(200)).withColumn("ok", F.lit(True)).withColumn("ms", F.lit(-5))
    rows = rows.withColumn("meta_exceptions", F.lit(1)).withColumn("meta_has_log", F.lit(True)).withColumn("meta_stored", F.lit(False)).withColumn("meta_parse_ms", F.lit(3))
    ledger.export_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert back.client == "'=HYPERLINK(1)" and back.ms == "'-5" and json.loads(back.meta.replace('\\"', '"'))["exceptions"] == 1


def test_raw_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_bytes(b"59.0 X,FINE\r\n1|USER_DEBUG|[1]|DEBUG|bad \xff byte\r\n\r\nend")
    lines = files.log_lines(spark, str(tmp_path / "logs")).orderBy("line_no").collect()
    assert [r.log_id for r in lines] == ["a"] * 3 and "�" in lines[1].raw
    root = tmp_path / "org"
    for path in ("classes/Foo.cls", "triggers/T.trigger", "flows/F.flow", "objects/O.object", "lwc/cmp/cmp.js", "lwc/cmp/cmp.html", "other/x.txt"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)
    got = {(r.kind, r.name, r.file) for r in files.backup(spark, str(root)).collect()}
    assert got == {("class", "Foo", "Foo.cls"), ("trigger", "T", "T.trigger"), ("flow", "F", "F.flow"), ("object", "O", "O.object"), ("lwc", "cmp", "cmp.js"), ("lwc", "cmp", "cmp.html")}
    (tmp_path / "apex.json").write_text(json.dumps({"Id": "1", "Name": "Foo", "Body": "class Foo {}"}) + "\n")
    assert files.listing(spark, str(tmp_path / "apex.json"), files.APEX_LISTING).first().Name == "Foo"


def test_stores(spark, tmp_path):
    folder = str(tmp_path / "kb")
    cards = spark.createDataFrame([("o1", "A"), ("o2", "B")], "org_id string, component_id string")
    stores.save_knowledgebase({"cards": cards}, folder)
    stores.save_knowledgebase({"cards": cards.filter("org_id = 'o1'").withColumn("component_id", F.lit("A2"))}, folder)
    kb = stores.load_knowledgebase(spark, folder)
    assert list(kb) == ["cards"] and sorted(r.component_id for r in kb["cards"].collect()) == ["A2", "B"]
    inc = spark.createDataFrame([("o1", 1), ("o1", 2)], "org_id string, incident_id int")
    stores.save_incidents(inc, str(tmp_path / "inc"))
    assert [r.incident_id for r in stores.list_incidents(spark, str(tmp_path / "inc"), "o1").collect()] == [2, 1]
    assert stores.load_incident(spark, str(tmp_path / "inc"), "o1", 1).count() == 1
    lines = spark.createDataFrame([(1, 1, "1|USER_DEBUG|[1]|DEBUG|x"), (2, 1, "1|USER_DEBUG|[1]|DEBUG|y")], "log_id int, line_no bigint, raw string")
    routed = debug_logs.routed(debug_logs.events(lines))
    stores.save_section(routed, "routed", str(tmp_path / "logs"))
    stores.save_section(lines.select("log_id").distinct(), "log_meta", str(tmp_path / "logs"))
    assert [r.log_id for r in stores.list_logs(spark, str(tmp_path / "logs")).collect()] == [2, 1]
    stores.download_log({"routed": stores.load_section(spark, "routed", str(tmp_path / "logs"))}, 2, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "routed")).first().detail == "y"
    stores.append_run(spark.createDataFrame([("o1", 1)], "org_id string, added int"), str(tmp_path / "runs"))
    stores.append_run(spark.createDataFrame([("o1", 2)], "org_id string, added int"), str(tmp_path / "runs"))
    assert stores.run_counts(spark, str(tmp_path / "runs")).first().runs == 2
