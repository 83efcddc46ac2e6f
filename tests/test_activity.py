"""The breakdowns of the activity report, from ledger rows and from the pre-aggregate."""

from faultline.operators import activity as act
from faultline.sources.views import AS_OF, view

SF = "/root/testdata/sf0.001"


def shown(df):
    return sorted(map(str, df.collect()))


def test_pre_aggregate_loses_nothing(spark):
    rows = act.conform(view(spark, SF, "activity")).cache()
    grain, times, usage, registry = act.grain(rows).cache(), act.latencies(rows), view(spark, SF, "usage"), view(spark, SF, "registry")
    assert grain.agg({"n_events": "sum"}).first()[0] == rows.count()
    assert shown(act.features(grain, times)) == shown(act.features(rows))
    assert shown(act.tools(grain, times)) == shown(act.tools(rows))
    assert shown(act.log_parser(act.parses(rows))) == shown(act.log_parser(rows))
    for section in (act.categories, act.clients, act.by_channel, act.hours, act.errors, act.ladder):
        assert shown(section(grain)) == shown(section(rows))
    assert shown(act.by_day_channel(grain, AS_OF, 35)) == shown(act.by_day_channel(rows, AS_OF, 35))
    for section, other in ((act.users, usage), (act.totals, usage), (act.orgs, registry)):
        assert shown(section(grain, other)) == shown(section(rows, other))


def test_silent_users_are_those_without_chat_or_turns(spark):
    ledger = spark.createDataFrame(
        [(i, "action", user, channel) for i, (user, channel) in enumerate([("a", "web"), ("b", "chat"), ("b", "web"), ("c", "web"), (None, "web"), ("d", "web")])]
        + [(9, "ui", "e", "web")], "event_id long, kind string, username string, channel string",
    ).selectExpr(
        "*", "timestamp'2024-01-01 10:00:00' AS at_ts", "date'2024-01-01' AS day", "'x' AS action", "true AS ok", "false AS meta_has_log",
    )
    usage = spark.createDataFrame([("c", 5), (None, 5), ("z", 1)], "username string, total_tokens long")
    total = act.totals(act.conform(ledger), usage).first()
    assert (total.actions, total.ui_events, total.active_users, total.llm_turns, total.non_llm_users) == (6, 1, 5, 3, 2)
