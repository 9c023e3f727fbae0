"""Event operators on awkward rows."""

from archive_spark.streaming import events


def test_rows_without_an_event_stay(spark):
    rows = [("s", None, "c1", 1, 1), ("s", "TOOL_CALL_REQUEST", "c1", 2, 2), ("s", "TOOL_CALL_REQUEST", "c1", 3, 3), ("s", "TOOL_CALL_REQUEST", None, 4, 4)]
    df = spark.createDataFrame(rows, "session_id string, event string, call_id string, ts long, event_id long")
    assert sorted(r["event_id"] for r in events.deduplicate(df).collect()) == [1, 2, 4]
