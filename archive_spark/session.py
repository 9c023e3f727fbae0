"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def get_spark(app: str = "archive_spark", *, master: str | None = None, shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; shuffle partitions are left to Spark's setting unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    session = builder.config(map=conf | (extra or {})).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """From now on, Arrow batches of this session hold `limit` bytes at most, or one row: texts can be long, and a task
    holds several batches on either side."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= limit:
        spark.conf.set(key, limit)


def _bytes(text: str) -> int:
    digits = text.rstrip("bBkKmMgG")
    return int(digits) << {"k": 10, "m": 20, "g": 30}.get(text[len(digits) :].lower().rstrip("b"), 0)
