"""URL rules by a Bloom filter cascade, in DataFrame functions only.

Listed keys are (host, path start) pairs. Every key that any URL of the corpus could be listed under is known before
the filters are built, so alternate levels can be made exact: level 1 holds the listed keys, level 2 the corpus keys
that level 1 takes wrongly, level 3 the listed keys that level 2 takes wrongly, and so on until no key is taken
wrongly. A key's membership is then read from the depth at which it first misses, with no join.

Defined results: a null URL, or one without `://`, has empty host and path and fits no rule; a URL that fits no rule
gets `default`; the longest fitting rule (host and path together) wins, then the one with the longer host; a key listed
both ways is blocked; repeated rows and rules change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits for each key of a level, and hash functions.
BITS_PER_KEY, HASHES = 12, 6
#: Levels are put into the plan as literals up to so many bytes in all; beyond, keys are joined.
MAX_LITERAL_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\u0000"), path)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix, path start) under which a URL could be listed; path starts have the lengths that rules have."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: _key(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    # 40-bit halves: sums stay far from the limits of a long.
    a, b = (F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * level + i)), 24) for i in (0, 1))
    return [F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(HASHES)]


def _words(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """The filter's 64-bit words, in order; bits are OR-ed before the shuffle."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
    # shiftleft(1, 63) is the sign bit, which is what is meant
    words = at.select(F.floor(F.col("at") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int")).alias("bit"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    return words.unionByName(empty).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _in_level(key: Column, level: int, bits: int, words: Column) -> Column:
    tests = [F.bit_get(F.element_at(words, F.floor(p / 64).cast("int") + 1), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _positions(key, level, bits)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


class Cascade:
    """Levels are (bits, JSON array of words), bounded by MAX_LITERAL_BYTES together."""

    def __init__(self, levels: list[tuple[int, str]]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            bits, words = self.levels[i]
            hit = _in_level(key, i, bits, F.from_json(F.lit(words), "array<bigint>"))
            out = F.when(~hit, F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, max_bytes: int = MAX_LITERAL_BYTES) -> Cascade | None:
    """universe: key, listed (boolean), each key once. None if the levels would take more than max_bytes."""
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    levels: list[tuple[int, str]] = []
    while n := inside.count():
        bits = 64 * max(1, math.ceil(n * BITS_PER_KEY / 64))
        if (max_bytes := max_bytes - bits // 8) < 0:
            return None
        words = [r["bits"] for r in _words(inside, len(levels), bits).orderBy("word").collect()]
        level = (bits, json.dumps(words))
        wrong = outside.where(_in_level(F.col("key"), len(levels), bits, F.from_json(F.lit(level[1]), "array<bigint>")))
        levels.append(level)
        inside, outside = wrong, inside
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bytes: int = MAX_LITERAL_BYTES) -> DataFrame:
    """rules: host, path, verdict ('allow' or 'block'). Returns id, host, path, rule (null if none fits), verdict."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.where("host <> '' and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().orderBy(F.length("path")).collect()]
    base = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not lengths:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = base.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    listed = rules.select(_key(F.col("host"), F.col("path")).alias("key"), "verdict")
    seen = keyed.select(F.explode("_keys").alias("key")).distinct()
    universe = materialize(
        seen.select("key", F.lit(None).cast("string").alias("verdict")).unionByName(listed).groupBy("key").agg(F.max("verdict").alias("verdict")),
        "url-keys",
    )
    lists = {v: build_cascade(universe.select("key", F.coalesce(F.col("verdict") == v, F.lit(False)).alias("listed")), max_bytes // 2) for v in ("allow", "block")}
    if None in lists.values():
        return _judge_by_join(base, keyed, listed, id_col, default)
    def hits(v: str) -> Column:
        found = F.filter("_keys", lambda k: lists[v].contains(k))
        return F.transform(found, lambda k: F.struct((F.length(k) - 1).alias("size"), F.instr(k, "\u0000").alias("host_size"), F.translate(k, "\u0000", "").alias("rule"), F.lit(v).alias("verdict")))

    best = F.array_max(F.concat(hits("allow"), hits("block")))
    return keyed.withColumn("_best", best).select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def _judge_by_join(base: DataFrame, keyed: DataFrame, listed: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same result for lists too long for literals: distinct (host, path) pairs look their keys up by a join."""
    pairs = keyed.select("host", "path", F.explode("_keys").alias("key")).distinct().join(listed, "key")
    best = pairs.groupBy("host", "path").agg(F.max(F.struct((F.length("key") - 1).alias("size"), F.instr("key", "\u0000").alias("host_size"), F.translate("key", "\u0000", "").alias("rule"), "verdict")).alias("_best"))
    return base.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
