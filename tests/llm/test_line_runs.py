"""Line dedup against a plain search for runs of 20 words that an earlier document holds too."""

import random

from archive_spark.llm import line_dedup as ld


def plain(docs):
    out = []
    for d, text in docs:
        at, keys, words = ld.line_keys(text.encode())
        gone = set()
        for e, other in docs:
            if e < d:
                have = ld.line_keys(other.encode())[1]
                for i in range(len(keys)):
                    for k in range(len(have)):
                        n = 0
                        while i + n < len(keys) and k + n < len(have) and keys[i + n] == have[k + n]:
                            n += 1
                        if sum(words[i : i + n]) >= ld.MIN_BLOCK_WORDS:
                            gone |= set(at[i : i + n])
        out.append((d, len(gone)))
    return out


def counts(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(tuple(r) for r in ld.dedup_lines(df, count_col="n").select("doc_id", "n").collect())


def test_repeated_moved_and_scattered_passages(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p1, p2, x, y, z, m1, m2 = (line(n) for n in (12, 12, 9, 9, 9, 25, 25))
    short = [line(7) for _ in range(3)]
    ones = [line(1) for _ in range(30)]
    docs = [
        [x, p1, p2, y, p1, p2, z], [line(6), p1, p2, line(5)],  # twice in the earlier one
        [m1, x, m2], [m2, line(8), m1],  # in another order
        [short[0], short[1]], [short[1], short[2]], [line(3), *short, line(3)], [*short],  # first holders have parts
        [line(2), *ones], [*ones, "", line(2)],  # lines of one word
        [p1, p2, line(4), p1, p2],
    ]
    docs = [(i, "\n".join(t)) for i, t in enumerate(docs)]
    got = counts(spark, docs)
    assert got == plain(docs)
    assert [n for _, n in got] == [0, 2, 0, 2, 0, 0, 0, 3, 0, 30, 4]


def test_random_runs(spark):
    rng = random.Random(6)
    pool = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice((1, 2, 5, 9, 14)))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(60)]
    assert counts(spark, docs) == plain(docs)
