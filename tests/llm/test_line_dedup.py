"""Line dedup against a plain version that aligns every pair of documents."""

import random

from archive_spark.llm import line_dedup as ld


def plain(docs):
    out = []
    keyed = [(d, ld.line_keys((t or "").encode())) for d, t in docs]
    for i, (d, text) in enumerate(docs):
        gone = set()
        at, keys, words = keyed[i][1]
        for e, (_, other, _) in keyed:
            if e < d:
                gone |= {at[k] for k in ld.common_blocks(other, keys, words, ld.MIN_BLOCK_WORDS)}
        out.append((d, text if not gone else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone), len(gone)))
    return sorted(out)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, common = [line(30), line(12), line(15)], line(9)
    docs = []
    for d in range(40):
        lines = [line(rng.randrange(1, 12)) for _ in range(6)]
        if d % 3 == 0:
            lines[2:2] = passage
        if d % 2:
            lines.append(common)
        docs.append((d, "\n".join(lines)))
    docs += [(50, docs[5][1]), (51, docs[5][1] + "\n  "), (52, None), (53, ""), (54, "\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in ld.dedup_lines(df, count_col="n").collect())
    assert got == plain(docs)
    assert [n for d, _, n in got if d in (0, 3, 1, 50)] == [0, 0, 3, len(docs[5][1].split("\n"))]
    left = {r[0] for r in ld.dedup_lines(df, drop_emptied=True).select("doc_id").collect()}
    assert 50 not in left and {5, 52, 53, 54} <= left


def test_columns_of_the_caller_stay(spark):
    text = "\n".join(f"line {i} of some words that stand in both of them" for i in range(6))
    rows = [(1, text, "a", "b", "c", "d"), (2, f"head\n{text}", "e", "f", "g", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _dl_text string, gone string, did string, new string")
    got = sorted(tuple(r) for r in ld.dedup_lines(df, count_col="n").collect())
    assert got == [(*rows[0], 0), (2, "head", *rows[1][2:], 6)]


def test_patience():
    assert ld.patience([1, 2, 3, 4], [9, 1, 2, 4]) == [(0, 1), (1, 2), (3, 3)]
    assert ld.patience([], [1]) == []
    assert ld.common_blocks([1, 2, 3], [1, 2, 3], [5, 5, 5], 15) == [0, 1, 2]
    assert ld.common_blocks([1, 2, 3], [1, 7, 3], [5, 5, 5], 6) == []
