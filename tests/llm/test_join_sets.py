"""Whole sets are written only for pairs that bit sets leave."""

from archive_spark.llm import ngram_join

from . import brute


def test_whole_sets_of_near_pairs_only(spark, monkeypatch):
    common = " ".join(f"c{i}" for i in range(90))
    rows = [(i, f"{common} " + " ".join(f"u{i}x{k}" for k in range(24))) for i in range(40)]  # candidates that cannot link
    rows += [(100 + i, " ".join(f"n{k}" for k in range(120 - i))) for i in range(3)]
    written, read = {}, ngram_join._read_sets

    def spy(scratch, base, owners, column, form):
        df = read(scratch, base, owners, column, form)
        written[column] = max(written.get(column, 0), df.count())
        return df

    monkeypatch.setattr(ngram_join, "_read_sets", spy)
    got = sorted(tuple(r) for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute.jaccard(rows))
    assert written["bits"] > 3 >= written["items"] > 0
