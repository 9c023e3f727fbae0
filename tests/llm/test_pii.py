"""Octets made of zeros only are addresses as well."""

from archive_spark.llm import pii

from . import brute


def test_zero_octets(spark):
    texts = ["10.0.0.1", "127.0.0.1 and 192.168.0.7", "at 0.0.0.0.", "00.1.2.3 000.00.0.0000", "0.0.0.256 0.0.0.0256 1.00.300.0", "1.2.3.4 1.02.3.4 0255.0.0.255", "0" * 2000 + ".0.0.0 " + "0" * 2000 + "300.0.0.0"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in pii.personal_data(df, max_train=0).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect())
    assert got == sorted(brute.pii(docs))
    assert [r[2] for r in got] == [1, 2, 1, 2, 0, 3, 1]
    assert [r["text"] for r in pii.redact(df, max_train=0).orderBy("doc_id").limit(3).collect()] == ["<ip>", "<ip> and <ip>", "at <ip>."]


def test_written_out_forms_are_added(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    forms = [f"please write to {n} (at) example{i} dot org about {i} items" for i, n in enumerate(("john.doe", "mary", "k.ito", "sales"))]
    forms += [f"card no. {c} is on file" for c in ("4111.1111.1111.1111", "5500.0000.0000.0004")]
    forms += [f"call 00{n} in the morning" for n in ("49 30 1234567", "44 20 7946 0958")]
    plain = ["in 2019 and 2020 some 10,000 people met", "the sum of 4111.1111.1111.1112 was wrong", "at 10.30 we saw 12 of 15 at (the) dot of noon"]
    mine = [(10**6 + i, t) for i, t in enumerate([*forms, *plain])]
    found = pii.personal_data(docs.unionByName(spark.createDataFrame(mine, "doc_id long, text string"))).where("doc_id >= 1000000").orderBy("doc_id").collect()
    assert all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == 0 for r in found)
    got = [bool(r["spans"]) for r in found]
    assert sum(got[: len(forms)]) >= 0.75 * len(forms), got
    assert not any(got[len(forms) :]), got


def test_every_candidate_counts(spark):
    docs = spark.range(30_000).selectExpr("id doc_id", "concat('mail to a', id % 7, '@b.org, code 300.1.2.', id % 3) text")
    found = pii.candidates(pii.base_spans(docs), fitting=True)
    n = found.selectExpr("size(_candidates) + size(filter(_candidates, x -> x.rewritten is not null)) n").groupBy().sum("n").first()[0]
    rows = pii.labelled(found)
    assert rows.groupBy().sum("weight").first()[0] == n > 50_000 and rows.count() < 100
    assert pii.train(found).trees
