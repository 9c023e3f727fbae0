"""Small parts: loser tree, cascade, blocks of the token store, packing, hot shingles."""

import random

import numpy as np
import public_tokenizers

from archive_spark.llm import decontaminate, ngram_join, packing, token_store, tokens, url_filter, warc

from . import brute


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_ranges_of_captures(spark):
    rng = random.Random(2)
    rows = [(i, 0, "", "response", None, f"k{rng.choice((0, 0, rng.randrange(40)))}", rng.randrange(9), f"a{i % 7}", i, 1) for i in range(3000)]
    runs = spark.createDataFrame(sorted(rows, key=lambda r: (r[7], *r[5:7])), warc.CAPTURE)
    got = [tuple(r) for r in warc.merge_runs(runs, range_rows=200).orderBy("shard", "position").collect()]
    assert [r[:10] for r in got] == sorted(rows, key=warc._order)
    sizes = [sum(r[10] == s for r in got) for s in {r[10] for r in got}]
    assert len(sizes) > 10 and max(sizes) < 600  # a hot key is spread, too


def test_cascade_is_exact(spark):
    keys = [(f"k{i}", i % 7 == 0) for i in range(3000)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = url_filter.build_cascade(universe)
    wrong = universe.where(cascade.contains(universe.key) != universe.listed).count()
    assert wrong == 0 and len(cascade.levels) > 1
    assert url_filter.build_cascade(universe, 8) is None


def test_sum_of_squares_fits():
    lengths = np.random.default_rng(0).integers(1, 1025, 2000)
    sequence, offset = packing.sum_of_squares(lengths)
    fill = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist()):
        assert o == fill.get(s, 0)
        fill[s] = o + n
    assert max(fill.values()) <= 1024


def test_packed_ids_are_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 90").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 5")).cache()  # repeated rows
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), shard_rows=40)
    rows = packed.orderBy("sequence_id", "offset").collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = sorted((d, np.array(ids, dtype="<u4").tobytes()) for (d, _), ids in zip(texts, brute._tokens("byte_bpe_50k.json", [t for _, t in texts])))
    parts = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"], r["sequence_id"])):
        parts.setdefault(r["doc_id"], {}).setdefault(r["piece"], []).append(bytes(r["ids"]))
    got = sorted((d, b"".join(c)) for d, p in parts.items() for c in zip(*p.values()))
    assert got == want
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == sum(r["length"] for r in rows) and max(r["n_tokens"] for r in whole) <= 1024
    assert len(whole) <= 1.05 * sum(r["length"] for r in rows) / 1024 + 3


def test_short_document_access(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), block_bytes=2000)
    got = token_store.read_documents(spark, path, [3, 41])
    want = {r["doc_id"]: bytes(r["ids"]) for r in token_store.read_store(spark, path).withColumnRenamed("id", "doc_id").collect()}
    assert {k: v.tobytes() for k, v in got.items()} == {k: want[k] for k in (3, 41)}


def test_hot_and_long_lists(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in ngram_join.similar_documents(docs, hot=2, short_list=2, block=64).collect())
    assert got == sorted(brute.jaccard(rows))


def test_bit_sets_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64)) for n in (1, 7, 300, 520, 5000)]
    sets += [sets[2][:250], sets[3][:505], sets[3][:520], sets[4][:3800], np.union1d(sets[4], sets[3]), np.union1d(sets[2], sets[0])]
    met = 0
    for x in sets:
        for y in sets:
            n = len(np.intersect1d(x, y))
            true = 100 * n >= 75 * (len(x) + len(y) - n)
            assert ngram_join.linked(x.tobytes(), y.tobytes()) == true
            possible = ngram_join.near(ngram_join.bit_set(x), ngram_join.bit_set(y))
            assert possible or not true
            met += not possible
    assert met > 40  # sets that have nothing in common are ruled out


def test_blocks_of_long_lists(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = " ".join(f"v{i}" for i in range(80)).split()
    rows += [(10_000 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(60)]  # near copies of near copies
    rows += [(20_000 + i, " ".join(base[:40] + [f"x{i}{k}" for k in range(3)] + base[43 + i % 7 :])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.similar_documents(frame, short_list=1, block=16).collect())
    assert got == sorted(brute.jaccard(rows))


def test_members_of_a_group_are_told_apart():
    # six common shingles each, so that texts of equal size can share a prefix without linking
    token = np.array([5, 5, 5, 9], dtype=np.uint64)
    group, fp, n = np.array([1, 1, 2, 3]), np.array([10, 11, 12, 13]), np.array([40, 40, 40, 40])
    t, g, f, m, r, head, size = ngram_join._lists(token, group, fp, n, np.array([30, 30, 30, 40]))
    assert f.tolist() == [10, 12, 13] and head.tolist() == [0, 0, 2] and size.tolist() == [2, 2, 1]


def test_hit_offsets_in_the_original():
    raw = "Zé, the Quick-brown FOX! ünd 12 x"
    items = decontaminate.Items([("a", b"the quick brown fox"), ("b", "fox ünd".encode()), ("c", b"nothere")])
    ranges, ids = items.scan(decontaminate.normal_words(raw.encode()))
    assert (ranges, ids) == ([(1, 6)], {"a", "b"})
    start, end = decontaminate.hit_offsets(raw.encode(), [x for r in ranges for x in r])
    assert raw[start:end] == "the Quick-brown FOX! ünd"


def test_large_benchmark_is_one_automaton(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, words(rng.choice((3, 12, 13, 14, 40, 2000)))) for i in range(2500)]
    docs = []
    for d in range(120):
        text = words(rng.randrange(300))
        for _ in range(d % 4):
            item = rng.choice(items)[1]
            at, n = rng.randrange(len(item)), rng.randrange(1, 40)
            k = rng.randrange(len(text) + 1)
            text[k:k] = item[at : at + n] * rng.choice((1, 2))
        docs.append((d, " ".join(text)))
    items = [(i, " ".join(w)) for i, w in items]
    assert sum(len(t) for _, t in items) > 2 << 20
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(frame, bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one scan
    want = sorted(brute.contamination(docs, items))
    assert sorted(tuple(r) for r in found.collect()) == want and sum(r[2] > 0 for r in want) > 40
    small = decontaminate.contamination(frame, bench, max_bytes=1 << 20)
    assert sorted(tuple(r) for r in small.collect()) == want
    left = decontaminate.remove_contaminated(frame.withColumnRenamed("doc_id", "_ranges"), bench)
    assert sorted(r["_ranges"] for r in left.collect()) == [r[0] for r in want if not r[5]]


def test_dotted_capital_i():
    texts = ["İ>", "\t\tİ\x01a", "İ1 İİ, ıI", "a b\x01 c"]
    for name, keeps in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        e = tokens.PieceEncoder(public_tokenizers.path(name), keeps)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(texts)] == want
