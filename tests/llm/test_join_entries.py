"""Entries of the join before they are shuffled: few bytes each, and shingles taken for one another lose no pair."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from archive_spark.llm import ngram_join


@pytest.mark.parametrize("bits", (32, 3))
def test_entries_are_narrow_and_whole(monkeypatch, bits):
    names = ngram_join._names
    mask = np.uint64(0xFFFFFFFF << 32 | (1 << bits) - 1)
    monkeypatch.setattr(ngram_join, "_names", lambda shingles, buckets: names(shingles, buckets) & mask)
    rng = np.random.default_rng(4)
    texts = []
    for d in range(60):
        words = [f"w{i}" for i in rng.integers(0, 5000, 200)]
        texts += [" ".join(words), " ".join(words[: 195 - d % 9]), " ".join([*words[:60], "x", *words[61:]])]
    sketch = SimpleNamespace(value=np.zeros(1 << ngram_join.SKETCH_BITS, dtype=np.int64))
    dealt = pa.Table.from_batches(ngram_join._deal(sketch, "text", 16, 1)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    sets = [ngram_join.shingle_sets([t.encode()])[0] for t in texts]
    entries = sum(ngram_join.prefix_size(len(s)) for s in sets)
    sent = sum(len(r["data"]) for r in dealt.to_pylist() if r["kind"] == ngram_join._ENTRIES)
    assert sent <= 20 * entries
    met = pa.concat_tables(ngram_join._meet(10_000)(dealt.filter(pc.equal(dealt["bucket"], b))) for b in range(16)).to_pylist()
    group = {r["b"]: r["a"] for r in met if r["kind"] in (ngram_join._GROUP, ngram_join._MEMBER)}
    pairs = {frozenset((r["a"], r["b"])) for r in met if r["kind"] in (ngram_join._STAR, ngram_join._OTHER)}
    linked = {frozenset(group[ngram_join.fingerprint(s)] for s in (x, y)) for i, x in enumerate(sets) for y in sets[:i] if ngram_join.linked(x.tobytes(), y.tobytes())}
    assert len(linked) > 100 and {x for x in linked if len(x) > 1} <= pairs  # members of a group go where it goes
