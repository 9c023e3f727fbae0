"""The classifier's verdicts on labelled documents that it was not fitted on."""

import numpy as np

from archive_spark.llm import quality

from .test_contracts import table


def test_held_out_accuracy(sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has too few labels
    texts = dict(table(sf, "documents", "doc_id", "text"))
    labels = [(d, y) for d, y in table(sf, "labels", "doc_id", "quality") if texts.get(d) and y is not None]
    order = np.random.default_rng(0).permutation(len(labels))
    fitted, held = ([labels[i] for i in part] for part in np.array_split(order, 2))
    model = quality.fit([texts[d].encode() for d, _ in fitted], [y for _, y in fitted])
    parts = quality.read_parts([texts[d].encode() for d, _ in held])
    p, y = model.probability(parts, len(held)), np.array([y for _, y in held])
    good, bad = p[y == 1], p[y == 0]
    auc = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    cells = np.minimum((p * 10).astype(int), 9)
    gap = sum(abs(p[cells == c].mean() - y[cells == c].mean()) * np.mean(cells == c) for c in np.unique(cells))
    assert auc > 0.9 and gap < 0.1
    kept = p >= quality.THRESHOLD
    assert kept[y == 1].mean() > 0.98 and y[kept].mean() > 0.95 and (~kept)[y == 0].mean() > 0.6
