"""Toxic words of a long tail: each in less than a hundredth of the toxic rows."""
import zlib

import numpy as np
from helpers import labels

from contactlake.llm.toxicity import toxicity_scores


def test_rare_toxic_words_are_found(spark):
    rng = np.random.Generator(np.random.PCG64(11))
    plain = ["".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(3, 8)))) for _ in range(400)]
    bad = ["".join(rng.choice(list("kqvwxyz"), 7)) for _ in range(150)]
    rows, marks = [], []
    for i in range(16_000):
        w = [plain[int(x)] for x in rng.integers(0, len(plain), 8)]
        if i % 7 == 0:
            w[int(rng.integers(0, 8))] = bad[i // 7 % len(bad)]
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 7 == 0)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    held = [r for r in toxicity_scores(docs, labels(spark, marks)).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    toxic = [r.predicted for r in held if r.doc_id % 7 == 0]
    clean = [r.predicted for r in held if r.doc_id % 7]
    print("RECALL", np.mean(toxic), np.mean(clean))
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02
