"""The near-duplicate stage against all pairs of five-word shingle sets."""

import numpy as np

import corpus_pipeline
from weftnet.llm import shingles


def similar(x, y):
    x, y = (x or "").lower().split(), (y or "").lower().split()
    x, y = ({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (x, y))
    return 5 * len(x & y) >= 4 * len(x | y)


def test_stage_links_all_similar_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 8)
    rnd = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for i in range(30):
        base = [f"W{x}" for x in rnd.integers(0, 5000, int(rnd.integers(1, 160)))]
        texts.append(base)
        for _ in range(int(rnd.integers(0, 6))):
            other = list(base)
            for _ in range(int(rnd.integers(0, 6))):
                other[int(rnd.integers(0, len(other)))] = f"new{rnd.integers(0, 9999)}"
            texts.append(other)
            base = other if i % 3 == 0 else base
    texts += [passage + [f"t{i}x{k}" for k in range(4 + i)] for i in range(12)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, ""), (1001, None), (1002, " \n"), (1003, "one two"), (1003, "one two"), (1004, "ONE\ttwo"), (None, " ".join(texts[0]))]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(rows[i][1], rows[j][1]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({rows[find(i)][0] for i in range(len(rows))})
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want and len(want) < len(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_parity_bitmaps_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(5)
    for size in (1, 40, 300, 5_000):
        own = np.unique(rng.integers(0, 2**64, size, np.uint64))
        other = np.unique(np.concatenate((own[: len(own) * 3 // 4], rng.integers(0, 2**64, size // 5 + 1, np.uint64))))
        bits = sum(int(x).bit_count() for x in (shingles.parity_bitmap(own) ^ shingles.parity_bitmap(other)).view(np.uint64))
        assert bits <= len(np.setxor1d(own, other))
        assert not (shingles.parity_bitmap(own) ^ shingles.parity_bitmap(own[::-1])).any()
