"""The pipeline's stages one after another, against what brute force gives on each stage's own input."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

pytest.importorskip("public_tokenizers")

SAMPLES = {"en": "the quick brown fox jumps over lazy dogs while they think about other things and of what was there", "de": "der schnelle braune fuchs springt über den faulen hund und sie denken über andere dinge nach"}


def test_stages(spark, tmp_path):
    rnd = np.random.default_rng(9)
    passage = " ".join(f"word{x}" for x in rnd.integers(0, 9999, 60))
    rows = []
    for i in range(80):
        lang = list(SAMPLES)[i % 2]
        text = "\n".join(" ".join(rnd.permutation(SAMPLES[lang].split()).tolist() + [f"n{i}x{k}"]) for k in range(4))
        rows.append([i, text, lang, f"s{i % 3}"])
    for i in (10, 20, 30):
        rows[i][1] += "\n" + passage
    rows += [[100, rows[3][1], "de", "s0"], [101, rows[4][1].replace("n4x2", "changed"), "en", "s1"], [102, None, None, None], [103, "123 456", "en", "s1"], [104, "", "en", None]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in seen["language_id"]} == set(range(80)) | {100, 101}
    texts = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert sum(passage in t for t in texts.values()) == 1 and texts[100] == "" and texts[5] == rows[5][1]
    kept = [r.doc_id for r in seen["near_dedup"]]
    assert len(kept) == len(set(kept)) and set(range(80)) - {4} <= set(kept)
    sizes = {r.doc_id: len(r.text.split()) for r in seen["near_dedup"]}
    total = sum(sizes[r.doc_id] for r in seen["mixing"])
    assert abs(total - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values()) and max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 2
    assert len({r.sequence_id for r in seen["packing"]}) <= sum(r.length for r in seen["packing"]) // 2048 + 2
    assert Counter(r.doc_id for r in seen["packing"] if r.piece == 0) == Counter(r.doc_id for r in seen["mixing"])
