"""The pipeline's stages, each on its predecessor's rows, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__ as entry  # noqa: E402
from quire.llm.base import cut  # noqa: E402
from quire.llm.wordbpe import WordIds  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], d), name))
    return out


def test_schemas(stages):
    for s in stages[1:-1]:
        assert s.schema.simpleString() == stages[0].schema.simpleString()


def test_quality_keeps_clean_rows(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    clean = [r.doc_id for r in labels if r.quality == 1 and len(WORD.findall(texts[r.doc_id])) >= 20]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert sum(r.doc_id in kept for r in labels if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in labels)


def test_one_of_each_group_stays(stages):
    before, after = stages[1].collect(), stages[2].collect()
    shingles = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(WORD.findall(t))
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    kept = {r.doc_id: shingles(r.text) for r in after}
    ids = list(kept)
    assert len(after) == len(kept) and not any(near(kept[a], kept[b]) for i, a in enumerate(ids) for b in ids[:i])
    for r in before:
        assert r.doc_id in kept or any(near(shingles(r.text), s) and i < r.doc_id for i, s in kept.items())


def test_mix_takes_from_what_came(stages):
    before = {r.doc_id: len(WORD.findall(r.text)) for r in stages[2].collect()}
    taken = Counter()
    for r in stages[3].collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert set(taken) <= set(before) and all(n <= 2 * before[i] for i, n in taken.items())
    assert abs(sum(taken.values()) / sum(before.values()) - 1.5) < 0.02


def test_packing_holds_all(stages):
    coder, want = WordIds(str(public_tokenizers.path("word_bpe_49k.json"))).tokenizer, Counter()
    for r in stages[3].collect():
        ids = [*coder.encode(r.text, add_special_tokens=False).ids, 0]
        for n, s in enumerate(range(0, len(ids), 2048)):
            part = np.asarray(ids[s : s + 2048], "<u4")
            want[r.doc_id, n, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4].collect()) == want


def test_registered_with_run():
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages_on_awkward_rows(spark):
    """Nulls everywhere, empty and long texts, repeats, clashing columns, and no rows at all."""
    from test_operators import CLASHES, SCHEMA, awkward

    from pyspark.sql import functions as F

    docs = spark.createDataFrame([*awkward(), (None, None, None, None, None)], SCHEMA).withColumns({c: F.lit("clash") for c in (*CLASHES, "_", "source_", "mixed")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert stage(spark, docs.where("false"), "").count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() > 0, name
