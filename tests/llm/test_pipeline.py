"""Each stage of the pipeline on its own input."""

from collections import Counter

import regex

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_text_ops import DOCS, ODD, jaccard_classes
from wayfold.llm import sentencepieces
from wayfold.llm.common import stage


def test_stages(spark):
    from sentencepiece import SentencePieceProcessor

    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(i and i + 10**6, *rest) for i, *rest in ODD], DOCS))
    before = docs
    after = []
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), "test")
        after.append(docs)
    for df in after[:3]:
        assert df.dtypes == before.dtypes
    known, single, mixed, pieces = after
    letters = Counter((r.doc_id, r.text) for r in before.collect() if regex.search(r"\p{L}", r.text or ""))
    assert Counter((r.doc_id, r.text) for r in known.collect()) == letters
    classes = jaccard_classes([(r.doc_id, r.text) for r in known.collect()])
    assert single.count() == len({c for _, c, _ in classes}) and {r.doc_id for r in single.collect()} == {c for _, c, _ in classes}
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times.values()) <= {1, 2} and set(times) <= {r.doc_id for r in single.collect()}
    sp = SentencePieceProcessor(model_file=sentencepieces.vocabulary_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert Counter(r.doc_id for r in pieces.collect()) == times
    for r in pieces.collect():
        assert r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
