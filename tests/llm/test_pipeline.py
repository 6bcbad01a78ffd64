"""The pipeline against stages written plainly, on the small table."""

import collections

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from boutline.llm import langid, quality, secret_scan
from tests.llm.conftest import FOLDER
from tests.llm.test_documents import brute
from tests.llm.test_tokens import check_packing


def test_stages_return_documents(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns, name
            out.collect()
        assert {"doc_id", "sequence_id"} <= set(corpus_pipeline.packed(spark, docs, FOLDER).columns)


def test_run_equals_plain_stages(spark, real):
    kept = {r.doc_id for r in quality.quality(real).filter("kept").collect()}
    docs = real.filter(real.doc_id.isin(list(kept)))
    model = langid.fit(docs, docs.doc_id.isNotNull())
    kept = {r.doc_id for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    ids = sorted(texts)
    groups = brute(ids, [texts[i] for i in ids], 5)
    left = [(i, secret_scan.masked(texts[i])) for i in ids if groups[i][1] == i]
    assert 50 < len(left) < len(ids)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    check_packing(spark.createDataFrame(left, "doc_id bigint, text string"), rows, 4096)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
