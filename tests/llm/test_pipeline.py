"""The pipeline against applying the plain rules one after another, and its stages' contract."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa

from marlstone.llm import decontaminate, quality, vocabulary
from marlstone.llm.words import FOLDED, RAW, slices

from .helpers import AWKWARD, SCHEMA, frame
from .test_lines import brute as plain_lines
from .test_near_duplicates import groups_by_brute_force


def test_run_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    x = np.concatenate([quality.statistics(s) for s in slices(pa.array([t for _, t in docs]), RAW)])
    docs = [d for d, p in zip(docs, model.probability(x)) if p >= quality.THRESHOLD]
    docs = plain_lines(spark, docs, corpus_pipeline.line_dedup.THRESHOLD)
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    docs = [docs[i] for i in order]
    _, group = groups_by_brute_force(docs, 0.5)
    docs = [d for i, d in enumerate(docs) if group[i] == i]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = [next(slices(pa.array([t]), FOLDED)).hashes for t in items]
    seeds = decontaminate.Seeds(list(range(len(items))), [w for w in words if len(w) >= decontaminate.SPAN])
    docs = [d for d in docs if not seeds.verified(next(slices(pa.array([d[1]]), FOLDED)))]
    want = {k: vocabulary.encoding().encode_ordinary(t) for k, t in docs}
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf).collect()}
    # Near duplicates are found by estimates, so pairs at the threshold may go either way.
    assert len(set(got) ^ set(want)) <= 0.02 * len(want)
    assert all(got[k] == want[k] for k in set(got) & set(want))


def test_stages_keep_columns_and_survive_awkward_rows(spark, sf):
    docs = frame(spark, AWKWARD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns == ["doc_id", "token_ids", "n_tokens"]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, sf).collect()}
    assert len(good - kept) <= 0.02 * len(good)
    lines = corpus_pipeline.line_deduplication(spark, docs, sf)
    assert Counter(r.doc_id for r in lines.collect()) == Counter(r.doc_id for r in docs.collect())
