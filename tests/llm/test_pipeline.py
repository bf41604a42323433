"""The pipeline against its stages' brute-force meaning on a small fixture."""

import gc
import os
import random
import time
from collections import Counter

import corpus_pipeline
from docquery.llm import mixing, pii, quality, simhash
from docquery.llm.common import materialise, table
from tests.llm.test_operators import brute_mix, check_sequences, docs, prose


def test_stages_compose(spark, sf):
    """Every stage takes what the one before kept, and its decisions take effect."""
    now = table(spark, sf, "documents")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, sf).cache()
        assert now.columns == columns, name
        ids, had = Counter(r.doc_id for r in now.collect()), Counter(r.doc_id for r in before.collect())
        if name == "quality_rules":
            assert set(ids) == {r.doc_id for r in quality.report(before).where("verdict = 'keep'").collect()}
        if name == "near_dedup":
            grouped = {r.doc_id: r.kept_id for r in simhash.groups(before).collect()}
            assert set(ids) == {d for d in had if grouped.get(d, d) == d}
        if name == "redact_pii":
            assert ids == had and pii.pii_spans(now).count() == 0
        if name == "mix_sources":
            rows = [(r.doc_id, r.source, r.n_tokens, r.key) for r in mixing._keyed(before, 17).collect()]
            assert ids == Counter({d: n for (d, _, _), n in brute_mix(rows).items()})
    check_sequences(now, corpus_pipeline.STAGES[-1][1](spark, now, sf), 2048)
    check_sequences(now, corpus_pipeline.run(spark, sf), 2048)


def test_stages_take_odd_rows_and_empty_tables(spark):
    long = prose(1, 30_000)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (None, "one two three", None, None), (4, "!!! ???", "en", "a"), (4, "!!! ???", "en", "a"), (5, long, "en", "b"), (6, long, "en", "b"), (None, None, None, None)]
    for df, empty in ((docs(spark, rows), False), (docs(spark, []), True)):
        now = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "").cache()
            assert now.columns == df.columns, name
            assert (now.count() == 0) == empty, name
        check_sequences(now, corpus_pipeline.best_fit_packing(spark, now, ""), 2048)
        for name, stage in corpus_pipeline.STAGES:  # each stage by itself on all of them
            assert stage(spark, df, "").count() >= 0, name


def test_clean_documents_survive_the_filters(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(40, 300), 4000), "en", "a") for i in range(80)]
    df = docs(spark, rows, clash=False)
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, df, ""), "")
    assert {r.doc_id for r in kept.collect()} == set(range(80))


def test_tables_go_when_no_plan_needs_them(spark):
    def collected():
        for _ in range(3):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)
        return materialise(spark.range(1))

    kept = materialise(spark.range(100))
    path = kept.inputFiles()[0].removeprefix("file://")
    derived = kept.where("id < 50").groupBy().count()  # not run yet
    del kept
    collected()
    assert os.path.exists(path) and derived.first()[0] == 50
    del derived
    collected()
    assert not os.path.exists(os.path.dirname(path))
