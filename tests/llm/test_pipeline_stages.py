import math
import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixture import documents, empty, labels  # noqa: E402

import corpus_pipeline  # noqa: E402
from covera.llm import kn_quality  # noqa: E402
from test_documents_ops import plain_model, plain_simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows_and_none(spark, tmp_path):
    folder = str(tmp_path / "sf")
    labels(spark, [(1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 0)]).write.parquet(f"{folder}/labels.parquet")
    for docs in (documents(spark), empty(spark)):
        docs, count = docs.cache(), docs.count()
        at = docs
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{folder}/{count}-{number}"
            out = stage(spark, at, folder)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.write.parquet(path)
            at = spark.read.parquet(path)
        assert {"doc_id", "ids"} <= set(at.columns)
        assert (at.count() == 0) == (count == 0)


def test_run_on_documents(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.where("NOT exact").count() == 0
    assert 0 < out.count() <= 2 * given.count()
    assert out.join(given, "doc_id", "left_anti").count() == 0


def kept_by_hand(docs, marks):
    """doc_ids that the quality stage keeps: the textbook model, and the quantile of the trusted documents."""
    verdicts = {}
    for i, quality, toxic in marks:
        verdicts.setdefault(i, []).append(quality == 1 and toxic == 0)
    trusted = {i for i, v in verdicts.items() if all(v)}
    p = plain_model([t for i, t, _ in docs if i in trusted])
    known, bits, n = {}, {}, {}
    for i, t, _ in docs:
        codes = kn_quality.grams(t).tolist()
        for c in set(codes) - set(known):
            known[c] = round(-math.log2(max(p(c), 1e-30)), 6)
        bits[i], n[i] = sum(known[c] for c in codes), len(codes)
    mean = lambda ids: sum(bits[i] for i in ids) / max(1, sum(n[i] for i in ids))
    of = {}
    for i, _, lang in docs:
        if i in trusted:
            of.setdefault(lang, []).append(i)
    few = kn_quality.FEW
    means = {lang: mean(ids) if len(ids) >= few else mean(trusted) for lang, ids in of.items()}
    level = lambda i, lang: (bits[i] + kn_quality.PRIOR * means.get(lang, mean(trusted))) / (n[i] + kn_quality.PRIOR)
    quantile = lambda xs: sorted(xs)[math.ceil(kn_quality.QUANTILE * len(xs)) - 1]
    whole = quantile([level(i, lang) for lang, ids in of.items() for i in ids])
    limits = {lang: quantile([level(i, lang) for i in ids]) if len(ids) >= few else whole for lang, ids in of.items()}
    return {i for i, _, lang in docs if level(i, lang) <= limits.get(lang, whole) + 1e-6}


def test_stages_equal_brute_force(spark, tmp_path):
    """Quality and dedup against plain code on the whole table; what follows against its own rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    given = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    at, stages = docs, dict(corpus_pipeline.STAGES)

    def run(name):
        stages[name](spark, at, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    at = run("quality_classifier")
    good = kept_by_hand(given, marks)
    assert {r["doc_id"] for r in at.collect()} == good
    text = {i: t for i, t, _ in given if i in good}
    ids = sorted(text)
    prints = np.array([plain_simhash(text[i]) for i in ids], np.uint64)
    label = np.arange(len(ids))
    while True:
        new = np.array([label[np.bitwise_count(prints ^ f) <= 3].min() for f in prints])
        if (new == label).all():
            break
        label = new
    at = run("simhash_dedup")
    assert {r["doc_id"] for r in at.collect()} == {ids[k] for k in set(label.tolist())}
    before = at.collect()
    at = run("secret_scan")
    for a, b in zip(sorted(before), sorted(at.collect())):
        assert a["doc_id"] == b["doc_id"] and len(b["text"]) == b["n_chars"]
        parts = b["text"].split("[SECRET]")
        assert len(parts) > 1 or a["text"] == b["text"]
        # What stands between the marks is the text as it was.
        where = 0
        for part in parts:
            assert (where := a["text"].index(part, where)) >= 0
            where += len(part)
    rows = {r["doc_id"]: r["text"] for r in at.collect()}
    at = run("source_mix")
    assert all(rows[r["doc_id"]] == r["text"] for r in at.collect())
    last = run("sentencepiece")
    assert last.count() == at.count() and last.where("NOT exact").count() == 0
