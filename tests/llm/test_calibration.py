"""What op2 rejects by is set by all labelled documents: again in numpy, over the whole table."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coderill.llm import langid, weakrules

SYLLABLES = {"aa": ["ka", "mo", "ti", "ru", "sel"], "bb": ["she", "lin", "dor", "ve", "kas"]}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for k in range(240):
        lang = rng.choice(list(SYLLABLES))
        noise = rng.choice([0, 0, 0.05, 0.2])
        words = [word(rng, lang) if rng.random() >= noise else "".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(rng.choice([6, 6, 20, 60, rng.randint(5, 200)]))]
        rows.append((k, " ".join(words), lang))
    rows += [(300, rows[0][1], rows[0][2]), (301, None, "aa"), (302, "", "bb"), (303, "ka mo", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).cache()


def by_hand(docs):
    """Means, variances and limit from every labelled document, scored by models that were trained without its part."""
    rows = [r for r in docs.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(langid.FOLDS))).collect() if r.text is not None and r.lang is not None]
    names = sorted({r.lang for r in rows})
    got = []
    for fold in range(langid.FOLDS):
        models = []
        for lang in names:
            seen = Counter(g for r in rows if r.fold != fold and r.lang == lang for g in langid.grams(pa.array([r.text]))[0].tolist())
            keys = np.array(sorted(seen), np.uint64)
            models.append(langid.train(keys, np.array([seen[k] for k in keys.tolist()])))
        for r in rows:
            key = langid.grams(pa.array([r.text]))[0]
            if r.fold == fold and len(key):
                bits = [-float(np.log2(m.probability(key)).mean()) for m in models]
                if names[int(np.argmin(bits))] == r.lang:
                    got.append((names.index(r.lang), min(bits), len(key)))
    mean, variance, excess = [], [], []
    for k in range(len(names)):
        bits, length = np.array([(b, n) for j, b, n in got if j == k]).T
        short = length < np.median(length)
        mean.append(np.median(bits[~short]))
        spread = [(1.4826 * np.median(np.abs(bits[h] - mean[k]))) ** 2 for h in (short, ~short)]
        inverse = [np.mean(1 / length[h]) for h in (short, ~short)]
        within = max(0.0, (spread[0] - spread[1]) / (inverse[0] - inverse[1]))
        variance.append((max(spread[1] - within * inverse[1], langid.LEAST_BETWEEN**2), within))
        excess.append((bits - mean[k]) / np.sqrt(variance[k][0] + within / length))
    near = np.concatenate(excess)
    return len(got), np.array(mean), np.array(variance), max(langid.LEAST_LIMIT, 2 * np.quantile(near[near <= langid.LEAST_LIMIT], 0.999))


def same(ident, docs):
    n, mean, variance, limit = by_hand(docs)
    assert n >= 200
    np.testing.assert_allclose(ident.mean, mean, rtol=1e-5)
    np.testing.assert_allclose(ident.variance, variance, rtol=1e-3)
    assert abs(ident.limit - limit) < 1e-3 * limit


def test_every_labelled_document_sets_the_thresholds(docs):
    same(langid.fit(docs), docs)


def test_every_labelled_document_sets_the_thresholds_of_the_stage(spark, docs, monkeypatch):
    """The pipeline's stage decides by the same thresholds, and keeps what is within them."""
    used = []
    decide = langid.keep_identified
    monkeypatch.setattr(langid, "keep_identified", lambda df, ident, *more: used.append(ident) or decide(df, ident, *more))
    odd = spark.createDataFrame([(400, "".join(random.Random(1).choice("qxzjw") for _ in range(300)), None)], docs.schema)
    table = docs.unionByName(odd)
    kept = corpus_pipeline.language_id(spark, table, "").collect()
    same(used[0], table)
    rows = table.collect()
    accepted = used[0].decide(pa.array([r.text for r in rows], pa.string()))[0] >= 0
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r, ok in zip(rows, accepted, strict=True) if ok)
    assert len(kept) >= 230 and not {r.doc_id for r in kept} & {301, 302, 400}


def test_stages_fit_on_more_documents_than_a_sample_would_hold(spark, monkeypatch):
    """The two stages of the pipeline that fit something, over 6500 documents: a sample of 4000, as there once was, has other figures."""
    rng = random.Random(8)
    rows = []
    for k in range(6500):
        lang = rng.choice(list(SYLLABLES))
        noise = rng.choice([0, 0, 0.05, 0.2])
        words = [word(rng, lang) if rng.random() >= noise else "".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(rng.choice([6, 12, 30]))]
        rows.append((k, ("| " if k % 50 == 0 else " ").join(words), lang))
    table = spark.createDataFrame([*rows, (7000, None, "aa")], "doc_id bigint, text string, lang string").repartition(3).cache()
    fitted, used = [], []
    em, decide = weakrules.fit, langid.keep_identified
    monkeypatch.setattr(weakrules, "fit", lambda *histogram: fitted.append(histogram) or em(*histogram))
    monkeypatch.setattr(langid, "keep_identified", lambda df, ident, *more: used.append(ident) or decide(df, ident, *more))
    good = corpus_pipeline.quality_rules(spark, table, "").cache()
    corpus_pipeline.language_id(spark, good, "")
    patterns, counts = np.unique(weakrules.patterns_of(pa.array([r[1] for r in rows])), return_counts=True)
    np.testing.assert_array_equal(fitted[0], [patterns, counts])
    assert len(patterns) > 3 and good.count() > 6000
    same(used[0], good)


def test_quantiles_of_all_rows(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(-3, 40, 4001), 1: np.repeat([0.0, 1.0, -2.5], [7, 2, 1]), 2: np.array([4.25]), 5: 2 + rng.random(1000) * 1e-7, 7: np.array([-1e-9, 1e-9])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g int, v double").repartition(5)
    for q in (0.0, 0.5, 0.999, 1.0):
        got = langid.quantiles(df, q)
        assert set(got) == set(groups)
        for g, x in groups.items():
            assert abs(got[g] - np.quantile(x, q)) <= 1e-12 * max(1, abs(got[g])), (g, q)
    assert langid.quantiles(df.limit(0), 0.5) == {}


@pytest.mark.parametrize("sizes", [[7] * 12, [5] * 9 + [30] * 3, [5] * 3 + [30] * 9])
def test_halves_where_most_lengths_are_equal(spark, sizes):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ka", "mo", "ti", "ru"]) for _ in range(n)) for n in sizes]
    ident = langid.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("aa")))
    assert np.isfinite(ident.mean).all() and np.isfinite(ident.variance).all() and ident.mean[0] < 16 and langid.LEAST_LIMIT <= ident.limit <= 2 * langid.LEAST_LIMIT
