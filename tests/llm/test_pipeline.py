"""The corpus pipeline on awkward rows: stage by stage, against the operators and against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coderill.llm import bpe, ordermin, tiling, weakrules

SYLLABLES = {"en": "the of and to in stone river light cold morning walk bird seven under bright".split(), "de": "der die und den von stein fluss licht kalt morgen vogel unter hell gehen sieben".split()}
NAMES = ["quality_rules", "language_id", "near_dedup", "decontamination", "bpe"]


def prose(rng, lang, n):
    out = []
    while len(out) < n:
        out += [rng.choice(SYLLABLES[lang]) + rng.choice(["", "s", "ly", "ka", "mo", "ri"]) for _ in range(rng.randint(5, 12))]
        out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(k, prose(rng, lang, rng.randint(60, 200)), lang) for k, lang in enumerate(["en", "de"] * 40)]
    passage = prose(rng, "en", 30)
    base = rows[4][1].split()
    near = " ".join(w if k % 12 else "changed" for k, w in enumerate(base))
    odd = [
        (100, rows[2][1], "en"), (100, rows[2][1], "en"), (None, rows[2][1], None), (101, near, "en"), (102, None, "en"), (103, "", "de"), (104, "&%$ ## @@ || " * 60, "en"), (105, passage + " " + prose(rng, "en", 70), "en"),
        (106, prose(rng, "en", 60_000), "en"), (107, "日本語のテキスト。" * 40, None), (108, "x", "en"), (None, None, None),
    ]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), 1, 2, "r") for i, t, g in rows + odd], "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, token_ids int, `row.hash` string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "never seen anywhere else"), (3, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*(F.col(f"`{c}`") for c in columns)).collect()), key=repr)


def test_stages_one_by_one(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != "bpe":
            assert after.columns == columns
            after.write.parquet(f"{folder}/{name}.parquet")
            after = spark.read.parquet(f"{folder}/{name}.parquet")
        kept[name] = (docs, after)
        docs = after

    # quality: every text by the posterior of its votes
    before, after = kept["quality_rules"]
    texts = [r.text for r in before.select("text").collect()]
    patterns = weakrules.patterns_of(pa.array(texts, pa.string()))
    import numpy as np

    seen, counts = np.unique(patterns[patterns >= 0], return_counts=True)
    posterior = dict(zip(seen.tolist(), weakrules.fit(seen, counts).posterior(weakrules.unpack(seen)).tolist(), strict=True))
    assert sorted(t for t, p in zip(texts, patterns.tolist(), strict=True) if p >= 0 and posterior[p] >= weakrules.THRESHOLD) == sorted(r.text for r in after.collect())
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert 104 in gone and 102 in gone

    # language: only rows whose text is known stay, with the language found; everything else in them is as it was
    before, after = kept["language_id"]
    others = [c for c in columns if c != "lang"]
    assert set(rows_of(after, others)) <= set(rows_of(before, others)) and {r.lang for r in after.collect()} <= {"en", "de"}
    clean = {r.doc_id for r in before.collect() if r.doc_id is not None and r.doc_id < 100}
    assert clean <= {r.doc_id for r in after.collect()} and {r.lang for r in after.where("doc_id < 80 and doc_id % 2 = 1").collect()} == {"de"}
    assert not {r.doc_id for r in after.collect()} & {103, 107}

    # near duplicates: one of each group of near texts, by all pairs
    before, after = kept["near_dedup"]
    rows = before.collect()
    words = [np.array(tiling.word_hashes(pa.array([r.text]))[0] >> np.uint64(32), np.uint32) for r in rows]
    left = after.collect()
    for r, w in zip(rows, words, strict=True):
        assert any(k.text == r.text or ordermin.similarity(w, v, ordermin.SIMILARITY) is not None for k in left for j, v in zip(rows, words, strict=True) if j == k)
    held = [next(w for j, w in zip(rows, words, strict=True) if j == k) for k in left]
    assert not any(ordermin.similarity(held[a], held[b], ordermin.SIMILARITY) is not None for a in range(len(held)) for b in range(a))
    assert {2, 4} <= {r.doc_id for r in left} and not {100, 101} & {r.doc_id for r in left}

    # decontamination: exactly the document with the passage goes
    before, after = kept["decontamination"]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {105} & {r.doc_id for r in before.collect()}

    # tokens: of every text, and they are its bytes
    before, after = kept["bpe"]
    assert after.columns == [*columns, "_token_ids", "n_tokens", "round_trip"] and after.count() == before.count() and after.where("not round_trip").isEmpty()
    v = bpe.Vocabulary(open(bpe.VOCABULARY_PATH, "rb").read())
    for r in after.where("length(text) < 3000").limit(10).collect():
        assert v.decode(np.array(r._token_ids)).tobytes().decode() == r.text

    # all at once is the same as one after the other
    assert rows_of(corpus_pipeline.run(spark, folder), ["doc_id", "text", "lang", "n_tokens"]) == rows_of(after, ["doc_id", "text", "lang", "n_tokens"])


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "n_tokens" in out.columns
