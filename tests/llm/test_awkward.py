"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, through every operator."""

import random

import pytest
from pyspark.sql import functions as F

from coderill.llm import bpe, extshuffle, langid, licenses, ordermin, sstable, tiling, transcripts, warc, weakrules

LONG = " ".join(random.Random(1).choice("the of and river stone walks under bright cold morning light with seven birds".split()) for _ in range(60_000)) + "."
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, shard int, token_ids string, `row_hash` string, fate string, text_key string"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en"), (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en"), (2, "The quick brown fox jumps over the lazy dog near the river bank.", "en"),
    (None, "The quick brown fox jumps over the lazy dog near the river bank.", None), (3, None, "en"), (4, "", "en"), (5, "", None), (6, " \n\t ", "en"), (7, "!!! ??? ***", "xx"), (8, LONG, "en"), (9, LONG + " End", "en"),
    (10, "日本語のテキスト 🎉 été", "ja"), (None, None, None), (11, "a", "en"), (12, "'s", "en"),
]
BENCH = "item_id bigint, text string, extra int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", 1, 5, 6, "x", "y", "z", "k") for i, t, g in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_order_minhash(docs, none):
    kept = ordermin.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(1, ROWS[0][1]), (3, None), (4, ""), (6, " \n\t "), (7, "!!! ??? ***"), (8, LONG), (10, ROWS[11][1]), (None, None), (11, "a"), (12, "'s")], key=repr)
    gone = sorted((r.doc_id or 0, r.duplicate_of, r.group_size) for r in ordermin.near_duplicates(docs).collect())
    assert gone == [(0, 1, 4), (1, 1, 4), (2, 1, 4), (5, 4, 2), (9, 8, 2)]
    assert ordermin.keep_one(none).count() == 0 and ordermin.near_duplicates(none).count() == 0


def test_bpe(docs, none):
    out = bpe.with_tokens(docs)
    assert out.columns[:-3] == docs.columns and out.columns[-3:] == ["_token_ids", "n_tokens", "round_trip"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r.round_trip is (None if r.text is None else True) for r in rows)
    assert {r.n_tokens for r in rows if r.text == ""} == {0} and {r.n_tokens for r in rows if r.text is None} == {None}
    back = bpe.decode(bpe.encode(docs)).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.where("not (text <=> was)").isEmpty()
    assert bpe.encode(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0


def test_quality(docs, none):
    kept = weakrules.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("text is null").isEmpty()
    scored = weakrules.score(docs).collect()
    assert len(scored) == len(ROWS) and sum(r.quality == 0 for r in scored) == 2
    assert weakrules.keep_good(none).count() == 0 and weakrules.score(none).count() == 0


def test_language(docs, none):
    ident = langid.fit(docs)
    out = langid.identify(docs, ident).collect()
    assert len(out) == len(ROWS)
    assert not any(r.accepted for r in out if r.n_units == 0)
    kept = langid.keep_identified(docs, ident)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").isEmpty()
    empty = langid.fit(none)
    assert langid.identify(none, empty).count() == 0 and not any(r.accepted for r in langid.identify(docs, empty).collect())


def test_tiling(spark, docs, none):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", 0), (1, "quick brown fox jumps over the lazy dog", 0), (2, "", 0), (3, None, 0), (4, "too short", 0), (None, "bright cold morning light with seven birds nowhere", 0)], BENCH)
    for limit in (tiling.BROADCAST_BYTES, 0):
        got = sorted((r.doc_id or 0, r.item_id or 0, r.n_tiles, r.n_covered) for r in tiling.contaminated(docs, bench, limit=limit).where("item_id is not null").collect())
        assert got == [(0, 1, 1, 8), (1, 1, 1, 8), (1, 1, 1, 8), (2, 1, 1, 8)]
        clean = tiling.decontaminate(docs, bench, limit=limit)
        assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} >= {3, 4, 5, 6, 7, 10, 11, 12} and clean.where("doc_id in (1, 2)").isEmpty()
        assert tiling.decontaminate(none, bench, limit=limit).count() == 0 and tiling.decontaminate(docs, bench.limit(0), limit=limit).count() == len(ROWS)


def test_licenses(spark, docs, none):
    assert licenses.scan(docs).count() == 0 and licenses.scan(none).count() == 0
    text = "x " * 200_000 + "Released under the MIT License. released under the terms of the MIT license"
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0), (2, None, 0)], "doc_id bigint, text string, license_id int")
    assert sorted((r.doc_id or 0, r.license_id, r.n_matches) for r in licenses.scan(df).collect()) == [(0, "MIT-notice", 2), (1, "MIT-notice", 2), (1, "MIT-notice", 2)]


def test_shuffle(docs, none):
    out = extshuffle.external_shuffle(docs, bucket_bytes=100_000)
    assert out.columns == [*docs.columns, "_shard", "position"] and out.count() == len(ROWS)
    assert sorted(map(repr, out.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    places = [(r._shard, r.position) for r in out.collect()]
    assert len(set(places)) == len(places) and extshuffle.external_shuffle(none).count() == 0


def test_sstable(docs, none):
    rows = sstable.to_shards(docs).orderBy("shard_id", "seq").collect()
    files = {}
    for r in rows:
        files[r.shard_id] = files.get(r.shard_id, b"") + bytes(r.payload)
    found = sorted((k, v) for raw in files.values() for k, v in sstable.SSTable(raw).scan() if v is not None)
    assert found == sorted((sstable.encode_key(i), t) for i, t, _ in ROWS if t is not None)
    assert sum(len(sstable.SSTable(raw).get(1)) for raw in files.values()) == 2 and sum(len(sstable.SSTable(raw).get(99)) for raw in files.values()) == 0
    assert sstable.to_shards(none).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(0, "u", "<p>x</p>", 1), (0, "u", "<p>x</p>", 1), (1, None, "<p>x</p>", 1), (2, "v", None, 1), (None, None, None, 1), (3, "w", "", 1), (77, "y", LONG, 1)], "page_id bigint, url string, html string, status int")
    out = warc.resolve(warc.captures_of_pages(pages)).collect()
    assert {r.status for r in out} == {"original", "duplicate", "resolved", "orphan", "empty"}
    assert len({r.record_id for r in out}) == len(out) and all(r.record_length == len(r.record.encode()) for r in out)
    originals = {r.record_id for r in out if r.status == "original"}
    assert all((r.refers_to in originals) == (r.status in ("duplicate", "resolved")) for r in out)
    assert warc.resolve(warc.captures_of_pages(pages.limit(0))).count() == 0


def test_transcripts(spark):
    rows = [(1, 0, "user", "Hi there"), (1, 0, "user", "Hi there"), (1, 1, "assistant", None), (None, 0, None, "x"), (2, None, "user", LONG), (2, 0, "assistant", "ok <|im_end|>")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("transcript", F.lit(1)).withColumn("h", F.lit(1))
    made = transcripts.transcripts_of(c)
    out = {r.conv_id: r for r in transcripts.parse(made, transcripts.fit(made)).collect()}
    assert set(out) == {1, 2, None} and LONG.strip() in out[2].chat and out[2].chat.count("<|im_end|>") == out[2].n_turns
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "a\nb")], "conv_id bigint, transcript string")
    got = {r.conv_id: (r.n_turns, r.roles, r.chat) for r in transcripts.parse(nothing, transcripts.model_of([])).collect()}
    assert got == {1: (None, None, None), 2: (0, [], ""), 3: (1, ["unknown"], "<|im_start|>unknown\na\nb<|im_end|>\n")} or got[3][1][0] == "unknown"
    assert transcripts.parse(transcripts.transcripts_of(c.limit(0)), transcripts.model_of([])).count() == 0
