"""Each method against a brute-force version, an exact round trip or held-out accuracy."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from coderill.llm import bpe, extshuffle, langid, licenses, ordermin, sstable, tiling, transcripts, warc, weakrules

SF = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not SF.exists(), reason="no driver tables here")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(5)
    for t in range(1500):
        a = [rng.randrange(3 + t % 9) for _ in range(rng.randrange(18))]
        b = [x for x in a if rng.random() > 0.2] + [1] * rng.randrange(3) if t % 2 else [rng.randrange(3 + t % 9) for _ in range(rng.randrange(18))]
        d = levenshtein(a, b)
        for most in range(0, 20, 3):
            assert ordermin.edit_distance(np.array(a, np.int64), np.array(b, np.int64), most) == (d if d <= most else most + 1)


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}x" for _ in range(n)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        base = words(rng, rng.choice([6, 12, 30, 120, 300]))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            texts.append([w if rng.random() > rng.choice([0.02, 0.1]) else "changed" for w in base])
    shared = words(rng, 40)
    texts += [words(rng, 150) + shared + words(rng, 150) for _ in range(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    near = [(i, j) for i in range(len(texts)) for j in range(i) if levenshtein(texts[i], texts[j]) <= (1 - ordermin.SIMILARITY) * max(len(texts[i]), len(texts[j])) + 1e-9]
    group = {r.doc_id: r.component for r in ordermin.groups(df).collect()}
    caught = sum(group.get(i, -i) == group.get(j, -j - 1) for i, j in near)
    assert caught >= 0.97 * len(near) and len(near) > 60
    # no group holds what no chain of near pairs connects
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in near:
        parent[root(i)] = root(j)
    for c in set(group.values()):
        assert len({root(i) for i in group if group[i] == c}) == 1


def test_order_matters():
    a = [f"w{i}" for i in range(200)]
    b = a[100:] + a[:100]
    keys = []
    for t in (a, b, a[:190] + ["x"] * 10):
        _, w, at = ordermin.nodes_of(pa.array([" ".join(t)]))
        keys.append(set(ordermin.sketch(w, at, ordermin.K, ordermin.PICKED, ordermin._SEEDS[:48])[0].tolist()))
    assert len(keys[0] & keys[1]) < 24 < len(keys[0] & keys[2])


@needs_data
def test_bpe_against_exact_merging(spark):
    v = bpe.Vocabulary(Path(bpe.VOCABULARY_PATH).read_bytes())
    rng = random.Random(2)
    texts = ["".join(rng.choice(" \n\t'sldmtrevé日🎉1٣$-_.,  abcXYZ") for _ in range(rng.randrange(60))) for _ in range(400)] + ["don't you'll 's 'tis we've", "ab" * 3000, ""]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    tokens, at = v.encode(pa.array(texts))
    for i, t in enumerate(texts):
        want = [v.ranks[x] for w in pattern.findall(t) for x in bpe.merge_exactly(w.encode(), v.ranks)]
        assert tokens[at[i] : at[i + 1]].tolist() == want
    assert v.decode(tokens).tobytes().decode() == "".join(texts)


def test_compatible_pairs_by_definition():
    v = bpe.Vocabulary(Path(bpe.VOCABULARY_PATH).read_bytes())
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3000, 3000), rng.integers(0, 3000, 3000)
    got = v.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        assert ok == (bpe.merge_exactly(v.tokens[x] + v.tokens[y], v.ranks) == [v.tokens[x], v.tokens[y]])


@needs_data
def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ident = langid.fit(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs.where("doc_id % 2 = 1"), ident).join(docs.select("doc_id", "lang"), "doc_id").collect()
    long = [r for r in got if r.n_units >= 100]
    assert sum(r.language == r.lang for r in long) >= 0.97 * len(long)
    rng = random.Random(3)
    odd = ["".join(rng.choice("qxzjkvwпрстжщ") + (" " if rng.random() < 0.2 else "") for _ in range(600)) for _ in range(20)] + ["0xdeadbeef9f8c7a6b5c4d3e2f1a0b9c8d7e6f" * 20]
    strange = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    assert not any(r.accepted for r in langid.identify(strange, ident).collect())


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    seen = np.unique(rng.integers(97, 101, (400, 4)), axis=0).astype(np.uint64)
    keys = np.sort(seen[:, 3] | seen[:, 2] << np.uint64(16) | seen[:, 1] << np.uint64(32) | seen[:, 0] << np.uint64(48))
    m = langid.train(keys, rng.integers(1, 6, len(keys)))
    context = (int(keys[7]) >> 16) << 16
    p = m.probability(np.array([context | c for c in range(1 << 16)], np.uint64))
    assert abs(p.sum() - 1) < 1e-9


@needs_data
def test_quality_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    by = {r.doc_id: r.keep for r in weakrules.score(docs).collect()}
    rows = labels.collect()
    good, bad = [by[r.doc_id] for r in rows if r.quality == 1], [by[r.doc_id] for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.35


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, rules = 20000, len(weakrules.RULES)
    bad = rng.random(n) < 0.2
    defect = rng.integers(0, rules, n)
    votes = np.ones((rules, n), int)
    for r in range(rules):
        hit = bad & (defect == r)
        votes[r] = np.where(hit, np.where(rng.random(n) < 0.9, -1, 1), np.where(rng.random(n) < 0.005, -1, 1))
        votes[r][rng.random(n) < 0.3] = 0
    patterns = (3 ** np.arange(rules)[:, None] * (votes + 1)).sum(0)
    seen, counts = np.unique(patterns, return_counts=True)
    m = weakrules.fit(seen, counts)
    keep = m.posterior(weakrules.unpack(patterns)) >= 0.5
    assert (keep[~bad]).mean() > 0.9 and 0.1 < 1 - m.share[0] < 0.3


def test_tiles_against_brute_force():
    rng = random.Random(6)

    def brute(doc, item, least):
        used_d, used_i, out = set(), set(), []
        while True:
            best = (0, 0, 0)
            for p in range(len(doc)):
                for q in range(len(item)):
                    k = 0
                    while p + k < len(doc) and q + k < len(item) and doc[p + k] == item[q + k] and p + k not in used_d and q + k not in used_i:
                        k += 1
                    if k > best[2]:
                        best = (p, q, k)
            if best[2] < least:
                return out
            out.append(best)
            used_d |= set(range(best[0], best[0] + best[2]))
            used_i |= set(range(best[1], best[1] + best[2]))

    for _ in range(60):
        item = [rng.randrange(1, 9) for _ in range(24)]
        doc = item[12:] + [rng.randrange(1, 9) for _ in range(6)] + item[:12] if rng.random() < 0.5 else [rng.randrange(1, 4) for _ in range(30)]
        got = tiling.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert got == brute(doc, item, 3)


def test_reordered_passage_is_caught_and_clean_text_stays(spark):
    rng = random.Random(1)
    item = [f"t{i}" for i in range(40)]
    rows = [(1, words(rng, 90) + item[20:] + words(rng, 30) + item[:20]), (2, words(rng, 200)), (3, words(rng, 90) + item[:12] + words(rng, 90))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = tiling.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in got] == [(1, 7, 2, 1.0)]


def test_license_automaton():
    t = "Permission <<beginOptional>>is hereby <<endOptional>>granted to <<var;name=\"who\";original=\"Ann\";match=\".{1,2}\">> for any use"
    a = licenses.Automaton(t)
    for text, n in (("Permission granted to Ann for any use", 1), ("permission is hereby granted, to Ann Lee, for any use!", 1), ("Permission is granted to Ann for any use", 0), ("Permission granted to A B C for any use", 0), ("permission granted to x for any use " * 2, 2)):
        assert a.count(licenses.tokens(text)) == n
    with pytest.raises(ValueError):
        licenses.Automaton("<<beginOptional>>x<<endOptional>>")


def test_permutation_is_uniform():
    counts = Counter(tuple(extshuffle.fisher_yates(3, np.random.default_rng(s)).tolist()) for s in range(6000))
    assert len(counts) == 6 and max(counts.values()) < 1.2 * min(counts.values())


def test_shuffle_repeats_and_moves(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text")
    one = extshuffle.external_shuffle(df, bucket_bytes=4000)
    two = extshuffle.external_shuffle(spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text"), bucket_bytes=4000)
    a, b = ({r.doc_id: (r.shard, r.position) for r in x.collect()} for x in (one, two))
    assert a == b and a != {r.doc_id: (r.shard, r.position) for r in extshuffle.external_shuffle(df, seed=3, bucket_bytes=4000).collect()}
    sizes = Counter(s for s, _ in a.values())
    assert min(sizes.values()) > 0.5 * max(sizes.values())


def test_sstable_lookup(spark, tmp_path):
    df = spark.range(3000).selectExpr("id * 3 - 900 as doc_id", "repeat(cast(id as string), 20) as text")
    found = sstable.write_files(sstable.to_shards(df, block_bytes=2000, shard_bytes=2000), str(tmp_path)).collect()
    tables = [sstable.SSTable(Path(r.path).read_bytes()) for r in sorted(found, key=lambda r: r.shard_id)]
    assert len(tables) > 3 and sum(t.n_entries for t in tables) == 3000
    keys = [k for t in tables for k, _ in t.scan()]
    assert keys == sorted(keys)
    for i in (0, 1, 17, 2999):
        assert [x for t in tables for x in t.get(i * 3 - 900)] == [str(i) * 20]
    assert sum(t.may_have(sstable.encode_key(k)) for t in tables for k in range(10**6, 10**6 + 500)) < 0.05 * 500 * len(tables)
    bad = bytearray(Path(found[0].path).read_bytes())
    bad[3] ^= 1
    with pytest.raises(ValueError):
        list(sstable.SSTable(bytes(bad)).scan())


@needs_data
def test_warc_archives(spark, tmp_path):
    import gzip

    out = warc.resolve(warc.captures_of_pages(spark.read.parquet(f"{SF}/pages.parquet")))
    index = warc.write_archives(out, tmp_path.as_uri()).collect()
    record = {r.record_id: r for r in out.collect()}
    assert len(index) == len(record) and len({r.record_id for r in index}) == len(index)
    raw = {p: Path(p.removeprefix("file://")).read_bytes() for p in {r.path for r in index}}
    for r in index:
        # a member is found at its offset in the file as it lies there, and is one record
        assert gzip.decompress(raw[r.path][r.member_offset : r.member_offset + r.member_length]) == record[r.record_id].record.encode()
    assert sum(r.member_length for r in index) == sum(map(len, raw.values()))
    back = {r.record_id: r for r in warc.read_archives(spark, sorted(raw)).collect()}
    assert set(back) == set(record)
    for k, r in back.items():
        own = record[k]
        assert (r.record_type, r.captured_at, r.url) == (own.record_type, own.captured_at, own.url or None) and (own.status != "original" or own.record.endswith(r.http_header + r.payload + "\r\n\r\n"))


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    with np.errstate(divide="ignore"):
        m = transcripts.model_of([("start", "", "0u", 3), ("move", "0u", "1u", 2), ("move", "1u", "0a", 2), ("move", "0a", "0u", 1), ("marker", "user", "0u", 5), ("marker", "ai", "0a", 5), ("look", "list", "1u", 3)])
    names = ["user", "ai", "none", "new"]
    for _ in range(40):
        seen = [("x", (names[rng.integers(4)], "True", ".", "5", ["list", "plain"][rng.integers(2)]), "x", [], "new") for _ in range(5)]
        score = [sum(m.emit[k].get(f, m.unseen[k]) for k, f in enumerate(x[1])) for x in seen]
        value = lambda p: m.start[p[0]] + score[0][p[0]] + sum(m.move[a, b] + score[k][b] for k, (a, b) in enumerate(zip(p, p[1:]), 1))
        best = max(value(p) for p in product(range(4), repeat=5))
        assert abs(value(m.decode(seen)) - best) < 1e-9


@needs_data
def test_roles_held_out(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = transcripts.fit(transcripts.transcripts_of(c.where("conv_id % 2 = 0")))
    made = transcripts.transcripts_of(c.where("conv_id % 2 = 1"))
    got = transcripts.parse(made, model).join(made.select("conv_id", "turns"), "conv_id").collect()
    assert sum(r.roles == [t["role"] for t in r.turns] for r in got) >= 0.8 * len(got)
