"""Order MinHash: what closes open keys, long positions, scripts without spaces and awkward rows, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from coderill.llm import ordermin, tokens
from coderill.llm.common import materialise, scratch


def frame(spark, texts):
    return spark.createDataFrame([(i, t if isinstance(t, str) else " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_words_by_script():
    def split(text):
        data, offsets = tokens.utf8(pa.array([text]))
        return [data[a:b].tobytes().decode() for a, b in zip(*tokens.word_runs(data, offsets), strict=True)]

    assert split("“hello” world—again… don’t") == ["hello", "world", "again", "don", "t"]
    assert split("今天,天气很好。明日！") == list("今天天气很好明日")
    assert split("été à Zürich; привет، мир") == ["été", "à", "Zürich", "привет", "мир"]
    assert split("ไทย ab漢c") == ["ไ", "ท", "ย", "ab", "漢", "c"] and split("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"]
    assert split("x𝒳y 🎉z") == ["x𝒳y", "z"] and split("") == []


def test_copies_in_a_script_without_spaces(spark):
    rng = random.Random(3)
    base = [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120)]
    other = [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120)]
    near = list(base)
    for k in rng.sample(range(120), 6):
        near[k] = "的"
    texts = ["".join(x[:40]) + "，" + "".join(x[40:]) + "。" for x in (base, near, other)]
    group = {r.doc_id: r.component for r in ordermin.groups(frame(spark, texts)).collect()}
    assert set(group) == {0, 1} and len(set(group.values())) == 1


def test_keys_change_by_and_by_with_length():
    counts = []
    for n in (1, 16, 24, 25, 26, 36, 47, 48, 49, 200):
        _, w, at = ordermin.nodes_of(pa.array([" ".join(f"w{k}" for k in range(n))]))
        counts.append(len(ordermin._keys(w, at, np.array([0]))[0]) - ordermin.SKETCHES)
    assert counts[0] == counts[2] == ordermin.SHORT_SKETCHES and counts[-3:] == [0, 0, 0]
    assert all(0 <= a - b <= 1 for a, b in zip(counts[2:5], counts[3:5], strict=False)) and sorted(counts, reverse=True) == counts


def test_positions_beyond_the_usual_bits(monkeypatch):
    rng = np.random.default_rng(1)
    words = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    at = np.array([0, 3000])
    want = ordermin.sketch(words, at, ordermin.K, ordermin.PICKED, ordermin._SEEDS[:48])
    # with six bits at least, 3000 positions need twelve: they must be taken, not wrapped
    monkeypatch.setattr(ordermin, "_POSITION_BITS", 6)
    assert (ordermin.sketch(words, at, ordermin.K, ordermin.PICKED, ordermin._SEEDS[:48]) == want).all()


def test_a_text_of_more_than_two_to_the_24_words():
    n = (1 << 24) + 5000
    words = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    element, starts = ordermin.labelled_kmers(words, np.array([0, n]), 1)
    seed = ordermin._SEEDS[0]
    key = ordermin.sketch(words, np.array([0, n]), 1, 2, np.array([seed]))[0, 0]
    least = np.sort(np.argsort(element * seed, kind="stable")[:2])
    want = seed
    with np.errstate(over="ignore"):
        for p in least:
            want = ordermin.mix(np.array([want * np.uint64(0xD6E8FEB86659FD93) + element[p]]))[0]
    assert key == want


def test_shared_words_and_similarity():
    rng = random.Random(6)
    from collections import Counter

    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        x, y = (np.unique(np.array(v, np.uint32), return_counts=True) for v in (a, b))
        assert ordermin.shared_words(x, y) == sum((Counter(a) & Counter(b)).values())
    long = np.arange(4000, dtype=np.uint32)
    for changed in (0, 1, 40, 400, 1000, 1001):
        other = long.copy()
        other[np.linspace(0, 3999, changed).astype(int)] = 10**6
        got = ordermin.similarity(long, other, 0.75)
        assert (got is None) == (changed > 1000) and (got is None or abs(got - (1 - changed / 4000)) < 1e-12)


@pytest.mark.parametrize("small,block", [(64, 1024), (3, 1024), (3, 4), (1, 2)])
def test_open_keys_lose_no_near_pair(spark, small, block):
    """Whatever way a key is closed, its near pairs of different components are among the candidates."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(30)]
    texts = []
    for _ in range(25):
        body = passage + [f"b{rng.randrange(10**6)}" for _ in range(40)]
        texts.append(body)
        if rng.random() < 0.5:
            near = list(body)
            for k in rng.sample(range(70), rng.randint(8, 17)):
                near[k] = f"c{rng.randrange(10**6)}"
            texts.append(near)
    df = frame(spark, texts)
    words = materialise(ordermin.words_of(ordermin._signatures(df).select("node").distinct(), df), "words")
    held = {r.node: np.frombuffer(r.words, np.uint32) for r in words.collect()}
    # all under one key, all apart
    shared = spark.createDataFrame([(1, n, len(w), 0) for n, w in held.items()], "key bigint, node bigint, n_words bigint, hub bigint")
    found = spark.createDataFrame([], "node bigint, component bigint")
    got = [(r.hub, r.node) for r in ordermin.left_open(shared, found, words, 0.75, small, block).collect()]
    near = {(min(a, b), max(a, b)) for a in held for b in held if a != b and ordermin.similarity(held[a], held[b], 0.75) is not None}
    assert len(set(got)) == len(got) and near <= set(got) and len(near) > 5
    if small < 64:
        # the passage that all share brings nobody together
        assert len(got) < len(held) * 4


def test_components_by_both_ways(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "hub bigint, node bigint")
    one, two = ({r.node: r.component for r in ordermin.components(df, limit).collect()} for limit in (1 << 20, 0))
    assert one == two and one[1060] == 1000 and all(one[a] == one[b] for a, b in edges)
    assert ordermin.components(df.limit(0)).count() == ordermin.components(df.limit(0), -1).count() == 0


def test_words_are_found_by_both_ways(spark):
    df = frame(spark, ["a b c", "d e f g", "a b c", "x"])
    wanted = ordermin._signatures(df).select("node").distinct().limit(2)
    wanted = materialise(wanted, "w")
    one, two = ({(r.node, bytes(r.words)) for r in ordermin.words_of(wanted, df, limit).collect()} for limit in (1 << 20, 0))
    assert one == two and len(one) == 2


def test_many_candidates_of_one_hub(spark, monkeypatch):
    monkeypatch.setattr(ordermin, "HUB_ROWS", 7)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(80)]
    texts = [base] + [[w if rng.random() > 0.05 else "x" + str(rng.random()) for w in base] for _ in range(40)]
    group = {r.doc_id: r.component for r in ordermin.groups(frame(spark, texts)).collect()}
    assert len(group) == 41 and len(set(group.values())) == 1


def test_string_ids_and_dotted_columns(spark):
    rows = [("b", "one two three four five six", 1), ("a", "one two three four five six", 2), (None, "one two three four five six", 3), ("c", "seven", 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, `n.a` int")
    kept = ordermin.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == ["a", "c"]
    assert sorted((r.doc_id or "", r.duplicate_of) for r in ordermin.near_duplicates(df).collect()) == [("", "a"), ("b", "a")]


def test_what_is_written_on_the_way_is_deleted(spark):
    import os

    from coderill.llm.common import application_dir

    df = frame(spark, ["one two three", "one two three", "four"])
    with scratch(spark):
        materialise(df, "gone").count()
    before = set(os.listdir(application_dir(spark)))
    ordermin.groups(df)
    assert {x.split("-")[0] for x in set(os.listdir(application_dir(spark))) - before} == {"groups"} and not any(x.startswith("gone") for x in before)
