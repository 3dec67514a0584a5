"""Benchmark decontamination: both ways of tiling, short items, repetitive texts and all sides of its switches."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from coderill.llm import tiling


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


@pytest.mark.parametrize("way", [tiling.tiles, tiling.tiles_by_length, lambda a, b, n: tiling.tiles(a, b, n, 0)])
def test_tiles_with_many_ties(way):
    rng = random.Random(1)
    for _ in range(120):
        kinds, least = rng.choice([2, 3, 5, 9]), rng.randrange(1, 5)
        item, doc = ([rng.randrange(1, kinds + 1) for _ in range(rng.randrange(1, n))] for n in (30, 40))
        assert way(np.array(doc, np.uint64), np.array(item, np.uint64), least) == brute(doc, item, least)


def test_equal_hashes_are_not_taken_for_equal_tokens(monkeypatch):
    monkeypatch.setattr(tiling, "ngram_hashes", lambda words, n: np.zeros(max(0, len(words) - n + 1), np.uint64))
    doc, item = np.arange(1, 30, dtype=np.uint64), np.arange(20, 60, dtype=np.uint64)
    assert tiling.tiles(doc, item, 3) == brute(doc.tolist(), item.tolist(), 3)


def test_memory_of_a_text_that_repeats_one_token():
    code = "import numpy as np, resource; from coderill.llm import tiling; assert tiling.tiles(np.full(200_000, 7, np.uint64), np.full(1000, 7, np.uint64)) == [(0, 0, 1000)]; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) < 500, done.stdout + done.stderr


@pytest.mark.parametrize("limit", [tiling.BROADCAST_BYTES, 0])
def test_short_items_ties_and_repetitive_texts(spark, limit):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "delta epsilon zeta"), (4, "eta theta iota kappa"), (5, "one two three four five six"), (6, "za " * 300), (7, "今天天气"), (8, "...")]
    docs = [
        (1, "an alpha here"), (2, "beta and gamma"), (3, "so beta, gamma"), (4, "delta epsilon nothing zeta delta epsilon zeta"), (5, "theta eta theta iota kappa"), (6, "eta theta iota"),
        (7, "one two three four five six one two three four five six"), (8, "za " * 30_000), (9, "“alpha” — said"), (10, "我说今天天气很好。"), (11, None), (12, ""), (12, "alpha"), (12, "alpha"), (None, "alpha"),
    ]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, `item.id` int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.n_covered, r.n_item_tokens) for r in tiling.contaminated(d, b, limit=limit).collect())
    assert got == [(0, 1, 1, 1), (1, 1, 1, 1), (3, 2, 2, 2), (4, 3, 3, 3), (5, 4, 4, 4), (7, 5, 6, 6), (8, 6, 300, 300), (9, 1, 1, 1), (10, 7, 4, 4), (12, 1, 1, 1), (12, 1, 1, 1)]
    clean = tiling.decontaminate(d, b, limit=limit)
    assert clean.columns == d.columns and sorted((r.doc_id, r.text) for r in clean.collect() if r.text) == [(2, docs[1][1]), (6, docs[5][1])] and clean.count() == 4
