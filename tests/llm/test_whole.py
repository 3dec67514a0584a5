"""Cases in which an operator must do the whole job, where a shortcut would leave something out."""

import random
from pathlib import Path

import pytest

from coderill.llm import langid, ordermin


def test_copies_that_are_near_their_original_only(spark):
    rng = random.Random(4)
    texts = [[f"w{k}" for k in range(200)]]
    for c in range(1000):
        text = list(texts[0])
        for k in rng.sample(range(200), rng.randint(30, 48)):  # 15 to 24 %
            text[k] = f"c{c}x{k}"
        texts.append(text)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    group = {r.doc_id: r.component for r in ordermin.groups(df).collect()}
    caught = sum(group.get(i, -1) == group.get(0, -2) for i in range(1, 1001))
    print(f"with the original: {caught} of 1000")
    assert caught >= 950


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no driver tables here")
def test_labelled_junk_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + (" " if rng.random() < 0.2 else "") for _ in range(600)) for _ in range(20)]
    table = docs.unionByName(spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(odd)], "doc_id bigint, text string, lang string")).cache()
    ident = langid.fit(table)
    got = langid.identify(table, ident).collect()
    junk, own = [r for r in got if r.doc_id < 0], [r for r in got if r.doc_id >= 0]
    print(f"{sum(not r.accepted for r in junk)} of {len(junk)} junk rejected, {sum(not r.accepted for r in own)} of {len(own)} own; limit {ident.limit:.1f}, least excess of junk {min(r.excess for r in junk):.1f}")
    assert len(junk) == 20 and not any(r.accepted for r in junk)
    assert sum(not r.accepted for r in own) <= 0.002 * len(own)
