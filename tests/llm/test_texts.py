"""WARC digests and hot archives, blank lines and foreign fashions of transcripts, whole licenses, and brute force for models."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from coderill.llm import langid, licenses, transcripts, warc, weakrules

PUBLIC = Path("/usr/share/common-licenses")


def test_digests_in_all_spellings(spark, monkeypatch):
    body = "<p>same</p>"
    raw = hashlib.sha1(body.encode()).digest()
    b32, plain = base64.b32encode(raw).decode(), raw.hex()
    rows = [("a", "u", 5, "response", f"sha1:{b32}", body), ("b", "u", 6, "revisit", b32.lower(), None), ("c", "u", 7, "revisit", f"SHA1:{plain.upper()}", None), ("d", "u", 8, "revisit", plain, None), ("e", "u", 9, "revisit", "md5:00ff", None), ("f", "v", 4, "response", None, body)]
    c = spark.createDataFrame([(*r, None) for r in rows], "record_id string, url string, captured_at bigint, record_type string, payload_digest string, payload string, archive_no bigint")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    got = {r.record_id: r for r in warc.resolve(c).collect()}
    assert {k: r.status for k, r in got.items()} == {"f": "original", "a": "duplicate", "b": "resolved", "c": "resolved", "d": "resolved", "e": "orphan"}
    assert {r.payload_digest for k, r in got.items() if k != "e"} == {plain} and {r.refers_to for k, r in got.items() if k in "abcd"} == {"f"}
    # a hot archive is split, and offsets count within each part
    parts = defaultdict(list)
    for r in got.values():
        parts[r.archive_part].append((r.record_offset, r.record_length))
    assert len(parts) > 1
    for own in parts.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_pages_of_one_id_keep_their_urls(spark):
    pages = spark.createDataFrame([(None, "u", "<p>"), (None, "v", "<p>"), (1, "u", "<p>"), (1, "w", "<p>")], "page_id bigint, url string, html string")
    got = warc.resolve(warc.captures_of_pages(pages)).collect()
    assert sorted(r.url for r in got) == ["u", "u", "v", "w"] and sum(r.status == "original" for r in got) == 1


def test_blank_lines_inside_a_turn_stay():
    counts = [("start", "", "0user", 9), ("move", "0user", "1user", 9), ("move", "1user", "1user", 30), ("move", "1user", "0assistant", 9), ("move", "0assistant", "0user", 9), ("marker", "user", "0user", 50), ("marker", "assistant", "0assistant", 50), ("marker", "none", "1user", 90)]
    m = transcripts.model_of(counts)
    text = "User: first\n\nsecond paragraph\n  \n\n    code\nAssistant: yes\n\nUser: more"
    assert m.turns(text) == [("user", "first\n\nsecond paragraph\n  \n\n    code"), ("assistant", "yes"), ("user", "more")]


def test_steps_of_many_are_those_of_each():
    rng = np.random.default_rng(5)
    states = ["0u", "1u", "0a", "1a"]
    m = transcripts.model_of([("start", "", s, int(rng.integers(1, 9))) for s in states[::2]] + [("move", a, b, int(rng.integers(1, 9))) for a in states for b in states] + [(f, x, s, int(rng.integers(1, 9))) for f in transcripts.FEATURES for x in "pqr" for s in states])
    many = [[("", tuple(str(x) for x in rng.choice(list("pqrz"), len(transcripts.FEATURES))), "", [], "z") for _ in range(n)] for n in (0, 3, 1, 7, 0, 7, 2)]

    def alone(observed):
        if not observed:
            return []
        scores = [sum(m.emit[k].get(f, m.unseen[k]) for k, f in enumerate(o[1])) for o in observed]
        best, back = m.start + scores[0], []
        for s in scores[1:]:
            way = best[:, None] + m.move
            back.append(way.argmax(0))
            best = way.max(0) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    assert m.decode_all(many) == [alone(o) for o in many]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no driver tables here")
def test_fashions_that_the_generator_does_not_make(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    m = transcripts.fit(transcripts.transcripts_of(c))
    said = ["Could you help me with the garden?", "Of course. What do you grow?", "Roses, and some herbs.", "Then water them early."]
    want = ["user", "assistant", "user", "assistant"]
    for names in (("Customer", "Agent"), ("Prompt", "Output"), ("Nadia", "Tomas")):
        for shape in ("{}: {}", "<{}> {}", "## {}\n{}", "{}:\n{}"):
            text = "\n\n".join(shape.format(names[k % 2], t) for k, t in enumerate(said))
            got = m.turns(text)
            assert [t for _, t in got] == said, (shape, names, got)
            # who speaks first is a guess with names that nobody labelled, but the last two turns are a question and its answer
            assert [r for r, _ in got[2:]] == want[2:], (shape, names, got)
    assert [r for r, _ in m.turns("\n".join(f"{'User' if k % 2 == 0 else 'Assistant'}: {t}" for k, t in enumerate(said)))] == want


def strip(template, keep):
    """The text of a template, with its optional regions or without them, and variables as they originally were."""
    out, depth, pos = [], 0, 0
    for m in [*licenses.MARK.finditer(template), None]:
        if keep or not depth:
            out.append(template[pos : m.start() if m else None])
        if m:
            pos = m.end()
            depth += 1 if m[0].startswith("<<begin") else -1 if m[0] == "<<endOptional>>" else 0
            if m[0].startswith("<<var") and (keep or not depth):
                original = m[0].split('original="')[1].split('"')[0]
                out.append(f" {original or 'Somebody'} ")
    return "".join(out)


def test_every_template_accepts_itself_and_no_other():
    of = licenses.templates()
    assert len(of) >= 25
    automata = {k: licenses.Automaton(t) for k, t in of.items()}
    whole = {k for k in of if not k.endswith(("-notice", "-header", "-tag"))}
    for name, t in of.items():
        for keep in (True, False):
            text = strip(t, keep)
            found = {k for k, a in automata.items() if a.count(licenses.tokens(text))}
            assert name in found, name
            if name in whole:
                # one license holds all of another's wording and more
                assert found & whole <= {name, *({"MIT"} if name == "X11" else ())}, (name, found)
        # one mandatory word off, and it is not accepted
        words = licenses.tokens(strip(t, False))
        must = licenses.mandatory(t)
        k = words.index(must[len(must) // 2])
        if words.count(must[len(must) // 2]) == 1:
            assert automata[name].count([*words[:k], "otherwise", *words[k + 1 :]]) == 0, name


@pytest.mark.skipif(not PUBLIC.exists(), reason="no license texts on this machine")
def test_license_files_as_they_are_published(spark):
    want = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(k, (PUBLIC / k).read_text()) for k in want if (PUBLIC / k).exists()]
    got = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(texts, "doc_id string, text string")).collect():
        if not r.license_id.endswith(("-notice", "-header", "-tag")):
            got[r.doc_id].add(r.license_id)
    assert got == {k: {want[k]} for k, _ in texts}


def test_license_sql_finds_what_the_automata_find():
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(1)
    of = licenses.templates()
    texts = [strip(t, k) for t in of.values() for k in (True, False)] + ["", None, "...", "mit license. Released under the\nMIT License, released under the terms of the MIT license"]
    for _ in range(30):
        words = strip(rng.choice(list(of.values())), True).split()
        words[rng.randrange(len(words))] = rng.choice(["x", "--", "the", "1."])
        texts.append(" ".join(words * rng.choice([1, 2])))
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    automata = {k: licenses.Automaton(t) for k, t in of.items()}
    want = sorted((i, k, n) for i, t in enumerate(texts) if t for k, a in automata.items() if (n := a.count(licenses.tokens(t))))
    assert sorted(con.execute(licenses.oracle_sql()).fetchall()) == want and len(want) > 70


def test_kneser_ney_from_dictionaries(spark):
    """The whole model again, with dictionaries of strings, and the choice of language that follows from it."""
    rng = random.Random(7)
    syllables = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["ka", "she", "lin", "dor", "ve"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(k, make(lang, rng.randint(5, 60)), lang) for k in range(60) for lang in syllables]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    ident = langid.fit(df, calibration_rows=20)

    def counts(lang):
        grams = Counter()
        for _, t, own in rows:
            if own == lang:
                x = "\0" * 3 + t
                grams.update(x[i - 3 : i + 1] for i in range(3, len(x)))
        tables = [grams]
        for n in (3, 2, 1):
            tables.insert(0, Counter(g[1:] for g in tables[0]))
            assert all(len(g) == n for g in tables[0])
        return tables

    tables = {lang: counts(lang) for lang in syllables}

    def discount(table):
        n1, n2 = (sum(v == k for v in table.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def probability(lang, gram):
        p = 1 / langid.VOCABULARY
        for n, table in enumerate(tables[lang], 1):
            own, d = gram[-n:], discount(table)
            total = sum(v for g, v in table.items() if g[:-1] == own[:-1])
            kinds = sum(1 for g in table if g[:-1] == own[:-1])
            if total:
                p = max(table[own] - d, 0) / total + d * kinds / total * p
        return p

    tests = [make("aa", 6), make("bb", 6), "ka", "zzz ka"]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(tests)), "doc_id bigint, text string"), ident).collect()}
    for i, t in enumerate(tests):
        x = "\0" * 3 + t
        bits = {lang: -sum(math.log2(probability(lang, x[k - 3 : k + 1])) for k in range(3, len(x))) / len(t) for lang in syllables}
        assert abs(got[i].bits_per_char - min(bits.values())) < 1e-4
        if got[i].accepted:
            assert got[i].language == min(bits, key=bits.get)
    assert got[0].language == "aa" and got[1].language == "bb"
    # both languages have this syllable: there is no evidence for either
    assert not got[2].accepted


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no driver tables here")
def test_rejection_at_every_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    ident = langid.fit(docs)
    texts = [r.text for r in docs.where("length(text) > 4000 and lang = 'en'").limit(5).collect()]
    cuts = [(k * 100 + i, t[:n], "en") for i, t in enumerate(texts) for k, n in enumerate((60, 200, 1000, 4000))] + [(900 + i, t * 20, "en") for i, t in enumerate(texts)]
    rng = random.Random(4)
    junk = [(2000 + n, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)), None) for n in (60, 200, 1000, 4000, 100_000)] + [(3000, "hi", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(cuts + junk, "doc_id bigint, text string, lang string"), ident).collect()}
    assert all(got[i].accepted and got[i].language == "en" for i, _, _ in cuts), [got[i] for i, _, _ in cuts if not got[i].accepted]
    assert not any(got[i].accepted for i, _, _ in junk), [got[i] for i, _, _ in junk if got[i].accepted]
    own = langid.identify(docs, ident).collect()
    assert sum(not r.accepted for r in own) <= 0.002 * len(own), [r for r in own if not r.accepted][:5]


def test_expectation_maximisation_in_plain_python():
    rng = random.Random(3)
    rules = len(weakrules.RULES)
    seen = Counter()
    for _ in range(400):
        bad = rng.randrange(rules) if rng.random() < 0.3 else None
        votes = [0 if rng.random() < 0.2 else -1 if (r == bad and rng.random() < 0.9) or rng.random() < 0.01 else 1 for r in range(rules)]
        seen[sum(3**r * (v + 1) for r, v in enumerate(votes))] += 1
    patterns = np.array(sorted(seen))
    m = weakrules.fit(patterns, np.array([seen[p] for p in patterns.tolist()]), rounds=25, tolerance=0)

    votes = {p: [p // 3**r % 3 - 1 for r in range(rules)] for p in seen}
    classes = range(rules + 1)
    weight = {}
    for p, v in votes.items():
        n_bad = sum(x == -1 for x in v)
        weight[p] = [0.1 if n_bad else 0.95] + [(0.9 / n_bad if x == -1 else 0.0) if n_bad else 0.05 / rules for x in v]
    for _ in range(25):
        share = [(sum(seen[p] * weight[p][c] for p in seen) + 1) / (sum(seen.values()) + rules + 1) for c in classes]
        right = []
        for c in classes:
            up, down = ((1 - weakrules.NOISE) * 100, weakrules.NOISE * 100) if c == 0 else (1, 1)
            row = []
            for r in range(rules):
                good = sum(seen[p] * weight[p][c] for p in seen if votes[p][r] == 1) + up
                bad = sum(seen[p] * weight[p][c] for p in seen if votes[p][r] == -1) + down
                row.append(good / (good + bad))
            right.append(row)
        for p, v in votes.items():
            joint = [share[c] * math.prod(right[c][r] if x == 1 else 1 - right[c][r] if x == -1 else 1 for r, x in enumerate(v)) for c in classes]
            weight[p] = [x / sum(joint) for x in joint]
    got = m.posterior(weakrules.unpack(patterns))
    assert m.rounds == 25 and all(abs(got[k] - weight[p][0]) < 1e-6 for k, p in enumerate(patterns.tolist()))


def test_votes_ties_and_ids_of_any_kind(spark):
    text = "It was a plain text. " * 6
    df = spark.createDataFrame([("a", text), ("a", text), (None, text), ("z", None), ("y", "")], "doc_id string, text string")
    got = weakrules.score(df).collect()
    assert len(got) == 5 and len({r.quality for r in got if r.doc_id in ("a", None)}) == 1
    # dashes and quotes of any script separate words
    a, b = weakrules.votes_of(pa.array(["one two — three “four” five " * 12, "one two - three 'four' five " * 12])).T
    assert (a == b).all()
