"""Quality rules under weak supervision.

Each rule votes that a text is good (1) or bad (-1), or abstains (0). A document is good or has one of several defects,
one hidden class for each rule that can name a defect: with a single bad class, rules that look for different defects
would contradict each other on every bad document. Expectation-maximisation over all documents estimates how often each
rule, when it votes on a class, is right, and the share of each class; the posterior probability of being good then
replaces a filter that all rules must pass. Abstaining says nothing about the class. Votes depend on the classes alone, so the
histogram of vote patterns is sufficient: at most 3**rules rows leave the executors, whatever the size of the corpus.

Votes are computed by numpy over the UTF-8 buffers of Arrow batches: the same counts by regular expressions in the JVM
take several times as long.

Defined cases: a null text gets pattern -1, quality 0 and is rejected; an empty text is voted on like any (most rules
abstain); ties and repeated rows count and are judged one by one, null ids included; an empty table gives an empty
result; other columns pass through untouched and are never read by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, free_name, in_arrow, string_array, text_slices, with_columns, workers_see_package
from .tokens import hash_words, run_hashes, runs, utf8, word_runs

RULES = ("symbols", "shouting", "adjacent_repeats", "vocabulary", "cells", "word_length", "sentences", "stop_words", "repeated_lines", "symbol_runs")
#: Function words of the languages at hand.
STOP_WORDS = (
    "the of and to in is that it for was on are as with his they be at this have from or by not but what all were we when a an"
    " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " de la le et les des en un du une que est pour qui dans sur au pas plus par avec ce il se ne son"
    " el y los del las por con no una su para al lo como más pero sus o este ya"
)
THRESHOLD = 0.5
#: Expected share of bad votes among a rule's votes on good documents.
NOISE = 0.01

_SYMBOL, _UPPER, _LETTER, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
for _c in range(256):
    _ch = chr(_c)
    _SPACE[_c] = _c in b" \t\r\n\v\f"
    _LETTER[_c] = _c >= 0x80 or _ch.isalpha()
    _UPPER[_c] = _c < 0x80 and _ch.isupper()
    _SYMBOL[_c] = _c < 0x80 and not _ch.isalnum() and not _SPACE[_c] and _ch not in ".,;:'\"-()"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return good.astype(np.int8) - (bad & ~good).astype(np.int8)


def votes_of(texts: pa.Array) -> np.ndarray:
    """(rules, texts) of 1, 0 or -1."""
    data, offsets = utf8(texts)
    n = len(texts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    # letters are counted by their first bytes; of the capitals of two bytes only those of Latin-1 (C3 80..9E) count as shouting
    size = per_text(~_SPACE[data])
    letters = per_text(_LETTER[data] & (data & 0xC0 != 0x80))
    upper_flags = _UPPER[data]
    if len(data) > 1:
        upper_flags = upper_flags.copy()
        upper_flags[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = per_text(upper_flags)
    sign = _SYMBOL[data]
    symbols, bars = per_text(sign), per_text(data == ord("|"))
    pair = np.zeros(len(data), bool)
    pair[1:] = sign[1:] & sign[:-1]
    run_start = pair.copy()
    run_start[1:] &= ~pair[:-1]
    sign_runs = per_text(run_start)
    stops = per_text((data == ord(".")) | (data == ord("!")) | (data == ord("?")))
    low = _LOWER[data]
    starts, ends = word_runs(data, offsets)
    h = run_hashes(low, starts, ends)
    at = np.searchsorted(starts, offsets)
    words = np.diff(at)
    owner = np.repeat(np.arange(n), words)
    length = np.bincount(owner, (ends - starts).astype(float), n)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, same, n)
    function_words = np.bincount(owner, np.isin(h, _stop_hashes()), n)

    def distinct(hashes: np.ndarray, who: np.ndarray) -> np.ndarray:
        key = np.sort((who.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n)[:n]

    vocabulary = distinct(h, owner)
    line_starts, line_ends = runs(data != ord("\n"), offsets)
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)[:n]
    line_kinds = distinct(run_hashes(data, line_starts, line_ends), line_owner)

    w, some, many = np.maximum(words, 1), words >= 10, words >= 50
    ratio = symbols / np.maximum(size, 1)
    shout = upper / np.maximum(letters, 1)
    mean = length / w
    ends_ = stops / w
    known = function_words / w
    fresh = vocabulary / w
    # long texts repeat words by nature: the share expected falls with the root of the length
    expected = np.minimum(0.25, 5 / np.sqrt(w))
    return np.stack([
        _vote(ratio < 0.04, ratio > 0.12),
        _vote((shout < 0.2) & (letters >= 20), (shout > 0.5) & (letters >= 20)),
        _vote((repeats / w < 0.05) & some, (repeats / w > 0.2) & some),
        _vote((fresh > expected) & many, (fresh < expected / 2) & many),
        _vote((bars == 0) & some, (bars / w > 0.1) & some),
        _vote((mean >= 3) & (mean <= 9) & some, ((mean < 2) | (mean > 15)) & some),
        _vote((ends_ > 0.02) & (ends_ < 0.3) & some, ((ends_ < 0.005) | (ends_ > 0.5)) & many),
        _vote((known > 0.08) & many, (known < 0.02) & many),
        _vote((line_kinds / np.maximum(lines, 1) > 0.9) & (lines >= 3), (line_kinds / np.maximum(lines, 1) < 0.5) & (lines >= 4)),
        _vote((sign_runs / w < 0.02) & some, (sign_runs / w > 0.1) & some),
    ])


_stops: list[np.ndarray] = []


def _stop_hashes() -> np.ndarray:
    if not _stops:
        _stops.append(hash_words(sorted(set(STOP_WORDS.split()))))
    return _stops[0]


def patterns_of(texts: pa.Array) -> np.ndarray:
    """The votes of each text as one number in base 3; -1 for null."""
    out = np.empty(len(texts), np.int32)
    weights = 3 ** np.arange(len(RULES), dtype=np.int32)
    for lo, hi in text_slices(texts, SLICE_BYTES):
        out[lo:hi] = weights @ (votes_of(texts.slice(lo, hi - lo)).astype(np.int32) + 1)
    out[np.asarray(texts.is_null())] = -1
    return out


def unpack(patterns: np.ndarray) -> np.ndarray:
    """(rules, patterns) of votes."""
    return patterns[None, :] // 3 ** np.arange(len(RULES))[:, None] % 3 - 1


@dataclass
class Model:
    """Class 0 is good, class r + 1 has the defect that rule r looks for.

    share[c]: of the documents. votes_good[c, r]: how often rule r, when it votes on class c, votes good.
    """

    share: np.ndarray
    votes_good: np.ndarray
    rounds: int

    def joint(self, votes: np.ndarray) -> np.ndarray:
        """(classes, patterns): log-probability of class and votes."""
        return np.log(self.votes_good) @ (votes == 1) + np.log1p(-self.votes_good) @ (votes == -1) + np.log(self.share)[:, None]

    def classes(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each class, and the log-evidence of each pattern."""
        joint = self.joint(votes)
        top = joint.max(0)
        evidence = top + np.log(np.exp(joint - top).sum(0))
        return np.exp(joint - evidence), evidence

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.classes(votes)[0][0]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> Model:
    """Expectation-maximisation, begun with each bad vote taken for its own defect.

    Pseudo-counts (NOISE bad votes in all votes on good documents, one vote each way on others) keep probabilities inside
    (0, 1), so an empty histogram gives a model too.
    """
    votes, counts = unpack(patterns), counts.astype(float)
    is_good, is_bad = (votes == 1).astype(float), (votes == -1).astype(float)
    n_bad = is_bad.sum(0)
    start = np.vstack([np.where(n_bad > 0, 0.1, 0.95), np.where(n_bad > 0, 0.9 * is_bad / np.maximum(n_bad, 1), 0.05 / len(votes))])
    prior = np.ones((len(start), 2))
    prior[0] = (1 - NOISE) * 100, NOISE * 100
    model, before, responsible = None, -np.inf, start
    for k in range(rounds):
        mass = responsible * counts
        good, bad = mass @ is_good.T + prior[:, :1], mass @ is_bad.T + prior[:, 1:]
        share = (mass.sum(1) + 1) / (counts.sum() + len(start))
        model = Model(share, good / (good + bad), k + 1)
        responsible, evidence = model.classes(votes)
        now = float((counts * evidence).sum())
        if abs(now - before) <= tolerance * max(1.0, abs(now)):
            break
        before = now
    return model


def histogram(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns of all documents, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 ** len(RULES), np.int64)
        for b in batches:
            p = patterns_of(string_array(b.column(0)))
            counts += np.bincount(p[p >= 0], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["pattern", "n"])

    found = df.select(F.col(f"`{text_col}`")).mapInArrow(run, "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    return found["pattern"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def score(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id as it is, one vote per rule, quality (posterior of good) and keep."""
    workers_see_package(df.sparkSession)
    model = fit(*histogram(df, text_col))
    schema = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), *(T.StructField(f"vote_{r}", T.ByteType()) for r in RULES)])
    schema = with_columns(schema, quality=T.DoubleType(), keep=T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = patterns_of(string_array(b.column(1)))
            votes = unpack(np.maximum(p, 0))
            votes[:, p < 0] = 0
            q = np.where(p < 0, 0.0, model.posterior(votes))
            columns = [b.column(0), *(pa.array(v, pa.int8()) for v in votes), pa.array(q), pa.array(q >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select("doc_id", F.col(f"`{text_col}`")).mapInArrow(run, schema)


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose posterior reaches the threshold, as they are; no shuffle."""
    workers_see_package(df.sparkSession)
    model = fit(*histogram(df, text_col))
    at = df.columns.index(text_col)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = patterns_of(string_array(b.column(at)))
            q = np.where(p < 0, 0.0, model.posterior(unpack(np.maximum(p, 0))))
            kept = b.filter(pa.array(q >= threshold))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return in_arrow(df, run, df.schema)


__all__ = ["RULES", "Model", "fit", "free_name", "histogram", "keep_good", "score"]
