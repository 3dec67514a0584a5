"""Benchmark decontamination by greedy string tiling.

Seeds, all runs of MIN_TILE tokens of the benchmark, are joined with those of the documents. On each pair of document and
item that shares one, the longest match between tokens not yet marked is marked as a tile, again and again, until no match
of MIN_TILE tokens is left (ties: first in the document, then in the item). Matches are found by running Karp-Rabin hashes
and then compared token by token: hashes of MIN_TILE tokens, whose neighbours along a diagonal make up longer ones, or,
where texts repeat themselves so much that there would be more than SEED_PAIRS of these, hashes of all runs of one length
at a time, in memory that grows with the texts alone. The tiles' share of the item's tokens is its coverage; from COVERAGE
on the document is contaminated. Since tiles may stand in any order, passages whose parts were reordered are caught.

An item of fewer than MIN_TILE tokens is one seed as a whole: it is found where all of it stands in a row.

The benchmark is sent to all executors only while its text stays under BROADCAST_BYTES; then documents are read once and
not shuffled. A larger one is joined by seed with a shuffle; the outcome is the same.

Tokens are words in lower case. Defined cases: null and empty texts share no seed; items without words are not found
anywhere; repeated items (same id and text) count once, repeated documents each get their rows; null ids pass through; an
empty table on either side gives an empty result; further columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, checked_broadcast, columns, free_name, in_arrow, materialise, string_array, text_slices, workers_see_package
from .tokens import _BASE, mix, ngram_hashes, word_hashes

MIN_TILE = 5
COVERAGE = 0.5
#: Pairs of equal seeds of one document and one item that are laid out side by side.
SEED_PAIRS = 1 << 18
SCHEMA = "item_id bigint, n_tiles int, n_covered int, n_item_tokens int, coverage double, longest_tile int"


def tiles(doc: np.ndarray, item: np.ndarray, min_tile: int = MIN_TILE, seed_pairs: int = SEED_PAIRS) -> list[tuple[int, int, int]]:
    """(from in doc, from in item, length) of each tile, in the order of marking."""
    a, b = ngram_hashes(doc, min_tile), ngram_hashes(item, min_tile)
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    at = np.flatnonzero(hi > lo)
    many = hi[at] - lo[at]
    if many.sum() > seed_pairs:
        return tiles_by_length(doc, item, min_tile)
    i = np.repeat(at, many)
    within = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    j = order[np.repeat(lo[at], many) + within]
    for k in range(min_tile):
        same = doc[i + k] == item[j + k]
        i, j = i[same], j[same]
    found = []
    while len(i):
        # neighbouring seeds on a diagonal are one match
        k = np.lexsort((i, i - j))
        i, j = i[k], j[k]
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(i) != 1) | (np.diff(i - j) != 0)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(i))) + min_tile - 1
        best = start[length == length.max()]
        best = best[np.lexsort((j[best], i[best]))[0]]
        p, q, n = int(i[best]), int(j[best]), int(length.max())
        found.append((p, q, n))
        free = ((i + min_tile <= p) | (i >= p + n)) & ((j + min_tile <= q) | (j >= q + n))
        i, j = i[free], j[free]
    return found


def _powers(n: int) -> np.ndarray:
    x = np.full(n + 1, _BASE, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


class _Runs:
    """Running hashes of all runs of unmarked tokens of one text."""

    def __init__(self, tokens: np.ndarray, power: np.ndarray):
        self.tokens, self.power, self.free = tokens, power, np.ones(len(tokens), bool)
        # sums[i] is the polynomial over the first i tokens, highest power first
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens) * power[len(tokens) - 1 - np.arange(len(tokens))], dtype=np.uint64)])

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the unmarked runs of ``n`` tokens; hashes of two texts of other lengths are brought to one power."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[n:] == marked[: len(marked) - n])
        return at, (self.sums[at + n] - self.sums[at]) * self.power[len(self.power) - 1 - (len(self.tokens) - 1 - at)]

    def mark(self, at: int, n: int) -> None:
        self.free[at : at + n] = False


def tiles_by_length(doc: np.ndarray, item: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """As ``tiles``, with memory for the runs of one length at a time.

    If some run of n tokens matches, so does one of n - 1; so the greatest length is found by bisection. All tiles of one length
    are marked in one pass, as marking makes no longer one.
    """
    power = _powers(max(len(doc), len(item), 1))
    a, b = _Runs(doc, power), _Runs(item, power)

    def matches(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of the runs in ``doc`` that ``item`` has too, and of those in ``item``, in the order of their hashes."""
        (p, x), (q, y) = a.of(n), b.of(n)
        order = np.argsort(y, kind="stable")
        q, y = q[order], y[order]
        hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
        return p[hit], x[hit], q, y

    found, longest = [], min(len(doc), len(item))
    while longest >= min_tile:
        lo, hi = min_tile - 1, longest
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(matches(mid)[0]) else (lo, mid - 1)
        longest = lo
        if longest < min_tile:
            break
        places, hashes, q, y = matches(longest)
        until = 0
        for p, x in zip(places.tolist(), hashes, strict=True):
            # what is marked here is marked from the left
            if p < until:
                continue
            for k in q[np.searchsorted(y, x, "left") : np.searchsorted(y, x, "right")].tolist():
                if np.array_equal(doc[p : p + longest], item[k : k + longest]):
                    found.append((p, k, longest))
                    a.mark(p, longest)
                    b.mark(k, longest)
                    until = p + longest
                    free = (q + longest <= k) | (q >= k + longest)
                    q, y = q[free], y[free]
                    break
            if not len(q):
                break
        longest -= 1
    return found


@dataclass
class Benchmark:
    """Items with their tokens, and for each length of seeds all of these, sorted by hash, with the items that have them."""

    ids: list[int | None]
    tokens: list[np.ndarray]
    seeds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    min_tile: int

    @classmethod
    def of(cls, ids: list[int | None], texts: pa.Array, min_tile: int = MIN_TILE) -> Benchmark:
        words, at = word_hashes(texts)
        kept, tokens, seen = [], [], set()
        for k, i in enumerate(ids):
            own = words[at[k] : at[k + 1]]
            if len(own) and (i, own.tobytes()) not in seen:
                seen.add((i, own.tobytes()))
                kept.append(i)
                tokens.append(own.copy())
        seeds = []
        for n in sorted({min(min_tile, len(t)) for t in tokens}):
            owners = [k for k, t in enumerate(tokens) if min(min_tile, len(t)) == n]
            grams = [ngram_hashes(tokens[k], n) for k in owners]
            flat = np.concatenate(grams)
            owner = np.repeat(owners, [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(flat, kind="stable")
            seeds.append((n, flat[order], owner[order], place[order]))
        return cls(kept, tokens, seeds, min_tile)

    def compare(self, doc: np.ndarray, item: int) -> tuple | None:
        own = self.tokens[item]
        found = tiles(doc, own, min(self.min_tile, len(own)))
        if not found:
            return None
        n, covered = len(own), sum(x[2] for x in found)
        return self.ids[item], len(found), covered, n, covered / n, max(x[2] for x in found)

    def scan(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, tuple]]:
        """(number of the text, row of SCHEMA) of all pairs that reach the coverage."""
        for lo, hi in text_slices(texts):
            words, at = word_hashes(texts.slice(lo, hi - lo))
            for n, seeds, owners, places in self.seeds:
                g = ngram_hashes(words, n)
                left = np.searchsorted(seeds, g)
                hit = np.flatnonzero(seeds[np.minimum(left, len(seeds) - 1)] == g)
                doc = np.searchsorted(at, hit, side="right") - 1
                inside = hit + n <= at[doc + 1]
                # a seed that a text repeats counts once
                once = np.unique(doc[inside] * len(seeds) + left[hit[inside]])
                doc, slot = once // len(seeds), once % len(seeds)
                many = np.searchsorted(seeds, seeds[slot], side="right") - slot
                slot = np.repeat(slot, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                doc, item, spot = np.repeat(doc, many), owners[slot], places[slot]
                order = np.lexsort((spot, item, doc))
                doc, item, spot = doc[order], item[order], spot[order]
                if not len(doc):
                    continue
                edge = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0)))
                for s, e in zip(edge, [*edge[1:], len(doc)], strict=True):
                    d, k = int(doc[s]), int(item[s])
                    # what seeds cover bounds what tiles can cover
                    bound = n + np.minimum(np.diff(spot[s:e]), n).sum()
                    if bound >= coverage * len(self.tokens[k]):
                        row = self.compare(words[at[d] : at[d + 1]], k)
                        if row and row[4] >= coverage:
                            yield lo + d, row


def small_enough(benchmark: DataFrame, limit: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= limit


def _fetch(benchmark: DataFrame, min_tile: int) -> Benchmark:
    got = benchmark.select(F.col("item_id").cast("bigint"), "text").orderBy("item_id", "text").toArrow()
    return Benchmark.of(got.column("item_id").to_pylist(), string_array(got.column("text")), min_tile)


def _rows(ids: list, rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
    names = ["item_id", "n_tiles", "n_covered", "n_item_tokens", "coverage", "longest_tile"]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["doc_id", *names])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id and SCHEMA for every pair of document and item whose coverage reaches the threshold."""
    workers_see_package(docs.sparkSession)
    if not small_enough(benchmark, limit):
        leaks = materialise(_by_seed_join(docs, benchmark, coverage, min_tile), "leaks")
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha1("text").alias("k")).join(leaks, "k").drop("k")
    shared = docs.sparkSession.sparkContext.broadcast(_fetch(benchmark, min_tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(shared.value.scan(string_array(b.column(1)), coverage))
            yield _rows([b.column(0)[k].as_py() for k, _ in found], [r for _, r in found])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + SCHEMA)


def _by_seed_join(docs: DataFrame, benchmark: DataFrame, coverage: float, min_tile: int) -> DataFrame:
    """As contaminated(), for a benchmark of any size, by ``k``, the SHA-1 of the text, in place of doc_id.

    Seeds meet in a shuffle, and only pairs that share one meet as texts. The outcome depends on the text alone, so equal
    texts meet the benchmark once.
    """

    def emit(lengths: list[int] | None):
        """Seeds of the texts: of all these lengths, or of each text the length that it has as an item."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = string_array(b.column(1))
                for lo, hi in text_slices(texts):
                    words, at = word_hashes(texts.slice(lo, hi - lo))
                    size = np.diff(at)
                    for n in lengths or range(1, min_tile + 1):
                        g = ngram_hashes(words, n)
                        doc = np.searchsorted(at, np.arange(len(g)), side="right") - 1
                        inside = np.arange(len(g)) + n <= at[doc + 1]
                        if not lengths:
                            inside &= np.minimum(size, min_tile)[doc] == n
                        pairs = np.unique(np.stack([doc[inside].astype(np.uint64), g[inside]]), axis=1)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[0].astype(np.int64) + lo)), pa.array(pairs[1].view(np.int64))], names=["k", "seed"])

        return run

    def lengths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.minimum(np.diff(word_hashes(string_array(b.column(0)))[1]), min_tile)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[n > 0]))], names=["n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i in range(b.num_rows):
                bench = Benchmark.of([b.column(2)[i].as_py()], string_array(b.column(3).slice(i, 1)), min_tile)
                for _, r in bench.scan(string_array(b.column(1).slice(i, 1)), coverage):
                    ids.append(b.column(0)[i].as_py())
                    rows.append(r)
            got = _rows([None] * len(ids), rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *got.columns[1:]], names=["k", *got.schema.names[1:]])

    key = F.sha1("text")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item_text")).where("item_text is not null").distinct().withColumn("i", F.sha1("item_text"))
    texts = docs.where("text is not null").select(key.alias("k"), "text").dropDuplicates(["k"])
    lengths = sorted(r.n for r in items.select("item_text").mapInArrow(lengths_of, "n bigint").distinct().collect())  # min_tile rows at most
    d_seeds = texts.mapInArrow(emit(lengths or [min_tile]), "k string, seed bigint").distinct()
    i_seeds = items.select("i", "item_text").distinct().mapInArrow(emit(None), "k string, seed bigint").select(F.col("k").alias("i"), "seed").distinct()
    pairs = materialise(d_seeds.join(i_seeds, "seed").select("k", "i").distinct(), "pairs")
    met = pairs.join(texts, "k").join(items, "i")
    return met.select("k", "text", "item_id", "item_text").mapInArrow(compare, "k string, " + SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that no item covers up to the threshold, as they are."""
    workers_see_package(docs.sparkSession)
    if not small_enough(benchmark, limit):
        k = free_name(docs.columns, "text_key")
        bad = materialise(_by_seed_join(docs, benchmark, coverage, min_tile).select(F.col("k").alias(k)).distinct(), "leaks")
        return docs.withColumn(k, F.sha1("text")).join(checked_broadcast(bad, bad.count(), 64), k, "left_anti").select(columns(docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(_fetch(benchmark, min_tile))
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for k, _ in shared.value.scan(string_array(b.column(at)), coverage):
                clean[k] = False
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(clean)).columns, names=names)

    return in_arrow(docs, run, docs.schema)
