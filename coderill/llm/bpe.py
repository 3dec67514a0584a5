"""Byte-pair encoding and decoding by speculation and verification.

The vocabulary is a rank file (one base64 token and its rank a line). Text is cut into words by the usual pattern of such
files, here by classes of code points over the UTF-8 buffers of a whole slice of texts. Each distinct word of the slice is
then encoded once:

* speculate: greedy longest match proposes tokens, all words at a time;
* verify: a proposal is the true encoding exactly if every adjacent pair of its tokens could stand side by side, that is,
  if undoing their merges step by step finds no merge across the border that would have come first. All distinct pairs
  are tested at a time;
* only words with a failing pair undergo exact merging, pair of lowest rank first.

``decode`` gathers the bytes of tokens. Nothing is trained, and the vocabulary reaches the executors as one broadcast.

Defined cases: a null text has null tokens, the empty text no token; whole texts of any length are encoded; special tokens
are ordinary text; repeated rows and null ids are encoded one by one; an empty table gives an empty result; the operator
reads two columns by name and others pass through ``with_tokens``, where clashing new names get underscores in front.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_arrow, string_array, text_slices, with_columns, workers_see_package
from .tokens import _RANDOM, _power_tables, mix, utf8

VOCABULARY_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of whole texts that are encoded at a time.
SLICE_BYTES = 1 << 20
#: Longer failing words are merged one by one with a heap, shorter ones all at a time; the outcome is the same.
LONG_WORD = 48

_U = np.uint64
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_classes: list[np.ndarray] = []
_vocabularies: dict[int, Vocabulary] = {}


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[list(_WHITE)] = SPACE
        _classes.append(table)
    return _classes[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    if start[0]:
        start = np.concatenate([[0], start])
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    lead = padded[start].astype(np.int32)
    points = lead.copy()
    multi = np.flatnonzero(lead >= 0xC0)
    if len(multi):
        b = [padded[start[multi] + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        m = lead[multi]
        two, three = (m & 0x1F) << 6 | b[0], (m & 0x0F) << 12 | b[0] << 6 | b[1]
        four = (m & 0x07) << 18 | b[0] << 12 | b[1] << 6 | b[2]
        points[multi] = np.minimum(np.where(m < 0xE0, two, np.where(m < 0xF0, three, four)), 0x10FFFF)
    return points, start


def words_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which words begin, and the length of ``data`` behind them; words tile the texts.

    As 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ would cut them.
    """
    points, at = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    kind = classes()[points]
    text_edge = np.zeros(n + 1, bool)
    text_edge[np.searchsorted(at, offsets)] = True
    begins = text_edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # the last white space before other signs: a blank joins them, any other is a word of its own
    last_space = np.zeros(n, bool)
    last_space[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_edge[1:n]
    joins = last_space & (points == 32)
    cut = begins | last_space
    cut[1:] &= ~joins[:-1]
    # a lone apostrophe that opens a word takes 's, 't, 're, 've, 'm, 'll or 'd with it
    quote = np.flatnonzero(cut & (points == 39))
    if len(quote):
        nxt = np.concatenate([points, np.zeros(3, points.dtype)])
        inside = np.concatenate([~text_edge[1:n], np.zeros(3, bool)])  # i and i+1 are of one text
        one, two = nxt[quote + 1], nxt[quote + 2]
        same1, same2 = inside[quote], inside[quote] & inside[np.minimum(quote + 1, n)]
        short = same1 & np.isin(one, [ord(c) for c in "stmd"])
        long = same2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        q = quote[short | long]
        end = q + np.where(short, 2, 3)[short | long]
        cut[q + 1] = False
        end = end[end < n]
        cut[end] = True
    return np.append(at[cut], len(data))


class Hashed:
    """Hashes of any slices of a byte buffer, off one prefix sum."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_RANDOM[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_U))


class HashMap:
    """An immutable open-addressing table from 64-bit hashes to integers; -1 for a key that it lacks."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys) - 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.zeros(1 << self.bits, _U), np.full(1 << self.bits, -2, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.values[slot] == -2
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[todo[put]], values[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo, slot = None, self._slot(keys)
        while True:
            found, value = self.keys[slot], self.values[slot]
            wanted = keys if todo is None else keys[todo]
            hit = (found == wanted) & (value != -2)
            if todo is None:
                out[hit] = value[hit]
            else:
                out[todo[hit]] = value[hit]
            more = ~hit & (value != -2)
            if not more.any():
                return out
            todo = np.flatnonzero(more) if todo is None else todo[more]
            slot = (slot[more] + 1) & self.mask


def merge_exactly(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Byte-pair merging, lowest rank first and leftmost among equals; ``below``: only merges of lower rank."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None and (below is None or r < below):
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[i] >= to or end[end[i]] != to:
            continue
        alive[end[i]] = False
        end[i] = to
        if to < n:
            before[to] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


class Vocabulary:
    """Tokens by rank, with the tables of the vectorised steps."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError("a byte-level vocabulary needs all bytes")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.tokens = tokens
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.width)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # every prefix of a token, with the token that it is, if it is one
        prefixes = {t[:k]: -1 for t in ranks for k in range(1, len(t))} | ranks
        names = list(prefixes)
        flat = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(p) for p in names])
        self.prefixes = HashMap(Hashed(flat).of(np.concatenate([[0], ends[:-1]]), ends), np.array([size if v < 0 else v for v in prefixes.values()]))
        self.size = size
        # the last merge of each token; what no merge makes has none
        left, right = np.arange(size), np.arange(size)
        for t, r in ranks.items():
            if len(t) > 1:
                parts = merge_exactly(t, ranks, r)
                if len(parts) == 2:
                    left[r], right[r] = ranks[parts[0]], ranks[parts[1]]
        self.left, self.right = left, right
        merged = np.flatnonzero(left != np.arange(size))
        self.pairs = HashMap(self._pair(left[merged], right[merged]), merged)
        # every way to put a token together from two
        joins = np.array([(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks], np.int64).reshape(-1, 3)
        self.joins = HashMap(self._pair(joins[:, 0], joins[:, 1]), joins[:, 2])
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a.astype(_U) << _U(32) | b.astype(_U))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b may be neighbours: the last merges are undone, latest first, down to the border, and
        at no time may the two that meet there have a merge that would have come before what was undone."""
        a, b = a.copy(), b.copy()
        ok, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 60)
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            joined = self.pairs.get(self._pair(x, y))
            bad = (joined >= 0) & (joined < most)
            ok[live[bad]] = False
            # undo the later of the two merges; a token without one ends its side
            rx, ry = self.right[x], self.left[y]
            can_x, can_y = rx != x, ry != y
            take_x = can_x & ((x > y) | ~can_y)
            take_y = can_y & ~take_x
            a[live], b[live] = np.where(take_x, rx, x), np.where(take_y, ry, y)
            # at equal ranks the merge further left comes first
            limit[live] = np.where(take_x, x, np.where(take_y, y + 1, most))
            live = live[~bad & (take_x | take_y)]
        return ok

    def longest(self, hashed: Hashed, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each byte and ends by ``stop``, and its length."""
        n = len(stop)
        token, length = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, k = np.arange(n), 0
        while len(at):
            k += 1
            at = at[at + k <= stop[at]]
            got = self.prefixes.get(hashed.of(at, at + k))
            known = got >= 0
            at, got = at[known], got[known]
            whole = got < self.size
            token[at[whole]], length[at[whole]] = got[whole], k
        return token, length

    def merge_all(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words (``data`` holds one after the other): in each round, every word's first pair of
        lowest rank. Gives the tokens of all words and how many each has."""
        n, none = len(sizes), 1 << 60
        token, word = self.of_byte[data], np.repeat(np.arange(n), sizes)
        done_token, done_word = [], []
        rank = np.full(len(token), none)
        stale = np.arange(len(token))
        while len(token):
            stale = stale[stale + 1 < len(token)]
            got = self.joins.get(self._pair(token[stale], token[stale + 1]))
            rank[stale] = np.where((got >= 0) & (word[stale] == word[stale + 1]), got, none)
            rank[-1] = none
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, start)
            over = np.repeat(least == none, np.diff(np.append(start, len(token))))
            if over.any():
                done_token.append(token[over])
                done_word.append(word[over])
            at = np.flatnonzero((rank == np.repeat(least, np.diff(np.append(start, len(token))))) & ~over)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])] if len(at) else at
            token[at] = rank[at]
            keep = ~over
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            token, word, rank = token[keep], word[keep], rank[keep]
            here = place[at]
            stale = np.concatenate([here, here[here > 0] - 1])
        if not done_token:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        token, word = np.concatenate(done_token), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=n)

    def exact(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge_all``; the few words longer than LONG_WORD are merged by a heap, one by one."""
        tokens, count = self.merge_all(data[np.repeat(sizes <= LONG_WORD, sizes)], sizes[sizes <= LONG_WORD])
        long = np.flatnonzero(sizes > LONG_WORD)
        if not len(long):
            return tokens, count
        start = np.cumsum(sizes) - sizes
        many = np.zeros(len(sizes), np.int64)
        many[sizes <= LONG_WORD] = count
        merged = [[self.ranks[t] for t in merge_exactly(data[start[w] : start[w] + sizes[w]].tobytes(), self.ranks)] for w in long]
        many[long] = [len(m) for m in merged]
        out, at = np.empty(many.sum(), np.int64), np.cumsum(many) - many
        short = np.repeat(sizes <= LONG_WORD, many)
        out[short] = tokens
        for w, m in zip(long, merged, strict=True):
            out[at[w] : at[w] + len(m)] = m
        return out, many

    def encode_words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of all words data[cuts[i]:cuts[i+1]], where those of each word begin, and how many words had to be merged."""
        n_words = len(cuts) - 1
        if not n_words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64), 0
        stop = np.repeat(cuts[1:], np.diff(cuts))
        token, length = self.longest(Hashed(data), stop)
        at, live = cuts[:-1].copy(), np.arange(n_words)
        took_word, took_token = [], []
        while len(live):
            p = at[live]
            took_word.append(live)
            took_token.append(token[p])
            at[live] = p + length[p]
            live = live[at[live] < cuts[live + 1]]
        owner, proposed = np.concatenate(took_word), np.concatenate(took_token)
        order = np.argsort(owner, kind="stable")
        owner, proposed = owner[order], proposed[order]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(proposed[inner] << 32 | proposed[inner + 1], return_inverse=True)
        bad_pair = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failing = np.unique(owner[inner[bad_pair]])
        count = np.bincount(owner, minlength=n_words)
        if len(failing):
            sizes = np.diff(cuts)[failing]
            merged, many = self.exact(data[_ranges(cuts[failing], sizes)], sizes)
            fails = np.zeros(n_words, bool)
            fails[failing] = True
            keep = ~fails[owner]
            count[failing] = many
            starts = np.concatenate([[0], np.cumsum(count)])
            out = np.empty(starts[-1], np.int64)
            first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_words))])
            out[(starts[owner] + np.arange(len(owner)) - first[owner])[keep]] = proposed[keep]
            out[_ranges(starts[failing], many)] = merged
            return out, starts, len(failing)
        return proposed, np.concatenate([[0], np.cumsum(count)]), 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in order, and where those of each text begin."""
        data, offsets = utf8(texts)
        cuts = words_of(data, offsets)
        if len(cuts) < 2:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        start, end = cuts[:-1], cuts[1:]
        _, first, back = np.unique(Hashed(data).of(start, end), return_index=True, return_inverse=True)
        size = (end - start)[first]
        own = data[_ranges(start[first], size)]
        tokens, at, _ = self.encode_words(own, np.concatenate([[0], np.cumsum(size)]))
        many = np.diff(at)[back]
        out = tokens[_ranges(at[:-1][back], many)]
        return out, np.concatenate([[0], np.cumsum(many)])[np.searchsorted(start, offsets)]

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        return self.bytes[_ranges(self.starts[tokens], self.width[tokens])]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then as many from starts[1], and so on."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(before[-1]) + np.repeat(starts - before[:-1], sizes)


def _vocabulary(raw: bytes) -> Vocabulary:
    key = hash(raw)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(raw)
    return _vocabularies[key]


def broadcast_vocabulary(spark: SparkSession, path: str = VOCABULARY_PATH):
    """The rank file, read by the driver: executors need not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(vocabulary: Vocabulary, texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, pa.Array, pa.Array]]:
    """(from, to, token lists, counts, whether they decode to the text) of slices of texts."""
    for lo, hi in text_slices(texts, SLICE_BYTES):
        part = texts.slice(lo, hi - lo)
        tokens, at = vocabulary.encode(part)
        data, offsets = utf8(part)
        back = vocabulary.decode(tokens)
        ends = np.concatenate([[0], np.cumsum(vocabulary.width[tokens])])[at]
        same = np.array_equal(back, data) and np.array_equal(ends, offsets)
        right = np.full(hi - lo, True) if same else np.array([back[ends[i] : ends[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(hi - lo)])
        null = np.asarray(part.is_null())
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(null, False)), pa.array(tokens.astype(np.int32)))
        yield lo, hi, lists, pa.array(np.diff(at), pa.int64(), mask=null), pa.array(right, pa.bool_(), mask=null)


def encode(df: DataFrame, path: str = VOCABULARY_PATH, text_col: str = "text") -> DataFrame:
    """doc_id, token_ids, n_tokens, and round_trip: whether the decoded tokens are the text, byte for byte."""
    return with_tokens(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), path, "text", True).drop("text")


def with_tokens(df: DataFrame, path: str = VOCABULARY_PATH, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """The rows of ``df`` with token_ids, n_tokens and round_trip; no shuffle."""
    spark = df.sparkSession
    workers_see_package(spark)
    shared = broadcast_vocabulary(spark, path)
    names = [free_name(df.columns, x) for x in ("token_ids", "n_tokens", "round_trip")]
    at = df.columns.index(text_col)
    kept = [i for i in range(len(df.columns)) if not (drop_text and i == at)]
    schema = T.StructType([df.schema.fields[i] for i in kept])
    schema = with_columns(schema, **dict(zip(names, (T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for b in batches:
            for lo, hi, lists, counts, right in _encoded(vocabulary, string_array(b.column(at))):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), lists, counts, right], names=schema.names)

    return in_arrow(df, run, schema)


def decode(df: DataFrame, path: str = VOCABULARY_PATH, tokens_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with the decoded text; null tokens give a null text, and bytes that are no UTF-8 U+FFFD."""
    spark = df.sparkSession
    workers_see_package(spark)
    shared = broadcast_vocabulary(spark, path)
    at, name = df.columns.index(tokens_col), free_name(df.columns, text_col)
    schema = with_columns(df.schema, **{name: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for b in batches:
            lists = b.column(at)
            tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            raw = vocabulary.decode(tokens).tobytes()
            ends = np.concatenate([[0], np.cumsum(vocabulary.width[tokens])])[np.concatenate([[0], np.cumsum(sizes)])]
            null = np.asarray(lists.is_null())
            texts = [None if null[i] else raw[ends[i] : ends[i + 1]].decode("utf-8", "replace") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    import pyarrow.compute  # noqa: F401  (pa.compute in the workers)

    return in_arrow(df, run, schema)
