"""Near-duplicate removal by order MinHash and banded alignment.

A text is its sequence of words in lower case. Its k-mers (K words) are labelled by occurrence: the second "of the" is
another element than the first. For each of SKETCHES seeded hashes, the PICKED labelled k-mers of least hash are taken and
put into the order in which they stand in the text; a hash of that sequence is one key. Two texts agree in a key with a
probability that falls with their edit distance, also where the same k-mers stand in another order.

Equal word sequences are one node. Of the nodes under one key, the least is the hub, and each other one is a candidate for
it; as nodes are hashes, it is mostly the same hub for the same group of copies, so a group of n yields about n candidates
and not n squared. Keys whose nodes are not all connected by that are open, and what is left of them is compared exactly:

* under a key of at most SMALL nodes, all pairs of different components and fitting lengths are candidates, which is less
  than SMALL for each (key, node);
* under a larger one, two nodes meet only if they also share a word among their rarest: if two texts of at most n words are
  near, they share so many (occurrence-labelled) words that the first floor((1 - SIMILARITY) * n) + 1 words of each, in order
  of ascending number of texts that hold them, have one in common. So a passage that very many texts share brings none of
  them together, unless it is all that they hold. Groups that are still large are compared in blocks of BLOCK nodes.

So any two near nodes that share a key are aligned or connected in the end. Candidates are aligned word by word in a band of
(1 - SIMILARITY) times the longer length, which is exact for all pairs that reach SIMILARITY; what is connected already and
what lengths or the number of shared words rule out is not aligned. Connected components of the verified pairs are the
groups, and the row of least doc_id stays in each.

Short texts have keys of single words too, since few of their k-mers survive a change: SHORT_SKETCHES of them up to SHORT
words, and ever fewer up to twice that.

Nothing unbounded is collected. Sides of joins are broadcast, and edges are sent to the driver, only when their counted size
allows it; beyond, the same rows come out of shuffles.

Defined cases: a null text is no duplicate of anything; texts without words are duplicates only if they are equal strings;
rows of one text are duplicates of each other whatever their ids, and exactly one of them stays, of repeated rows too; null
ids come last in the order of ids; ties go to the lesser id, then to any of the rows that are equal in id and text; an empty
table gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, checked_broadcast, column, columns, free_name, in_arrow, materialise, scratch, string_array, text_slices, with_columns, workers_see_package
from .tokens import mix, word_hashes

K = 2
PICKED = 3
SKETCHES = 48
#: Edit similarity, 1 - distance / longer length in words, from which texts are near duplicates.
SIMILARITY = 0.75
SHORT = 24
#: Candidates of one hub that one task aligns.
HUB_ROWS = 4096
#: Nodes under an open key of which all pairs are candidates, and nodes in a block of a larger group.
SMALL = 64
BLOCK = 1024
SHORT_SKETCHES = 16
SHORT_PICKED = 2

_U = np.uint64
#: Bits of a position in a text, at least; as many as it takes where a text is longer.
_POSITION_BITS = 24
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 2 * (SKETCHES + SHORT_SKETCHES), dtype=np.uint64) | _U(1)


def labelled_kmers(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of each text (texts[i] is words[at[i]:at[i+1]]), and the offsets of each.

    A text of fewer than k words has one k-mer for each of its words.
    """
    n = len(at) - 1
    size = np.diff(at)
    width = np.minimum(k, np.maximum(size, 1))
    many = np.where(size == 0, 0, size - width + 1)
    starts = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(n), many)
    first = np.arange(starts[-1]) - starts[owner] + at[owner]
    h = words[first].copy()
    for d in range(1, k):
        more = d < width[owner]
        h[more] = h[more] * _U(0xD6E8FEB86659FD93) + words[first[more] + d]
    h = mix(h)
    # the rank of each among the equal ones of its text, in text order
    key = h ^ mix(owner.astype(_U) + _U(0x51ED27))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    group = np.flatnonzero(fresh)
    rank = np.arange(len(key)) - np.repeat(group, np.diff(np.append(group, len(key))))
    label = np.empty(len(key), _U)
    label[order] = rank.astype(_U)
    return mix(h + label * _U(0x9E3779B97F4A7C15)), starts


def sketch(words: np.ndarray, at: np.ndarray, k: int, picked: int, seeds: np.ndarray) -> np.ndarray:
    """(texts, seeds) of keys; texts without words have zeros."""
    element, starts = labelled_kmers(words, at, k)
    n = len(at) - 1
    out = np.zeros((n, len(seeds)), _U)
    full = np.flatnonzero(np.diff(starts) > 0)
    if not len(full):
        return out
    begin = starts[:-1][full]
    bits = max(_POSITION_BITS, int(np.diff(starts).max() + 1).bit_length())
    local = (np.arange(len(element)) - np.repeat(begin, np.diff(starts)[full])).astype(_U)
    low = _U((1 << bits) - 1)
    high, most = ~low, _U(2**64 - 1)
    value = np.empty(len(element), _U)
    place = np.empty((picked, len(full)), _U)
    rows = np.arange(len(full))
    for s, seed in enumerate(seeds):
        np.multiply(element, seed, out=value)
        value &= high
        value |= local
        for p in range(picked):
            least = np.minimum.reduceat(value, begin)
            place[p] = least & low
            gone = least == most
            place[p][gone] = low
            if p + 1 < picked:
                value[np.where(gone, begin, begin + (least & low).astype(np.int64))] = most
        order = np.sort(place, axis=0)
        key = np.full(len(full), seed, _U)
        for p in range(picked):
            real = order[p] != low
            step = element[np.where(real, begin + (order[p] & low).astype(np.int64), begin)]
            key = np.where(real, mix(key * _U(0xD6E8FEB86659FD93) + step), key)
        out[full[rows], s] = key
    return out


def nodes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, words, offsets of words): the node is a hash of the word sequence, or of the string where it has no word."""
    words, at = word_hashes(texts)
    n = len(at) - 1
    size = np.diff(at)
    # a polynomial over the words of each text, off one pass; the multiplier's powers restart with each text
    owner = np.repeat(np.arange(n), size)
    place = (np.arange(len(words)) - at[owner]).astype(_U)
    node = np.zeros(n, _U)
    if len(words):
        some = np.flatnonzero(size > 0)
        node[some] = np.add.reduceat(mix(words + mix(place + _U(1))), at[:-1][some])
    node = mix(node + size.astype(_U))
    for i in np.flatnonzero(size == 0):
        raw = texts[i].as_py()
        if raw:
            import xxhash

            node[i] = xxhash.xxh64_intdigest(raw.encode(), 5)
    return node, words, at


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Levenshtein distance of two sequences if it is at most ``most``, else ``most`` + 1.

    Only a band of ``most`` cells to either side of the diagonal is filled, a column at a time, as bit vectors of the
    differences between neighbouring cells that slide down along the diagonal.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > most:
        return most + 1
    same = np.flatnonzero(a != b[:m])
    lead = int(same[0]) if len(same) else m
    a, b = a[lead:], b[lead:]
    m, n = m - lead, n - lead
    if m:
        same = np.flatnonzero(a[::-1] != b[n - m :][::-1])
        tail = int(same[0]) if len(same) else m
        a, b = a[: m - tail], b[: n - tail]
        m, n = m - tail, n - tail
    if not m:
        return n if n <= most else most + 1
    most = min(most, n)
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    # row r of the band in column j is row j - most + r of the table; rows 0 .. 2 * most
    width = 2 * most + 1
    ones = (1 << width) - 1
    # above the first row, the table goes on with the distances that an alignment from there would have
    vp, vn = ones & ~((1 << most) - 1), 0
    distance, bottom = min(m, most), 1 << (width - 1)
    column = 0
    for y in b.tolist():
        column += 1
        eq = where.get(y, 0)
        shift = column - 1 - most
        eq = (eq >> shift if shift >= 0 else eq << -shift) & ones
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & ones
        hp = vn | (ones & ~(d0 | vp))
        hn = d0 & vp
        row = column + most  # of the table, at the bottom of the band
        if row <= m:
            distance += not d0 & bottom
        else:
            bit = 1 << (width - 1 - (row - m))
            distance += bool(hp & bit) - bool(hn & bit)
        half = d0 >> 1
        vp = (hn | ~(half | hp)) & ones
        vn = half & hp
    return distance if distance <= most else most + 1


def shared_words(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two multisets, each as sorted distinct words and their counts."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())


def similarity(a: np.ndarray, b: np.ndarray, least: float, counted: tuple[np.ndarray, np.ndarray] | None = None) -> float | None:
    """Edit similarity of two word sequences if it reaches ``least``; ``counted`` has the distinct words of ``a``, if known."""
    longer = max(len(a), len(b))
    if not min(len(a), len(b)):
        return None
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return None
    # each edit takes one word off the shared ones
    if longer - shared_words(counted or np.unique(a, return_counts=True), np.unique(b, return_counts=True)) > most:
        return None
    # a narrow band does for most; each wider one is four times the work
    band = min(most, 32)
    while (d := edit_distance(a, b, band)) > band:
        if band == most:
            return None
        band = min(most, 4 * band)
    return 1 - d / longer


def _signatures(df: DataFrame) -> DataFrame:
    """(doc_id, node, n_words, keys) of all rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = string_array(b.column(1))
            for lo, hi in text_slices(texts):
                node, words, at = nodes_of(texts.slice(lo, hi - lo))
                size = np.diff(at)
                # copies within a slice are sketched once
                _, first, back = np.unique(node, return_index=True, return_inverse=True)
                keys = _keys(words, at, first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(node.view(np.int64)), pa.array(size.astype(np.int64)), keys.take(pa.array(back))],
                    names=["doc_id", "node", "n_words", "keys"],
                )

    schema = with_columns(T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType)]), node=T.LongType(), n_words=T.LongType(), keys=T.ArrayType(T.LongType()))
    return df.select("doc_id", "text").where("text is not null").mapInArrow(run, schema)


def _keys(words: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> pa.ListArray:
    size = np.diff(at)[chosen]
    own_at = np.concatenate([[0], np.cumsum(size)])
    own = words[np.arange(own_at[-1]) + np.repeat(at[:-1][chosen] - own_at[:-1], size)]
    long = sketch(own, own_at, K, PICKED, _SEEDS[:SKETCHES])
    more = np.where(size > 0, np.clip((2 * SHORT - size) * SHORT_SKETCHES // SHORT, 0, SHORT_SKETCHES), 0)
    brief = np.flatnonzero(more)
    brief_at = np.concatenate([[0], np.cumsum(size[brief])])
    brief_words = own[np.arange(brief_at[-1]) + np.repeat(own_at[:-1][brief] - brief_at[:-1], size[brief])]
    short = sketch(brief_words, brief_at, 1, SHORT_PICKED, _SEEDS[SKETCHES : SKETCHES + SHORT_SKETCHES])
    starts = np.concatenate([[0], np.cumsum(np.where(size == 0, 0, SKETCHES) + more)])
    flat = np.empty(starts[-1], _U)
    some = np.flatnonzero(size > 0)
    flat[starts[:-1][some][:, None] + np.arange(SKETCHES)] = long[some]
    used = np.arange(SHORT_SKETCHES) < more[brief][:, None]
    flat[(starts[:-1][brief][:, None] + SKETCHES + np.arange(SHORT_SKETCHES))[used]] = short[used]
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat.view(np.int64)))


def holders(signatures: DataFrame) -> DataFrame:
    """(key, node, n_words, hub) of all keys that several nodes share; the hub is the least of them.

    Keys are summed in each task before they are shuffled, so a key that a third of all rows have is no row more than others.
    """
    rows = signatures.select("node", "n_words", F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    hubs = materialise(hubs, "hubs")
    return rows.join(checked_broadcast(hubs, hubs.count(), 16), "key").groupBy("key", "node").agg(F.min("n_words").alias("n_words"), F.min("hub").alias("hub"))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("hub", "node")).alias("node")).distinct()


def words_of(wanted: DataFrame, df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(node, words) of the nodes in ``wanted``, read off the texts again, once for each node."""
    spark = df.sparkSession
    wanted = materialise(wanted, "wanted")
    n = wanted.count()
    few = n * 8 <= limit
    chosen = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column("node").to_numpy()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = string_array(b.column(0))
            for lo, hi in text_slices(texts):
                node, words, at = nodes_of(texts.slice(lo, hi - lo))
                node = node.view(np.int64)
                first = np.unique(node, return_index=True)[1]
                if chosen.value is not None:
                    at_chosen = np.minimum(np.searchsorted(chosen.value, node[first]), max(len(chosen.value) - 1, 0))
                    first = first[chosen.value[at_chosen] == node[first]] if len(chosen.value) else first[:0]
                size = np.diff(at)[first]
                own_at = np.concatenate([[0], np.cumsum(size)])
                # 32 bits tell the words of two texts apart
                own = (words[np.arange(own_at[-1]) + np.repeat(at[:-1][first] - own_at[:-1], size)] >> _U(32)).astype(np.uint32)
                blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((own_at * 4).astype(np.int32)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([pa.array(node[first]), blob], names=["node", "words"])

    words = df.select("text").where("text is not null").mapInArrow(run, "node bigint, words binary")
    if not few:
        words = words.join(wanted, "node", "left_semi")
    return words.groupBy("node").agg(F.any_value("words").alias("words"))


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(hub, node) of the candidates that an alignment bears out.

    Words move to their hub, which comes first; a task holds one hub and one other node. Hubs of many candidates are sent to
    several tasks.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("parts"))
    members = pairs.join(parts, "hub").select("node", "hub", F.pmod("node", "parts").cast("int").alias("part"))
    hubs = parts.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    moves = checked_broadcast(members.unionByName(hubs), 2 * pairs.count(), 24)
    met = words.join(moves, "node").repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node") != F.col("hub"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = counted = None
        for b in batches:
            nodes, owners = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep = []
            for i in range(b.num_rows):
                own = np.frombuffer(b.column(2)[i].as_buffer(), np.uint32)
                if nodes[i] == owners[i]:
                    hub = own.copy()
                    counted = np.unique(hub, return_counts=True)
                elif similarity(hub, own, least, counted) is not None:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(owners[keep]), pa.array(nodes[keep])], names=["hub", "node"])

    return met.select("node", "hub", "words").mapInArrow(align, "hub bigint, node bigint")


def connected(shared: DataFrame, df: DataFrame, least: float) -> DataFrame:
    """(node, component) over all pairs of nodes that share a key and that an alignment bears out."""
    words = materialise(words_of(shared.select("node").distinct(), df), "words")
    star = shared.where("hub <> node").select("hub", "node").distinct()
    edges, found = linked(materialise(star, "candidates"), None, None, words, least)
    return linked(materialise(left_open(shared, found, words, least), "candidates"), edges, found, words, least)[1]


def linked(pairs: DataFrame, edges: DataFrame | None, found: DataFrame | None, words: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``edges`` with all it takes of the candidates ``pairs`` to connect what they do, and their components; ``found`` has those so far.

    First every node meets the least of its hubs. What that has connected needs no further proof, so of the other candidates
    only those between different components are aligned; the components come out as if all had been.
    """
    first = pairs.groupBy("node").agg(F.min("hub").alias("hub")).select("hub", "node")
    for part in (first, pairs.join(first, ["hub", "node"], "left_anti")):
        if found is not None:
            part = _apart(part, found)
        more = materialise(verified(materialise(part, "met"), words, least), "verified")
        edges = more if edges is None else edges.unionByName(more)
        found = components(edges)
    return edges, found


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The ``pairs`` between different components; a node that is not in ``found`` is its own."""
    a, b = found.select(F.col("node").alias("hub"), F.col("component").alias("a")), found.select("node", F.col("component").alias("b"))
    met = pairs.join(a, "hub", "left").join(b, "node", "left")
    return met.where(F.coalesce("a", "hub") != F.coalesce("b", "node")).select("hub", "node")


def left_open(shared: DataFrame, found: DataFrame, words: DataFrame, least: float, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(hub, node), the candidates of different components under all keys that hold several; see above."""
    now = shared.join(found, "node", "left").select("key", "node", "n_words", F.coalesce("component", "node").alias("component"))
    summed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high").select("key", "m")
    left = materialise(now.join(summed, "key"), "open")
    few = left.where(F.col("m") <= small).select(F.col("key").alias("g"), "node", "n_words", "component")
    many = left.where(F.col("m") > small)
    if many.isEmpty():
        return _compared(few.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)), few.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)), least).distinct()
    rare = rarest(words.join(many.select("node").distinct(), "node", "left_semi"), least)
    split = many.join(rare, "node").select(F.xxhash64("key", "token").alias("g"), "node", "n_words", "component")
    rows = materialise(few.unionByName(split), "compared")
    sizes = rows.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("low <> high").select("g", "blocks")
    placed = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _compared(placed.withColumn("i", F.col("own")).withColumn("j", F.col("other")), placed.withColumn("i", F.col("other")).withColumn("j", F.col("own")), least).distinct()


def _compared(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(hub, node) with hub < node of the rows that share g, i and j, have different components and lengths that allow it."""
    side = [left.select("g", "i", "j", F.col("node").alias("hub"), F.col("n_words").alias("m"), F.col("component").alias("c")), right.select("g", "i", "j", "node", "n_words", "component")]
    near = F.abs(F.col("m") - F.col("n_words")) <= F.floor((1 - least) * F.greatest("m", "n_words") + 1e-9)
    return side[0].join(side[1], ["g", "i", "j"]).where((F.col("hub") < F.col("node")) & (F.col("c") != F.col("component")) & near).select("hub", "node")


def rarest(words: DataFrame, least: float) -> DataFrame:
    """(node, token), for each node of ``words`` its rarest occurrence-labelled words, as many as a near one must share one of.

    Words that no other node has are left out, but keep their places.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = np.frombuffer(b.column(1)[i].as_buffer(), np.uint32).astype(_U)
                tokens = labelled_kmers(own, np.array([0, len(own)]), 1)[0]
                for lo in range(0, len(tokens), 100_000):
                    part = tokens[lo : lo + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b.column(0)[i].as_py())), pa.array(np.full(len(part), len(own))), pa.array(part)], names=["node", "n", "token"])

    tokens = words.select("node", "words").mapInArrow(label, "node bigint, n bigint, token bigint")
    known = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = tokens.join(known, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    first = F.floor((1 - least) * F.col("n") + 1e-9) + 1 - (F.col("n") - F.size("t"))
    return kept.select("node", F.explode(F.slice("t", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select("node", F.col("x.token").alias("token"))


def components(edges: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (hub, node); the component is its least node.

    Edges of a counted size up to ``limit`` are put together in the driver. For more, every round takes the least label among
    the neighbours, then the label of the label, until nothing changes; each is written, so that lineage stays short and lost
    executors cost one round.
    """
    if edges.count() * 16 <= limit:
        return _few_components(edges)
    both = materialise(edges.select("hub", "node").unionAll(edges.select(F.col("node").alias("hub"), F.col("hub").alias("node"))).distinct(), "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("hub"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "hub"), "hub").groupBy("node").agg(F.min("component").alias("near"))
        one = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = materialise(one.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        if labels.where("old <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def _few_components(edges: DataFrame) -> DataFrame:
    got = edges.select("hub", "node").toArrow()
    ends_ = np.concatenate([got.column(x).to_numpy() for x in ("hub", "node")]).astype(np.int64)
    names, at = np.unique(ends_, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        # roots take the least root that an edge leads to; then all go to their root
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    return materialise(edges.sparkSession.createDataFrame(pa.table({"node": names, "component": names[label]}), "node bigint, component bigint"), "labels")


def groups(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, component, kept_id, kept_node) of the rows in groups of more than one.

    kept_node and kept_id name the row that stays: the one of least doc_id, nulls last, then of least node.
    """
    workers_see_package(df.sparkSession)
    with scratch(df.sparkSession):
        signatures = materialise(_signatures(df), "signatures")
        shared = materialise(holders(signatures), "holders")
        found = signatures.select("doc_id", "node").join(connected(shared, df, least), "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node"))
        summed = found.groupBy("component").agg(first.alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
        out = found.join(summed, "component").select("doc_id", "node", "component", F.col("kept.doc_id").alias("kept_id"), F.col("kept.node").alias("kept_node"), "n")
        return materialise(out, "groups", lasting=True)


def near_duplicates(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, duplicate_of (the doc_id that stays) and group_size for every row that goes.

    Of rows that equal the one that stays in id and text, all but one go.
    """
    found = groups(df, least)
    kept = (F.col("doc_id").eqNullSafe(F.col("kept_id"))) & (F.col("node") == F.col("kept_node"))
    alike = found.groupBy("doc_id", "node", "kept_id", "kept_node", "component", "n").agg(F.count(F.lit(1)).alias("copies"))
    gone = F.when(kept, F.col("copies") - 1).otherwise(F.col("copies")).cast("int")
    return alike.select("doc_id", F.col("kept_id").alias("duplicate_of"), F.col("n").alias("group_size"), F.explode(F.array_repeat(F.lit(0), gone)).alias("_")).drop("_")


def keep_one(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stay, as they are."""
    found = groups(df, least)
    nodes = found.groupBy("node").agg(
        F.max(F.struct("kept_id", "kept_node")).alias("kept"), F.sum((F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node"))).cast("int")).alias("same")
    )
    names = df.columns
    node, kept_id, stays, same = (free_name(names, x) for x in ("node", "kept_id", "stays", "same"))
    fate = nodes.select(F.col("node").alias(node), F.col("kept.kept_id").alias(kept_id), (F.col("kept.kept_node") == F.col("node")).alias(stays), F.col("same").alias(same))
    fate = materialise(fate, "fate", lasting=True)
    fate = checked_broadcast(fate, fate.count(), 32)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = string_array(b.column(at))
            for lo, hi in text_slices(texts):
                part = texts.slice(lo, hi - lo)
                ids = pa.array(nodes_of(part)[0].view(np.int64), mask=np.asarray(part.is_null()))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, ids], names=[*names, node])

    marked = in_arrow(df, run, with_columns(df.schema, **{node: T.LongType()}))
    rest = marked.join(fate, node, "left").where(column(stays).isNull() | (column(stays) & F.col("doc_id").eqNullSafe(column(kept_id))))
    once = rest.where(F.coalesce(column(same), F.lit(1)) <= 1)
    more = rest.where(column(same) > 1).dropDuplicates([node])
    return once.select(columns(names)).unionAll(more.select(columns(names)))


__all__ = ["components", "edit_distance", "groups", "keep_one", "near_duplicates", "similarity", "sketch"]
