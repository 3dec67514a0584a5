"""Language identification by character language models.

One interpolated Kneser-Ney model of order 4 for each language, counted over all labelled documents: absolute counts at the
highest order, continuation counts (in how many contexts a gram occurs) below, one discount an order, and a uniform floor
over all code units. A gram is hashed to 64 bits without collision, as four UTF-16 units side by side, and each order is a
sorted array of hashes with arrays of values beside it, searched by bisection, and grams that a language has seen have their
interpolated log-probability beside them; others back off order by order.

Every language is trained by one task, from all grams of its documents, and its arrays are written to the shared folder;
scoring maps them into memory. So nothing of the model passes through the driver, and no gram is left out at any size.

A text goes to the language of lowest cross-entropy per character. It is rejected if that is too far above what texts of
the language show: the excess is scaled by its expected deviation, whose variance is one between texts (LEAST_BETWEEN
squared at least, so that a long text may hold a foreign passage) plus one that falls with the length. Both are taken, with
the limit, from all labelled documents that get their own label: these fall into FOLDS parts, copies of a text into the same
one, and each part is scored by models trained on the others. Medians and percentiles are those of all these scores, found by
counts in ever narrower buckets, so the scores stay on the executors. The limit is twice the 99.9th percentile of those within
LEAST_LIMIT deviations, and that at least, so junk that carries a label cannot raise it beyond 2 * LEAST_LIMIT. It is rejected,
too, if it has too little evidence: if the next language explains the whole text in less than LEAST_MARGIN bits more.

Texts are read whole: lower case, digits as one sign, all else that is no letter as single spaces.

Defined cases: a null text, an empty one and one without letters or digits have no evidence and are rejected; null labels
do not train; repeated rows count as often as they occur; equal entropies go to the first language in order of name; without
any labelled text all is rejected; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import application_dir, column, files, free_name, in_arrow, materialise, scratch, string_array, text_slices, workers_see_package
from .tokens import utf8

ORDER = 4
#: Parts of the labelled documents, each scored by models of the others to set the deviations and the limit.
FOLDS = 5
#: Least limit, in robust deviations.
LEAST_LIMIT = 12.0
#: Least deviation, in bits per unit, between texts of one language: subjects, names and quotations make as much.
LEAST_BETWEEN = 0.05
#: Bits, over the whole text, by which the language found must beat the next one.
LEAST_MARGIN = 2.0
VOCABULARY = 1 << 16

_U = np.uint64
_NORM = np.arange(1 << 16, dtype=np.uint16)
for _c in range(256):
    _ch = chr(_c)
    if _ch.isdigit():
        _NORM[_c] = ord("0")
    elif not _ch.isalnum():
        _NORM[_c] = 32
_NORM[0x2000:0x2070] = 32
_NORM[0x3000:0x3004] = 32


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised UTF-16 units of all texts, each behind ORDER - 1 zeros, and the offset of each text's first own unit."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(offsets) - 1
    raw = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-16-le", "surrogatepass"), np.uint16)
    width = ((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0)
    at = np.concatenate([[0], np.cumsum(width)])[offsets]
    u = _NORM[raw]
    space = u == 32
    before = np.ones(len(u) + 1, bool)
    before[1:] = space
    before[at] = True
    keep = ~(space & before[:-1])
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    u = u[keep]
    pad = ORDER - 1
    out = np.zeros(len(u) + pad * n, np.uint16)
    owner = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(len(u)) + pad * (owner + 1)] = u
    return out, at + pad * np.arange(1, n + 2)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the gram that ends at each unit, and the number of the text it belongs to."""
    u, at = units(texts)
    x = u.astype(_U)
    if len(x) < ORDER:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    key = x[3:] | x[2:-1] << _U(16) | x[1:-2] << _U(32) | x[:-3] << _U(48)
    n = len(at) - 1
    own = np.diff(at) - (ORDER - 1)
    owner = np.repeat(np.arange(n), own)
    place = np.arange(len(owner)) + np.repeat((ORDER - 1) * np.arange(n), own)
    return key[place], owner


@dataclass
class Order:
    """Sorted hashes of grams with their discounted shares, and of contexts with the weight of what lies below."""

    keys: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def make_order(keys: np.ndarray, counts: np.ndarray) -> Order:
    """Absolute discounting by n1 / (n1 + 2 n2) of sorted grams, each context (all but the last unit) on its own."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    contexts, at, kinds = np.unique(keys >> _U(16), return_inverse=True, return_counts=True)
    total = np.bincount(at, counts, len(contexts))
    return Order(keys, np.maximum(counts - discount, 0) / total[at], contexts, discount * kinds / total)


@dataclass
class Model:
    """Interpolated Kneser-Ney over grams of ORDER units."""

    orders: list[Order]  # from 1 to ORDER

    def probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / VOCABULARY)
        for n, o in enumerate(self.orders, 1):
            own = keys & _U((1 << 16 * n) - 1)
            at, hit = _find(o.keys, own)
            share = np.where(hit, o.share[at], 0.0) if len(o.keys) else 0.0
            at, hit = _find(o.contexts, own >> _U(16))
            p = share + (np.where(hit, o.weight[at], 1.0) if len(o.contexts) else 1.0) * p
        return p


def train(keys: np.ndarray, counts: np.ndarray) -> Model:
    """From sorted distinct grams and how often each occurs."""
    orders = [make_order(keys, counts.astype(float))]
    for n in range(ORDER - 1, 0, -1):
        # keys are distinct: each suffix counts once for every unit before it
        keys, counts = np.unique(keys & _U((1 << 16 * n) - 1), return_counts=True)
        orders.insert(0, make_order(keys, counts.astype(float)))
    return Model(orders)


_ARRAYS = (("keys", _U), ("share", np.float64), ("contexts", _U), ("weight", np.float64))


def save(model: Model, folder: str) -> None:
    """All arrays in one file behind their lengths, since a worker has the models of all folds open."""
    system, path = files(folder)
    system.create_dir(path, recursive=True)
    logs = np.log2(model.probability(model.orders[-1].keys)).astype(np.float32)
    arrays = [np.ascontiguousarray(getattr(o, name), kind) for o in model.orders for name, kind in _ARRAYS] + [logs]
    with system.open_output_stream(f"{path}/model") as f:
        for array in (np.array([len(x) for x in arrays], np.int64), *arrays):
            f.write(array.tobytes())


def load(folder: str) -> tuple[Model, np.ndarray]:
    """The model and the log-probabilities of its grams of highest order; each worker opens a folder once."""
    if folder not in _opened:
        if len(_opened) > 256:
            _opened.clear()
        system, path = files(folder)
        if system.type_name == "local":
            data = np.memmap(f"{path}/model", np.uint8, "r")
        else:
            with system.open_input_file(f"{path}/model") as f:
                data = np.frombuffer(f.read(), np.uint8)
        kinds = [np.dtype(kind) for _, kind in _ARRAYS] * ORDER + [np.dtype(np.float32)]
        at, arrays = 8 * len(kinds), []
        for kind, n in zip(kinds, data[:at].view(np.int64).tolist(), strict=True):
            arrays.append(np.asarray(data[at : at + n * kind.itemsize]).view(kind))
            at += n * kind.itemsize
        _opened[folder] = Model([Order(*arrays[k : k + len(_ARRAYS)]) for k in range(0, ORDER * len(_ARRAYS), len(_ARRAYS))]), arrays[-1]
    return _opened[folder]


_opened: dict[str, tuple[Model, np.ndarray]] = {}


@dataclass
class Identifier:
    """Names of languages and folders of their models, in order of name, and what calibration found."""

    languages: list[str]
    folders: list[str]
    mean: np.ndarray | None = None
    #: (languages, 2): variance of bits per unit between texts, and within them, for one unit.
    variance: np.ndarray | None = None
    limit: float = LEAST_LIMIT

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) of bits per unit, and the units of each text."""
        n = len(texts)
        sums, length = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        for lo, hi in text_slices(texts):
            key, owner = grams(texts.slice(lo, hi - lo))
            length[lo:hi] = np.bincount(owner, minlength=hi - lo)
            kinds, back = np.unique(key, return_inverse=True)
            for k, folder in enumerate(self.folders):
                model, known = load(folder)
                at, hit = _find(model.orders[-1].keys, kinds)
                logs = np.empty(len(kinds))
                logs[hit] = known[at[hit]]
                logs[~hit] = np.log2(model.probability(kinds[~hit]))
                sums[lo:hi, k] = -np.bincount(owner, logs[back], hi - lo)
        return sums / np.maximum(length, 1)[:, None], length

    def excess(self, best: np.ndarray, bits: np.ndarray, length: np.ndarray) -> np.ndarray:
        between, within = self.variance[best].T
        return (bits - self.mean[best]) / np.sqrt(between + within / np.maximum(length, 1))

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1 for rejected), entropy of the best, excess in deviations, units."""
        if not self.languages:
            n = len(texts)
            return np.full(n, -1), np.full(n, np.nan), np.full(n, np.inf), np.zeros(n, np.int64)
        entropy, length = self.entropies(texts)
        best = entropy.argmin(1)
        bits = entropy[np.arange(len(best)), best]
        excess = self.excess(best, bits, length)
        evidence = sure = length > 0
        if len(self.languages) > 1:
            sure = evidence & ((np.partition(entropy, 1, axis=1)[:, 1] - bits) * length >= LEAST_MARGIN)
        return np.where(sure & (excess <= self.limit), best, -1), np.where(evidence, bits, np.nan), np.where(evidence, excess, np.inf), length


def fold_of(text_col: str) -> Column:
    """The part of the labelled documents that a text is in."""
    return F.pmod(F.xxhash64(column(text_col).cast("string")), F.lit(FOLDS)).cast("int")


def count_grams(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(lang, gram, n0, n1, ...) over all labelled texts, a count a fold, summed in each task before the one shuffle."""
    parts = [f"n{f}" for f in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(name: str) -> None:
            keys, at = np.unique(np.concatenate([k for k, _ in found[name]]), return_inverse=True)
            counts = np.concatenate([n for _, n in found[name]])
            found[name] = [(keys, np.stack([np.bincount(at, counts[:, f], len(keys)).astype(np.int64) for f in range(FOLDS)], 1))]

        for b in batches:
            texts, labels, folds = string_array(b.column(0)), string_array(b.column(1)), b.column(2).to_numpy().astype(np.int64)
            for lo, hi in text_slices(texts):
                key, owner = grams(texts.slice(lo, hi - lo))
                code = labels.slice(lo, hi - lo).dictionary_encode()
                which = pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False)[owner]
                fold = folds[lo:hi][owner]
                for k, name in enumerate(code.dictionary.to_pylist()):
                    kinds, at = np.unique(key[which == k], return_inverse=True)
                    found.setdefault(name, []).append((kinds, np.bincount(at * FOLDS + fold[which == k], minlength=len(kinds) * FOLDS).reshape(-1, FOLDS)))
                    if sum(len(x[0]) for x in found[name]) > 2_000_000:
                        merge(name)
        for name in found:
            merge(name)
            keys, counts = found[name][0]
            for lo in range(0, len(keys), 100_000):
                part, n = keys[lo : lo + 100_000], counts[lo : lo + 100_000]
                columns = [pa.array([name] * len(part)), pa.array(part.view(np.int64)), *(pa.array(n[:, f]) for f in range(FOLDS))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", *parts])

    labelled = df.select(column(text_col), column(label_col).cast("string"), fold_of(text_col).alias("fold")).where(column(label_col).isNotNull() & column(text_col).isNotNull())
    schema = "lang string, gram bigint, " + ", ".join(f"{n} bigint" for n in parts)
    return labelled.mapInArrow(run, schema).groupBy("lang", "gram").agg(*(F.sum(n).alias(n) for n in parts))


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", calibration_rows: int | None = None) -> Identifier:
    """Count over all labelled documents, train each language in a task, and calibrate: on all of them too, unless
    ``calibration_rows`` asks for about so many."""
    spark = df.sparkSession
    workers_see_package(spark)
    base = f"{application_dir(spark)}/models-{uuid.uuid4().hex}"

    def one(table: pa.Table) -> pa.Table:
        keys = table.column("gram").to_numpy().view(_U)
        order = np.argsort(keys)
        keys, parts = keys[order], [table.column(f"n{f}").to_numpy()[order] for f in range(FOLDS)]
        counts = np.sum(parts, 0)
        # a task that is tried again writes elsewhere
        folder = f"{base}/{uuid.uuid4().hex}"
        save(train(keys, counts), folder)
        for f, own in enumerate(parts):
            rest = counts - own
            save(train(keys[rest > 0], rest[rest > 0]), f"{folder}-{f}")
        return pa.table({"lang": table.column("lang").slice(0, 1), "folder": [folder]})

    trained = count_grams(df, text_col, label_col).groupBy("lang").applyInArrow(one, "lang string, folder string").orderBy("lang").collect()
    ident = Identifier([r.lang for r in trained], [r.folder for r in trained])
    labelled = df.where(column(text_col).isNotNull() & column(label_col).isNotNull())
    if calibration_rows is not None:
        labelled = labelled.where(F.pmod(F.xxhash64(column(text_col).cast("string")), F.lit(max(labelled.count(), 1))) < calibration_rows)
    return calibrate(ident, labelled, text_col, label_col)


def quantiles(df: DataFrame, q: float) -> dict[int, float]:
    """The quantile of ``v`` in each group ``g``, of all rows, interpolated between neighbours.

    Rows are counted in buckets, then in narrower ones inside the buckets of the ranks that are wanted, then value by value
    inside those.
    """
    inside: dict[tuple[int, int], tuple[float | None, int]] = {}  # (group, rank): its bucket so far, and the rank inside
    between: dict[int, tuple[int, int, float]] = {}
    before = 0
    for scale in (1 << 8, 1 << 20, 0):
        rows = df
        if before:
            if not inside:
                return {}
            held = sorted({(g, bucket) for (g, _), (bucket, _) in inside.items()})
            rows = df.where(reduce(lambda x, y: x | y, ((F.col("g") == g) & (F.floor(F.col("v") * before) == bucket) for g, bucket in held)))
        key = F.floor(F.col("v") * scale) if scale else F.col("v")
        counts: dict[tuple[int, float | None], list[tuple[float, int]]] = {}
        for g, bucket, n in rows.groupBy("g", key.alias("bucket")).count().collect():
            counts.setdefault((g, math.floor(bucket * before / (scale or 1)) if before else None), []).append((bucket, n))
        if not before:
            for g, _ in counts:
                last = sum(n for _, n in counts[g, None]) - 1
                lo = min(math.floor(q * last), last)
                between[g] = lo, min(lo + 1, last), q * last - lo
                inside |= {(g, rank): (None, rank) for rank in between[g][:2]}
        for (g, rank), (bucket, left) in inside.items():
            for own, n in sorted(counts[g, bucket]):
                if left < n:
                    inside[g, rank] = own, left
                    break
                left -= n
        before = scale
    return {g: inside[g, lo][0] + (inside[g, hi][0] - inside[g, lo][0]) * part for g, (lo, hi, part) in between.items()}


def calibrate(ident: Identifier, df: DataFrame, text_col: str, label_col: str) -> Identifier:
    """Means, deviations and limit from labelled documents, each scored by the models that were trained without its fold."""
    n_lang = len(ident.languages)
    ident.mean, ident.variance = np.full(n_lang, math.log2(VOCABULARY)), np.ones((n_lang, 2))
    if not n_lang:
        return ident
    spark = df.sparkSession
    labelled = df.select(column(text_col).alias("text"), column(label_col).cast("string").alias("lang"), fold_of(text_col).alias("fold"))
    shared = spark.sparkContext.broadcast([Identifier(ident.languages, [f"{x}-{f}" for x in ident.folders]) for f in range(FOLDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, folds = string_array(b.column(0)), b.column(2).to_numpy()
            labels = pc.fill_null(pc.index_in(string_array(b.column(1)), pa.array(ident.languages, pa.string())), -1).to_numpy()
            for f, part in enumerate(shared.value):
                own = np.flatnonzero(folds == f)
                entropy, length = part.entropies(texts.take(pa.array(own)))
                best = entropy.argmin(1)
                right = (best == labels[own]) & (length > 0)
                length = length[right]
                columns = [pa.array(best[right].astype(np.int32)), pa.array(entropy.min(1)[right]), pa.array(length), pa.array(np.log2(length))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "bits", "length", "size"])

    def of(values: dict[int, float]) -> Column:
        """The value of a row's language."""
        return F.get(F.array(*(F.lit(float(values.get(k, 0))) for k in range(n_lang))), F.col("k"))

    with scratch(spark):
        got = materialise(labelled.mapInArrow(run, "k int, bits double, length bigint, size double"), "calibration")
        cut = quantiles(got.select(F.col("k").alias("g"), F.col("size").alias("v")), 0.5)
        below, above = F.col("size") < of(cut), F.col("size") > of(cut)
        sides = {r.k: r for r in got.groupBy("k").agg(F.count("*").alias("n"), F.count_if(below).alias("below"), F.count_if(above).alias("above")).collect()}
        seen = sorted(k for k, r in sides.items() if r.n >= 5)
        if not seen:
            return ident
        # the shorter half, and the longer one, which has the texts of median length, unless these are the shortest
        cut = {k: math.nextafter(x, math.inf) if sides[k].above and not sides[k].below else x for k, x in cut.items()}
        halves = got.where(F.col("k").isin(seen)).withColumn("long", (F.col("size") >= of(cut)).cast("int"))
        mean = quantiles(halves.where("long = 1").select(F.col("k").alias("g"), F.col("bits").alias("v")), 0.5)
        # robust variances of the shorter and of the longer half; their difference is due to length
        far = quantiles(halves.select((2 * F.col("k") + F.col("long")).alias("g"), F.abs(F.col("bits") - of(mean)).alias("v")), 0.5)
        # whole numbers, whose sum needs no order
        inverses = halves.groupBy("k", "long").agg(F.count("*").alias("n"), F.sum(F.round(F.lit(2.0**40) / F.col("length")).cast("decimal(38,0)")).alias("s")).collect()
        inverse = {(r.k, r.long): int(r.s) / r.n / 2**40 for r in inverses}
        for k in seen:
            spread = {half: (1.4826 * far[2 * k + half]) ** 2 for half in (0, 1) if 2 * k + half in far}
            within = max(0.0, (spread[0] - spread[1]) / (inverse[k, 0] - inverse[k, 1])) if 0 in spread and inverse[k, 0] > inverse[k, 1] else 0.0
            ident.mean[k], ident.variance[k] = mean[k], (max(spread[1] - within * inverse[k, 1], LEAST_BETWEEN**2), within)
        between, within = (of(dict(enumerate(x))) for x in ident.variance.T)
        excess = (F.col("bits") - of(mean)) / F.sqrt(between + within / F.col("length"))
        near = quantiles(halves.select(F.lit(0).alias("g"), excess.alias("v")).where(F.col("v") <= LEAST_LIMIT), 0.999)
        ident.limit = max(LEAST_LIMIT, 2 * near[0])
    return ident


def identify(df: DataFrame, ident: Identifier, text_col: str = "text") -> DataFrame:
    """doc_id, language (null if rejected), bits_per_char, excess, n_units, accepted."""
    workers_see_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ident)
    schema = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in (("language", T.StringType()), ("bits_per_char", T.DoubleType()), ("excess", T.DoubleType()), ("n_units", T.LongType()), ("accepted", T.BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bits, excess, length = shared.value.decide(string_array(b.column(1)))
            names = pa.array([*shared.value.languages, None], pa.string()).take(pa.array(np.where(at < 0, len(shared.value.languages), at)))
            columns = [b.column(0), names, pa.array(bits, from_pandas=True), pa.array(excess), pa.array(length), pa.array(at >= 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "language", "bits_per_char", "excess", "n_units", "accepted"])

    return df.select("doc_id", column(text_col)).mapInArrow(run, schema)


def keep_identified(df: DataFrame, ident: Identifier, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that are accepted, the label replaced by the language found; no shuffle."""
    workers_see_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ident)
    at_text, at_label, names = df.columns.index(text_col), df.columns.index(label_col), df.columns
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == label_col else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = shared.value.decide(string_array(b.column(at_text)))[0]
            ok = pa.array(at >= 0)
            kept = b.filter(ok)
            found = pa.array([*shared.value.languages, None], pa.string()).take(pa.array(at[at >= 0]))
            columns = list(kept.columns)
            columns[at_label] = found
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(df, run, schema)


__all__ = ["Identifier", "Model", "fit", "free_name", "identify", "keep_identified", "train"]
