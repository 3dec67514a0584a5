"""Sorted-string-table shards: documents keyed by identifier.

A shard is a file of data blocks, each with prefix-compressed keys and restart points and deflated as a whole;
then a sparse index (the last key of each block with its offset and length), a Bloom filter over the keys, and
a footer of fixed length. A reader takes the footer, index and filter off the end of the file; a lookup asks the filter,
finds the block by binary search in the index, reads that block alone and finds the key by binary search over its restart
points.

Keys: a long is written as ``n`` or ``p`` and 19 digits, so that bytes sort as numbers do; a string as its
UTF-8 bytes. Defined cases: a null identifier has the empty key, which sorts first; a null text is a value of
its own, unlike the empty text; repeated identifiers are all kept, in the order of a hash of their texts, and a
lookup returns all of them; an empty table gives no shard; a text longer than a block has a block to itself.
Further columns are not stored.
"""

from __future__ import annotations

import io
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, files, partitions_for, workers_see_package
from .extshuffle import payload_bytes

BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
RESTART_EVERY = 16
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
MAGIC = b"CRSST\x00\x01\n"
FOOTER = struct.Struct("<QIQIQQI8s")  # index at, length; filter at, length; entries; data bytes; crc of index+filter; magic
SCHEMA = (
    "shard_id bigint, section string, seq int, first_key string, last_key string, n_entries int, "
    "file_offset bigint, n_bytes int, doc_ids array<bigint>, payload binary"
)


def encode_key(v) -> bytes:
    if v is None:
        return b""
    if isinstance(v, int):
        return b"p%019d" % v if v >= 0 else b"n%019d" % (v + (1 << 63))
    return str(v).encode()


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 0x7F) << shift
        if c < 0x80:
            return n, at
        shift += 7


def encode_block(entries: list[tuple[bytes, bytes | None]]) -> bytes:
    body, restarts, last = bytearray(), [], b""
    for i, (key, value) in enumerate(entries):
        shared = 0
        if i % RESTART_EVERY == 0:
            restarts.append(len(body))
        else:
            most = min(len(key), len(last))
            while shared < most and key[shared] == last[shared]:
                shared += 1
        held = b"" if value is None else value
        body += varint(shared) + varint(len(key) - shared) + varint(0 if value is None else len(held) + 1) + key[shared:] + held
        last = key
    for r in restarts:
        body += struct.pack("<I", r)
    body += struct.pack("<I", len(restarts))
    packed = zlib.compress(bytes(body), 1)
    return packed + struct.pack("<I", zlib.crc32(packed))


class Block:
    def __init__(self, raw: bytes):
        packed, crc = raw[:-4], struct.unpack("<I", raw[-4:])[0]
        if zlib.crc32(packed) != crc:
            raise ValueError("damaged block")
        self.body = zlib.decompress(packed)
        n = struct.unpack_from("<I", self.body, len(self.body) - 4)[0]
        self.end = len(self.body) - 4 - 4 * n
        self.restarts = struct.unpack_from(f"<{n}I", self.body, self.end)

    def _entry(self, at: int, last: bytes) -> tuple[bytes, bytes | None, int]:
        shared, at = read_varint(self.body, at)
        rest, at = read_varint(self.body, at)
        size, at = read_varint(self.body, at)
        key = last[:shared] + self.body[at : at + rest]
        at += rest
        return (key, None, at) if size == 0 else (key, self.body[at : at + size - 1], at + size - 1)

    def scan(self, at: int = 0) -> Iterator[tuple[bytes, bytes | None]]:
        key = b""
        while at < self.end:
            key, value, at = self._entry(at, key)
            yield key, value

    def get(self, key: bytes) -> list[bytes | None]:
        # the last restart whose key is below the wanted one; equal keys may begin before a restart
        lo, hi = 0, len(self.restarts)
        while lo < hi:
            mid = (lo + hi) // 2
            if self._entry(self.restarts[mid], b"")[0] < key:
                lo = mid + 1
            else:
                hi = mid
        found = []
        for k, v in self.scan(self.restarts[max(0, lo - 1)] if self.restarts else 0):
            if k > key:
                break
            if k == key:
                found.append(v)
        return found


def bloom_probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(BLOOM_HASHES)]


def bloom_of(keys: list[bytes]) -> bytes:
    bits = max(64, len(keys) * BLOOM_BITS_PER_KEY)
    field = bytearray((bits + 7) // 8)
    for k in keys:
        for p in bloom_probes(k, bits):
            field[p >> 3] |= 1 << (p & 7)
    return struct.pack("<Q", bits) + bytes(field)


def encode_index(blocks: list[tuple[bytes, int, int]]) -> bytes:
    out = bytearray(varint(len(blocks)))
    for last_key, at, size in blocks:
        out += varint(len(last_key)) + last_key + varint(at) + varint(size)
    return bytes(out)


class SSTable:
    """Reader of one shard, given its bytes or an open file; of a file, only what a call needs is read."""

    def __init__(self, source):
        self.file = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else source
        end = self.file.seek(0, 2)
        at, size, bloom_at, bloom_size, self.n_entries, self.data_bytes, crc, magic = FOOTER.unpack(self._read(max(0, end - FOOTER.size), FOOTER.size)) if end >= FOOTER.size else [0] * 7 + [b""]
        tail = self._read(at, size + bloom_size) if magic == MAGIC and at + size == bloom_at else b""
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a shard, or damaged")
        self.bits = struct.unpack_from("<Q", tail, size)[0]
        self.bloom = tail[size + 8 :]
        self.index = []
        n, p = read_varint(tail, 0)
        for _ in range(n):
            length, p = read_varint(tail, p)
            key, p = tail[p : p + length], p + length
            where, p = read_varint(tail, p)
            length, p = read_varint(tail, p)
            self.index.append((key, where, length))

    @classmethod
    def open(cls, uri: str) -> SSTable:
        system, path = files(uri)
        return cls(system.open_input_file(path))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_probes(key, self.bits))

    def get(self, identifier) -> list[str | None]:
        key = encode_key(identifier)
        if not self.may_have(key):
            return []
        found: list[str | None] = []
        for _, at, size in self.index[bisect_left(self.index, key, key=lambda x: x[0]) :]:
            block = Block(self._read(at, size))
            got = block.get(key)
            found += [None if v is None else v.decode() for v in got]
            if not got or next(block.scan())[0] > key:
                break
        return found

    def scan(self) -> Iterator[tuple[bytes, str | None]]:
        for _, at, size in self.index:
            for k, v in Block(self._read(at, size)).scan():
                yield k, None if v is None else v.decode()


def sections(rows: Iterator[tuple[object, str | None]], shard_base: int, block_bytes: int, shard_bytes: int) -> Iterator[tuple]:
    """Rows of SCHEMA for documents that come in key order; one block is held at a time."""
    shard, state = shard_base, None

    def flush(s: dict) -> tuple:
        payload = encode_block(s["entries"])
        keys = [k for k, _ in s["entries"]]
        row = (shard, "data", len(s["blocks"]), keys[0].decode(), keys[-1].decode(), len(keys), s["at"], len(payload), s["ids"], payload)
        s["blocks"].append((keys[-1], s["at"], len(payload)))
        s["at"] += len(payload)
        s["keys"] += keys
        s["entries"], s["ids"], s["size"] = [], [], 0
        return row

    def close(s: dict) -> Iterator[tuple]:
        if s["entries"]:
            yield flush(s)
        index, bloom, data = encode_index(s["blocks"]), bloom_of(s["keys"]), s["at"]
        foot = FOOTER.pack(data, len(index), data + len(index), len(bloom), len(s["keys"]), data, zlib.crc32(index + bloom), MAGIC)
        at, first, last = data, s["keys"][0].decode(), s["keys"][-1].decode()
        for seq, (name, payload) in enumerate((("index", index), ("filter", bloom), ("footer", foot)), len(s["blocks"])):
            yield (shard, name, seq, first, last, len(s["keys"]), at, len(payload), None, payload)
            at += len(payload)

    for identifier, text in rows:
        if state is None:
            state = {"entries": [], "ids": [], "size": 0, "blocks": [], "at": 0, "keys": []}
        value = None if text is None else text.encode()
        state["entries"].append((encode_key(identifier), value))
        state["ids"].append(identifier if isinstance(identifier, int) else None)
        state["size"] += len(value or b"") + 24
        if state["size"] >= block_bytes:
            yield flush(state)
            if state["at"] >= shard_bytes:
                yield from close(state)
                state, shard = None, shard + 1
    if state is not None:
        yield from close(state)


def to_shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """All sections of all shards (see SCHEMA); a shard's file is its payloads in the order of ``seq``.

    One shuffle: ranges of the identifier, with a hash of the text behind it so that a hot identifier can be split.
    ``shard_id`` ascends with the keys.
    """
    workers_see_package(df.sparkSession)
    keyed = df.select(column(id_col).alias("k"), column(text_col).alias("v"))
    # as many tasks as shards will be, whatever the session's number of shuffle partitions
    n = partitions_for(df.sparkSession, payload_bytes(keyed), shard_bytes)
    keyed = keyed.withColumn("h", F.xxhash64("v"))
    ranged = keyed.repartitionByRange(n, F.col("k").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("k").asc_nulls_first(), "h")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def rows():
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)

        held, size = [], 0
        for row in sections(rows(), TaskContext.get().partitionId() << 32, block_bytes, shard_bytes):
            held.append(row)
            size += row[7]
            if size > 4 << 20:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return ranged.select("k", "v").mapInArrow(build, SCHEMA)


def write_files(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard to ``folder/shard-<id>.sst``, a path or URI that all executors reach, and return (shard_id, path, n_bytes, first_key, last_key).

    A shard is put together under a name of its task attempt and then renamed, so a repeated task leaves one whole file.
    """
    workers_see_package(shards.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = files(folder)
        system.create_dir(base, recursive=True)
        attempt, out, size, done = TaskContext.get().taskAttemptId(), None, 0, []
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(k)[i].as_py() for k, name in enumerate(("shard_id", "section", "first_key", "last_key", "payload"))}
                if out is None:
                    temp, size = f"{base}/.shard-{r['shard_id']}-{attempt}", 0
                    out = system.open_output_stream(temp)
                out.write(r["payload"])
                size += len(r["payload"])
                if r["section"] == "footer":
                    out.close()
                    out, name = None, f"shard-{r['shard_id']:016x}.sst"
                    system.move(temp, f"{base}/{name}")
                    done.append((r["shard_id"], f"{folder.rstrip('/')}/{name}", size, r["first_key"], r["last_key"]))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["shard_id", "path", "n_bytes", "first_key", "last_key"])

    sorted_ = shards.repartition("shard_id").sortWithinPartitions("shard_id", "seq").select("shard_id", "section", "first_key", "last_key", "payload")
    return sorted_.mapInArrow(write, "shard_id bigint, path string, n_bytes bigint, first_key string, last_key string")
