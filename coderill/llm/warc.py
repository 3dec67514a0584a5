"""WARC revisit resolution.

Captures are ``response`` records with a payload, or ``revisit`` records that only name a payload's digest. Headers,
without payloads, are shuffled by digest; the earliest response of each digest (then the least record id) is its
original; every other record of that digest becomes a revisit that refers to it. Payloads are joined again, by record
id, to the originals alone, and all records get fresh headers and their places in archives. Archives of more than
ARCHIVE_BYTES are split by a hash of the record id (archive_part), so a hot one is no single task.

Digests are SHA-1, given as hexadecimal or as base 32, with ``sha1:`` in front or without; they come out as hexadecimal.
Others are compared as they are, in lower case.

``write_archives`` writes each record as a gzip member and returns where it lies, so that a reader can seek to it;
``read_archives`` reads captures back from such files.

Defined cases: a response whose payload is null has no digest: it stays, with an empty block, as ``empty``. The empty
payload is a payload like any other. A revisit whose digest no response has is kept as ``orphan``, referring to nothing.
Records that repeat a record id are one record; a null record id is replaced by one made of digest, URL and date. Ties in
date go to the least record id. Null URLs and dates are written as empty fields. An empty table gives an empty result.
Columns beyond those of CAPTURE and http_header (the block's head as it was captured, if there is such a column; one is made
where it is missing or null) are not read, whatever their names. A null archive number is an archive of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import files, workers_see_package

#: What resolve() reads. captured_at counts seconds from 1970.
CAPTURE = ("record_id", "url", "captured_at", "record_type", "payload_digest", "payload", "archive_no")
PAGES_PER_ARCHIVE = 2000
EPOCH = 1704067200
ARCHIVE_BYTES = 1 << 30
_BASE32, _DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def iso(seconds: Column) -> Column:
    """Independent of the session's time zone."""
    # dateadd on a timestamp without zone; its text has no fraction for whole seconds
    return F.concat(F.translate(F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string"), " ", "T"), F.lit("Z"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """What a crawler that comes back would have recorded of ``pages``, every page once at least.

    Every third page was seen again a day later unchanged (a revisit), every seventh was fetched again two days later in
    full (a response with the same payload), and every eleventh has a revisit whose original lies in no archive at hand.
    """
    k = F.col("page_id")
    digest = F.sha1(F.col("html"))
    base = pages.select(
        k, F.col("url"), F.col("html").alias("payload"), digest.alias("digest"), F.coalesce(F.floor(k / PAGES_PER_ARCHIVE), F.lit(-1)).alias("archive_no")
    )
    kinds = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("response").alias("record_type")),
        F.when(F.pmod(k, F.lit(3)) == 0, F.struct(F.lit(1).alias("n"), F.lit("revisit").alias("record_type"))),
        F.when(F.pmod(k, F.lit(7)) == 0, F.struct(F.lit(2).alias("n"), F.lit("response").alias("record_type"))),
        F.when(F.pmod(k, F.lit(11)) == 0, F.struct(F.lit(3).alias("n"), F.lit("revisit").alias("record_type"))),
    )
    many = base.withColumn("c", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    n = F.col("c.n")
    own = F.when(n == 3, F.sha1(F.concat(F.lit("gone:"), F.coalesce("url", F.lit(""))))).otherwise(F.col("digest"))
    return many.select(
        F.concat(
            F.lit("urn:capture:"), F.coalesce(k.cast("string"), F.lit("none")), F.lit(":"), n.cast("string"), F.lit(":"), F.substring(F.sha1(F.coalesce("url", F.lit(""))), 1, 8),
            F.lit(":"), F.coalesce(F.substring(own, 1, 16), F.lit("none")),
        ).alias("record_id"),
        "url",
        (F.lit(EPOCH) + F.coalesce(F.pmod(k, F.lit(86400)), F.lit(0)) + n * 86400).cast("bigint").alias("captured_at"),
        F.col("c.record_type").alias("record_type"),
        F.when(F.col("c.record_type") == "revisit", own).alias("payload_digest"),
        F.when(F.col("c.record_type") == "response", F.col("payload")).alias("payload"),
        F.col("archive_no").cast("bigint").alias("archive_no"),
    )


def _fields(record_id: Column, url: Column, when: Column, digest: Column) -> Column:
    return F.concat(
        F.lit("\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Date: "), F.coalesce(when, F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), digest), F.lit("")),
    )


def plain_digest(digest: Column) -> Column:
    """A SHA-1 in base 32 as hexadecimal; anything else in lower case, without ``sha1:``."""
    body = F.regexp_replace(F.trim(digest), "^(?i)sha1:", "")
    chunks = [F.lpad(F.conv(F.translate(F.upper(F.substring(body, 1 + 8 * k, 8)), _BASE32, _DIGITS32), 32, 16), 10, "0") for k in range(4)]
    return F.lower(F.when(body.rlike("^[A-Za-z2-7]{32}$"), F.concat(*chunks)).otherwise(body))


def http_head(n_bytes: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n_bytes.cast("string"), F.lit("\r\n\r\n"))


def resolve(captures: DataFrame) -> DataFrame:
    """One row for each record of the deduplicated archives.

    record_id, url, captured_at, record_type, status (original, duplicate, resolved, orphan, empty), payload_digest,
    refers_to, archive_no, archive_part, record_offset, record_length (both before compression), record (header and block, as
    it stands in the archive).
    """
    given = F.col("http_header") if "http_header" in captures.columns else F.lit(None)
    c = captures.select(*CAPTURE, given.cast("string").alias("http_header"))
    digest = F.coalesce(plain_digest(F.col("payload_digest")), F.when(F.col("record_type") == "response", F.sha1("payload")))
    c = c.withColumn("payload_digest", digest).withColumn("captured_at", F.col("captured_at").cast("bigint"))
    made = F.concat(F.lit("urn:made:"), F.sha1(F.concat_ws("|", "payload_digest", "url", F.col("captured_at").cast("string"), "record_type")))
    c = c.withColumn("record_id", F.coalesce("record_id", made))
    headers = c.select(
        "record_id", "url", "captured_at", "record_type", "payload_digest", "archive_no",
        F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint").alias("n"), F.col("payload").isNotNull().alias("has"), "http_header",
    ).groupBy("record_id").agg(F.min(F.struct("captured_at", "url", "record_type", "payload_digest", "archive_no", "n", "has", "http_header")).alias("r")).select("record_id", "r.*")
    original = (
        headers.where((F.col("record_type") == "response") & F.col("has") & F.col("payload_digest").isNotNull())
        .groupBy("payload_digest")
        .agg(F.min(F.struct(F.coalesce("captured_at", F.lit(2**62)).alias("at"), "record_id", "url", "captured_at")).alias("o"))
    )
    known = headers.join(original, "payload_digest", "left")
    response = F.col("record_type") == "response"
    status = (
        F.when(response & ~F.col("has"), "empty")
        .when(response & (F.col("o.record_id") == F.col("record_id")), "original")
        .when(response, "duplicate")
        .when(F.col("o").isNotNull(), "resolved")
        .otherwise("orphan")
    )
    kept = F.col("status").isin("original", "empty")
    refers = F.when(F.col("status").isin("duplicate", "resolved"), F.col("o.record_id"))
    own = _fields(F.col("record_id"), F.col("url"), iso(F.col("captured_at")), F.col("payload_digest"))
    head = F.coalesce(F.col("http_header"), http_head(F.col("n")))
    block = F.when(F.col("status") == "original", F.octet_length(head) + F.col("n")).otherwise(F.lit(0))
    as_response = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response"), own, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"))
    target = F.concat(
        F.lit("\r\nWARC-Refers-To: <"), F.col("o.record_id"), F.lit(">\r\nWARC-Refers-To-Target-URI: "), F.coalesce("o.url", F.lit("")),
        F.lit("\r\nWARC-Refers-To-Date: "), F.coalesce(iso(F.col("o.captured_at")), F.lit("")),
    )
    as_revisit = F.concat(F.lit("WARC/1.1\r\nWARC-Type: revisit"), own, F.lit(f"\r\nWARC-Profile: {PROFILE}"), F.coalesce(F.when(refers.isNotNull(), target), F.lit("")), F.lit("\r\nContent-Length: 0\r\n\r\n"))
    placed = known.withColumn("status", status).withColumn("header", F.when(kept, as_response).otherwise(as_revisit))
    placed = placed.withColumn("record_length", (F.octet_length("header") + block + 4).cast("bigint"))
    # what comes in is no less than what goes out, and needs no join to be summed
    parts = c.groupBy(F.col("archive_no").alias("a")).agg(F.ceil(F.sum(F.coalesce(F.octet_length("payload"), F.lit(0)) + 2000) / ARCHIVE_BYTES).alias("parts"))
    placed = placed.join(parts, F.col("archive_no").eqNullSafe(F.col("a"))).withColumn("archive_part", F.pmod(F.xxhash64("record_id"), "parts")).drop("a", "parts")
    running = "sum(record_length) over (partition by archive_no, archive_part order by captured_at nulls first, record_id rows unbounded preceding)"
    placed = placed.withColumn("record_offset", F.expr(running) - F.col("record_length")).select(
        "record_id", "url", "captured_at", F.when(kept, "response").otherwise("revisit").alias("record_type"), "status", "payload_digest",
        refers.alias("refers_to"), "archive_no", "archive_part", "record_offset", "record_length", "header", head.alias("head"),
    )
    # one capture of a record id, as its header
    payloads = c.where(F.col("payload").isNotNull() & (F.col("record_type") == "response")).select("record_id", "payload")
    originals = placed.where(F.col("status") == "original").join(payloads, "record_id").dropDuplicates(["record_id"])
    whole = originals.withColumn("record", F.concat("header", "head", "payload", F.lit("\r\n\r\n")))
    others = placed.where(F.col("status") != "original").withColumn("record", F.concat("header", F.lit("\r\n\r\n")))
    columns = ["record_id", "url", "captured_at", "record_type", "status", "payload_digest", "refers_to", "archive_no", "archive_part", "record_offset", "record_length", "record"]
    return whole.select(columns).unionAll(others.select(columns))


def write_archives(resolved: DataFrame, folder: str) -> DataFrame:
    """Write ``folder/archive-<n>-<part>.warc.gz``, each record a gzip member, and return an index of the members.

    (record_id, path, member_offset, member_length): these count bytes of the file as it lies there. ``folder`` is a path or URI
    that all executors reach. A file is written under a name of its task attempt and then renamed.
    """
    workers_see_package(resolved.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        from pyspark import TaskContext

        system, base = files(folder)
        system.create_dir(base, recursive=True)
        attempt, out, at, size, index = TaskContext.get().taskAttemptId(), None, None, 0, []

        def close() -> pa.RecordBatch:
            out.close()
            system.move(f"{base}/.{at}-{attempt}", f"{base}/{at}")
            path = f"{folder.rstrip('/')}/{at}"
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in index]), pa.array([path] * len(index)), *(pa.array([x[k] for x in index], pa.int64()) for k in (1, 2))], names=["record_id", "path", "member_offset", "member_length"])

        for b in batches:
            for i in range(b.num_rows):
                number, part, record_id, record = (b.column(k)[i].as_py() for k in range(4))
                name = f"archive-{'none' if number is None else number}-{part}.warc.gz"
                if name != at:
                    if out is not None:
                        yield close()
                    at, size, index = name, 0, []
                    out = system.open_output_stream(f"{base}/.{at}-{attempt}", compression=None)
                member = gzip.compress(record.encode(), 6, mtime=0)
                out.write(member)
                index.append((record_id, size, len(member)))
                size += len(member)
        if out is not None:
            yield close()

    order = ("archive_no", "archive_part", "record_offset")
    placed = resolved.select("archive_no", "archive_part", "record_id", "record", "record_offset").repartition("archive_no", "archive_part").sortWithinPartitions(*order)
    return placed.drop("record_offset").mapInArrow(write, "record_id string, path string, member_offset bigint, member_length bigint")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with names in lower case, block) of each record of an unpacked archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def read_archives(spark: SparkSession, paths: list[str], tasks: int | None = None) -> DataFrame:
    """Captures (CAPTURE and http_header) of the response and revisit records in archives, packed or not, one file a task at most.

    ``archive_no`` is the place of the file in ``paths``. A payload that is no UTF-8 has U+FFFD where it isn't, and keeps the digest
    that its record says. Records of other types are passed over.
    """
    workers_see_package(spark)
    named = spark.createDataFrame(list(enumerate(paths)), "archive_no bigint, path string").repartition(max(1, min(tasks or len(paths), 100_000)))
    schema = "record_id string, url string, captured_at bigint, record_type string, payload_digest string, payload string, archive_no bigint, http_header string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io
        from datetime import datetime, timezone

        def capture(fields: dict[str, str], block: bytes, number: int) -> tuple:
            head = body = None
            if fields["warc-type"] == "response":
                cut = block.find(b"\r\n\r\n") + 4
                head, body = (block[:cut], block[cut:]) if cut > 3 and block.startswith(b"HTTP/") else (b"", block)
            when = fields.get("warc-date")
            stamp = int(datetime.fromisoformat(when.replace("Z", "+00:00")).replace(tzinfo=timezone.utc).timestamp()) if when else None
            text = [None if x is None else x.decode("utf-8", "replace") for x in (body, head)]
            return (fields.get("warc-record-id", "").strip("<>") or None, fields.get("warc-target-uri") or None, stamp, fields["warc-type"], fields.get("warc-payload-digest"), text[0], number, text[1])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.int64() if " bigint" in x else pa.string() for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for b in batches:
            for number, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, name = files(path)
                raw = io.BufferedReader(system.open_input_file(name))
                stream = gzip.open(raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for fields, block in _records(stream):
                    if fields.get("warc-type") in ("response", "revisit"):
                        rows.append(capture(fields, block, number))
                        size += len(block) + 500
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return named.mapInArrow(read, schema)


#: resolve(captures_of_pages(pages)) in DuckDB.
ORACLE_SQL = f"""
with base as (
  select page_id, url, html, sha1(html) as digest, coalesce(page_id // {PAGES_PER_ARCHIVE}, -1) as archive_no from pages),
many as (
  select *, 0 as n, 'response' as kind from base
  union all select *, 1, 'revisit' from base where page_id % 3 = 0
  union all select *, 2, 'response' from base where page_id % 7 = 0
  union all select *, 3, 'revisit' from base where page_id % 11 = 0),
cap as (
  select url, archive_no, kind, case when n = 3 then sha1('gone:' || coalesce(url, '')) else digest end as payload_digest,
    case when kind = 'response' then html end as payload,
    {EPOCH} + coalesce(page_id % 86400, 0) + n * 86400 as captured_at, page_id, n from many),
ided as (
  select *, 'urn:capture:' || coalesce(page_id::varchar, 'none') || ':' || n || ':' || substr(sha1(coalesce(url, '')), 1, 8)
      || ':' || coalesce(substr(payload_digest, 1, 16), 'none') as record_id,
    strftime(timestamp '1970-01-01' + to_seconds(captured_at), '%Y-%m-%dT%H:%M:%SZ') as iso from cap),
once as (select * from ided qualify row_number() over (partition by record_id order by captured_at) = 1),
orig as (
  select payload_digest as d, arg_min(record_id, (captured_at, record_id)) as o_id, arg_min(url, (captured_at, record_id)) as o_url,
    arg_min(iso, (captured_at, record_id)) as o_iso from once where kind = 'response' and payload is not null group by 1),
known as (
  select *, case when kind = 'response' and payload is null then 'empty' when kind = 'response' and o_id = record_id then 'original'
      when kind = 'response' then 'duplicate' when o_id is not null then 'resolved' else 'orphan' end as status
  from once left join orig on d = payload_digest),
blocks as (
  select *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload)
      || chr(13) || chr(10) || chr(13) || chr(10) || payload as block,
    chr(13) || chr(10) || 'WARC-Record-ID: <' || record_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'WARC-Date: ' || iso || coalesce(chr(13) || chr(10) || 'WARC-Payload-Digest: sha1:' || payload_digest, '') as own from known),
heads as (
  select *, case when status in ('original', 'empty')
      then 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || own || chr(13) || chr(10) || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
        || 'Content-Length: ' || case when status = 'original' then strlen(block) else 0 end || chr(13) || chr(10) || chr(13) || chr(10)
      else 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: revisit' || own || chr(13) || chr(10) || 'WARC-Profile: {PROFILE}'
        || case when status = 'orphan' then '' else chr(13) || chr(10) || 'WARC-Refers-To: <' || o_id || '>' || chr(13) || chr(10) || 'WARC-Refers-To-Target-URI: '
          || coalesce(o_url, '') || chr(13) || chr(10) || 'WARC-Refers-To-Date: ' || o_iso end
        || chr(13) || chr(10) || 'Content-Length: 0' || chr(13) || chr(10) || chr(13) || chr(10) end as header from blocks),
whole as (
  select *, header || case when status = 'original' then block else '' end || chr(13) || chr(10) || chr(13) || chr(10) as record from heads)
select record_id, url, captured_at::bigint as captured_at, case when status in ('original', 'empty') then 'response' else 'revisit' end as record_type, status,
  payload_digest, case when status in ('duplicate', 'resolved') then o_id end as refers_to, archive_no::bigint as archive_no, 0::bigint as archive_part,
  (sum(strlen(record)) over (partition by archive_no order by captured_at, record_id rows unbounded preceding) - strlen(record))::bigint as record_offset,
  strlen(record)::bigint as record_length, record
from whole
"""
