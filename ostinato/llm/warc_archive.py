"""WARC archives: writing, an index of every record, and reads of chosen records by coalesced byte ranges.

Writing stays in the JVM: each record is one row of text, and the record separator of the format is the line separator
of Spark's text sink, so files appear by Spark's own commit protocol on whatever file system the folder is in, and a
lost executor's part is written again. Payloads are never shuffled, but for the few rows that two filters of fixed error take
for others: a table of keys, digests and lengths decides which rows are revisits, responses go from the input straight to
the archive, and a revisit has no payload to write.

Reading starts from an index (file, offset, length, URL, payload digest per record), made by one pass over the headers
that skips each payload by its Content-Length. Chosen records are sorted by file and offset; neighbours less than
``GAP`` bytes apart are read together in ranges of at most ``RANGE`` bytes (a longer record is read alone), one range per task
step. Where Arrow can't open the archives' file system, Spark reads the files and the same ranges are cut from them; that
needs files below 2 GB, which hold as much as one input split does.

Defined results: a null payload is an empty one; a null URL is written as an empty header value; equal payloads of at least
``min_bytes`` keep the record with the smallest key as response, and repeated rows of that key are responses too; a row with a
null key is always a response, is never referred to and reads back with a null key; a payload of any length is one record
(memory for it is a few times its size); extra columns are ignored, whatever their names; an empty table gives an empty archive
and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.key_filter import without
from ostinato.llm.spread import salted_join
from ostinato.runtime import persist_table

SEPARATOR = "\r\n\r\n"
MIN_BYTES = 100
RANGE, GAP = 8 << 20, 64 << 10
_HEAD_BYTES = 16 << 10

INDEX_SCHEMA = (
    "file string, offset long, length long, head_bytes int, record_id string, record_type string, url string, "
    "payload_digest string, payload_bytes long, refers_to string"
)
RECORD_SCHEMA = (
    "record_id string, record_type string, url string, payload_digest string, refers_to string, read_bytes long, "
    "read_sha256 string, payload binary"
)


def payload_table(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """_key, _url, _text, _bytes and _digest of each row."""
    rows = pages.select(F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("")).alias("_url"), F.coalesce(F.col(payload), F.lit("")).alias("_text"))
    return rows.withColumns({"_bytes": F.octet_length("_text").cast("long"), "_digest": F.sha2(F.encode("_text", "UTF-8"), 256)})


def revisits(rows: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows (_key, _url, _bytes, _digest) that repeat an earlier key's payload, with that key as _first."""
    large = rows.where(F.col("_bytes") >= min_bytes)
    groups = large.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count("*").alias("n")).where("n > 1")
    groups = persist_table(groups, "payload-groups")
    # one digest may be that of a third of all rows
    met = salted_join(large, groups.drop("n"), ["_digest"], ["_key"], groups)
    return met.where("_key <> _first").select("_key", "_url", "_bytes", "_digest", "_first")


def write_archives(pages: DataFrame, path: str, key: str, url: str, payload: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes one WARC/1.1 record per row to files under ``path``."""
    rows = payload_table(pages, key, url, payload)
    digests = persist_table(rows.drop("_text"), "payload-digests")
    again = persist_table(revisits(digests, min_bytes), "revisits")
    name = lambda k: F.concat(F.lit("<urn:page:"), k.cast("string"), F.lit(">"))
    clean = F.regexp_replace("_url", r"[\x00-\x20\x7f]", "")

    def record(kind: str, more: F.Column, body: F.Column) -> F.Column:
        lines = [
            F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"),
            F.concat(F.lit("WARC-Record-ID: "), F.coalesce(name(F.col("_key")), F.lit(""))),
            F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
            F.concat(F.lit("WARC-Target-URI: "), clean),
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("_digest")),
            F.concat(F.lit("WARC-Payload-Length: "), F.col("_bytes").cast("string")),
            more,
            F.lit("Content-Type: text/html"),
            F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        ]
        return F.concat(F.concat_ws("\r\n", *lines), F.lit(SEPARATOR), body).alias("value")

    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "
    on = ["_key", "_digest"]
    whole = without(rows, on, again, on, digests).select(record("response", F.lit(None), F.col("_text")))
    empty = again.select(record("revisit", F.concat(F.lit(profile), name(F.col("_first"))), F.lit("")))
    whole.unionAll(empty).write.option("lineSep", SEPARATOR).text(path)


def _open(file: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(file)


def arrow_opens(path: str) -> bool:
    """Whether Arrow knows the file system of a path."""
    try:
        _open(path)
    except (ValueError, NotImplementedError, OSError):
        return False
    return True


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def _headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _index_row(file: str, at: int, head: bytes, found: dict[str, str]) -> dict:
    size = int(found["Content-Length"])
    return {
        "file": file,
        "offset": at,
        "length": len(head) + 4 + size,
        "head_bytes": len(head) + 4,
        "record_id": found.get("WARC-Record-ID", ""),
        "record_type": found["WARC-Type"],
        "url": found.get("WARC-Target-URI", ""),
        "payload_digest": found.get("WARC-Payload-Digest", "").removeprefix("sha256:"),
        "payload_bytes": int(found.get("WARC-Payload-Length", size)),
        "refers_to": found.get("WARC-Refers-To"),
    }


def scan_archive(file: str, source: pa.NativeFile) -> Iterator[dict]:
    """Index rows of one archive; payloads are skipped, not kept."""
    end, at = source.size(), 0
    held, held_at = b"", 0
    while at < end:
        want = _HEAD_BYTES
        while True:
            if not held_at <= at < held_at + len(held) or held.find(b"\r\n\r\n", at - held_at) < 0:
                source.seek(at)
                held, held_at = source.read(max(want, 1 << 20)), at
            stop = held.find(b"\r\n\r\n", at - held_at)
            if stop >= 0:
                break
            if held_at + len(held) >= end:
                raise ValueError(f"{file}: a record's header at {at} doesn't end")
            want = max(2 * want, 2 * len(held))
        head = held[at - held_at : stop]
        row = _index_row(file, at, head, _headers(head))
        yield row
        at += row["length"] + 4


_INDEX = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("head_bytes", pa.int32()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("refers_to", pa.string()),
    ]
)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``; one task step per file, which is what one task wrote."""
    direct = arrow_opens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, file in enumerate(batch.column(0).to_pylist()):
                if direct:
                    fs, at = _open(file)
                    source = fs.open_input_file(at)
                else:
                    source = pa.BufferReader(batch.column(1)[row].as_buffer())
                rows: list[dict] = []
                with source:
                    for found in scan_archive(file, source):
                        rows.append(found)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    n = max(1, 4 * spark.sparkContext.defaultParallelism)
    files = _archives(spark, path).select("path").repartition(n, "path") if direct else _archives(spark, path).select("path", "content")
    return files.mapInArrow(run, INDEX_SCHEMA)


def _ranges(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Groups of sorted index rows that one read covers."""
    group: list[tuple] = []
    for row in rows:
        file, offset, length = row[:3]
        if group and (
            file != group[0][0] or offset - (group[-1][1] + group[-1][2]) > GAP or offset + length - group[0][1] > RANGE
        ):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _record(raw: bytes, head: int, payloads: bool) -> tuple:
    found, body = _headers(raw[: head - 4]), raw[head:]
    digest = (found.get("WARC-Payload-Digest") or "").removeprefix("sha256:")
    about = (found.get("WARC-Record-ID"), found.get("WARC-Type"), found.get("WARC-Target-URI"), digest, found.get("WARC-Refers-To"))
    return *about, len(body), hashlib.sha256(body).hexdigest(), body if payloads else None


_RECORD = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "url", "payload_digest", "refers_to")]
    + [("read_bytes", pa.int64()), ("read_sha256", pa.string()), ("payload", pa.binary())]
)


def read_records(chosen: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of chosen index rows, headers parsed anew, with size and SHA-256 of the payload as read.

    The payload itself follows unless ``payloads`` is false; it is then null.

    Rows are dealt by (file, RANGE-sized block) and sorted, so a large archive spreads over tasks. ``chosen`` must not be empty of
    columns file, offset, length and head_bytes.
    """
    spark = chosen.sparkSession
    one = chosen.select("file").first()
    n = max(1, 4 * spark.sparkContext.defaultParallelism)
    rows = chosen.select("file", "offset", "length", "head_bytes")
    batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), _RECORD.types, strict=True)], schema=_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for group in _ranges(rows):
            file, start = group[0][:2]
            if opened[0] != file:
                fs, path = _open(file)
                opened = (file, fs.open_input_file(path))
            source = opened[1]
            source.seek(start)
            data = source.read(group[-1][1] + group[-1][2] - start)
            yield batch_of([_record(data[x - start : x - start + length], head, payloads) for _, x, length, head in group])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in enumerate(batch.column(1).to_pylist()):
                content = memoryview(batch.column(0)[row].as_buffer())
                for group in _ranges(("", x["offset"], x["length"], x["head_bytes"]) for x in found):
                    yield batch_of([_record(bytes(content[x : x + length]), head, payloads) for _, x, length, head in group])

    if one is None or arrow_opens(one["file"]):
        ordered = rows.withColumn("_block", F.floor(F.col("offset") / F.lit(RANGE))).repartition(n, "file", "_block")
        return ordered.sortWithinPartitions("file", "offset").select("file", "offset", "length", "head_bytes").mapInArrow(run, RECORD_SCHEMA)
    folder = one["file"].rsplit("/", 1)[0]
    wanted = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "head_bytes"))).alias("found"))
    held = _archives(spark, folder).select(F.col("path").alias("file"), "content")
    return held.join(wanted, "file").select("content", "found").mapInArrow(cut, RECORD_SCHEMA)


def key_of(record_id: str) -> F.Column:
    """The key in a record id; null where there is none."""
    return F.when(F.col(record_id).startswith("<urn:page:"), F.regexp_extract(F.col(record_id), "(?s)^<urn:page:(.*)>$", 1))


def archive_report(index: DataFrame, key: str, kind: str) -> DataFrame:
    """Per record, from what was read back: size and digest of the full payload, type, and what it refers to.

    A response's payload is hashed again. A revisit has no payload of its own; its size and digest are those of the
    response that it refers to, found by record id.
    """
    records = read_records(index, payloads=False)
    mine = records.where("record_type = 'response'")
    whole = mine.select(F.col("record_id").alias("_id"), F.col("read_bytes").alias("_bytes"), F.col("read_sha256").alias("_sha"))
    again = records.where("record_type = 'revisit'")
    counts = index.where("record_type = 'revisit'").groupBy("refers_to").agg(F.count("*").alias("n"))
    # one response may be that of a third of all rows
    met = salted_join(
        again, whole.where("_id <> ''").dropDuplicates(["_id"]).withColumnRenamed("_id", "refers_to"), ["refers_to"], ["record_id"], counts, "left"
    )
    columns = ["record_id", "record_type", "refers_to"]
    both = mine.select(*columns, "read_bytes", "read_sha256").unionAll(met.select(*columns, "_bytes", "_sha"))
    return both.select(
        key_of("record_id").cast(kind).alias(key),
        F.col("read_bytes").alias("payload_bytes"),
        F.col("read_sha256").alias("payload_digest"),
        "record_type",
        key_of("refers_to").cast(kind).alias("refers_to"),
    )
