"""WARC archives with a two-level capture index.

Writing: every task writes one archive file of gzip members, one record each, and reports where every record lies.
Only the files that the committed report names belong to the archive, so a task that is run again does no harm.

Index: captures are sorted by reversed-host key and page id over all partitions; each partition writes its captures
as compressed blocks of BLOCK_LINES lines, and a sparse directory with the first key of each block.  A look-up searches
the parts' first keys, then a part's directory, both by bisection, reads the one block range that can hold the key,
and gets file, offset and length of the records.

Reading: located records are sorted by file and offset, so neighbours are read together; payloads are checked against
their digest.

Payloads are the html in UTF-8 (null: empty).  Of equal payloads of 1000 bytes or more the record with the largest
page id is a response and the others revisit it; smaller ones are responses.  Rows without a page id are revisits of
such a group if it has an id at all; rows repeated with the largest id are all responses.  A null address gives the empty key and no
target line.  Extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.llm.common import fresh_folder, make_folder, materialise, store, table, with_column_batches
from vocspark.llm.registry import query

REVISIT_BYTES = 1000
BLOCK_LINES = 256
# Neighbouring records are fetched in one read of at most this many bytes.
READ_BYTES = 1 << 20
LOWEST = -(1 << 63)
REPORT = "surt string, page_id bigint, file string, offset bigint, length bigint"
RECORD = ("page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, "
          "payload binary")
_DATE = "2024-01-01T00:00:00Z"


def surt(url: Column) -> Column:
    """Reversed-host key: host labels from the top level down, then port, path and query; the scheme is left out."""
    address = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(address, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?[^/?#:]*", "")
    return F.when(address == "", F.lit("")).otherwise(F.concat(
        F.array_join(F.reverse(F.split(F.regexp_replace(host, r"\.+$", ""), r"\.")), ","), F.lit(")"), rest))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with key, payload digest and size, and ``refers_to`` where a record revisits another."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns({
        "surt": surt(F.col("url")), "digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("page_id").alias("main"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(groups, "digest", "left")
    revisit = F.col("main").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("main"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("main"))).drop("main")


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def render(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One uncompressed record: a revisit has the HTTP head alone, which still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple:
    """(page_id, url, type, digest, payload bytes, refers_to, payload) of one uncompressed record."""
    head, _, body = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = body[:int(fields["Content-Length"])]
    if body[len(block):] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")

    def number(field):
        text = fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return (number("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, digest, size, number("WARC-Refers-To"), payload)


def write_archive(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``captures`` rows as archive files in ``folder``; gives the report: key, id, file, offset, length."""
    make_folder(folder)

    def task(batches):
        sink, name, at = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if sink is None:
                    files, path = store(name)
                    sink = files.open_output_stream(path, compression=None)
                offsets, lengths = [], []
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    data = gzip.compress(render(row[0], row[1], row[2].encode("utf-8"), row[3], row[4]), 5, mtime=0)
                    sink.write(data)
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("surt"), batch.column("page_id"), pa.array([name] * len(offsets)), pa.array(offsets, pa.int64()),
                     pa.array(lengths, pa.int64())], names=["surt", "page_id", "file", "offset", "length"])
        finally:
            if sink is not None:
                sink.close()

    columns = ["surt", "page_id", "url", "payload", "digest", "refers_to"]
    return materialise(with_column_batches(rows, columns, REPORT, task), "warc-report")


@dataclass(frozen=True)
class CaptureIndex:
    """First key, block file and directory file of every part: one entry for each partition that wrote a part."""
    parts: list[tuple[tuple[bytes, int], str]]


def _key(surt_text, page_id) -> tuple[bytes, int]:
    return (surt_text or "").encode("utf-8"), LOWEST if page_id is None else page_id


def build_index(report: DataFrame, folder: str) -> CaptureIndex:
    """Sort the captures over all partitions and write blocks and sparse directories."""
    make_folder(folder)
    ordered = report.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")

    def task(batches):
        name, lines, directory, first, at = f"{folder}/{uuid.uuid4().hex}", [], [], None, 0
        files, path = store(name)
        sink = None

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode("utf-8"))
            sink.write(data)
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            at += len(data)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    sink, first = files.open_output_stream(path + ".blocks", compression=None), row
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        if sink is not None:
            if lines:
                flush()
            sink.close()
            with files.open_output_stream(path + ".directory", compression=None) as out:
                out.write(zlib.compress(json.dumps(directory).encode("utf-8")))
            yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.string()), pa.array([first[1]], pa.int64()), pa.array([name])],
                                             names=["surt", "page_id", "part"])

    columns = ["surt", "page_id", "file", "offset", "length"]
    parts = materialise(with_column_batches(ordered, columns, "surt string, page_id bigint, part string", task), "warc-parts")
    return CaptureIndex(sorted((_key(r["surt"], r["page_id"]), r["part"]) for r in parts.collect()))


@lru_cache(maxsize=64)
def _directory(part: str) -> tuple[list, list]:
    files, path = store(part + ".directory")
    with files.open_input_file(path) as source:
        rows = json.loads(zlib.decompress(source.read()))
    return [_key(r[0], r[1]) for r in rows], [(r[2], r[3]) for r in rows]


class _Searcher:
    """Look-ups of one task; keys come sorted, so the last block is kept."""

    def __init__(self, index: CaptureIndex):
        self.firsts = [k for k, _ in index.parts]
        self.names = [n for _, n in index.parts]
        self.open = self.last = None

    def block(self, part: str, number: int) -> list:
        if self.last and self.last[:2] == (part, number):
            return self.last[2]
        if not self.open or self.open[0] != part:
            if self.open:
                self.open[1].close()
            files, path = store(part + ".blocks")
            self.open = part, files.open_input_file(path)
        at, size = _directory(part)[1][number]
        rows = [json.loads(x) for x in zlib.decompress(self.open[1].read_at(size, at)).decode("utf-8").split("\n")]
        keys = [_key(r[0], r[1]) for r in rows]
        self.last = part, number, (rows, keys)
        return self.last[2]

    def find(self, key: tuple[bytes, int]) -> list:
        at = bisect.bisect_right(self.firsts, key) - 1
        if at < 0:
            return []
        keys = _directory(self.names[at])[0]
        number = max(0, bisect.bisect_left(keys, key) - 1)
        out = []
        while number < len(keys) and keys[number] <= key:
            rows, inside = self.block(self.names[at], number)
            out += rows[bisect.bisect_left(inside, key):bisect.bisect_right(inside, key)]
            number += 1
        return out


def look_up(wanted: DataFrame, index: CaptureIndex) -> DataFrame:
    """Captures of the wanted (surt, page_id) pairs: the report's columns; a pair without a capture gives none."""
    ordered = wanted.select("surt", "page_id").distinct().repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")

    def task(batches):
        searcher = _Searcher(index)
        for batch in batches:
            found = []
            for s, i in zip(batch.column("surt").to_pylist(), batch.column("page_id").to_pylist()):
                found += searcher.find(_key(s, i))
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                 pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                names=["surt", "page_id", "file", "offset", "length"])

    return with_column_batches(ordered, ["surt", "page_id"], REPORT, task)


def read_records(located: DataFrame) -> DataFrame:
    """Records at (file, offset, length), payload included (empty for a revisit)."""
    ordered = located.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def task(batches):
        name = source = None
        held, held_at = b"", 0
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns)))
            for start in range(0, len(places), 500):
                out = []
                for k in range(start, min(start + 500, len(places))):
                    file, offset, length = places[k]
                    if file != name:
                        if source is not None:
                            source.close()
                        files, path = store(file)
                        name, source, held, held_at = file, files.open_input_file(path), b"", 0
                    if not held_at <= offset <= offset + length <= held_at + len(held):
                        end = offset + length
                        for f, o, n in places[k + 1:]:
                            if f != file or o > end or o + n - offset > READ_BYTES:
                                break
                            end = max(end, o + n)
                        held, held_at = source.read_at(end - offset, offset), offset
                    out.append(parse(gzip.decompress(held[offset - held_at:offset - held_at + length])))
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[
                    "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

    return with_column_batches(ordered, ["file", "offset", "length"], RECORD, task)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages as archives, index them, find every page by its key, and read the records."""
    report = write_archive(captures(pages), fresh_folder(spark, "warc"))
    index = build_index(report, fresh_folder(spark, "warc-index"))
    wanted = pages.select(surt(F.col("url")).alias("surt"), F.col("page_id").cast("long").alias("page_id"))
    return read_records(look_up(wanted, index))


@query("op1_warc_capture_index", """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  g AS (SELECT html, max(page_id) AS main FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN main <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN main <> page_id THEN main END AS refers_to FROM p LEFT JOIN g ON p.html = g.html""")
def warc_capture_index(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
