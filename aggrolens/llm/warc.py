"""WARC archives: writing with segments and revisits, reading with segment reassembly."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, saved, scratch

END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def chunked(data: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (data[i : i + size] for i in range(0, len(data), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The content of a chunked body; ValueError if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[line + 2 : at])
        at += 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def header(kind: str, rid: str, length: int, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {length}"]).encode() + END


def page_records(page_id: int | None, url: str | None, html: bytes, first: int | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of a page, without what ends each: a response in one or more segments, or a revisit of page `first`."""
    digest = payload_digest(html)
    rid = record_id(page_id, digest)
    uri = url and "".join(url.splitlines())
    about = {"X_Page_ID": page_id, "WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}", "Content_Type": "application/http; msgtype=response"}
    if first is not None and first != page_id:
        block = HTTP.replace(b"Transfer-Encoding: chunked\r\n", b"")
        yield header("revisit", rid, len(block), **about, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=record_id(first, digest)) + block
        return
    block = HTTP + chunked(html, chunk_bytes)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        yield header("response", rid, len(block), **about) + block
        return
    yield header("response", rid, len(pieces[0]), **about, WARC_Segment_Number=1) + pieces[0]
    for n, piece in enumerate(pieces[1:], 2):
        total = len(block) if n == len(pieces) else None
        own = rid.replace(">", f"-{n}>")
        yield header("continuation", own, len(piece), X_Page_ID=page_id, WARC_Segment_Origin_ID=rid, WARC_Segment_Number=n, WARC_Segment_Total_Length=total) + piece


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = 8192, chunk_bytes: int = 4096, file_bytes: int = 16 << 20) -> None:
    """Write gzip-compressed archives under path, of about file_bytes each before compression at most.

    A record holds at most segment_bytes besides its header, so that a number of records bounds a file whatever the pages' lengths (one record at least).

    Payload: html in UTF-8 (null: empty). Of equal payloads of at least min_revisit_bytes that with
    the smallest page_id is a response and the others revisit it. Rows that share the smallest
    page_id are all responses, as are payloads with null page_ids alone; a null page_id revisits any other. The smallest
    page of a payload is found by an aggregate, combined on the map side and saved, so that a
    hot payload's rows are only ever split further. Spark's text writer sets down each record; the line separator is what
    ends a WARC record.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    d = pages.select("page_id", "url", html.alias("html")).withColumn("sha", F.sha1("html"))
    groups = saved(d.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    d = d.join(groups, "sha", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = zip(*[c.to_pylist() for c in b.slice(at, 500).columns], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r for x in rows for r in page_records(*x, segment_bytes, chunk_bytes)], pa.binary())], ["record"])

    d.select("page_id", "url", "html", "first").mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", max(1, file_bytes // segment_bytes)).text(path)


RECORD = "record_id string, kind string, page_id long, refers_to string, digest string, origin string, segment int, total long, block binary"


PIECE = 1 << 20


def unzipped(data: bytes) -> Iterator[bytes]:
    """What the gzip members of an archive hold, as far as they can be read, in pieces of at most 1 MiB; other archives as they are."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[at : at + PIECE]) for at in range(0, len(view), PIECE))
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(view):
            given = bytes(view[at : at + PIECE])
            at += len(given)
            while given and not z.eof:
                try:
                    piece = z.decompress(given, PIECE)
                except zlib.error:
                    return
                given = z.unconsumed_tail
                if piece:
                    yield piece
        at -= len(z.unused_data)
        if not z.eof:
            yield z.flush()


class Cut(ValueError):
    """A record goes on beyond the bytes at hand."""


def one_record(data: bytes | bytearray, at: int) -> tuple[tuple, int]:
    """The record that begins at a place, and where it ends; ValueError if its header or length is wrong, Cut if more bytes may mend it."""
    if not data.startswith(b"WARC/1.", at):
        raise Cut if len(data) - at < 7 else ValueError("no record header")
    end = data.find(END, at)
    if end < 0:
        raise Cut
    lines = data[at:end].decode(errors="replace").split("\r\n")
    f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not {"content-length", "warc-record-id", "warc-type"} <= f.keys():
        raise ValueError("a header is missing")
    start = end + len(END)
    stop = start + int(f["content-length"])
    if stop < start:
        raise ValueError("a negative length")
    if stop > len(data):
        raise Cut
    number = lambda k: int(f[k]) if k in f else None
    rid = f["warc-record-id"]
    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (rid, f["warc-type"], number("x-page-id"), f.get("warc-refers-to"), digest, f.get("warc-segment-origin-id", rid), number("warc-segment-number"), number("warc-segment-total-length"), bytes(data[start:stop])), stop + len(END)


def parsed(data: bytes) -> Iterator[tuple]:
    """The records of one archive file, read as a stream: held are the file as stored and the record at hand, unzipped.

    What is no sound record, up to the next header that follows a blank line, is one of kind
    broken. A length that reaches beyond the end of the file shows there only, so the bytes after
    such a header are held until then.
    """
    pieces, held, at, ended, want = unzipped(data), bytearray(), 0, False, 0
    while True:
        while not ended and (len(held) - at < want or at >= len(held)):
            gone = min(at, len(held))
            del held[:gone]
            at -= gone
            piece = next(pieces, None)
            ended = piece is None
            held += piece or b""
        if at >= len(held):
            return
        try:
            record, at = one_record(held, at)
            want = 0
        except ValueError as e:
            more = -1 if isinstance(e, Cut) and not ended else held.find(END + b"WARC/1.", at)
            if more < 0 and not ended:
                want = 2 * (len(held) - at) + 1
                continue
            stop = more + len(END) if more >= 0 else len(held)
            record, at, want = (None, "broken", None, None, None, None, None, None, bytes(held[at:stop])), stop, 0
        yield record


def records(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records in the archives under path, segments as they stand; at most batch_bytes of them (one record at least) leave Python at a time."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for r in parsed(b.column(0)[i].as_py()):
                    if rows and (size + len(r[-1]) > batch_bytes or len(rows) == 1000):
                        yield batch(rows)
                        rows, size = [], 0
                    rows.append(r)
                    size += len(r[-1])
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def reassembled(recs: DataFrame) -> DataFrame:
    """Whole response and revisit records: record_id, kind, page_id, refers_to, digest, block, copies.

    Only segmented records are shuffled: grouped by origin identifier, put in the order of their
    segment numbers and joined. block is null unless the numbers run from 1 without a gap and the
    lengths add up to the stated total. Segments that occur several times with the same bytes (a
    repeated record) count once; copies says how often the first occurs.
    """
    whole = recs.where("segment is null").select("record_id", "kind", "page_id", "refers_to", "digest", "block", F.lit(1).cast("long").alias("copies"))
    s = recs.where("segment is not null").groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("segment", F.col("block").cast("string").alias("b")))).alias("s"), F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.count_if(F.col("segment") == 1).alias("copies")
    )
    block = F.array_join(F.col("s.b"), "").cast("binary")
    sound = (F.col("s.segment") == F.sequence(F.lit(1), F.size("s"))) & (F.octet_length(block) == F.col("total"))
    return whole.unionByName(s.select(F.col("origin").alias("record_id"), F.lit("response").alias("kind"), "page_id", F.lit(None).cast("string").alias("refers_to"), "digest", F.when(sound, block).alias("block"), "copies"))


def payloads(whole: DataFrame) -> DataFrame:
    """Decode the HTTP framing of response records: record_id, kind, page_id, refers_to, digest, copies, payload, found (the payload's own digest), valid (the digest stated is that). Broken records have neither payload nor validity."""
    names = ["record_id", "kind", "page_id", "refers_to", "digest", "copies"]

    def decoded(kind: str, digest: str | None, block: bytes | None) -> tuple[bytes | None, str | None, bool]:
        if kind != "response" or block is None:
            return None, None, kind == "revisit"
        try:
            data = http_payload(block)
        except ValueError:
            return None, None, False
        found = payload_digest(data)
        return data, found, digest in (None, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                x = b.slice(at, 500)
                done = [decoded(*r) for r in zip(x.column("kind").to_pylist(), x.column("digest").to_pylist(), x.column("block").to_pylist(), strict=True)]
                made = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.binary(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*[x.column(n) for n in names], *made], [*names, "payload", "found", "valid"])

    return whole.select(*names, "block").mapInArrow(run, "record_id string, kind string, page_id long, refers_to string, digest string, copies long, payload binary, found string, valid boolean")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pages in the archives under path: page_id, payload (null for revisits), valid, and the rest of `payloads`."""
    return payloads(reassembled(records(spark, path)))


def archived_pages(pages: DataFrame, **parameters) -> DataFrame:
    """Write pages to archives, read these back and say what became of each page.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, valid. Bytes and digest are those of the
    payload read back; a revisit's are of the record that it refers to, joined by identifier. Null html: an empty payload. An empty table gives
    no rows; a repeated page gives as many. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch(spark)
    write(pages, path, **parameters)
    d = saved(read(spark, path).select("record_id", "kind", "page_id", "refers_to", "found", "copies", F.octet_length("payload").cast("long").alias("payload_bytes"), "valid"))
    remove(spark, path)
    heads = saved(d.where("kind = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("page_id").alias("head"), F.first("payload_bytes").alias("head_bytes"), F.first("found").alias("head_found")))
    again = d.where("kind = 'revisit'").drop("payload_bytes").join(heads, "refers_to", "left")
    done = d.where("kind = 'response'").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    done = done.select("page_id", "payload_bytes", F.col("found").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "valid")
    return done.unionByName(again.select("page_id", F.col("head_bytes").alias("payload_bytes"), F.col("head_found").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("head").alias("refers_to"), (F.col("valid") & F.col("head").isNotNull()).alias("valid")))
