"""Write pages as WARC records and read archives back.

Long payloads are cut into segments: a first record and continuation records that name it. The reader groups the
segments by the record they continue, orders them by number, checks the total length and removes the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworth.llm.common import written
from tallyworth.session import scratch_path

VERSION = b"WARC/1.1"
LINE, END = b"\r\n", "\r\n\r\n"
# Bytes of a block above which it is cut into segments; bytes of a chunk of a payload.
SEGMENT, CHUNK = 64 << 10, 16 << 10
# Rows per archive file: a reading task holds one file at a time.
FILE_ROWS = 2_000
# Compressed bytes that are unpacked at a time.
_FED = 1 << 18
_DATE = b"2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; raises ValueError where the framing is broken."""
    at, out = 0, []
    while True:
        end = body.index(LINE, at)
        size = int(body[at:end].partition(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != LINE:
            raise ValueError("a chunk does not end where it says")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record up to the two line ends that close it."""
    head = b"".join(b"%b: %b\r\n" % f for f in fields)
    return VERSION + LINE + head + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records_of(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of a row by its name: a revisit without a body, or a response in as many segments as it needs."""
    name = name.encode()
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m.group()[0], (url or "").encode("utf-8", "surrogatepass"))
    about = [(b"WARC-Target-URI", target)] if target else []
    about += [(b"WARC-Date", _DATE), (b"WARC-Payload-Digest", b"sha1:" + digest.encode())]
    if refers_to is not None:
        refers = (b"WARC-Refers-To", b"<%b>" % refers_to.encode())
        profile = (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        first = [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", b"<%b>" % name), *about, refers, profile]
        return [record(first, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", b"<%b>" % name), *about, (b"Content-Type", b"application/http; msgtype=response")]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [record(kind, block)]
    out = [record([*kind, (b"WARC-Segment-Number", b"1")], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        own = [
            (b"WARC-Type", b"continuation"),
            (b"WARC-Record-ID", b"<%b:segment:%d>" % (name, number)),
            (b"WARC-Date", _DATE),
            (b"WARC-Segment-Origin-ID", b"<%b>" % name),
            (b"WARC-Segment-Number", b"%d" % number),
        ]
        if number == len(parts):
            own.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(record(own, part))
    return out


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """name, url, payload and refers_to of every row: the names of its own record and of the one it refers to.

    A row refers to the largest page_id with the same payload, null for that page itself. Payloads under `least` bytes
    never refer. A null page_id is the smallest; a payload that only such rows have refers to none. The name is the page_id
    (`none` without one); where that is repeated, a digest of url and payload and, among rows that are
    equal in all, a number follow. Equal payloads are counted before they are shuffled, and the join back is one that
    Spark splits where a payload is very common. Rows equal in all are merged and dealt out again, so their numbers
    need no order of the rows.
    """
    page = F.col("page_id").cast("long")
    rows = pages.select(
        page.alias("page_id"),
        F.coalesce(page.cast("string"), F.lit("none")).alias("_page"),
        "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("_sum", F.concat(F.sha2("payload", 256), F.lit(":"), F.octet_length("payload")))
    rows = rows.withColumn("_own", F.sha2(F.concat("_sum", F.coalesce(F.concat(F.lit(":"), "url"), F.lit(""))), 256))
    kinds = written(rows.groupBy("_sum", "_page", "page_id", "_own").agg(F.count(F.lit(1)).alias("_rows")), "archive-kinds")
    ids = kinds.groupBy("_page").agg(F.sum("_rows").alias("_n")).filter(F.col("_n") > 1)
    repeated = written(ids.select("_page", F.lit(True).alias("_repeated")), "archive-repeated")
    plain = F.concat(F.lit("urn:page:"), F.col("_page"))
    base = F.when(F.col("_repeated"), F.concat(plain, F.lit(":"), "_own")).otherwise(plain)
    named = kinds.join(repeated, "_page", "left").select("_sum", "page_id", "_own", "_rows", "_repeated", base.alias("_base"))
    # the record of the largest page_id with a payload, the first of those that are equal in all
    first = F.when(F.col("_repeated"), F.concat("_base", F.lit(":1"))).otherwise(F.col("_base"))
    largest = named.groupBy("_sum").agg(
        F.max(F.struct("page_id", first.alias("name"))).alias("_largest"), F.sum("_rows").alias("_all")
    )
    shared = largest.filter(F.col("_all") > 1).select("_sum", F.col("_largest.page_id").alias("_id"), F.col("_largest.name").alias("_name"))
    other = F.col("_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("page_id")) & (F.octet_length("payload") >= least)

    def referring(some: DataFrame, name: Column) -> DataFrame:
        return some.join(shared, "_sum", "left").select(name.alias("name"), "url", "payload", F.when(other, F.col("_name")).alias("refers_to"))

    if repeated.isEmpty():
        return referring(rows, plain)
    # the payloads of rows with an id of their own are not touched by the rest
    again = rows.join(repeated, "_page")
    merged = again.groupBy("_sum", "_page", "page_id", "_own").agg(F.first("url").alias("url"), F.first("payload").alias("payload"), F.count(F.lit(1)).alias("_rows"))
    dealt = merged.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).repartition("_own", "_k")
    numbered = F.concat(plain, F.lit(":"), "_own", F.lit(":"), F.col("_k").cast("string"))
    alone = rows.join(repeated, "_page", "left_anti")
    return referring(alone, plain).unionByName(referring(dealt, numbered))


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, file_rows: int = FILE_ROWS) -> None:
    """Write a record per row of `pages` (page_id, url, html) as compressed archives under `path`.

    Null html is an empty payload, a null url leaves the target out. Rows of a repeated page_id are
    all written, each under a name of its own, and so are rows without a page_id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, url, payload, refers in zip(*(batch.column(c) for c in ("name", "url", "payload", "refers_to"))):
                body = payload.as_py()
                out += records_of(name.as_py(), url.as_py(), body, digest_of(body), refers.as_py(), segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], ["record"])

    rows = with_revisits(pages, least)
    records = rows.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
    # Spark's text sink writes the bytes as they are, with the end of a record as its line separator.
    writer = records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_rows)
    writer.mode("overwrite").text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive in stretches, from all its gzip members one after the other; plain bytes as they are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    member = None
    for at in range(0, len(content), _FED):
        data = content[at : at + _FED]
        while data:
            if member is None:
                data = data.lstrip(b"\0")  # padding between or after members
                if not data:
                    break
                member = zlib.decompressobj(31)
            yield member.decompress(data)
            data = member.unused_data
            member = None if member.eof else member
    if member is not None:
        raise ValueError("the archive ends within a gzip member")


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record; raises ValueError on a broken archive.

    A compressed archive may hold one gzip member, one for each record, or any other number. Of what is unpacked, no more
    is held than the record at hand and one stretch.
    """
    stretches, data, at = unpacked(content), bytearray(), 0

    def more() -> bool:
        stretch = next(stretches, None)
        data.extend(stretch or b"")
        return stretch is not None

    while True:
        while len(data) - at < 5 and more():
            pass
        if len(data) == at:
            return
        if not data.startswith(b"WARC/", at):
            raise ValueError("a record does not start where the last one ended")
        while (head_end := data.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("a record has no end of its headers")
        start = data.index(LINE, at) + 2
        headers = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(bytes(data[start : head_end + 2]))}
        begin = head_end + 4
        end = begin + int(headers["content-length"])
        while len(data) < end + 4 and more():
            pass
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record is shorter than it says")
        yield headers, bytes(data[begin:end])
        at = end + 4
        if at > _FED:
            del data[:at]
            at = 0


_PARTS = (
    "name string, target string, kind string, stated string, refers string, number int, total long, digest string, bytes long, "
    "payload binary, piece binary"
)
_KINDS = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
# Bytes of blocks after which a reading task hands on what it has.
_FLUSH = 8 << 20


def _named(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _response(block: bytes) -> bytes:
    """The payload of a whole response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _part(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A row of _PARTS: a whole response is measured at once, a segment keeps its block."""
    kind, number = headers["warc-type"], headers.get("warc-segment-number")
    name = headers.get("warc-segment-origin-id") if kind == "continuation" else headers["warc-record-id"]
    whole = _response(block) if kind == "response" and number is None else None
    total = headers.get("warc-segment-total-length")
    return (
        _named(name),
        headers.get("warc-target-uri"),
        kind,
        headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        _named(headers.get("warc-refers-to")),
        int(number or 0),
        None if total is None else int(total),
        None if whole is None else digest_of(whole),
        None if whole is None else len(whole),
        whole if payloads else None,
        block if number is not None else None,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, type=k) for c, k in zip(zip(*rows), _KINDS)]
    return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in _PARTS.split(", ")])


def join_segments(pieces: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of a segmented record: all numbers from 1 must be there, and the length must be the one stated."""
    ordered = sorted(pieces, key=lambda p: p[0])
    if [p[0] for p in ordered] != list(range(1, len(ordered) + 1)):
        raise ValueError("a segment is missing")
    block = b"".join(p[1] for p in ordered)
    if total is None or len(block) != total:
        raise ValueError("the segments are not as long as stated")
    return block


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """name, target, record_type, stated digest, digest and bytes of the payload as read, refers_to, and the payload.

    A revisit has no payload of its own: its payload, bytes and digest are those of the record it refers to. Raises
    where an archive, a segmented record or a chunked body is incomplete. With `payloads` false the payloads are
    dropped once they are measured.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for value in batch.column("content"):
                for headers, block in parse_archive(value.as_buffer().to_pybytes()):
                    rows.append(_part(headers, block, payloads))
                    held += len(block)
                    if held > _FLUSH:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                block = join_segments([(p["number"], p["piece"]) for p in row["pieces"]], row["total"])
                whole = _response(block)
                rows.append(
                    (row["name"], row["target"], "response", row["stated"], None, 0, None, digest_of(whole), len(whole), whole if payloads else None, None)
                )
            if rows:
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    parts = written(files.select("content").mapInArrow(parse, _PARTS), "archive-parts")
    # A group holds the segments of one record, so it is as large as that record.
    segments = parts.filter("number > 0").groupBy("name").agg(
        F.max("target").alias("target"),
        F.max("stated").alias("stated"),
        F.max("total").alias("total"),
        F.collect_list(F.struct("number", "piece")).alias("pieces"),
    )
    whole = parts.filter("number = 0").unionByName(segments.mapInArrow(reassemble, _PARTS))
    found = written(whole.drop("number", "total", "piece"), "archive-records")
    columns = ["name", "target", F.col("kind").alias("record_type"), "stated", "digest", "bytes", F.col("refers").alias("refers_to")]
    columns += ["payload"] if payloads else []
    responses = found.filter("kind = 'response'")
    origins = responses.select(F.col("name").alias("refers"), "digest", "bytes", "payload")
    revisits = found.filter("kind = 'revisit'").drop("digest", "bytes", "payload").join(origins, "refers", "left")
    return responses.select(*columns).unionByName(revisits.select(*columns))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages as archives into the shared folder and read them back, without payloads."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path, payloads=False)
