"""WARC archives: writing with deduplication and segmentation, and reading with segment reassembly.

Writing gives a response record per page (an HTTP message with chunked transfer framing), or a revisit record where the
same payload is kept by another page. A block longer than ``segment_bytes`` is cut into a first segment and continuation
records. Records are packed into archives of bounded size, which Spark's own writer puts out, so any store that
Spark writes to will do. Reading parses the archives, groups continuation records by their origin's identifier, orders
them by segment number, verifies the total length, and decodes the chunked framing.

Defined results: null html is an empty payload. Of equal payloads of at least ``min_bytes`` the largest page id is the response; rows
that repeat that id with the same payload are responses too, and a revisit names one of them. Every record has an identifier of its own, and
what a revisit refers to is the identifier of a response. Null urls are left out of the record; line breaks in urls become
spaces, and blanks and control characters at both ends of a url don't come back. An archive is one gzip member, so it is read from its beginning. A page without an id is written and comes back without one and is never referred to if another has one. Records with a missing segment, a
wrong length, a broken framing or a wrong digest come back with ``complete`` false and no payload. Very long pages are taken whole: a task holds one archive, or
one page where that is longer. Empty tables give no archives and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_batch, stored

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
ARCHIVE_BYTES = 8 * 1024 * 1024
#: Groups of equal payloads that are sent to all tasks; with more of them they are joined by shuffle.
BROADCAST_GROUPS = 200_000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for a in range(0, len(payload), size):
        piece = payload[a : a + size]
        parts.append(b"%x\r\n%s\r\n" % (len(piece), piece))
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload in a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        size = int(body[at:eol].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        piece = body[eol + 2 : eol + 2 + size]
        if len(piece) != size or body[eol + 2 + size : eol + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(piece)
        at = eol + 4 + size


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block


def identifier(page_id: int | None, unique: int) -> str:
    """A record's identifier: the page's id and what tells its rows apart."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{unique & 2**64 - 1:016x}>"


def page_records(page_id: int | None, unique: int, url: str | None, payload: bytes, keeper: tuple[int, int] | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page. ``keeper``: id and ``unique`` of the page that keeps the payload, for a revisit."""
    base = identifier(page_id, unique)
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
    if url is not None:
        common.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if keeper is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", base), ("WARC-Profile", PROFILE), ("WARC-Refers-To", identifier(*keeper)), *common, kind]
        yield record(fields, f"{http}Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", base), *common, kind], block)
        return
    pieces = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    for number, piece in enumerate(pieces, 1):
        if number == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", base), *common, kind, ("WARC-Segment-Number", "1")]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{base[:-1]}:{number}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
            fields += [("WARC-Segment-Origin-ID", base), ("WARC-Segment-Number", str(number))]
            if number == len(pieces):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(fields, piece)


def write_archives(df: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes gzip-compressed archives below ``path``."""
    pages = df.select(df[id_col].cast("bigint").alias("id"), df[url_col].alias("url"), F.coalesce(df[html_col], F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("unique", F.xxhash64("url", "sha"))
    # One small row for each page of a payload goes to the exchange; only repeated payloads are joined back.
    each = stored(pages.groupBy("sha", "id", "unique").agg(F.count("*").alias("n"), F.min(F.octet_length("html")).alias("size")), "payloads")
    if not each.filter("n > 1").isEmpty():
        # Rows that are equal in all of this are numbered instead, once, as both sides of the join must agree on the numbers.
        pages = stored(pages.withColumn("unique", F.monotonically_increasing_id()), "pages")
        each = pages.groupBy("sha", "id", "unique").agg(F.count("*").alias("n"), F.min(F.octet_length("html")).alias("size"))
    groups = each.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.max(F.struct("id", "unique")).alias("keeper"), F.sum("n").alias("n")).filter("n > 1 and keeper.id is not null")
    groups = groups.select(F.col("sha").alias("group_sha"), "keeper")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    joined = pages.join(groups, F.col("sha") == F.col("group_sha"), "left")
    other = ~F.col("keeper.id").eqNullSafe(F.col("id"))
    chosen = joined.select("id", "unique", "url", "html", F.when(other, F.col("keeper.id")).alias("keeper"), F.when(other, F.col("keeper.unique")).alias("keeper_unique"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (part for whole in batches for part in cut_batch(whole, "html")):
            frame = batch.to_pydict()  # integers stay whole beside nulls
            for page, unique, url, html, *keeper in zip(*[frame[c] for c in ("id", "unique", "url", "html", "keeper", "keeper_unique")], strict=True):
                for r in page_records(page, unique, url, html.encode(), None if keeper[0] is None else tuple(keeper), segment_bytes):
                    held.append(r)
                    size += len(r)
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_pydict({"value": pa.array([END.join(held)], pa.binary())})
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array([END.join(held)], pa.binary())})

    # The writer closes each row, that is each archive, with the line ends that close its last record. The cast keeps all bytes.
    archives = chosen.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive (plain or gzip, with one or many members)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        stop = data.index(END, at)
        lines = data[at:stop].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        if len(block) != length:
            raise ValueError("an archive ends within a record")
        yield fields, block
        at = stop + 8 + length


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _page(name: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)", name or "")
    return int(found[1]) if found else None


ROW = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, complete boolean"
PIECE = "origin string, number int, total bigint, block binary"


def _finished(fields: dict[str, str], block: bytes | None) -> dict:
    """The row of a whole record; ``block`` is None if segments are missing."""
    revisit = fields.get("warc-type") == "revisit"
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    out = {"page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": "revisit" if revisit else "response", "refers_to": _page(fields.get("warc-refers-to")), "payload_digest": stated, "payload_bytes": None, "payload": None, "complete": False}
    if revisit:
        found = re.search(rb"(?i)content-length:\s*(\d+)", block or b"")
        return out | {"payload_bytes": found and int(found[1]), "complete": found is not None}
    try:
        payload = payload_of(block) if block is not None else None
    except ValueError:
        payload = None
    if payload is not None and stated in (None, digest(payload)):
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload), "complete": True}
    return out


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    frame = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})
    for n, kind in (x.split() for x in schema.split(", ")):
        if kind in ("bigint", "int"):
            frame[n] = frame[n].astype("Int64" if kind == "bigint" else "Int32")
    return frame


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row per page: see ``ROW``. Only records that were cut into segments are shuffled, each by its own identifier."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                rows = [_finished(f, b) for f, b in parse(data) if "warc-segment-number" not in f]
                for r in rows if not payloads else ():
                    r["payload"] = None
                if rows:
                    yield _frame(rows, ROW)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                rows = []
                for f, b in parse(data):
                    if "warc-segment-number" in f:
                        number = int(f["warc-segment-number"])
                        head = record([(k, v) for k, v in f.items() if k != "content-length"], b) if number == 1 else b
                        rows.append({"origin": f["warc-record-id"] if number == 1 else f.get("warc-segment-origin-id"), "number": number, "total": f.get("warc-segment-total-length"), "block": head})
                for r in rows:
                    r["total"] = None if r["total"] is None else int(r["total"])
                if rows:
                    yield _frame(rows, PIECE)

    def reassemble(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("number").sort_values("number")
        numbers, blocks = group["number"].tolist(), group["block"].tolist()
        if numbers[0] != 1:
            return _frame([], ROW)
        fields, first = next(parse(blocks[0]))
        block = b"".join([first, *blocks[1:]])
        total = group["total"].dropna().tolist()
        ok = numbers == list(range(1, len(numbers) + 1)) and len(total) == 1 and int(total[0]) == len(block)
        row = _finished(fields, block if ok else None)
        return _frame([row if payloads else row | {"payload": None}], ROW)

    return files.mapInPandas(whole, ROW).unionByName(files.mapInPandas(cut, PIECE).groupBy("origin").applyInPandas(reassemble, ROW))


def round_trip(df: DataFrame, path: str, **options) -> DataFrame:
    """Writes the archives of a table of pages and reads them back, without payloads."""
    write_archives(df, path, **options)
    return read_archives(df.sparkSession, path, payloads=False)
