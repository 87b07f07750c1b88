"""WARC archives: one gzip member per record, written and read by Spark's own file access, read in byte ranges.

Archives are written by the text writer, whose lines are whole gzip members and whose line separator is an empty one; a file
is thus plain multi-member gzip. They are read by the text source with the first bytes of a member as separator: each task
scans its byte range and owns the members that start inside, wherever the files lie. As those bytes can also occur inside
compressed data, every candidate is proved by decoding it. Names do not matter: Spark would unpack a file called .gz as a
whole, so such files are read under other names, by links of a view file system that exists in the reader's options only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small

#: How a gzip member begins, and a whole member without content.
MAGIC = b"\x1f\x8b\x08"
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")
#: Records of equal payloads shorter than this are all written in full.
MIN_REVISIT = 100
ID, NO_ID = "urn:page:", "urn:no-page"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_type string, page_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"


def member(raw: bytes) -> bytes:
    """raw as one gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record: a response with its payload, or a revisit that names the response and has the HTTP head only."""
    name = f"<{ID}{quote(page_id, safe='')}>" if page_id is not None else f"<{NO_ID}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{quote(refers_to, safe='')}>"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The FIELDS of a record of any writer: names of fields in any case, ids other than ours as they stand, without brackets.

    payload is what follows the HTTP head where the content is HTTP, else the whole block. A revisit has none: its digest is
    the one told (without a sha256 label, others as they stand) and its length that of the HTTP head; null if not told.
    """
    head, _, block = raw.partition(b"\r\n\r\n")
    told = {k.lower(): v.strip() for k, v in re.findall(r"^([^\s:]+):(.*)$", head.decode("utf-8", "replace").replace("\r", ""), re.M)}
    block = block[: int(told.get("content-length") or len(block))]

    def page(name: str) -> str | None:
        value = told.get(name, f"<{NO_ID}>").removeprefix("<").removesuffix(">")
        return unquote(value[len(ID) :]) if value.startswith(ID) else None if value == NO_ID else value

    kind, uri = told.get("warc-type"), told.get("warc-target-uri", "").removeprefix("<").removesuffix(">") if "warc-target-uri" in told else None
    is_http = told.get("content-type", "").lower().replace(" ", "").startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        return kind, page("warc-record-id"), page("warc-refers-to"), uri, int(size[1]) if size else None, told.get("warc-payload-digest", "").removeprefix("sha256:") or None, None
    return kind, page("warc-record-id"), page("warc-refers-to"), uri, len(payload), hashlib.sha256(payload).hexdigest(), payload


class Scan:
    """Joins the pieces between magics into members: fed one by one, it yields records, and pieces that it cannot place."""

    def __init__(self) -> None:
        self.open: list[bytes] = []
        self.out = zlib.decompressobj(31)
        self.text: list[bytes] = []

    def feed(self, piece: bytes) -> tuple[str, bytes | None]:
        """('record', text), ('', None) if more is to come or nothing was in it, or ('stray', None): piece begins no member."""
        fresh = not self.open
        self.open.append(piece)
        try:
            self.text.append(self.out.decompress(MAGIC + piece))
            if fresh and self.text[0][:5] != b"WARC/"[: len(self.text[0])]:
                raise zlib.error
        except zlib.error:
            self.__init__()
            return "stray", None
        if not self.out.eof:
            return "", None
        text = b"".join(self.text)
        self.__init__()
        return ("record", text) if text else ("", None)


def _plainly_named(spark: SparkSession, path: str) -> tuple[list[str], dict[str, str]]:
    """Paths under which the text source reads the files at path byte by byte, and the options that these paths need.

    Only names that end like a compressed file's get a link. The list of files is what Spark's own index holds on the driver.
    """
    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    packed = [f for f in files if re.search(r"\.(gz|bz2|deflate|zst|lz4|snappy)$", f)]
    if not packed:
        return [path], {}
    view = f"warc{uuid.uuid4().hex}"
    options = {f"fs.viewfs.mounttable.{view}.link./f{i}": f for i, f in enumerate(packed)}
    plain = [f for f in files if f not in set(packed)]
    return [f"viewfs://{view}/f{i}" for i in range(len(packed))] + plain, options


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row of FIELDS for every record in the archives at path (without payload if that isn't wanted); an archive that ends within a record raises.

    The archives are scanned once, and what was found is written to the shared folder. Pieces at the borders of byte ranges
    that a task cannot place (a magic inside compressed data may have been taken for a border) go with their places to a
    second step, which joins them file by file; they are few, as such magics are.
    """
    paths, options = _plainly_named(spark, path)
    lines = spark.read.options(**options).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths)
    lines = lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scanner, nth, kept = None, Scan(), 0, []

        def left(kept):
            return [(None,) * 7 + (now[0], now[1], n, p) for n, p in kept]

        for batch in batches:
            rows = []
            for piece, file, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, start) != now:
                    rows += left(kept)
                    now, scanner, nth, kept = (file, start), Scan(), 0, []
                    if start == 0 and not piece:
                        continue  # what stands before the first magic
                nth += 1
                kept.append((nth, piece))
                what, text = scanner.feed(piece)
                if what == "stray":
                    rows += left(kept)
                    kept = []
                elif not scanner.open:
                    kept = []
                    if what:
                        rows.append(parse(text) + (None, None, None, None))
            yield from packed(rows)
        yield from packed(left(kept) if now else [])

    names = [*(f.split()[0] for f in FIELDS.split(", ")), "file", "start", "nth", "piece"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def packed(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    fields = names[:7] if payloads else names[:6]
    found = materialize(lines.mapInArrow(scan, FIELDS + ", file string, start long, nth long, piece binary").select(*fields, *names[7:]))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        scanner, rows = Scan(), []
        for piece in group.sort_values(["start", "nth"])["piece"]:
            what, text = scanner.feed(piece)
            if what == "stray":
                raise ValueError(f"damaged archive: {group['file'].iloc[0]}")
            if what:
                rows.append(parse(text))
        if scanner.open:
            raise ValueError(f"archive ends within a record: {group['file'].iloc[0]}")
        return pd.DataFrame(rows, columns=names[:7])

    border = found.where("piece IS NOT NULL").select(*names[7:]).groupBy("file").applyInPandas(join, FIELDS)
    return found.where("piece IS NULL").select(*fields).unionByName(border.select(*fields))


def write_warc(pages: DataFrame, path: str, page_id="page_id", url="url", html="html", min_revisit: int = MIN_REVISIT) -> None:
    """Writes one record per row into archives under path.

    Of rows with equal payloads of min_revisit bytes or more, those with the smallest page_id are responses, the others
    revisit it. Null html is an empty payload; null ids revisit, and are no one's response unless all are null (then all are
    responses). Repeated rows are written each. An empty table writes no record. Payloads are not exchanged between tasks as
    long as the repeated digests fit the broadcast bound.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    same = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    same = small(materialize(same.select(F.col("digest").alias("d"), "first")))
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))

    @F.arrow_udf("binary")
    def packed(page: pa.Array, url: pa.Array, payload: pa.Array, digest: pa.Array, refers_to: pa.Array) -> pa.Array:
        columns = (c.to_pylist() for c in (page, url, payload, digest, refers_to))
        return pa.array([member(record(*row)) for row in zip(*columns, strict=True)], pa.binary())

    joined = rows.join(same, F.col("digest") == F.col("d"), "left")
    made = packed(F.col("page").cast("string"), "url", "payload", "digest", refers.cast("string")).cast("string")
    joined.select(made.alias("value")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def round_trip(pages: DataFrame, path: str, page_id="page_id", url="url", html="html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes the archives to path, then reads them: page_id, payload_bytes, payload_digest, record_type, refers_to of each record."""
    write_warc(pages, path, page_id, url, html, min_revisit)
    kind = dict(pages.dtypes)[page_id]
    read = read_warc(pages.sparkSession, path, payloads=False)
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
