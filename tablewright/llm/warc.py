"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Every record is a gzip member of its own. Spark's text writer puts the members into files of
the shared folder, with an empty member as separator, so the files are plain ``.warc.gz``
content on any file system Spark knows. Files are read back whole, one at a time per task;
``records_per_file`` and ``bytes_per_file`` bound them. Spark's writer closes a file after a number of
rows, so a member of many bytes is followed by empty rows, which are further empty members.

The reader checks the checksum of each member, the length of each record and the digest of its
block. After a failed check it looks for the next member or version line that passes, goes on
there, and reports the bytes in between as a gap. In a member of several records the search for
version lines runs in its content, also in what a damaged member gives before it fails.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import shared_path, table

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = MAGIC + bytes([0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
#: payloads of fewer bytes are never replaced by a revisit
LEAST_BYTES = 100
RECORDS_PER_FILE = 20_000
#: a file holds no more than this and its last member
BYTES_PER_FILE = 1 << 26
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _named(page: int | str | None) -> str:
    return "<urn:page:" + ("" if page is None else quote(str(page), safe="")) + ">"


def record(
    page: int | str | None, url: str | None, payload: bytes, digest: str, refers: int | str | None, revisit: bool
) -> bytes:
    """The bytes of a record, its block being the payload, or nothing for a revisit."""
    block = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _named(page)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest() if revisit else digest}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=~")))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _named(refers))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Columns page, url, html, digest, refers, revisit become one member per row, and an empty one for every ``share`` bytes."""
    for batch in batches:
        step = max(1, min(256, (batch.num_rows << 23) // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            columns = [c.to_pylist() for c in batch.slice(at, step).columns]
            made = []
            for page, url, html, digest, refers, revisit in zip(*columns, strict=True):
                made.append(member(record(page, url, (html or "").encode(), digest, refers, revisit)))
                made += [b""] * (len(made[-1]) // share)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])


def write_pages(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE,
) -> None:
    """Writes one record per row to a new folder.

    Of the rows with equal payloads (html as UTF-8; null: empty) of ``least_bytes`` or more, that
    with the smallest id is a response and the others are revisits of it; rows that share this id
    too are all responses, and without any id all are. A null id is never the smallest. Null URLs
    have no field; other URLs are percent-encoded, and so are ids, which may be numbers or texts. An empty
    table gives archives without records. Smaller payloads meet no partner and are spread over the join.
    """
    digest = F.sha2(F.coalesce(F.col(html), F.lit("")).cast("binary"), 256)
    rows = pages.select(
        F.col(page_id).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), digest.alias("digest")
    )
    size = F.octet_length(F.coalesce(F.col(html), F.lit("")))
    firsts = pages.where(size >= least_bytes).groupBy(digest.alias("of")).agg(
        F.min(page_id).alias("first"), F.count("*").alias("n")
    ).where("n > 1").select("of", "first")
    small = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) < least_bytes
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64("page", "url"), F.lit(4096)).cast("string"))
    told = rows.withColumn("met", F.when(small, spread).otherwise(F.col("digest"))).join(
        firsts, F.col("met") == F.col("of"), "left"
    )
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    made = told.select("page", "url", "html", "digest", F.col("first").alias("refers"), revisit.alias("revisit")).mapInArrow(
        partial(_members, share=max(1, bytes_per_file // records_per_file)), "member binary"
    )
    made.select(F.col("member").cast("string").alias("value")).write.option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")
    ).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).option("compression", "none").text(path)


class Damaged(Exception):
    """A check failed."""


def _one_member(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the member at a place."""
    unpack = zlib.decompressobj(31)
    out, step = [], 1 << 14
    place = at
    try:
        while not unpack.eof and place < len(data):
            part = data[place : place + step]
            out.append(unpack.decompress(part))
            place += len(part)
            step = min(step * 2, 1 << 20)
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    if not unpack.eof:
        raise Damaged("member: cut off")
    return b"".join(out), place - len(unpack.unused_data)


def _one_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at a place."""
    if not VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Damaged("head: cut off")
    fields = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("head: a line without a colon")
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise Damaged("head: no length")
    begin, end = head_end + 4, head_end + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block: its end is not where the length says")
    block = data[begin:end]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise Damaged("block: wrong digest")
    return fields, block, end + 4


def _content_so_far(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int]:
    """What a damaged member still gives (``most`` bytes, or a few more), and how far it was read."""
    unpack = zlib.decompressobj(31)
    out, size, place, step = [], 0, at, 1 << 14
    while not unpack.eof and place < len(data) and (most is None or size < most):
        before = unpack.copy() if step > 1 else None
        part = data[place : place + step]
        try:
            got = unpack.decompress(part)
        except zlib.error:
            if step == 1:
                break
            unpack, step = before, 1  # up to the byte that fails
            continue
        if most is not None and step > 1 and size + len(got) >= most:
            unpack, step = before, 1
            continue
        out.append(got)
        size += len(got)
        place += len(part)
    return b"".join(out), place


def _inside(content: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """The same as ``salvage`` for bare records in the content of a member."""
    at, gap, reason = 0, -1, ""
    while at < len(content):
        try:
            fields, block, end = _one_record(content, at)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            at = content.find(VERSION[:7], at + 1)
            at = len(content) if at < 0 else at
            continue
        if gap >= 0:
            yield gap, at, None, reason
            gap = -1
        yield at, end, fields, block
        at = end
    if gap >= 0:
        yield gap, len(content), None, reason


class _Places:
    """The next member or version line of the data; each is searched once, however often a check fails."""

    def __init__(self, data: bytes):
        self.data, self.next = data, {MAGIC: -1, VERSION[:7]: -1}

    def after(self, at: int) -> int:
        """The first place at or behind one that never goes back; the end if there is none."""
        for mark, place in self.next.items():
            if place < at:
                found = self.data.find(mark, at)
                self.next[mark] = len(self.data) if found < 0 else found
        return min(self.next.values())


def _unit(data: bytes, at: int) -> tuple[list[tuple[dict[str, str] | None, bytes | str]], int, str | None]:
    """What the member or bare record at a place has, the place to go on, and why the member failed.

    Gaps are (None, reason). Of a member whose checksum or end is wrong the records that carry
    a digest and pass stay; a record that is all there is of such a member is lost with it, as
    nothing else vouches for its head.
    """
    if not data.startswith(MAGIC, at):
        fields, block, end = _one_record(data, at)
        return [(fields, block)], end, None
    try:
        content, end = _one_member(data, at)
        failed = None
    except Damaged as e:
        failed = e
        content, end = _content_so_far(data, at)
    found = list(_inside(content))
    good = [f for f in found if f[2] is not None]
    if failed:
        good = [f for f in good if f[2].get("warc-block-digest", "").startswith("sha256:")]
        if not good or (good[0][0], good[0][1]) == (0, len(content)):
            raise failed
        # the bytes before the end of the last good record are this member's
        _, end = _content_so_far(data, at, good[-1][1])
        return [f[2:] for f in good], end, str(failed)
    if found and not good:
        raise Damaged(found[0][3])
    return [
        (fields, block if fields is not None else f"{block}; bytes {a} to {b} of the member's content")
        for a, b, fields, block in found
    ], end, None


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """(start, end, fields, block) of each record that passes, (start, end, None, reason) of each gap.

    A gap inside a member has the member's bounds and names its bytes of the content. The gap of a
    member that fails as a whole begins where the member does, whatever of it was saved; the
    records saved from it end where the last of them does.
    """
    at, gap, reason, places = 0, -1, "", _Places(data)
    while at < len(data):
        try:
            found, end, failed = _unit(data, at)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            at = places.after(at + 1)
            continue
        if gap >= 0:
            yield gap, at, None, reason
            gap = -1
        for fields, block in found:
            yield at, end, fields, block
        if failed:
            gap, reason = at, failed
            end = places.after(end)
        at = end
    if gap >= 0:
        yield gap, len(data), None, reason


SCHEMA = (
    "file string, start long, end long, gap string, record_type string, page_id {ids}, url string, refers_to {ids}, "
    "payload_digest string, payload_bytes long, payload binary"
)


def _urn(value: str | None, ids: str) -> int | str | None:
    name = unquote((value or "").removeprefix("<urn:page:").removesuffix(">"))
    if ids == "string":
        return name or None
    return int(name) if name.removeprefix("-").isdecimal() else None


def _read(batches: Iterator[pa.RecordBatch], payloads: bool, names: list[str], ids: str) -> Iterator[pa.RecordBatch]:
    page = pa.string() if ids == "string" else pa.int64()
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 2, page, pa.string(), page, pa.string(), pa.int64(), pa.binary()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for k in range(batch.num_rows):
            file, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            rows, held = [], 0
            for start, end, fields, block in salvage(data):
                if fields is None:
                    rows.append((file, start, end, block, *[None] * 7))
                else:
                    revisit = fields.get("warc-type") == "revisit"
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    uri = fields.get("warc-target-uri")
                    rows.append((
                        file, start, end, None, fields.get("warc-type"), _urn(fields.get("warc-record-id"), ids),
                        None if uri is None else unquote(uri), _urn(fields["warc-refers-to"], ids) if "warc-refers-to" in fields else None,
                        digest if revisit else hashlib.sha256(block).hexdigest(),
                        int(fields.get("x-payload-length", 0)) if revisit else len(block), block if payloads else None,
                    ))
                    held += len(block) if payloads else 100
                if held > 1 << 22:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, ids: str = "long") -> DataFrame:
    """One row per record or gap of the archives in a folder.

    Records: file, start and end (of the member), record_type, page_id, url, refers_to,
    payload_digest and payload_bytes (of a revisit: as written in its head), payload (with
    ``payloads``). Gaps: file, start, end and the reason in gap; the bytes stay where they are.
    ``ids`` is the type of the pages' ids, long or string; an id that does not fit is null, and so is the
    empty text. Archives without records give no rows.
    """
    if ids not in ("long", "string"):
        raise ValueError(f"ids are long or string, not {ids}")
    schema = SCHEMA.format(ids=ids)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return files.mapInArrow(partial(_read, payloads=payloads, names=names, ids=ids), schema)


def op4_warc_salvage(spark, sf_dir):
    path = shared_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False)
    return found.where(F.col("gap").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_salvage": op4_warc_salvage}

ORACLES = {
    "op4_warc_salvage": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f""",
}
