"""WARC archives: a writer with a gzip member per record, and a reader that salvages what a damaged archive still holds.

The writer goes through Spark's text sink, which commits whole files on any Hadoop file system: a record's gzip member is
handed over as a line and the line separator is one zero byte. The last byte of a member is the high byte of its length,
zero for records under 16 MiB, so for those the separator is that byte; a longer member keeps all its bytes and the
separator stands as padding, which readers of gzip skip.

Files are bounded by bytes: a task begins a new archive when the one it writes has ``archive_bytes``, and the driver gives
the committed files their ``.warc.gz`` names. A revisit's record needs no payload, so only responses move with theirs.

The reader checks each member's CRC, its version line, its block length and its payload digest. After a failed check it
searches for the next valid member (or, in plain archives, the next version line that begins a whole record), goes on from
there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.common import written
from groundline.sources.scratch import scratch_path

MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/\d+\.\d+\r?\n")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
LOG = "path string, gap_start long, gap_end long, reason string"
#: Pieces of a hot payload in the join that tells its pages which of them is the response; rows of that join have no payload.
SALT = 64
ARCHIVE_BYTES = 64 << 20


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def encode(page_id: int | None, url: str | None, record_type: str, refers_to: int | None, payload: bytes, digest: str, n_bytes: int) -> bytes:
    """One record, uncompressed. A revisit has no block; its fields tell the payload's digest, length and response."""
    block = payload if record_type == "response" else b""
    fields = [
        ("WARC-Type", record_type), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Payload-Length", n_bytes), ("X-Page-ID", page_id),
        ("WARC-Refers-To", record_id(refers_to) if record_type == "revisit" else None), ("X-Refers-To-Page-ID", refers_to if record_type == "revisit" else None),
        ("WARC-Profile", PROFILE if record_type == "revisit" else None), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(block)),
    ]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields if v is not None) + b"\r\n" + block + b"\r\n\r\n"


def compress(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def decode(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the position after it; ValueError, telling which check failed."""
    if not (m := VERSION.match(data, at)):
        raise ValueError("no version line")
    if (end := data.find(b"\r\n\r\n", m.end() - 2)) < 0:
        raise ValueError("header cut short")
    fields = {}
    for line in data[m.end():end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        raise ValueError("bad length") from None
    begin = end + 4
    if length < 0 or data[begin + length:begin + length + 4] != b"\r\n\r\n":
        raise ValueError("block length is off")
    payload = data[begin:begin + length]
    try:
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in fields else hashlib.sha1(payload).hexdigest()
    except ValueError:
        raise ValueError("bad digest") from None
    kind = fields.get("warc-type", "")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")

    def number(name: str) -> int | None:
        value = fields.get(name, "")
        return int(value) if re.fullmatch(r"-?\d{1,19}", value) and -(2**63) <= int(value) < 2**63 else None

    n_bytes = number("x-payload-length")
    return {
        "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("x-refers-to-page-id"),
        "payload_bytes": len(payload) if kind == "response" or n_bytes is None else n_bytes, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }, begin + length + 4


def salvage(data: bytes) -> Iterator[tuple[dict | None, tuple[int, int, str] | None]]:
    """Records of an archive, compressed by member or plain, as ``(record, None)``; gaps as ``(None, (start, end, reason))``.

    Every whole record outside the damage is found again: the search for the next one tries each place where a member's
    magic or a version line stands. Zero bytes between members are padding and no gap.
    """
    p, n = 0, len(data)
    gap: tuple[int, str] | None = None
    view = memoryview(data)
    while p < n:
        if data[p] == 0 and gap is None:
            p += 1
            continue
        try:
            if data.startswith(MAGIC, p):
                found, after = _member(view, p)
            else:
                record, after = decode(data, p)
                found = [record]
        except ValueError as e:
            gap = gap or (p, str(e))
            p = _next_start(data, p + 1)
            continue
        if gap:
            yield None, (gap[0], p, gap[1])
            gap = None
        for record in found:
            yield record, None
        p = after
    if gap:
        yield None, (gap[0], n, gap[1])


def _member(view: memoryview, at: int) -> tuple[list[dict], int]:
    """The records of the gzip member at ``at`` and the position after it, fed in pieces so that the archive's tail isn't copied."""
    d, out, p = zlib.decompressobj(31), [], at
    try:
        while not d.eof and p < len(view):
            piece = view[p:p + 65536]
            out.append(d.decompress(piece))
            p += len(piece)
    except zlib.error as e:
        raise ValueError(f"bad member: {e}") from None
    if not d.eof:
        raise ValueError("member cut short")
    text, records, q = b"".join(out), [], 0
    while q < len(text):
        record, q = decode(text, q)
        records.append(record)
    if not records:
        raise ValueError("empty member")
    return records, p - len(d.unused_data)


def _next_start(data: bytes, p: int) -> int:
    """The next place that may begin a member or a record."""
    member, line = data.find(MAGIC, p), data.find(b"WARC/", p)
    return min([x for x in (member, line) if x >= 0], default=len(data))


def classify(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """``pages(page_id, url, html)`` as ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``; a revisit's payload is null.

    Of equal payloads of at least ``revisit_bytes`` the one with the largest page_id is the response. Digests are counted
    before they are joined back, a hot digest is dealt to ``SALT`` pieces of the join, and payloads take no part in it. Only
    then the responses' payloads are looked up, by page_id and digest.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    narrow = written(hashed.drop("payload"), "payload-digests")
    groups = (
        narrow.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first"))
        .where("n > 1 and first is not null").select("payload_digest", "payload_bytes", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    )
    salted = narrow.where(F.col("payload_bytes") >= revisit_bytes).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    told = salted.join(groups, ["payload_digest", "payload_bytes", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = written(told.select("page_id", "url", "payload_bytes", "payload_digest", "first"), "revisits")
    gone = revisits.select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d")).distinct()
    responses = hashed.join(gone, hashed["page_id"].eqNullSafe(gone["_p"]) & (hashed["payload_digest"] == gone["_d"]), "left_anti")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(*columns).unionByName(
        revisits.withColumns({"payload": F.lit(None).cast("binary"), "record_type": F.lit("revisit"), "refers_to": F.col("first")}).select(*columns)
    )


def write_archives(pages: DataFrame, path: str, *, revisit_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row of ``pages(page_id, url, html)`` to ``.warc.gz`` files of about ``archive_bytes`` under ``path``; a longer
    record is a file of its own.

    A null html is an empty payload. Rows that share the largest page_id of a payload are all responses; a null page_id
    revisits any other, and payloads of null page_ids alone are responses. An empty table writes an archive without records.
    Other columns are left out.
    """
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, held = 0, 0
        for batch in batches:
            lines, archives = [], []
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "record_type", "refers_to", "payload", "payload_digest", "payload_bytes")], strict=True):
                member = compress(encode(*(x.as_py() for x in row)))
                if held and held + len(member) > archive_bytes:
                    archive, held = archive + 1, 0
                held += len(member)
                lines.append(member[:-1] if member[-1] == 0 else member)
                archives.append(archive)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array(archives, pa.int32())], ["line", "archive"])

    rows = classify(pages, revisit_bytes).mapInArrow(members, "line binary, archive int")
    rows.select(F.col("line").cast("string").alias("value"), "archive").write.option("lineSep", "\u0000").partitionBy("archive").text(path)
    named(pages.sparkSession, path)


def named(spark, path: str) -> None:
    """Gives the committed files under ``path`` the names of archives: a rename each, no data moves."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = java(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(root, True)
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().startswith("part-") and file.getName().endswith(".txt"):
            fs.rename(file, java(file.getParent(), file.getName()[:-4] + ".warc.gz"))


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all ``.warc`` and ``.warc.gz`` archives under ``path``, and a row with ``gap_start, gap_end, reason`` for each
    quarantined gap. An archive is read as one value of at most 2 GB; Spark refuses longer ones with an error. No archive at all gives
    no row."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for record, gap in salvage(data.as_py() or b""):
                    row = dict.fromkeys(names) | {"path": path}
                    row |= record if record else dict(zip(("gap_start", "gap_end", "reason"), gap, strict=True))
                    rows.append({k: row[k] for k in names})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    records = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in f"{records}, {LOG}".split(", ")])
    names = schema.names
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    return files.select("path", "content").mapInArrow(parse, f"{records}, {LOG}")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder, reads them back, and returns the records without payloads. A gap in what was just
    written is an error."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    found = read_archives(spark, path, with_payload=False)
    damaged = F.raise_error(F.concat(F.lit("damaged archive: "), "path", F.lit(": "), "reason")).cast("boolean")
    return found.where(F.when(F.col("reason").isNotNull(), damaged).otherwise(F.lit(True)))
