"""WARC archives: writing, an index made first, and reading selected records by coalesced byte ranges.

*Writing* is one pass: every task appends its records to an archive of its own in the shared folder, each record a gzip
member of its own, and reports one index row per record (file, offset, length, type, URL, digest).  The index is
written with the job, so only archives of committed attempts are ever referred to.

*Reading* starts from the index alone: the records wanted are sorted by file and offset (a range-partitioned sort, so
one huge archive is read by many tasks), neighbours whose gap is small are fetched by one read of bounded size, and each
record is decompressed, parsed and checked against its digest.

Of equal payloads the record with the smallest key is the response and the others become revisits that refer to it.
The keeper comes from a partially aggregated minimum per digest; no group of copies is gathered.

Defined results: a null payload is an empty one; a null URL is an empty header; rows that repeat a key and a payload are
the same record and share its type; a record with a null key revisits an equal payload that has a key, and is a response
if none has one; payloads below ``min_payload`` bytes are responses; an empty table gives empty archives and an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablab.llm.common import materialise, ref
from tablab.llm.storage import TASK_BYTES, PartFile, RangeReader, tasks_for
from tablab.session import scratch_path

#: Bytes between two records that are read through rather than skipped, and of one read at most (a longer record is
#: read by itself).
GAP, READ = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, record_type string, url string, payload_digest string, record_key long, refers_to long"
RECORD = "record_key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {digest}')}>"


def build_record(key: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member.  A revisit has no payload; its full length is kept in an extension field."""
    body = b"" if revisit else payload
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Record-Key: {'' if key is None else key}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Type: {'application/http; msgtype=response' if revisit else 'text/html'}",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and content block of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length differs from its header")
    return fields, rest[:size]


def _int(text: str | None) -> int | None:
    return int(text) if text else None


def write_archives(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_payload: int = 0) -> DataFrame:
    """Write one record per row to archives under ``folder`` and return their index, materialised."""
    payload = F.coalesce(ref(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        ref(key_col).cast("long").alias("k"), F.coalesce(ref(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"),
    )
    # equal payloads: a digest that stands alone needs no revisit, so only repeated ones are joined back
    repeated = rows.where(F.col("n") >= min_payload).groupBy("sha", "n").agg(F.min("k").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    repeated = materialise(repeated.where("copies > 1").select(F.col("sha").alias("rsha"), F.col("n").alias("rn"), "keeper"), "copies")
    # one row per record that revisits, found from keys and digests alone; (key, digest) is no hot pair
    marks = rows.select("k", "sha", "n").join(repeated, (F.col("sha") == F.col("rsha")) & (F.col("n") == F.col("rn")))
    marks = marks.where("keeper is not null and not (k <=> keeper)").select(F.col("k").alias("mk"), F.col("sha").alias("msha"), "keeper").distinct()
    marked = rows.join(marks, F.col("k").eqNullSafe(F.col("mk")) & (F.col("sha") == F.col("msha")), "left").select("k", "url", "payload", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            part = part or PartFile(folder, ".warc.gz")
            out = []
            for k, url, text, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                payload = text.encode("utf-8", "surrogatepass")
                digest, revisit = digest_of(payload), keeper is not None
                record, at = build_record(k, url, payload, digest, keeper, revisit), part.size
                part.write(record)
                out.append((part.uri, at, len(record), "revisit" if revisit else "response", url, digest, k, keeper))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if part:
            part.close()

    return materialise(marked.mapInArrow(run, INDEX), "warc-index")


def coalesce_ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """Sorted (file, offset, length) -> (file, start, end, rows) of each read: close records share one."""
    held: list[tuple[str, int, int]] = []
    start = end = 0
    for row in rows:
        file, offset, length = row
        if held and (file != held[0][0] or offset - end > GAP or offset + length - start > READ):
            yield held[0][0], start, end, held
            held = []
        if not held:
            start, end = offset, offset
        held.append(row)
        end = max(end, offset + length)
    if held:
        yield held[0][0], start, end, held


def read_records(index: DataFrame, with_payload: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Records named by rows of an index (any selection of it), read by sorted, coalesced byte ranges, by one task for
    about ``task_bytes`` of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for file, start, end, wanted in coalesce_ranges(rows):
                block = reader.read(file, start, end - start)
                out = []
                for _, offset, length in wanted:
                    fields, body = parse_record(block[offset - start : offset - start + length])
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(fields["x-payload-length"])
                    if kind == "response" and (digest_of(body) != digest or len(body) != size):
                        raise ValueError(f"{file}: the payload at {offset} does not match its digest")
                    payload = body.decode("utf-8", "surrogatepass") if with_payload and kind == "response" else None
                    out.append((_int(fields.get("x-record-key")), fields["warc-target-uri"], kind, _int(fields.get("x-refers-to-key")), size, digest, payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        reader.close()

    tasks = tasks_for(index.agg(F.sum("length")).first()[0], task_bytes)
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(run, RECORD)


def archive_and_read(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                     min_payload: int = 0, wanted: Column | None = None) -> DataFrame:
    """Archive ``pages`` in the shared folder and read back the records whose index row fulfils ``wanted`` (all)."""
    index = write_archives(pages, scratch_path(pages.sparkSession, "warc"), key_col, url_col, payload_col, min_payload)
    return read_records(index if wanted is None else index.where(wanted), with_payload=False)
