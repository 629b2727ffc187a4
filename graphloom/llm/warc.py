"""WARC archives, index first.

Writing: each task writes gzip members, one per record, to a file of its own and emits an index
row per record (path, offset, length, URL, payload digest). The index is a table; only files that
it names are ever read, so that the leftovers of failed task attempts do no harm. Reading: the index
rows that are wanted are range-sorted by (path, offset), and each task reads stretches of
neighbouring records at once, up to READ_BYTES and over gaps of up to GAP_BYTES.

A record whose payload of at least `dedup_bytes` bytes equals another's is a revisit of the one with
the largest page_id; its payload is not stored. Payloads are compared by SHA-256; the digest written
is SHA-1, in base 32 as the format has it.

Defined results: a null html is an empty payload; a null page_id is the smallest and written as
`null`; rows that repeat the kept page_id and its payload are all responses. A record's id is made of page_id
and payload digest, so rows equal in both share it. A null URL is written as the record's own id and
read back as null; one with line breaks is written without them, and whole in a field of its own; an empty table gives an empty archive; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialize, partitions, scratch_path, table

READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
FILE_BYTES = 1 << 30
INDEX = "page_id long, url string, record_type string, payload_digest string, path string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_bytes(page_id, url, payload: bytes, sha1_hex: str, refers_to, kind: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    import base64
    import zlib

    name = f"urn:page:{'null' if page_id is None else page_id}:{sha1_hex}"
    plain = name if url is None else " ".join(url.split()) or "-"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {plain}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1_hex)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None and (url != plain or url.startswith("urn:page:")):
        head.append(f"X-Url: {base64.b64encode(url.encode()).decode()}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}:{sha1_hex}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> dict:
    """The fields of RECORD out of a gzip member; checks a stored payload against its digest."""
    import base64
    import hashlib
    import zlib

    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda urn: None if urn.startswith("<urn:page:null:") else int(urn.split(":")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind, page_id = fields["WARC-Type"], number(fields["WARC-Record-ID"])
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {page_id} does not match its digest")
    url = fields["WARC-Target-URI"]
    own = f"<{url}>" == fields["WARC-Record-ID"]
    return {
        "page_id": page_id,
        "url": base64.b64decode(fields["X-Url"]).decode() if "X-Url" in fields else None if own else url,
        "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "payload": payload,
    }


def _writer(folder: str):
    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        names = [f.split()[0] for f in INDEX.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, offset = None, "", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, sha1_hex, kind, refers_to in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "record_type", "refers_to")], strict=True):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        path, offset = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(path, compression=None)
                    member = record_bytes(page_id, url, (html or "").encode(), sha1_hex, refers_to, kind)
                    out.write(member)
                    rows.append((page_id, url, kind, sha1_hex, path, offset, len(member)))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)
        finally:
            if out is not None:
                out.close()

    return write


def write_archive(pages: DataFrame, folder: str, dedup_bytes: int = 1000) -> DataFrame:
    """Write a record per row of pages below folder; returns the index as a table."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("sha1"), F.sha2(html, 256).alias("same"), (F.octet_length(html) >= dedup_bytes).alias("large")
    )
    kept = rows.where("large").groupBy("same").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "kept")
    joined = rows.join(materialize(kept, "warc-kept"), "same", "left")
    revisit = F.col("large") & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    planned = joined.select(
        "page_id", "url", "html", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to")
    )
    return materialize(planned.mapInArrow(_writer(folder), INDEX), "warc-index")


def _reader(folder: str):
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
        opened, source = None, None

        def stretches(rows):
            run = []
            for path, at, size in rows:
                if run and (path != run[0][0] or at + size - run[0][1] > READ_BYTES or at - (run[-1][1] + run[-1][2]) > GAP_BYTES):
                    yield run
                    run = []
                run.append((path, at, size))
            if run:
                yield run

        for b in batches:
            for run in stretches(zip(*[b.column(c).to_pylist() for c in ("path", "offset", "length")], strict=True)):
                path, first = run[0][0], run[0][1]
                if path != opened:
                    if source is not None:
                        source.close()
                    opened, source = path, store.open_input_file(path)
                data = source.read_at(run[-1][1] + run[-1][2] - first, first)
                found = [parse_record(data[at - first : at - first + size]) for _, at, size in run]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in kinds.items()], names=list(kinds))
        if source is not None:
            source.close()

    return read


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of index name, in the columns of RECORD (payload null for revisits)."""
    n = partitions(index.sparkSession)
    wanted = index.select("path", "offset", "length").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return wanted.mapInArrow(_reader(folder), RECORD)


def op2_warc(spark, sf_dir):
    folder = scratch_path(spark, "warc")
    index = write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(index, folder).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
k AS (SELECT html, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT p.page_id, p.url, p.payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN k.kept IS NOT NULL AND p.page_id IS DISTINCT FROM k.kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.kept IS NOT NULL AND p.page_id IS DISTINCT FROM k.kept THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html AND p.payload_bytes >= 1000
"""
