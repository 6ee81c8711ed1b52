"""WARC archives with an index that comes first: every record is found by offset and length.

Writing: each task writes its pages as gzip members, one a record, into an archive file of its
own under the archive folder and answers with the index rows (file, offset, length, URL, digest, type).
The index is a written table, so it names the files of the tasks that ended well only: a retried or lost
task leaves a file no index row points to.  Payloads equal to an earlier page's become ``revisit`` records,
which hold no payload and name the page they refer to.

Reading: index rows (all, or a selection) are dealt to as many tasks as their bytes ask for (the index is small, so
its own size says nothing of the work), by file and stretch of the file; a task sorts its rows by file and
offset, and neighbours whose gap is at most ``GAP`` bytes are read in one range request.

Files are opened through Arrow's file systems, so the folder may be on any store that both
Spark and Arrow can reach; pages are read by Spark.

Defined results: a null html is an empty payload; payloads under ``MIN_REVISIT`` bytes are never
revisited; rows that share the smallest page_id of a payload are all responses; a null page_id
is a response unless another page has its payload; a null url is kept; repeated rows are records
of their own; an empty table gives an empty index; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import ready_python, scratch_path, written_table

MIN_REVISIT = 100
GAP = 1 << 16            # bytes read in vain rather than asked for apart
MOST = 1 << 23           # bytes of one range request, unless one record is longer
STRETCH = 1 << 23        # bytes of an archive one group of records covers
TASK = 1 << 26           # bytes of archives one task reads, about
LEVEL = 6

INDEX = ("page_id bigint, url string, file string, offset bigint, length bigint, payload_bytes bigint, "
         "payload_digest string, record_type string, refers_to bigint, record_id string")


def _uri(path: str) -> str:
    """Spark's ``file:/x`` and bare paths as Arrow reads them."""
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(_uri(path))


def record(kind: str, record_id: str, url: str | None, page_id: int | None, digest: str, size: int,
           refers_to: int | None, payload: bytes) -> bytes:
    """One record: header lines, a blank line, the block, two blank lines."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; broken records raise."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    return fields, rest[:size]


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _whole(value):
    return None if pd.isna(value) else int(value)


def planned(pages: DataFrame) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest, record_type and refers_to."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    sized = pages.select("page_id", "url", payload.alias("payload")) \
        .withColumn("payload_bytes", F.octet_length("payload").cast("bigint")) \
        .withColumn("payload_digest", F.sha2("payload", 256))
    repeated = sized.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest") \
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")) \
        .where((F.col("n") > 1) & F.col("first_id").isNotNull()).select(F.col("payload_digest").alias("repeated"), "first_id")
    # broadcast when it is small; beyond, both sides shuffle and skewed digests are split
    joined = sized.join(bounded_broadcast(repeated), F.col("payload_digest") == F.col("repeated"), "left")
    again = F.col("first_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record a page under ``folder``; returns the index (a written table)."""
    ready_python(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = name = None
        offset = 0
        try:
            for frame in frames:
                found = []
                for r in frame.itertuples(index=False):
                    if out is None:
                        name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                        store, path = filesystem(name)
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    page_id, refers_to = _whole(r.page_id), _whole(r.refers_to)
                    payload = b"" if r.record_type == "revisit" else bytes(r.payload)
                    record_id = str(uuid.uuid4())
                    data = _member(record(r.record_type, record_id, r.url, page_id, r.payload_digest,
                                          int(r.payload_bytes), refers_to, payload))
                    out.write(data)
                    found.append((page_id, r.url, name, offset, len(data), int(r.payload_bytes), r.payload_digest,
                                  r.record_type, refers_to, record_id))
                    offset += len(data)
                columns = [c.split()[0] for c in INDEX.split(", ")]
                yield pd.DataFrame(found, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return written_table(planned(pages).mapInPandas(run, INDEX), "warc-index")


def ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Positions [a, b) of sorted records that one request reads."""
    a = 0
    for b in range(1, len(offsets) + 1):
        if b == len(offsets) or offsets[b] - offsets[b - 1] - lengths[b - 1] > GAP \
                or offsets[b] + lengths[b] - offsets[a] > MOST:
            yield a, b
            a = b


READ = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, payload binary")


def _stretch():
    return F.floor(F.col("offset") / STRETCH)


def tasks(index: DataFrame) -> int:
    """Tasks that read the rows' records: one for every TASK bytes, and no fewer than cores or stretches, whichever are fewer."""
    total, stretches = index.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("file", _stretch())).first()
    cores = index.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // TASK), min(stretches, cores))


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the records of ``index`` (any selection of its rows) back from the archives.  The
    payload of a response is checked against its digest; a revisit has the digest of its header."""
    ready_python(index.sparkSession)
    stretched = index.select("file", "offset", "length", _stretch().alias("stretch"))
    # a number given by hand is not coalesced; the rows of a stretch stand together and in order: one file is open at a time
    dealt = stretched.repartition(tasks(index), "file", "stretch").sortWithinPartitions("file", "offset")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, source = None, None
        for frame in frames:
            for file, part in frame.groupby("file", sort=False):
                if file != name:
                    if source is not None:
                        source.close()
                    store, path = filesystem(file)
                    name, source = file, store.open_input_file(path)
                offsets, lengths = part["offset"].tolist(), part["length"].tolist()
                for a, b in ranges(offsets, lengths):
                    start = offsets[a]
                    data = source.read_at(offsets[b - 1] + lengths[b - 1] - start, start)
                    found = []
                    for i in range(a, b):
                        fields, block = parse(zlib.decompress(
                            data[offsets[i] - start:offsets[i] - start + lengths[i]], 31))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response" and (len(block), hashlib.sha256(block).hexdigest()) != (size, digest):
                            raise ValueError(f"{file} at {offsets[i]}: payload and digest differ")
                        found.append((fields.get("X-Page-ID"), fields.get("WARC-Target-URI"), size, digest,
                                      fields["WARC-Type"], fields.get("X-Refers-To-Page-ID"),
                                      block if with_payload else None))
                    out = pd.DataFrame(found, columns=[c.split()[0] for c in READ.split(", ")])
                    for c in ("page_id", "refers_to"):
                        out[c] = pd.array([None if v is None else int(v) for v in out[c]], "Int64")
                    yield out
        if source is not None:
            source.close()

    return dealt.mapInPandas(run, READ)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the pages' archives (under the shared scratch folder unless one is named) and read all
    records back: (index, records without payload)."""
    index = write(pages, folder or scratch_path(pages.sparkSession, "warc"))
    return index, read(index, with_payload=False)
