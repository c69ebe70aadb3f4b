"""WARC: a deterministic sharded writer, and its reader.

Pages are dealt to shards by ranges of ``ids_per_shard`` page ids, so a shard's
content depends on the rows alone, not on partitions, samples or task order.
Shards are range-partitioned and sorted by (page_id, payload digest, url); each
is written as one or more files, rolled when the compressed size passes
``roll_bytes``.  Every record is a gzip member with fresh headers, a block and
a payload digest; record ids and dates derive from the row, so equal input
gives equal bytes.

Of pages with equal payloads of at least ``min_bytes`` bytes, that with the
largest page_id is the response; the others are written as revisit records
that refer to it and carry no payload.  The choice is a grouped maximum,
combined before the shuffle; html is shuffled once, to its shard.

Commit: a task writes to a temporary name of its own and returns a manifest
row; Spark keeps the rows of one attempt per task only.  The manifest is
written, a second job renames the listed files (a repeated task finds the
final name and leaves it), and the final manifest names them.  Readers read
what the manifest lists; files of lost attempts are never listed.

Files go through pyarrow's file systems to the folder given, by default one
under spark.checkpoint.dir.  A row without html has an empty payload; one
without url has an empty target; rows without page_id are in shard -1 and
refer to nothing but themselves (always a response); of rows equal in page_id
and payload all are responses, or all revisits.  No rows give no files.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.session import scratch_path

DATE = "1970-01-01T00:00:00Z"  # pages carry no date; a fixed one keeps files reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, part int, name string, records long, bytes long, sha256 string"


def _open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def _base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, payload_bytes: int) -> bytes:
    """One WARC record; a revisit if refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    name = "" if page_id is None else str(page_id)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = head + (payload if refers_to is None else b"")
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{name}:{target}:{digest}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {name}", f"X-Payload-Length: {payload_bytes}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


class _Shards:
    """Writes sorted rows to files; yields a manifest row for each."""

    def __init__(self, folder: str, roll_bytes: int, level: int):
        self.fs, self.folder = _open_folder(folder)
        self.roll_bytes, self.level, self.shard, self.out = roll_bytes, level, None, None
        self.attempt = uuid.uuid4().hex

    def _start(self, shard: int, part: int) -> None:
        self.shard, self.part, self.records, self.size, self.sha = shard, part, 0, 0, hashlib.sha256()
        self.name = f"part-{shard:012d}-{part:05d}.warc.gz"
        self.out = self.fs.open_output_stream(f"{self.folder}/_temporary/{self.name}.{self.attempt}", compression=None)

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.close()
        self.out = None
        return [(self.shard, self.part, f"{self.name}.{self.attempt}", self.records, self.size, self.sha.hexdigest())]

    def add(self, shard: int, data: bytes) -> list[tuple]:
        done = []
        if self.out is not None and (shard != self.shard or self.size >= self.roll_bytes):
            part = self.part + 1 if shard == self.shard else 0
            done = self.close()
            self._start(shard, part)
        elif self.out is None:
            self._start(shard, 0)
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = z.compress(data) + z.flush()
        self.out.write(data)
        self.sha.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        return done


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["shard", "part", "name", "records", "bytes", "sha256"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _write(folder: str, roll_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, done, revisit = _Shards(folder, roll_bytes, level), [], None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cols = [batch.column(c).slice(lo, 256).to_pylist() for c in ("shard", "page_id", "digest", "refers_to", "url", "html")]
                for shard, page_id, digest, refers_to, url, html in zip(*cols, strict=True):
                    if refers_to is not None:  # sorted before the pages it speaks of
                        revisit = (page_id, digest, refers_to)
                        continue
                    payload = html or b""
                    to = revisit[2] if revisit is not None and revisit[:2] == (page_id, digest) else None
                    done += shards.add(shard, record(page_id, url, payload, _base32(digest), to, len(payload)))
        done += shards.close()
        if done:
            yield _manifest_batch(done)

    return run


def _rename(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open_folder(folder)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                final, temporary = r["name"].rsplit(".", 1)[0], f"{at}/_temporary/{r['name']}"
                if fs.get_file_info(f"{at}/{final}").size != r["bytes"] or fs.get_file_info(temporary).type == pafs.FileType.File:
                    fs.move(temporary, f"{at}/{final}")
                rows.append((r["shard"], r["part"], final, r["records"], r["bytes"], r["sha256"]))
            if rows:
                yield _manifest_batch(rows)

    return run


def write_warc(pages: DataFrame, folder: str, ids_per_shard: int = 4096, roll_bytes: int = 64 << 20, min_bytes: int = 0, level: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files in a new folder; returns the final manifest."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("binary"), F.expr("X''"))
    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / ids_per_shard), F.lit(-1)).cast("long").alias("shard"), "page_id", F.sha1(html).alias("digest"),
        F.lit(None).cast(id_type).alias("refers_to"), F.col("url").cast("string").alias("url"), html.alias("html"))
    # one narrow pass finds which pages revisit which
    ids = rows.filter(F.octet_length("html") >= min_bytes).filter("page_id is not null").select("shard", "page_id", "digest")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("refers_to <> least").drop("least")
    revisits = ids.join(last, "digest").filter("page_id <> refers_to").distinct().select(
        "shard", "page_id", "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"))
    sorted_ = revisits.union(rows).repartitionByRange("shard").sortWithinPartitions(
        "shard", "page_id", "digest", F.col("refers_to").asc_nulls_last(), "url")
    fs, at = _open_folder(folder)
    fs.create_dir(f"{at}/_temporary", recursive=True)
    written, final = f"{folder}/_temporary/manifest", f"{folder}/manifest"
    sorted_.mapInArrow(_write(folder, roll_bytes, level), MANIFEST).write.parquet(written)
    spark.read.schema(MANIFEST).parquet(written).mapInArrow(_rename(folder), MANIFEST).write.parquet(final)
    return spark.read.schema(MANIFEST).parquet(final)


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP head, payload) of each gzip member of a file, read in pieces."""
    data, ended = b"", False
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                data = stream.read(1 << 20)
                ended = not data
                if ended:
                    break
            out.append(z.decompress(data))
            data = z.unused_data if z.eof else b""
        if ended:
            if out and any(out):
                raise ValueError("the file ends within a record")
            return
        text = b"".join(out)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if headers["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError(f"block digest of {headers['WARC-Record-ID']} does not match")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield headers, http, payload


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and
    html (null for revisits) of every record of the manifest's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open_folder(folder)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "html": pa.string()}

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for h, _, payload in records(stream):
                        whole = h["WARC-Type"] == "response"
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if whole and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload digest of {h['WARC-Record-ID']} does not match")
                        refers = h.get("X-Refers-To-Page-Id")
                        rows.append({
                            "page_id": int(h["X-Page-Id"]) if h["X-Page-Id"] else None, "url": h["WARC-Target-URI"],
                            "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "record_type": h["WARC-Type"],
                            "refers_to": int(refers) if refers else None, "html": payload.decode("utf-8", "replace") if whole else None})
                        size += len(payload)
                        if size > 4 << 20 or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    files = max(1, manifest.count())  # one task for each file
    return manifest.select("name").repartition(files).mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
