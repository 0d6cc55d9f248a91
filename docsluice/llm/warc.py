"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id, each shard is written by one task, and its files roll at a compressed size.
Every header, id and digest is computed anew from the record, so equal input gives equal bytes. Payloads that
were written before are revisits without a payload. Files get temporary names; a manifest, written by
Spark, names those of the attempts that counted; then they are renamed.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import MOST_TASKS, new_dir, read, save, shard_count, shard_of, splitters, utf8
from .tokens import store

#: Bytes of payload in a shard, compressed bytes at which a file is closed, payloads below which are never revisits.
SHARD_BYTES, ROLL_BYTES, LEAST_REVISIT = 32 << 20, 16 << 20, 100
#: Crawl dates are not in the table; a fixed one keeps files reproducible.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard name space for URLs
FILES = "shard int, part int, name string, records long, bytes long, sha256 string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}/{digest}')}>"


def _headers(pairs: list[tuple[str, object]]) -> bytes:
    """Header lines; line ends inside values would forge headers, so they are percent-escaped."""
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return "".join(f"{k}: {clean(v)}\r\n" for k, v in pairs if v is not None).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as bytes, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("X-Page-Id", page_id), ("X-Refers-To-Page-Id", refers_to if revisit else None), ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return b"WARC/1.1\r\n" + _headers(head) + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of its own, without a time or name in its header."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class RollingWriter:
    """The files of one shard, closed at ROLL_BYTES, under names of this attempt."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        self.files, self.at = store(root)
        self.files.create_dir(f"{self.at}/tmp", recursive=True)
        self.shard, self.roll, self.part, self.done, self.out = shard, roll_bytes, 0, [], None

    def add(self, data: bytes) -> None:
        member = gzip_member(data)
        if self.out is not None and self.size and self.size + len(member) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"{self.shard:06d}-{self.part:04d}-{uuid.uuid4().hex}"
            self.out, self.size, self.n, self.sha = self.files.open_output_stream(f"{self.at}/tmp/{self.name}", compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.n += 1

    def close(self) -> list[dict]:
        if self.out is not None:
            self.out.close()
            self.done.append({"shard": self.shard, "part": self.part, "name": self.name, "records": self.n, "bytes": self.size, "sha256": self.sha.hexdigest()})
            self.part, self.out = self.part + 1, None
        return self.done


def file_name(shard: int, part: int) -> str:
    return f"pages-{shard:06d}-{part:04d}.warc.gz"


def revisits(light: DataFrame) -> DataFrame:
    """(id, digest, refers_to) of the records whose payload one of a smaller id has too.

    light: id, digest, size of every record. Digests with several records are counted with partial sums first
    and saved, so the join back has plain exchanges on both sides and a very common payload can be split.
    """
    groups = light.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    joined = light.where(F.col("size") >= LEAST_REVISIT).join(save(groups.select("digest", "refers_to"), "payload-groups"), "digest")
    return joined.where(F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "digest", "refers_to")


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for every row of df and return the manifest (one row a file).

    Null payloads are empty, null urls leave the target out. Of records with equal payloads of LEAST_REVISIT
    bytes or more the one with the smallest id is the response. Rows without an id come first and name no
    response; of rows with equal ids and payloads the first is the response, the others revisit it.
    Payloads are shuffled once: revisit marks travel with them and meet their records in the sorted shard.
    """
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("payload"))
    pages = pages.select("*", F.sha2("payload", 256).alias("digest"))
    light = save(pages.select("id", "digest", F.octet_length("payload").cast("long").alias("size")), "payloads")
    n, size = light.agg(F.count("*"), F.sum("size")).first()
    bounds = splitters(light, "id", shard_count(size, shard_bytes), n)
    marks = revisits(light).select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", F.lit(0).alias("kind"))
    rows = pages.select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind")).unionByName(marks.distinct())
    rows = rows.withColumn("shard", shard_of(F.col("id"), bounds)).repartitionById(len(bounds) + 1, F.col("shard"))
    rows = rows.sortWithinPartitions(F.col("shard"), F.col("id").asc_nulls_first(), "kind", "digest", "url")
    # ids go as strings, which stay exact in pandas beside nulls
    rows = rows.select("shard", F.col("id").cast("string").alias("id"), "kind", "digest", "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, marked, seen = None, None, {}, set()
        for pdf in batches:
            ids, refers = ([None if x is None else int(x) for x in pdf[c].tolist()] for c in ("id", "refers_to"))
            for shard, i, kind, digest, url, payload, target in zip(pdf["shard"].tolist(), ids, pdf["kind"].tolist(), pdf["digest"].tolist(), pdf["url"].tolist(), pdf["payload"].tolist(), refers, strict=True):
                if out is None or out.shard != shard:
                    if out is not None:
                        yield pd.DataFrame(out.close())
                    out, now = RollingWriter(path, shard, roll_bytes), None
                if now is None or now[0] != i:
                    now, marked, seen = (i,), {}, set()
                if kind == 0:
                    marked[digest] = target
                    continue
                if i is not None and digest in seen and len(payload) >= LEAST_REVISIT:
                    marked.setdefault(digest, i)  # an equal row of the same id
                seen.add(digest)
                out.add(record(i, url, payload, digest, marked.get(digest), digest in marked))
        if out is not None:
            yield pd.DataFrame(out.close())

    manifest = save(rows.mapInPandas(run, FILES), "warc-manifest")
    return commit(manifest, path)


def commit(manifest: DataFrame, path: str) -> DataFrame:
    """Rename the files of the manifest, which may be repeated, drop other attempts' files, write the manifest."""

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = store(path)
        for pdf in batches:
            for shard, part, name in zip(pdf["shard"].tolist(), pdf["part"].tolist(), pdf["name"].tolist(), strict=True):
                if files.get_file_info(f"{at}/tmp/{name}").type != fs.FileType.NotFound:
                    files.move(f"{at}/tmp/{name}", f"{at}/{file_name(shard, part)}")
            yield pdf

    manifest.repartition("shard", "part").mapInPandas(rename, FILES).drop("name").write.mode("overwrite").parquet(f"{path}/manifest")
    files, at = store(path)
    if files.get_file_info(f"{at}/tmp").type == fs.FileType.Directory:
        files.delete_dir(f"{at}/tmp")
    return manifest.sparkSession.read.parquet(f"{path}/manifest")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a compressed archive, one gzip member at a time."""
    held = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            data = held or stream.read(1 << 18)
            held = b""
            if not data:
                if out:
                    raise ValueError("the archive ends inside a record")
                return
            out.append(z.decompress(data))
        held = z.unused_data
        raw = b"".join(out)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield fields, rest[:n]


def read_warc(manifest: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; digests are verified."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = store(path)
        for pdf in batches:
            for shard, part in zip(pdf["shard"].tolist(), pdf["part"].tolist(), strict=True):
                rows = []
                with files.open_input_stream(f"{at}/{file_name(shard, part)}", compression=None) as f:
                    for head, block in records(f):
                        if head["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
                            raise ValueError(f"damaged block of {head['WARC-Record-ID']}")
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                                raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
                        rows.append((head.get("X-Page-Id"), size, digest, head["WARC-Type"], head.get("X-Refers-To-Page-Id")))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.assign(**{c: pd.array([None if x is None or x == "None" else int(x) for x in out[c]], dtype="Int64") for c in ("page_id", "refers_to")})

    part = manifest.select("shard", "part")
    return part.repartition(min(MOST_TASKS, max(1, part.count())), "shard", "part").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back; see write_warc for nulls, ties and repeated rows."""
    path = new_dir(spark, "warc")
    return read_warc(write_warc(read(spark, sf_dir, "pages"), path), path)


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
FROM m
"""
