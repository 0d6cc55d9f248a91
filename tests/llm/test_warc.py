import gzip
import hashlib

import pytest

from docsluice.llm import warc as A
from docsluice.llm.base import new_dir

BIG, OTHER = "<html>" + "x" * 200, "<p>" + "ü" * 99
ROWS = [
    (5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (-2, "http://a/-2", None), (7, "http://a/7", ""), (8, "u\r\nX-Evil: 1", "short"), (11, "v", "short"),
    (12, "w", "y" * 99), (13, "w", "y" * 99), (14, "w", OTHER), (15, "w", OTHER), (None, "n", BIG), (20, "same", "z" * 150), (20, "same", "z" * 150), (21, "long", "0123456789" * 30_000),
]


def brute(rows):
    least = {}
    for i, _, p in rows:
        if i is not None:
            least[p or ""] = min(i, least.get(p or "", i))
    out, seen = [], set()
    for i, _, p in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (p or "").encode()
        first = least.get(p or "", None)
        again = len(data) >= 100 and first is not None and (i != first or (i, data) in seen)
        seen.add((i, data))
        out.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "roll"), [(300, 200), (1 << 20, 1 << 20)])
def test_round_trip(spark, shard, roll):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS digest", "'s' AS shard")
    path = new_dir(spark, "test-warc")
    manifest = A.write_warc(df, path, shard_bytes=shard, roll_bytes=roll)
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in A.read_warc(manifest, path).collect()), key=str)
    assert got == brute(ROWS)
    files, at = A.store(path)
    names = sorted(f.base_name for f in files.get_file_info(A.fs.FileSelector(at)) if f.base_name.endswith(".gz"))
    assert names == sorted(A.file_name(r.shard, r.part) for r in manifest.collect())
    for r in manifest.collect():
        raw = files.open_input_stream(f"{at}/{A.file_name(r.shard, r.part)}", compression=None).read()
        assert hashlib.sha256(raw).hexdigest() == r.sha256 and len(raw) == r.bytes and gzip.decompress(raw).count(b"WARC/1.1\r\n") == r.records
        assert r.records == 1 or r.bytes <= roll
        assert b"\r\nX-Evil" not in gzip.decompress(raw)


def test_files_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    found = [sorted((r.shard, r.part, r.sha256) for r in A.write_warc(df.repartition(n), new_dir(spark, "test-warc"), shard_bytes=300).collect()) for n in (1, 6)]
    assert found[0] == found[1]


def test_empty_table(spark):
    path = new_dir(spark, "test-warc")
    manifest = A.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert A.read_warc(manifest, path).count() == 0
