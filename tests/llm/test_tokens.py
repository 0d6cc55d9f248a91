import io
import zlib

import numpy as np
import pytest

from docsluice.llm import tokens as T

PATH = T.tokenizer_path()
TEXTS = ["", " ", "Hello, world's end. I'm 42 ½ x² it'll ªº", "ÉCOLE été Straße İstanbul ΑΣ σς", "é combining ́start", "日本語 テキスト 123", "tab\tnbsp nel\u0085x\x1cy\x1fz", "<|endoftext|> a<|startoftext|>b", "a_b__c #$% |x| don't DON'T 'S 's'", "œuvre Œuvre – — “quoted” … €5", "ǅ ﬁ K Å", "soft­hyphen", "x" * 3000, "word " * 5000, "Ünï-ß\nnew  lines\r\n\r\nhere", "😀 emoji 👍🏽"]


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_librarys(text):
    e = T.encoder(PATH)
    for _ in range(2):
        assert np.frombuffer(e(text), dtype=e.dtype).tolist() == library(text)


def test_other_tokenizer_files():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = T.Encoder(path), Tokenizer.from_file(path)
    for text in TEXTS:
        assert np.frombuffer(e(text), dtype=e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 50)
    e = T.Encoder(PATH)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(400))
    assert np.frombuffer(e(text), dtype=e.dtype).tolist() == library(text)
    assert len(e.seen) <= 50 and len(e.known) <= 50


def test_frames_detect_damage():
    data = T.frame(b"abc") + T.frame(b"")
    assert T.seek_one(io.BytesIO(data), 0) == b"abc" and T.seek_one(io.BytesIO(data), 19) == b""
    for at in (0, 9, 13, 16):
        worse = bytearray(data)
        worse[at] ^= 1
        with pytest.raises(ValueError):
            T.unframe(io.BytesIO(worse), 0)
    with pytest.raises(ValueError):
        T.unframe(io.BytesIO(data[:14]), 0)


def test_shuffled_reads_by_the_index(spark):
    path = T.new_dir(spark, "test-tokens")
    T.write_tokens(spark.createDataFrame(ROWS, "doc_id long, text string"), path, PATH)
    files, root = T.store(path)
    entries = np.frombuffer(files.open_input_file(f"{root}/shard-000000.idx").read(), dtype=T.ENTRY)
    with files.open_input_file(f"{root}/shard-000000.bin") as f:
        for e in entries[::-1]:
            ids = np.frombuffer(T.seek_one(f, int(e["offset"])), dtype="<u2")
            assert len(ids) == e["n"] and ids[-1] == T.END_ID


ROWS = [(9, "last"), (-5, "first by id"), (3, None), (None, "no id"), (4, "same"), (4, "same"), (4, "another"), (7, "Ünï 日本"), (8, "long " * 3000)]


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_round_trip(spark, shard_bytes):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "0 AS shard", "1 AS id")
    path = T.new_dir(spark, "test-tokens")
    manifest = T.write_tokens(df, path, PATH, shard_bytes=shard_bytes)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read_tokens(manifest, path, 2).collect()))
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library(t) + [T.END_ID]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert manifest.agg({"tokens": "sum"}).first()[0] == at
    files, root = T.store(path)
    names = [f.base_name for f in files.get_file_info(T.fs.FileSelector(root))]
    assert "tmp" not in names and len([n for n in names if n.endswith(".bin")]) == manifest.count()


def test_a_large_range_is_written_in_several_files(spark, monkeypatch):
    """However few tasks there may be, files keep their size: one shard rolls on, ids and starts go on over its files."""
    from docsluice.llm import base

    monkeypatch.setattr(base, "MOST_TASKS", 1)
    rows = [(i, f"text number {i} of some length") for i in range(60)]
    path = T.new_dir(spark, "test-tokens")
    manifest = T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, shard_bytes=100, file_bytes=100)
    assert {r.shard for r in manifest.collect()} == {0} and manifest.count() > 5 and manifest.agg({"bytes": "max"}).first()[0] < 200
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in T.read_tokens(manifest, path, 2).collect())
    want, at = [], 0
    for i, t in rows:
        want.append((i, at, len(library(t)) + 1))
        at += want[-1][2]
    assert got == want


def test_files_are_the_same_on_every_run(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    digests = []
    for n in (1, 5):
        path = T.new_dir(spark, "test-tokens")
        T.write_tokens(df.repartition(n), path, PATH, shard_bytes=200)
        files, root = T.store(path)
        digests.append({f.base_name: zlib.crc32(files.open_input_file(f.path).read()) for f in files.get_file_info(T.fs.FileSelector(root)) if f.base_name.endswith(("bin", "idx"))})
    assert digests[0] == digests[1] and digests[0]


def test_empty_table(spark):
    path = T.new_dir(spark, "test-tokens")
    manifest = T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert manifest.count() == 0 and T.read_tokens(manifest, path, 2).count() == 0
