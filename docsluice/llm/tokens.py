"""Token ids in length-delimited binary files with a separate offset index.

A data file is a row of frames: length of the payload (8 bytes), masked CRC-32 of those bytes (4), payload
(the ids of one document, 2 bytes each if the vocabulary allows, else 4), masked CRC-32 of the payload (4);
all little-endian. Beside it lies an index file of fixed-size entries: flag (1: the id is null), document
id, offset of the frame, number of ids. Any document can so be read by one seek, in any order. Masking (rotate
by 15 bits, add a constant) keeps a checksum of stored checksums from being trivial.

Shards are ranges of document ids, written by one task each, in several parts if a range is large. A task writes
temporary names that no other attempt uses; the manifest, a table written by Spark, names the files of the attempts
that counted; then they are renamed.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import MOST_TASKS, give_back, new_dir, read, save, shard_count, shard_of, splitters

#: Bytes of text that a shard aims at, and bytes of a data file from which on the next document begins another one.
SHARD_BYTES, FILE_BYTES = 24 << 20, 48 << 20
#: Words whose ids a worker remembers, and a quarter as many pieces of words; then it forgets all of them and starts anew.
CACHE_WORDS = 400_000
#: The same where other stages of a job run in the same workers.
FEW_WORDS = 100_000
MASK_DELTA = 0xA282EAD8
ENTRY = np.dtype([("null", "<u1"), ("id", "<i8"), ("offset", "<u8"), ("n", "<u4")])
END_ID = 1


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(stream: BinaryIO, offset: int) -> bytes:
    """The payload of the frame that a stream stands at; both checksums must hold."""
    head = stream.read(12)
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(zlib.crc32(head[:8])):
        raise ValueError(f"damaged length at {offset}")
    n = struct.unpack("<Q", head[:8])[0]
    rest = stream.read(n + 4)
    if len(rest) < n + 4 or struct.unpack("<I", rest[n:])[0] != masked(zlib.crc32(rest[:n])):
        raise ValueError(f"damaged payload at {offset}")
    return rest[:n]


def seek_one(file: BinaryIO, offset: int) -> bytes:
    """The payload at an offset of the index: a shuffled read."""
    file.seek(offset)
    return unframe(file, offset)


class Encoder:
    """Ids of texts as bytes, by the tokenizers library, each distinct piece encoded once.

    In texts of Latin letters each word between white space is looked up; a new word is lower-cased and split
    by the tokenizer's own pattern, its pieces are looked up, and only new pieces go through the library's
    model. Where the text has anything else (other scripts, combining marks, control characters, strings of special tokens), or the file isn't
    of this kind, the library encodes the words between spaces and newlines, or the whole text.
    """

    #: Composed Latin letters: normalisation leaves them alone, lower-casing is letter by letter.
    plain = re.compile("[\t\n\r -~¡-¬®-ÿŒœ‘-„–—…€]*")
    pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿœ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿœ0-9²³¹¼-¾]+")

    def __init__(self, path: str, most: int | None = None):
        most = CACHE_WORDS if most is None else most
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_words = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"] and not any(" " in s or "\n" in s for s in self.special)
        pattern = split[0].get("pattern", {}).get("Regex") if split else None
        self.by_pieces = self.by_words and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and not split[1].get("add_prefix_space")
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        encode, model, dtype = self.tokenizer.encode, self.tokenizer.model, self.dtype

        class Pieces(dict):
            def __missing__(self, piece: str, alphabet=self.alphabet) -> bytes:
                if len(self) >= most // 4:
                    self.clear()
                ids = [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(alphabet))]
                out = self[piece] = np.array(ids, dtype=dtype).tobytes()
                return out

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= most // 4:
                    self.clear()
                out = self[word] = np.array(encode(word, add_special_tokens=False).ids, dtype=dtype).tobytes()
                return out

        seen, find = Pieces(), self.pieces.findall

        class Plain(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= most:
                    self.clear()
                out = self[word] = b"".join(map(seen.__getitem__, find(word.lower())))
                return out

        self.seen, self.words, self.known = seen, Words(), Plain()

    def forget(self) -> None:
        """Give the memory of all remembered words back."""
        for remembered in (self.seen, self.words, self.known):
            remembered.clear()

    def __call__(self, text: str) -> bytes:
        if self.by_pieces and self.plain.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.known.__getitem__, text.split()))
        if self.by_words:
            return b"".join(map(self.words.__getitem__, re.split("[ \n]+", text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, most: int | None = None) -> Encoder:
    """One encoder for each tokenizer file, bound and worker process."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


class ShardWriter:
    """One data file and its index under names of this attempt."""

    def __init__(self, root: str, shard: int, part: int):
        self.files, at = store(root)
        self.name = f"{shard:06d}-{part:04d}-{uuid.uuid4().hex}"
        self.at, self.shard, self.part = at, shard, part
        self.files.create_dir(f"{at}/tmp", recursive=True)
        self.data = self.files.open_output_stream(f"{at}/tmp/{self.name}.bin")
        self.entries: list[tuple] = []
        self.offset = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes, n: int) -> None:
        out = frame(ids)
        self.data.write(out)
        self.entries.append((doc_id is None, doc_id or 0, self.offset, n))
        self.offset += len(out)
        self.tokens += n

    def close(self) -> dict:
        self.data.close()
        with self.files.open_output_stream(f"{self.at}/tmp/{self.name}.idx") as f:
            f.write(np.array(self.entries, dtype=ENTRY).tobytes())
        return {"shard": self.shard, "part": self.part, "name": self.name, "docs": len(self.entries), "tokens": self.tokens, "bytes": self.offset}


MANIFEST = "shard int, part int, name string, docs long, tokens long, bytes long"


def file_name(shard: int, part: int) -> str:
    return f"shard-{shard:06d}" + (f"-{part:04d}" if part else "")


def write_tokens(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, remember: bool = True) -> DataFrame:
    """Encode every text, write the files in ascending id order, return the manifest (one row a pair of files).

    Null texts are empty and have the end id only; rows without an id come first; rows with equal ids are in
    the order of their texts, equal rows are all written. The manifest has the number of ids before each
    file (start). Without remember a worker remembers FEW_WORDS at most, forgets them after each task and gives their memory, and
    what earlier stages left, back to the system: a sixth slower, but stages of a job share the memory of an executor. An empty table writes nothing. Texts are shuffled once.
    """
    part = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, size = part.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    bounds = splitters(part, "id", shard_count(size, shard_bytes), n)
    dealt = part.withColumn("shard", shard_of(F.col("id"), bounds)).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("shard"), F.col("id").asc_nulls_first(), "text")
    dealt = dealt.select("shard", F.col("id").cast("string").alias("id"), "text")  # exact in pandas beside nulls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not remember:
            give_back()
        encode = encoder(tokenizer, None if remember else FEW_WORDS)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        out = None
        for pdf in batches:
            for shard, doc_id, text in zip(pdf["shard"].tolist(), pdf["id"].tolist(), pdf["text"].tolist(), strict=True):
                if out is None or shard != out.shard or out.offset >= file_bytes:
                    if out is not None:
                        yield pd.DataFrame([out.close()])
                    out = ShardWriter(path, shard, out.part + 1 if out is not None and shard == out.shard else 0)
                ids = encode(text) + end
                out.add(None if doc_id is None else int(doc_id), ids, len(ids) // encode.dtype.itemsize)
        if out is not None:
            yield pd.DataFrame([out.close()])
        if not remember:
            encode.forget()
            _encoders.clear()
            encode = None
            give_back()

    manifest = save(dealt.mapInPandas(run, MANIFEST), "token-manifest")
    return commit(manifest, path)


def commit(manifest: DataFrame, path: str) -> DataFrame:
    """Give the files of the manifest their final names, delete what other attempts left, write the manifest.

    Renaming runs in tasks and may be repeated: a file that already has its final name is left alone.
    """

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = store(path)
        for pdf in batches:
            for shard, part, name in zip(pdf["shard"].tolist(), pdf["part"].tolist(), pdf["name"].tolist(), strict=True):
                for kind in ("bin", "idx"):
                    source, target = f"{at}/tmp/{name}.{kind}", f"{at}/{file_name(shard, part)}.{kind}"
                    if files.get_file_info(source).type != fs.FileType.NotFound:
                        files.move(source, target)
            yield pdf

    before = F.coalesce(F.sum("tokens").over(_ordered()), F.lit(0))  # one row a file: small, in one task
    done = manifest.repartition("shard", "part").mapInPandas(rename, MANIFEST).withColumn("start", before).drop("name")
    done.write.mode("overwrite").parquet(f"{path}/manifest")
    files, at = store(path)
    if files.get_file_info(f"{at}/tmp").type == fs.FileType.Directory:
        files.delete_dir(f"{at}/tmp")
    return manifest.sparkSession.read.parquet(f"{path}/manifest")


def _ordered():
    from pyspark.sql import Window

    return Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)


def read_tokens(manifest: DataFrame, path: str, width: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from index and data files, checksums verified.

    width: bytes of an id in the files. The checksum is over the ids as 32-bit integers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = store(path)
        for pdf in batches:
            for shard, part, start in zip(pdf["shard"].tolist(), pdf["part"].tolist(), pdf["start"].tolist(), strict=True):
                stem = f"{at}/{file_name(shard, part)}"
                with files.open_input_file(f"{stem}.idx") as f:
                    entries = np.frombuffer(f.read(), dtype=ENTRY)
                # frames lie in the order of the index: one pass with a small buffer, whatever the file's size
                with files.open_input_stream(f"{stem}.bin", compression=None, buffer_size=1 << 20) as f:
                    crc = [zlib.crc32(np.frombuffer(unframe(f, int(o)), dtype=f"<u{width}").astype("<u4").tobytes()) for o in entries["offset"]]
                n = entries["n"].astype(np.int64)
                yield pd.DataFrame({"doc_id": pd.Series(entries["id"]).astype("Int64").mask(pd.Series(entries["null"] == 1)), "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})

    part = manifest.select("shard", "part", "start")
    return part.repartition(min(MOST_TASKS, max(1, part.count())), "shard", "part").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_width(tokenizer: str) -> int:
    return encoder(tokenizer).dtype.itemsize


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written and read back; see write_tokens for nulls, empty texts, ties and repeated rows."""
    return write_and_read(read(spark, sf_dir, "documents"))


def write_and_read(documents: DataFrame, remember: bool = True) -> DataFrame:
    """Token files of documents under a new folder, read back: (doc_id, start, n_tokens, ids_crc32)."""
    path, tokenizer = new_dir(documents.sparkSession, "tokens"), tokenizer_path()
    return read_tokens(write_tokens(documents, path, tokenizer, remember=remember), path, id_width(tokenizer))
