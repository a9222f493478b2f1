"""Token ids as binary files: independent zstandard frames, a trailing seek table, per-frame checksums.

File layout: zstandard frames, each with the ids of one or more whole documents; a skippable frame with the
document index (doc ids, token counts, documents per frame); last a skippable frame with the seek table in the
public seekable format: per frame the compressed size, the decompressed size and the low 32 bits of the XXH64 of
the ids, then the number of frames, a descriptor byte and the magic number. A reader of some documents reads the
two tables and decompresses only those documents' frames.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import attempt_name, filesystem, pieces, shared_folder, written

#: Fixed values of the seekable format and of skippable frames.
SEEK_MAGIC, SEEK_FRAME, INDEX_FRAME, HAS_CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 0x80
END_ID = 2
FRAME_BYTES = 256 << 10


class WordIds(dict):
    """Ids of white-space-delimited words as little-endian bytes, computed when first asked for.

    Pieces never span white space in the tokenizers this is used with (checked in tests against whole-text
    encoding), so a text's ids are those of its words in order. A plain word's letters (ASCII or Latin-1) in lower case
    and its marks are words themselves, so that each is held once. The latest ``most`` are kept, and as many of the ones
    before; workers live on with them through later stages, so they are part of each stage's memory (some 100 MB a worker).
    """

    def __init__(self, path: str, dtype: str, most: int = 300_000):
        import re

        from tokenizers import Tokenizer

        self.tokenizer, self.code, self.most = Tokenizer.from_file(path), {"<u2": "H", "<u4": "I"}[dtype], most
        # of letters and marks; NFC keeps these letters, and their lower case is a character's own
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
        as_bytes = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.as_bytes = [as_bytes(c)[0][0] if c.isalpha() else c for c in map(chr, range(0x100))]
        self.old: dict[str, bytes] = {}
        self.merged = self.tokenizer.model.tokenize
        # U+001C to U+001F are white space to Python, but not to the tokenizer
        self.split = re.compile(r"[\S\x1c-\x1f]+").findall

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            m = self.plain(word)
            if not m or "<|" in word:
                ids = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
            elif m[2]:
                ids = self[m[1].lower()] + self[m[2]]
            elif word.islower():  # letters in lower case: one pre-token, which normalizing leaves as it is
                ids = self.packed([t.id for t in self.merged(word if word.isascii() else word.translate(self.as_bytes))])
            else:
                ids = self[word.lower()]
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return b"".join(map(self.__getitem__, self.split(text) if odd else text.split()))


_encoders: dict[tuple, WordIds] = {}


def word_ids(path: str, dtype: str) -> WordIds:
    """One encoder per Python worker; it stays warm from task to task."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = WordIds(path, dtype)
    return _encoders[path, dtype]


class TokenFileWriter:
    """Writes one file; documents in the order of add()."""

    def __init__(self, out, id_bytes: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.id_bytes, self.frame_bytes = out, id_bytes, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held, self.held_bytes, self.seek, self.docs, self.counts, self.per_frame = [], 0, [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.docs.append(doc_id)
        self.counts.append(len(ids) // self.id_bytes)
        if self.held_bytes >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        import xxhash

        if self.held:
            raw = b"".join(self.held)
            frame = self.compressor.compress(raw)
            self.out.write(frame)
            self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.per_frame.append(len(self.held))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        import numpy as np

        self.end_frame()
        known = np.array([d is not None for d in self.docs], "<u1")
        parts = [np.array([d or 0 for d in self.docs], "<i8"), known, np.array(self.counts, "<u8"), np.array(self.per_frame, "<u8")]
        index = struct.pack("<BQQ", self.id_bytes, len(self.docs), len(self.seek)) + self.compressor.compress(b"".join(p.tobytes() for p in parts))
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<III", *s) for s in self.seek) + struct.pack("<IBI", len(self.seek), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.out.close()


class TokenFileReader:
    """Reads the tables of one file; ``documents`` decompresses the frames that it needs, and checks each."""

    def __init__(self, source):
        import numpy as np
        import zstandard

        self.source, size = source, source.size()
        self.decompressor = zstandard.ZstdDecompressor()
        n, descriptor, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC or descriptor != HAS_CHECKSUMS:
            raise ValueError("no seek table")
        table_at = size - 9 - 12 * n - 8
        if struct.unpack("<II", self.at(table_at, 8)) != (SEEK_FRAME, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.seek = np.frombuffer(self.at(table_at + 8, 12 * n), "<u4").reshape(n, 3).astype("i8")
        self.frame_at = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        index = self.at(int(self.frame_at[-1]), table_at - int(self.frame_at[-1]))
        self.id_bytes, docs, _ = struct.unpack("<BQQ", index[8:25])
        raw = self.decompressor.decompress(index[25:])
        ids, known = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "<u1", docs, 8 * docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.counts = np.frombuffer(raw, "<u8", docs, 9 * docs).astype("i8")
        self.first_doc = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u8", n, 17 * docs).astype("i8"))])

    def at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def documents(self, wanted=None):
        """(doc_id, ids as little-endian bytes, place of its first id) of all or of the wanted doc ids."""
        import numpy as np
        import xxhash

        starts = np.concatenate([[0], np.cumsum(self.counts)])
        for f, (packed, size, checksum) in enumerate(self.seek.tolist()):
            lo, hi = int(self.first_doc[f]), int(self.first_doc[f + 1])
            if wanted is not None and not any(d in wanted for d in self.doc_ids[lo:hi]):
                continue
            raw = self.decompressor.decompress(self.at(int(self.frame_at[f]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {f} is damaged")
            for d in range(lo, hi):
                if wanted is None or self.doc_ids[d] in wanted:
                    a = int(starts[d] - starts[lo]) * self.id_bytes
                    yield self.doc_ids[d], raw[a : a + int(self.counts[d]) * self.id_bytes], int(starts[d])


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, id_bytes: int = 2, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Files of all documents in ascending doc_id order, one per range of doc ids; returns their manifest (file, path, docs, tokens).

    The documents are dealt to ranges by Spark's sampled splitters; a hot source or long text doesn't matter to them.
    Null texts are empty, rows without doc_id come first, rows with equal ids follow in the order of their texts.
    """
    dtype = {2: "<u2", 4: "<u4"}[id_bytes]

    def write(batches):
        import numpy as np
        import pyarrow as pa

        end, ids, writer, path = np.array([end_id], dtype).tobytes(), word_ids(tokenizer_path, dtype), None, None
        for batch in pieces(batches, "text"):
            if writer is None:
                fs, base = filesystem(folder)
                path = f"{folder}/{attempt_name('tokens', '.ztok')}"
                writer = TokenFileWriter(fs.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}"), id_bytes, frame_bytes)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                writer.add(doc_id, ids.encode(text or "") + end)
        if writer:
            writer.close()
            from pyspark import TaskContext

            yield pa.RecordBatch.from_pydict({"file": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path], "docs": pa.array([len(writer.docs)], pa.int64()), "tokens": pa.array([sum(writer.counts)], pa.int64())})

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(write, "file long, path string, docs long, tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 (of the ids as 32-bit integers)."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as source:
                    reader = TokenFileReader(source)
                    dtype, rows = f"<u{reader.id_bytes}", []
                    for doc_id, ids, start in reader.documents():
                        wide = ids if reader.id_bytes == 4 else np.frombuffer(ids, dtype).astype("<u4").tobytes()
                        rows.append((doc_id, base + start, len(ids) // reader.id_bytes, zlib.crc32(wide)))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # the window runs over one row per file
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", before)
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 2), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_and_index(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes the documents' ids to the shared folder, reads the files back, and returns read_tokens()."""
    return read_tokens(write_tokens(docs, tokenizer_path or tokenizer_file("word_bpe_49k.json"), shared_folder(spark, "tokens")))
