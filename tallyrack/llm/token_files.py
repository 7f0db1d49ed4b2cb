"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file holds a run of documents in ascending order of their ids:

    8 bytes   magic
    5 x 8     documents, of which without an id, tokens, bytes a token, smallest document id
    sequence  document boundaries (documents + 1 values)
    sequence  document ids, less the smallest
    ids       unsigned little-endian, 2 or 4 bytes each

A sequence (ascending, not negative) is Elias-Fano coded: of each value the low bits are packed,
the high part is written in unary, so a value takes about 2 + log2(range / count) bits; the
place of every 128th one-bit is kept, from which ``select`` finds a value without reading the
rest.  No table of 64-bit offsets exists.

Null texts count as empty and hold the end id only.  Null ids come first.  Rows with equal ids
stay, one after the other.  An empty table makes no file and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, file_bytes, materialise, new_folder, once, tokenizer_path
from .shared_files import read_file, write_file
from .stable_letters import outside as stable_outside
from .stable_letters import word_pattern
from .token_counts import byte_letters

MAGIC = b"TALLYID1"
EVERY = 128


class EliasFano:
    """An ascending sequence of integers >= 0."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        low = np.zeros((n, bits), np.uint8)
        for b in range(bits):
            low[:, b] = (values >> np.uint64(b)) & np.uint64(1)
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(flags, bitorder="little"), ones[::EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBII", self.count, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        count, bits, low, high = struct.unpack_from("<QBII", data, at)
        at += 17
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (-(-count // EVERY), np.dtype("<u4"))):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(count, bits, *parts), at

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, left = int(self.samples[i // EVERY]), i % EVERY
        byte, skip = divmod(place, 8)
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")[skip:])
            if left < len(ones):
                high = byte * 8 + skip + int(ones[left]) - i
                break
            left -= len(ones)
            byte, skip = byte + 64, 0
        if not self.low_bits:
            return high
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (high << self.low_bits) | ((window >> (first % 8)) & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        out = (ones - np.arange(self.count)).astype(np.int64) << self.low_bits
        low = np.unpackbits(self.low, count=self.count * self.low_bits, bitorder="little").reshape(self.count, self.low_bits)
        for b in range(self.low_bits):
            out |= low[:, b].astype(np.int64) << b
        return out


def pack(doc_ids: list[int | None], sizes: list[int], ids: bytes, width: int) -> list[bytes]:
    """The parts of a file; ``doc_ids`` ascend, nulls first."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    head = MAGIC + struct.pack("<QQQQq", len(sizes), len(sizes) - len(known), len(ids) // width, width, least)
    ends = EliasFano.of(np.concatenate([[0], np.cumsum(sizes)]))
    names = EliasFano.of(np.array([d - least for d in known], np.uint64))
    return [head, ends.to_bytes(), names.to_bytes(), ids]


class TokenFile:
    """A file's documents, by position."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.count, self.unnamed, tokens, width, self.least = struct.unpack_from("<QQQQq", data, 8)
        self.ends, at = EliasFano.read(data, 48)
        self.names, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", offset=at)
        if len(self.ids) != tokens or self.ends.count != self.count + 1:
            raise ValueError("a token-id file of wrong length")

    def doc_id(self, k: int) -> int | None:
        return None if k < self.unnamed else self.least + self.names.select(k - self.unnamed)

    def bounds(self, k: int) -> tuple[int, int]:
        return self.ends.select(k), self.ends.select(k + 1)


#: Fixed value: the published split pattern of this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """The tokenizers library with a memory of words.

    For vocabularies that lower-case, drop white space and never merge across ``WORDS``, a text
    is the sequence of its words: what stands between spaces is looked up, then the words in it;
    only new words go to the library's merging.  Texts with special strings or with a character
    matched by ``outside``, and other vocabularies, go to the library as a whole.
    """

    def __init__(self, blob: bytes, words: str, outside: str, cache_words: int = 500_000, cache_letters: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import unicodedata

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(blob)
        spec = json.loads(blob)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = splits[0].get("pattern", {}).get("Regex", "") if splits else ""
        pattern = pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and pattern == WORDS and splits[1]["type"] == "ByteLevel"
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.bare = Tokenizer(self.library.model)
        self.words, self.outside = re.compile(words).findall, re.compile(outside).search
        self.nfc = unicodedata.normalize
        self.letters = byte_letters()
        # ids of words, and of what stands between spaces; when the newer is full, it becomes the older
        self.newer: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.size, self.cache_words, self.cache_letters = 0, cache_words, cache_letters

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of ``chunks`` into the newer memory."""
        newer, older = self.newer, self.older
        cut = {}
        for c in chunks:
            if (found := older.get(c)) is None:
                cut[c] = self.words(c)
            else:
                newer[c] = found
        fresh = []
        for w in {w for words in cut.values() for w in words}:
            if w not in newer:
                if (found := older.get(w)) is None:
                    fresh.append(w)
                else:
                    newer[w] = found
        if fresh:
            letters = self.letters
            merged = self.bare.encode([w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in fresh], is_pretokenized=True, add_special_tokens=False)
            ids = array(self.kind, merged.ids).tobytes()
            ends = (np.cumsum(np.bincount(np.array(merged.word_ids, np.int64), minlength=len(fresh))) * self.width).tolist()
            newer.update(zip(fresh, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        newer.update({c: b"".join([newer[w] for w in words]) for c, words in cut.items() if c not in newer})
        self.size += sum(map(len, chunks)) + sum(map(len, fresh))

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text as packed little-endian integers, the end id last."""
        last = array(self.kind, [end]).tobytes()
        get, out, unknown = self.newer.get, [], set()
        for text in texts:
            plain = text.isascii()
            if not self.by_word or any(s in text for s in self.special) or self.outside(text):
                out.append([array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes(), last])
                continue
            # the library lower-cases letter by letter: no final sigma
            text = text.lower() if plain else self.nfc("NFC", text).replace("Σ", "σ").lower()
            chunks = text.replace("\n", " ").split(" ")
            found = list(map(get, chunks))
            if None in found:
                unknown.update([c for c, f in zip(chunks, found, strict=True) if f is None])
                out.append(chunks)
            else:
                found.append(last)
                out.append(found)
        if unknown:
            self._learn(unknown)
            for i, parts in enumerate(out):
                if isinstance(parts[0], str):
                    out[i] = found = list(map(get, parts))
                    found.append(last)
        if len(self.newer) >= self.cache_words or self.size >= self.cache_letters:
            self.newer, self.older, self.size = {"": b""}, self.newer, 0
        return list(map(b"".join, out))


def write_token_files(
    df: DataFrame,
    folder: str,
    vocabulary_path: str | None = None,
    end_id: int = 1,
    file_ids: int = 8_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode and write files below ``folder``; returns their manifest (file, part, k, n_docs,
    n_tokens), in which (part, k) order the files by document id."""
    blob = file_bytes(vocabulary_path or tokenizer_path("word_bpe_49k.json"))
    words, outside, crc = word_pattern(WORDS), stable_outside(), zlib.crc32(blob)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        coder = once(("token files", crc, words, outside), lambda: WordEncoder(blob, words, outside))
        names: list = []
        held: list[bytes] = []
        size = k = 0

        def flush():
            nonlocal size, k
            sizes = [len(h) // coder.width for h in held]
            path = f"{folder}/ids-{task.partitionId():06d}-{k:04d}-{task.taskAttemptId()}.bin"
            write_file(path, pack(names, sizes, b"".join(held), coder.width))
            row = {"file": [path], "part": [task.partitionId()], "k": [k], "n_docs": [len(sizes)], "n_tokens": [sum(sizes)]}
            names.clear(), held.clear()
            size, k = 0, k + 1
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(texts), 64):
                for name, packed in zip(ids[at : at + 64], coder.encode([t or "" for t in texts[at : at + 64]], end_id), strict=True):
                    names.append(name)
                    held.append(packed)
                    size += len(packed) // coder.width
                    if size >= file_ids:
                        yield flush()
        if held:
            yield flush()

    arrow = pa.schema([("file", pa.string()), ("part", pa.int64()), ("k", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.mapInArrow(write, "file string, part bigint, k bigint, n_docs bigint, n_tokens bigint"), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids of all documents before each file: sums of parts first, so that
    the one ordered pass over everything has a row a part."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("base", F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the CRC-32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = TokenFile(read_file(path))
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for k in range(data.count):
                    a, b = data.bounds(k)
                    out["doc_id"].append(data.doc_id(k))
                    out["start"].append(base + a)
                    out["n_tokens"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(data.ids[a:b].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = with_starts(manifest).select("file", "base").repartition(n, "file")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_rows(spark: SparkSession, df: DataFrame, vocabulary_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``df`` as token-id files in the shared folder and read them back."""
    return read_token_files(write_token_files(df, new_folder(spark, "token-files"), vocabulary_path, end_id))
