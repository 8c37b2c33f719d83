"""Token ids as sorted-string-table shards.

A shard holds (key, value) entries in key order. Keys are the identifiers in an order-keeping byte form, values the token
ids as little-endian integers of `width` bytes.

    shard   = block* bloom index footer
    block   = zstd(entry* restart-offset* n-restarts) crc32     (entries share key prefixes; every RESTART-th key is whole)
    entry   = varint(shared) varint(unshared) varint(len(value)) key-suffix value
    index   = per block: varint(len(last key)) last-key varint(offset) varint(length)
    footer  = struct FOOTER

A lookup asks the Bloom filter, finds the block by binary search over the sparse index, the restart by binary search
inside the block, and scans at most RESTART entries.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"STSST001"
#: data end, bloom offset and length, index offset and length, entries, ids, id width, bloom hashes, magic.
FOOTER = struct.Struct("<QQQQQQQII8s")
RESTART = 16
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 32 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(identifier: int | None) -> bytes:
    """Bytes that sort like the identifiers do; null sorts first."""
    return b"" if identifier is None else struct.pack(">Q", identifier + (1 << 63))


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return n, at
        shift += 7


def _bloom_slots(key: bytes, bits: int, hashes: int) -> list[int]:
    a = xxhash.xxh3_64_intdigest(key)
    b = xxhash.xxh3_64_intdigest(key, seed=1) | 1
    return [(a + i * b & 0xFFFFFFFFFFFFFFFF) % bits for i in range(hashes)]


class Writer:
    """Writes one shard to an open binary stream; keys must not decrease."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.offset = self.entries = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.packer = zstandard.ZstdCompressor(level=1)
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.count += 1
        self.entries += 1
        self.ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.count:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = self.packer.compress(raw)
        packed += struct.pack("<I", zlib.crc32(packed))
        self.index.append((self.last, self.offset, len(packed)))
        self._put(packed)
        self._fresh()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def close(self) -> None:
        self._flush()
        data_end = bloom_at = self.offset
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for slot in _bloom_slots(key, bits, BLOOM_HASHES):
                bloom[slot >> 3] |= 1 << (slot & 7)
        self._put(bytes(bloom))
        index_at = self.offset
        self._put(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index))
        self._put(FOOTER.pack(data_end, bloom_at, len(bloom), index_at, self.offset - index_at, self.entries, self.ids, self.width, BLOOM_HASHES, MAGIC))


class Reader:
    """Reads a shard from a seekable binary file: only footer, filter and index stay in memory."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        self.data_end, bloom_at, bloom_n, index_at, index_n, self.entries, self.ids, self.width, self.hashes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(bloom_at)
        self.bloom = file.read(bloom_n)
        file.seek(index_at)
        data, at = file.read(index_n), 0
        self.last_keys: list[bytes] = []
        self.spans: list[tuple[int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last_keys.append(data[at : at + n])
            offset, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.spans.append((offset, length))

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        offset, length = self.spans[i]
        self.file.seek(offset)
        packed = self.file.read(length)
        if zlib.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(packed[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 - 4 * n
        return raw, list(struct.unpack(f"<{n}I", raw[end:-4])), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            unshared, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + unshared]
            at += unshared
            yield key, raw[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.spans)):
            raw, _, end = self._block(i)
            yield from self._entries(raw, 0, end)

    def may_contain(self, key: bytes) -> bool:
        return all(self.bloom[s >> 3] & 1 << (s & 7) for s in _bloom_slots(key, 8 * len(self.bloom), self.hashes))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key (several if it was repeated), in order."""
        found: list[bytes] = []
        if not self.may_contain(key):
            return found
        i = bisect.bisect_left(self.last_keys, key)
        while i < len(self.spans):
            raw, restarts, end = self._block(i)
            low = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(raw, at, end))[0])
            for k, value in self._entries(raw, restarts[max(0, low - 1)], end):
                if k > key:
                    return found
                if k == key:
                    found.append(value)
            i += 1
        return found

    def values(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")


# Encoding. The vocabulary's normaliser and pre-tokeniser never look across white space, nor do its added tokens hold any, so a
# text's ids are those of its pieces between ASCII white space, in order; each distinct piece is encoded by the tokenizers library
# once a worker, the final marks after a letter or digit apart (they are a pre-token of their own). The library folds case after it
# composes letters with marks: folding ASCII letters first spares pieces, and changes nothing in texts without "<|", which added
# tokens start with, and without the marks that ASCII letters compose with (U+0300 to U+037F begin with these two bytes).
# Pieces of Latin letters that have one form only are single pre-tokens: many are encoded as one text and told apart by the
# vocabulary's mark at a word's end. Arrow cuts a group of texts into pieces, numbers the distinct ones and puts their ids in a row.

_TOKENIZERS: dict = {}
#: Pieces that a worker keeps, and the bytes of one that it keeps.
PIECES, PIECE_BYTES = 1_000_000, 256
#: Bytes of texts that are encoded in one go; the last text of a group may be longer.
GROUP_BYTES = 16 << 20
#: Marks that may end a piece: not the apostrophe, which is part of pre-tokens, nor what added tokens end with.
_MARKS = b".,;:!?*&$%#@+=~^`\"()[]{}/\\-_"
_UNFOLDED = (b"<|", b"\xcc", b"\xcd")
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+")
WORD_END = "</w>"


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        vocab = t.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = t, 2 if t.get_vocab_size() <= 1 << 16 else 4, {}, ends
    return _TOKENIZERS[path]


def _stem(piece: bytes) -> tuple[bytes, bytes]:
    """The piece and the final marks that follow a letter or digit."""
    stem = piece.rstrip(_MARKS)
    if len(stem) == len(piece) or not stem:
        return piece, b""
    last = stem[-1]
    apart = 97 <= last | 32 <= 122 or 48 <= last <= 57 or (last > 127 and _LETTERS.fullmatch(stem.decode()) is not None)
    return (stem, piece[len(stem) :]) if apart else (piece, b"")


def _pieces(texts: list[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where the pieces of each text begin and the last ones end, and the pieces of all texts in a row (empty ones may be among them)."""
    folded = pa.array([t if any(b in t for b in _UNFOLDED) else t.lower() for t in texts], pa.binary())
    cut = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(folded), *folded.buffers()[1:]))
    return cut.offsets.to_numpy(), cut.values.dictionary_encode()


def _encode_words(tokenizer, width: int, ends: np.ndarray, words: list[bytes], texts: list[str]) -> dict[bytes, bytes] | None:
    """The ids of words that are single pre-tokens, from one text of them; None if the vocabulary doesn't mark each one's end."""
    ids = np.array(tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, f"<u{width}")
    after = (np.flatnonzero(ends[ids]) + 1) * width
    if len(after) != len(words) or after[-1] != len(ids) * width:
        return None
    data, after = ids.tobytes(), after.tolist()
    return {w: data[i:j] for w, i, j in zip(words, [0, *after], after, strict=False)}


def _learn(tokenizer, width: int, known: dict[bytes, bytes], ends: np.ndarray, every: list[bytes]) -> list[bytes]:
    """The ids of distinct pieces, which known then keeps unless they are too long."""
    found = list(map(known.get, every))
    places = [i for i, ids in enumerate(found) if ids is None]
    if len(known) + len(places) > PIECES:
        known.clear()
    known[b""] = b""
    cut = [(i, every[i], *_stem(every[i])) for i in places]
    todo = list({s for _, _, *pair in cut for s in pair}.difference(known))
    kind = "H" if width == 2 else "I"
    for at in range(0, len(todo), 10_000):
        part = todo[at : at + 10_000]
        texts = [p.decode() for p in part]
        plain = [_LETTERS.fullmatch(t) is not None for t in texts]
        words = list(compress(part, plain))
        pure = _encode_words(tokenizer, width, ends, words, list(compress(texts, plain))) if words else {}
        if pure is not None:
            known.update(pure)
            single = [not x for x in plain]
            part, texts = list(compress(part, single)), list(compress(texts, single))
        for p, e in zip(part, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            known[p] = array(kind, e.ids).tobytes()
    for i, p, stem, end in cut:
        found[i] = known[p] = known[stem] + known[end] if end else known[stem]
    for _, *of in cut:
        for p in of:
            if len(p) > PIECE_BYTES:
                known.pop(p, None)
    return found


def encode_texts(texts: list[bytes | None], path: str, end_id: int) -> tuple[list[bytes], int]:
    """The ids of each text (UTF-8) and end_id, as bytes; and the bytes an id takes."""
    tokenizer, width, known, ends = _tokenizer(path)
    starts, pieces = _pieces([t or b"" for t in texts])
    distinct = pieces.dictionary.cast(pa.binary()).to_pylist()
    values = pa.array(_learn(tokenizer, width, known, ends, distinct), pa.large_binary())
    at = np.append(0, np.cumsum(pc.binary_length(values).to_numpy()[pieces.indices.to_numpy()]))[starts].tolist()
    data = memoryview(values.take(pieces.indices).buffers()[2] or b"")
    end = np.array([end_id], f"<u{width}").tobytes()
    return [bytes(data[i:j]) + end for i, j in pairwise(at)], width


def _grouped(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t or b"")
        if size >= GROUP_BYTES or i == len(texts):
            yield start, i
            start, size = i, 0


def _write_shards(path: str, end_id: int, folder: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, done, writer, stream = common.task_partition(), [], None, None
        name = ""

        def close() -> None:
            nonlocal writer
            writer.close()
            stream.close()
            done.append((part, len(done), name, writer.entries, writer.ids, writer.offset))
            writer = None

        for batch in batches:
            columns = batch.to_pydict()
            ids, texts = columns["doc_id"], columns["text"]
            for i, j in _grouped(texts):
                values, width = encode_texts(texts[i:j], path, end_id)
                for identifier, value in zip(ids[i:j], values, strict=True):
                    if writer is None:
                        name = f"shard-{part:06d}-{len(done):05d}-{uuid.uuid4().hex}.sst"
                        stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                        name = f"{folder}/{name}"
                        writer = Writer(stream, width)
                    writer.add(key_of(identifier), value)
                    if writer.offset >= shard_bytes:
                        close()
        if writer is not None:
            close()
        names = ("part", "seq", "file", "n_docs", "n_ids", "n_bytes")
        yield pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], pa.string() if n == "file" else pa.int64()) for i, n in enumerate(names)})

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every whole text of docs(doc_id, text) and writes shards in ascending doc_id order.

    Returns the manifest: part, seq (shards in order of both), file (as a URI, like `folder`), n_docs, n_ids, n_bytes, start (ids in all shards
    before). Null text is empty text; a null doc_id sorts first; repeated doc_ids are kept, ordered by their text's hash;
    other columns are ignored; an empty table gives an empty manifest. A file belongs to the result only if the manifest
    names it, so a task that runs twice does no harm.
    """
    spark = docs.sparkSession
    common.ship(spark)
    folder = folder or common.scratch(spark, "sst")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", F.col("text").cast("binary").alias("text"))
    wrote = rows.mapInArrow(_write_shards(tokenizer_path, end_id, folder, shard_bytes), "part long, seq long, file string, n_docs long, n_ids long, n_bytes long")
    manifest = common.stored(wrote, "sst-manifest")
    # Prefix sums on two levels, so that no task holds all shards: over parts, then over the shards of a part.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before_part"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.join(parts, "part").withColumn("start", F.col("before_part") + F.coalesce(inside, F.lit(0))).drop("before_part")


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            rows: list[tuple] = []
            fs, path = pafs.FileSystem.from_uri(file)
            with fs.open_input_file(path) as source:
                shard = Reader(source, source.size())
                for key, value in shard.scan():
                    ids = shard.values(value).astype("<u4")
                    rows.append((identifier_of(key), start, len(ids), zlib.crc32(ids.tobytes()), file))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield _digest(rows)
                        rows = []
            yield _digest(rows)


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32", "shard")
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string() if n == "shard" else pa.int64()) for i, n in enumerate(names)})


def read_shards(manifest: DataFrame) -> DataFrame:
    """Reads the shards back: doc_id, start, n_tokens, ids_crc32 of each document, from its stored ids, and its shard."""
    spark = manifest.sparkSession
    n = max(1, min(10_000, manifest.count()))
    common.ship(spark)
    return manifest.select("file", "start").repartition(n).mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer_path, end_id)).drop("shard")
