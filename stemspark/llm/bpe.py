"""Byte-level BPE with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry gets its id from one probe
and one comparison. Tier two merges the bytes of the others: a heap of candidate pairs over a doubly linked list of parts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_MASK = 0xFFFFFFFFFFFFFFFF


def _mix(h: int, d: int) -> int:
    x = (h ^ d * 0x9E3779B97F4A7C15) & _MASK
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & _MASK
    return x ^ x >> 32


class PerfectHash:
    """Hash and displace: n keys in exactly n slots. Buckets are placed largest first; one-key buckets name a free slot."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        self.displace = [0] * self.buckets
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        self.slots: list[int] = [-1] * n
        free = n
        for b, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(group) == 1:
                while self.slots[free - 1] >= 0:
                    free -= 1
                self.slots[free - 1] = group[0][1]
                self.displace[b] = -free
                continue
            d = 1
            while True:
                at = [_mix(h, d) % n for h, _ in group]
                if len(set(at)) == len(at) and all(self.slots[a] < 0 for a in at):
                    break
                d += 1
            for a, (_, i) in zip(at, group, strict=True):
                self.slots[a] = i
            self.displace[b] = d

    def __call__(self, key: bytes) -> int:
        """The one index that this key can have; the caller compares the key."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.buckets]
        return self.slots[-d - 1 if d < 0 else _mix(h, d) % self.n]


class Codec:
    """Encodes and decodes by a rank file of base64 tokens, pre-tokens by `pattern`. Ranks must be distinct and below 65536 or 2**32."""

    #: Unicode White_Space, as the pattern's \s means it.
    SPACE = "\t-\r \x85\xa0  -     　"

    def __init__(self, rank_file: str, pattern: str, pieces: int = 500_000):
        import regex

        with open(rank_file, "rb") as lines:
            pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line.strip())]
        if len({t for t, _ in pairs}) < len(pairs):
            raise ValueError("a token stands twice in the rank file")
        self.tokens = [t for t, _ in pairs]
        self.ranks = [r for _, r in pairs]
        self.hash = PerfectHash(self.tokens)
        top = max(self.ranks) + 1
        self.width = 2 if top <= 1 << 16 else 4
        by_rank = [b""] * top
        for t, r in pairs:
            by_rank[r] = t
        self.lengths = np.array([len(t) for t in by_rank], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(by_rank), np.uint8)
        ids = dict(pairs)
        self.of_byte = [ids.get(bytes([b]), -1) for b in range(256)]
        #: The id that two adjacent parts merge into.
        self.pairs = {(a, b): r for t, r in pairs for i in range(1, len(t)) if (a := ids.get(t[:i])) is not None and (b := ids.get(t[i:])) is not None}
        self.pre = regex.compile(pattern)
        # Matches of the pattern never hold white space before its last one, so a run of other characters and one space
        # before it can be encoded by itself; the pattern then cuts each such piece.
        self.cut = re.compile(f" ?[^{self.SPACE}]+|[{self.SPACE}]+(?![^{self.SPACE}])|[{self.SPACE}]+")
        self.known, self.tokens_known = common.Bounded(pieces), common.Bounded(pieces)

    def rank(self, token: bytes) -> int | None:
        i = self.hash(token)
        return self.ranks[i] if self.tokens[i] == token else None

    def merge(self, word: bytes) -> list[int]:
        """Tier two: the lowest-ranked adjacent pair, leftmost first, merges until no pair is in the vocabulary."""
        n, pairs = len(word), self.pairs
        part = [self.of_byte[b] for b in word]  # the id of the part that starts here; -1 once it is merged away
        if -1 in part:
            raise ValueError("the rank file lacks a single byte")
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := pairs.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, left, a, b = heapq.heappop(heap)
            right = after[left]
            if part[left] != a or right >= n or part[right] != b:
                continue
            part[left], part[right] = r, -1
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (new := pairs.get((r, part[right]))) is not None:
                    heapq.heappush(heap, (new, left, r, part[right]))
            if (at := before[left]) >= 0 and (new := pairs.get((part[at], r))) is not None:
                heapq.heappush(heap, (new, at, part[at], r))
        return [r for r in part if r >= 0]

    def encode_token(self, token: str) -> list[int]:
        word = token.encode()
        r = self.rank(word)
        return self.merge(word) if r is None else [r]

    def _token(self, token: str) -> tuple[bytes, str]:
        ids = self.encode_token(token)
        found = np.array(ids, f"<u{self.width}").tobytes(), "".join([f"{i}," for i in ids])
        self.tokens_known[token] = found
        return found

    def _piece(self, piece: str) -> tuple[bytes, str]:
        found = [self.tokens_known.get(t) or self._token(t) for t in self.pre.findall(piece)]
        self.known[piece] = both = (b"".join([f[0] for f in found]), "".join([f[1] for f in found]))
        return both

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and their decimal form joined by commas."""
        known = self.known
        found = [known.get(p) or self._piece(p) for p in self.cut.findall(text)]
        return np.frombuffer(b"".join([f[0] for f in found]), f"<u{self.width}"), "".join([f[1] for f in found])[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        n = self.lengths[ids]
        ends = np.cumsum(n)
        where = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.pool[where].tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    if (rank_file, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[rank_file, pattern] = Codec(rank_file, pattern)
        common.holds("bpe", _CODECS.clear)
    return _CODECS[rank_file, pattern]


def encode(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text of docs(doc_id, text), decodes the ids again and returns a row per document:
    doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids (array of int).

    Null text is empty text (no ids); doc_id is passed through, null and repeated ones too; other columns are ignored.
    One narrow pass: memory is bounded by a batch of texts and the cache of pieces.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, written, decoded, kept = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids, decimal = c.encode(text or "")
                    n.append(len(ids))
                    written.append(hashlib.sha256(decimal.encode()).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids.astype(np.int32))
                out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(written, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
