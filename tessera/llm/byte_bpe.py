"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text
from .pretoken import PartEncoder, spaced_split
from .words import mix

VOCABULARY = "byte_bpe_50k.tiktoken"
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PerfectHash:
    """Slot of each of n keys without gaps. ``shift`` has for each bucket a seed, or -1 - slot for a bucket of one key."""

    shift: np.ndarray
    size: int

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """A slot for any hash; whether it is the key's own is for the caller to compare."""
        if not self.size:
            return np.zeros(len(hashes), np.int64)
        shift = self.shift[(hashes % np.uint64(len(self.shift))).astype(np.int64)]
        with np.errstate(over="ignore"):
            moved = mix(hashes + shift.astype(np.uint64) * _STEP) % np.uint64(self.size)
        return np.where(shift < 0, -1 - shift, moved.astype(np.int64))

    @classmethod
    def build(cls, hashes: np.ndarray) -> "PerfectHash":
        """Largest buckets first, each with the first seed that sends its keys to free slots; single keys take what is left."""
        size = len(hashes)
        buckets = max(1, size // 3)
        shift = np.zeros(buckets, np.int64)
        home = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order])) + 1
        groups = sorted(np.split(hashes[order], cuts), key=len, reverse=True) if size else []
        taken = np.zeros(size, bool)
        for g in groups:
            bucket = int(g[0] % np.uint64(buckets))
            if len(g) == 1:
                break
            base, many = 0, 8
            while True:
                seeds = np.arange(base + 1, base + many + 1, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    tried = (mix(g[None, :] + seeds[:, None] * _STEP) % np.uint64(size)).astype(np.int64)
                good = ~taken[tried].any(1)
                good[good] = [len(set(x)) == len(x) for x in tried[good].tolist()]
                found = np.flatnonzero(good)
                if len(found):
                    shift[bucket] = int(seeds[found[0]])
                    taken[tried[found[0]]] = True
                    break
                base, many = base + many, min(4096, 4 * many)
        free = iter(np.flatnonzero(~taken).tolist())
        for g in groups:
            if len(g) == 1:
                shift[int(g[0] % np.uint64(buckets))] = -1 - next(free)
        return cls(shift, size)


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until no pair has one: a heap of pairs over doubly linked parts."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = parts[i]
        if left is None or (j := after[i]) >= n or len(left) + len(parts[j]) != size:
            continue
        left = parts[i] = left + parts[j]
        parts[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = left + parts[k]
            if (r := get(pair)) is not None:
                heapq.heappush(heap, (r, i, len(pair)))
        if (h := before[i]) >= 0:
            pair = parts[h] + left
            if (r := get(pair)) is not None:
                heapq.heappush(heap, (r, h, len(pair)))
    return [ranks[p] for p in parts if p is not None]


class ByteBPE:
    """Encode and decode by a file of ranks, each match of ``pattern`` separately, without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = list(self.ranks)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.tokens), np.uint64, len(self.tokens))
        self.perfect = PerfectHash.build(hashes)
        self.in_slot: list[bytes] = [b""] * len(self.tokens)
        self.slot_id = np.zeros(max(1, len(self.tokens)), np.int64)
        for slot, token in zip(self.perfect.slots(hashes).tolist(), self.tokens, strict=True):
            self.in_slot[slot], self.slot_id[slot] = token, self.ranks[token]
        most = max(self.ranks.values(), default=0)
        self.by_id: list[bytes] = [b""] * (most + 1)
        for token, i in self.ranks.items():
            self.by_id[i] = token
        self.decimal = [str(i) for i in range(most + 1)]
        matches = regex.compile(pattern).finditer
        self._split = lambda text: [m.group() for m in matches(text)]
        # the public pattern has a quicker form for Latin-1 texts
        split = spaced_split if pattern == public_tokenizers.PATTERN else self._split
        self.encoder = PartEncoder(self.encode_words, self.encode_text, split, width=2 if most < 1 << 16 else 4)
        self.kind = self.encoder.kind

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        slots = self.perfect.slots(np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))).tolist()
        held, ids, ranks = self.in_slot, self.slot_id, self.ranks
        return [[int(ids[s])] if held[s] == w else merge_bytes(w, ranks) for w, s in zip(raw, slots, strict=True)]

    def encode_text(self, text: str) -> list[int]:
        return [i for ids in self.encode_words(self._split(text)) for i in ids]


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """One a Python worker and file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode_bpe(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``: little-endian unsigned 32-bit ids of each text. A null text counts as empty; ``ids`` is replaced."""

    def make():
        bpe = load(vocabulary, pattern)
        return lambda texts: [[np.frombuffer(x, bpe.kind).astype("<u4").tobytes() for x in bpe.encoder.encode(texts)]]

    return map_text(docs, text_col, {"ids": "binary"}, make)


def decode_bpe(df: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_text`` (decimal ids joined by one space), ``decoded`` (bytes) and ``error``.

    Null or empty ids give no tokens and no bytes. Bytes that are no whole ids, or an id without a token, give nulls and what is wrong in ``error``, so one damaged
    row does not end the job.
    """

    def make():
        bpe = load(vocabulary, pattern)
        token, decimal, known = bpe.by_id.__getitem__, bpe.decimal.__getitem__, len(bpe.by_id)
        holes = {i for i, t in enumerate(bpe.by_id) if not t}

        def decoded(value: bytes) -> tuple:
            if len(value) % 4:
                return None, None, None, f"{len(value)} bytes are no whole ids"
            ids = np.frombuffer(value, "<u4").tolist()
            if ids and max(ids) >= known or holes and not holes.isdisjoint(ids):
                return None, None, None, f"no token has id {next(i for i in ids if i >= known or i in holes)}"
            return len(ids), " ".join(map(decimal, ids)), b"".join(map(token, ids)), None

        return lambda _, values: list(zip(*[decoded(v or b"") for v in values], strict=True)) if values else [[], [], [], []]

    return map_text(df, F.lit(None).cast("string"), {"n_tokens": "long", "ids_text": "string", "decoded": "binary", "error": "string"}, make, [ids_col])


def query(spark, sf_dir, vocabulary: str | None = None):
    from .common import documents

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    ids = encode_bpe(documents(spark, sf_dir).select("doc_id", "text"), path).select("doc_id", "ids")
    return decode_bpe(ids, path).select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
