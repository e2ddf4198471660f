"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes.

The rank file is read once on the driver and broadcast (its size is that of the vocabulary, not of the
data). In a task, the pre-tokens of a few documents at a time are reduced to the different ones. Tier 1 looks
them up in the vocabulary with a minimal perfect hash (hash and displace, one probe and one comparison);
tier 2 merges the bytes of a miss: all short ones of a slice together, a merge of each at a time over arrays of one
row a word, the others one by one over a linked list with a heap of the possible merges by rank.
Ids come back as bytes, little-endian unsigned 32-bit; decoding goes from ids to bytes through the
vocabulary only.

Defined results: null and empty texts have no ids; texts of any length are encoded whole, their pre-tokens
in slices of bounded number; repeated rows are encoded each; an empty table gives an empty result; only
the two named columns are read, whatever the others are called.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Characters of text, and pre-tokens of one text, that are worked on at a time.
SLICE_CHARS, SLICE_TOKENS = 2_000_000, 400_000
#: Pre-tokens whose ids a Python worker remembers; only speed depends on it.
REMEMBERED = 800_000
#: Bytes up to which words are merged together; work and memory of a word grow with the square of its bytes and with them.
SHORT = 32
#: Classes of characters as far as ASCII goes, for use in brackets.
ASCII_CLASSES = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r ", r"\S": r"^\t-\r "}


def for_ascii(pattern: str) -> re.Pattern | None:
    """The same matches in texts of ASCII alone, by the faster module; None if a part of ``pattern`` is not known to allow it."""
    parts, inside, out = re.findall(r"\\p\{[LN]\}|\\[sS]|\(\?[!:]|[\w' |?+)\[\]^]", pattern), False, []
    if "".join(parts) != pattern:
        return None
    for part in parts:
        inside = part == "[" or inside and part != "]"
        if inside and part == r"\S":
            return None
        listed = ASCII_CLASSES.get(part)
        out.append(part if listed is None else listed if inside else f"[{listed}]")
    return re.compile("".join(out))


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash of fixed keys: ``len(keys)`` slots, each the place of one key."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        hashes = self.hashes(keys)
        self.size, self.n_buckets = n, max(1, n // 3)
        self.displace = np.zeros(self.n_buckets, dtype=np.int64)
        self.key_at = np.full(n, -1, dtype=np.int64)
        buckets = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(buckets, kind="stable")
        ends = np.cumsum(np.bincount(buckets, minlength=self.n_buckets))
        groups = [order[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        taken = bytearray(n)
        for b in sorted((b for b in range(self.n_buckets) if len(groups[b]) > 1), key=lambda b: -len(groups[b])):
            parts = [(h ^ (h >> 29), h >> 17 | 1) for h in map(int, hashes[groups[b]])]
            d = 1
            while True:
                slots = []
                for h, step in parts:
                    mixed = h + d * step & 0xFFFFFFFFFFFFFFFF
                    slot = (mixed ^ (mixed >> 32)) % n
                    if taken[slot] or slot in slots:
                        break
                    slots.append(slot)
                else:
                    break
                d += 1
            self.displace[b], self.key_at[slots] = d, groups[b]
            for slot in slots:
                taken[slot] = 1
        free = iter(np.flatnonzero(self.key_at < 0).tolist())
        for b in (b for b in range(self.n_buckets) if len(groups[b]) == 1):  # single keys name their slot
            slot = next(free)
            self.displace[b], self.key_at[slot] = -1 - slot, groups[b][0]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(k) for k in keys), dtype=np.uint64, count=len(keys))

    def _slots(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (hashes >> np.uint64(29))) + d.astype(np.uint64) * (hashes >> np.uint64(17) | np.uint64(1))
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(self.size)).astype(np.int64)

    def places(self, keys: list[bytes]) -> np.ndarray:
        """For each key the only place in the key list where it can be; the caller compares."""
        hashes = self.hashes(keys)
        d = self.displace[(hashes % np.uint64(self.n_buckets)).astype(np.int64)]
        return self.key_at[np.where(d < 0, -1 - d, self._slots(hashes, d))]


class PairTable:
    """Rank of the token that two neighbouring tokens make, for many pairs at a time: open addressing, half empty at least."""

    def __init__(self, tokens: list[bytes], ranks: dict[bytes, int]):
        self.none = len(tokens)
        halves = (
            n for rank, t in enumerate(tokens) for i in range(1, len(t))
            if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None for n in (a * (self.none + 1) + b, rank)
        )
        keys, made = np.fromiter(halves, dtype=np.int64).reshape(-1, 2).T
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.made = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, self.none, dtype=np.int32)
        waiting, slots = np.arange(len(keys)), self._slots(keys)
        while len(waiting):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[waiting[free]]  # of several keys for a slot one stays
            placed = self.keys[slots] == keys[waiting]
            self.made[slots[placed]] = made[waiting[placed]]
            waiting, slots = waiting[~placed], slots[~placed] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair the rank of its token, or the number of tokens if there is none."""
        keys = left * (self.none + 1) + right
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.made[slots], self.none)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):  # another key is in the slot: the next one
            slots[on] = slots[on] + 1 & self.mask
            there = self.keys[slots[on]]
            out[on] = np.where(there == keys[on], self.made[slots[on]], self.none)
            on = on[(there != keys[on]) & (there >= 0)]
        return out


def _without(table: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table`` with the place ``at`` of each row left out."""
    kept = np.ones(table.shape, dtype=bool)
    kept[rows, at] = False
    return table[kept].reshape(len(rows), table.shape[1] - 1)


class Vocabulary:
    """What a task needs to encode and decode."""

    def __init__(self, tokens: list[bytes], pattern: str, added: dict[str, int] | None = None):
        """``added`` has texts that are tokens of their own, found before all others."""
        self.tokens, self.pattern, self.added = tokens, pattern, added or {}
        self.index = PerfectHash(tokens)

    def ready(self) -> Vocabulary:
        """Once per Python worker: tables that are cheaper to make than to send."""
        if not hasattr(self, "ranks"):
            self.ranks = {t: i for i, t in enumerate(self.tokens)}
            self.pairs = {(t[0], t[1]): i for i, t in enumerate(self.tokens) if len(t) == 2}
            self.of_byte = np.array([self.ranks.get(bytes([b]), len(self.tokens)) for b in range(256)], dtype=np.int64)
            self.joined = PairTable(self.tokens, self.ranks)
            self.split = regex.compile(self.pattern)
            self.split_ascii = for_ascii(self.pattern) or self.split
            self.apart = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
            self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
            self.memory: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}
            sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
            self.token_size, self.token_start = sizes, np.cumsum(sizes) - sizes
            self.token_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        return self

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "added": self.added, "index": self.index}

    def merge(self, word: bytes) -> bytes:
        """Tier 2: always the pair of neighbours with the lowest rank, the leftmost of equal ones."""
        return self.merge_short(word) if len(word) <= SHORT else self.merge_long(word)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The same for many words."""
        short = iter(self.merge_together([w for w in words if len(w) <= SHORT]))
        return [next(short) if len(w) <= SHORT else self.merge_long(w) for w in words]

    def merge_short(self, word: bytes) -> bytes:
        return self.merge_together([word])[0]

    def merge_together(self, words: list[bytes]) -> list[bytes]:
        """From the longest words down: rows of ``width`` pieces lose one by a merge each, or are done, and meet the words of the next width."""
        done, by_size = [b""] * len(words), defaultdict(list)
        for i, word in enumerate(words):
            by_size[len(word)].append(i)
        top, none = max(by_size, default=0), len(self.tokens)
        owner, ids, ranks = np.empty(0, np.int64), np.empty((0, top), np.int64), np.empty((0, max(0, top - 1)), np.int64)
        for width in range(top, 0, -1):
            if fresh := by_size[width]:
                read = self.of_byte[np.frombuffer(b"".join([words[i] for i in fresh]), np.uint8)].reshape(-1, width)
                if (read == none).any():
                    raise ValueError("a byte is no token")
                owner, ids = np.concatenate((owner, np.array(fresh))), np.concatenate((ids, read))
                ranks = np.concatenate((ranks, self.joined.ranks(read[:, :-1].ravel(), read[:, 1:].ravel()).reshape(len(read), width - 1)))
            rows = np.arange(len(owner))
            at = ranks.argmin(axis=1) if width > 1 else rows * 0
            least = ranks[rows, at] if width > 1 else rows * 0 + none
            ends, size = least == none, 4 * width
            packed = ids[ends].astype("<u4").tobytes()
            for k, i in enumerate(owner[ends].tolist()):
                done[i] = packed[size * k : size * (k + 1)]
            if width == 1:
                break
            on = ~ends
            owner, ids, ranks, at, least = owner[on], ids[on], ranks[on], at[on], least[on]
            rows = np.arange(len(owner))
            ids[rows, at] = least
            ids = _without(ids, rows, at + 1)
            ranks = _without(ranks, rows, at)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = self.joined.ranks(ids[left, at[left] - 1], least[left])
            ranks[right, at[right]] = self.joined.ranks(least[right], ids[right, at[right] + 1])
        return done

    def merge_long(self, word: bytes) -> bytes:
        rank_of, n = self.ranks.get, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at a place
        shift = n.bit_length()
        mask, both = (1 << shift) - 1, 2 * shift
        pairs = self.pairs
        heap = [pairs[a, b] << both | i << shift | i + 2 for i, (a, b) in enumerate(zip(word, word[1:])) if (a, b) in pairs]
        heapify(heap)
        while heap:
            code = heappop(heap)
            stop, i = code & mask, code >> shift & mask
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # a piece of this pair has been merged otherwise
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                rank = rank_of(word[i : end[stop]])
                if rank is not None:
                    heappush(heap, rank << both | i << shift | end[stop])
            if i:
                j = before[i]
                rank = rank_of(word[j:stop])
                if rank is not None:
                    heappush(heap, rank << both | j << shift | stop)
        ids, i = [], 0
        while i < n:
            ids.append(rank_of(word[i : end[i]]))
            i = end[i]
        return pack(f"<{len(ids)}I", *ids)

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of different pre-tokens by both tiers."""
        found = [self.packed[place] if self.tokens[place] == word else None for word, place in zip(words, self.index.places(words).tolist(), strict=True)]
        missed = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missed, self.merge_all([words[i] for i in missed]), strict=True):
            found[i] = ids
        return found

    def pieces_of(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token; each different one is looked up when it is met first."""
        if len(self.memory) >= REMEMBERED // 2:  # what was asked for lately stays a generation longer
            self.older, self.memory = self.memory, {}
        memory, older = self.memory, self.older
        found = list(map(memory.get, words))
        missed = [i for i, ids in enumerate(found) if ids is None]
        asked = dict.fromkeys([words[i] for i in missed])
        memory.update((w, older[w]) for w in asked if w in older)
        new = [w for w in asked if w not in memory]
        memory.update(zip(new, self.look_up([w.encode() for w in new]), strict=True))
        for i in missed:
            found[i] = memory[words[i]]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        pieces: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if not waiting:
                return
            found = self.pieces_of(waiting)
            ids = np.frombuffer(b"".join(found), dtype="<u4")
            ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4)
            at = done = 0
            for k, n in owners:
                at += n
                stop = int(ends[at - 1]) if n else done
                pieces[k].append(ids[done:stop])
                done = stop
            waiting.clear()
            owners.clear()

        def add(k: int, text: str) -> None:
            split = self.split_ascii if text.isascii() else self.split
            if len(text) <= SLICE_CHARS:
                words = split.findall(text)
                waiting.extend(words)
                owners.append((k, len(words)))
                if len(waiting) >= SLICE_TOKENS:
                    flush()
                return
            matches = (m.group() for m in split.finditer(text))
            while words := list(islice(matches, SLICE_TOKENS)):
                waiting.extend(words)
                owners.append((k, len(words)))
                flush()

        for k, text in enumerate(texts):
            done = 0
            for m in self.apart.finditer(text) if self.apart else ():
                add(k, text[done : m.start()])
                flush()
                pieces[k].append(np.array([self.added[m.group()]], dtype=np.uint32))
                done = m.end()
            add(k, text[done:] if done else text)
        flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, np.uint32) for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.token_bytes[spread(self.token_start[ids], self.token_size[ids])].tobytes()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all runs that begin at ``starts`` and have ``sizes`` items, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of a bounded number of characters at a time (one text at least); null is empty."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids (binary) and decoded (binary, the ids taken back to bytes)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(rank_file), pattern))
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value.ready()
        for keys, texts in slices(batches):
            ids = words.encode(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, arrow_type), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([words.decode(x) for x in ids], pa.binary()),
            ], ["doc_id", "n_tokens", "ids", "decoded"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(docs.schema[id_col].dataType)
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {key_type}, n_tokens bigint, ids binary, decoded binary")
