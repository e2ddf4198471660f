"""BPE against a library, and packing against what a sequence allows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENS = bpe.read_ranks(RANKS)
VOCABULARY = bpe.Vocabulary(TOKENS, public_tokenizers.PATTERN).ready()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_same_ids_as_the_library(texts):
    ids = VOCABULARY.encode(texts)
    assert [x.tolist() for x in ids] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [VOCABULARY.decode(x) for x in ids] == [t.encode() for t in texts]


def test_perfect_hash_has_one_slot_per_key():
    assert sorted(VOCABULARY.index.key_at.tolist()) == list(range(len(TOKENS)))
    assert (VOCABULARY.index.places(TOKENS) == range(len(TOKENS))).all()


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(bpe, "SLICE_TOKENS", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    texts = ["thntat ereing " * 40, "", "short one", "x" * 300]
    assert [x.tolist() for x in VOCABULARY.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_any_white_space_and_added_tokens(seed):
    """Random texts of blanks, other white space, marks and added tokens, against both libraries."""
    rng = random.Random(seed)
    parts = [" ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "The", "'s", "'ll", "12", "é", "!", "...", "<|endoftext|>", "<|", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4_000)]
    assert [x.tolist() for x in VOCABULARY.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = bpe.Vocabulary(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, packing.added_tokens(path)).ready() if seed == 0 else None
    if own:
        library = Tokenizer.from_file(path)
        assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encode_rows(docs, rows, empty):
    got = sorted((r["doc_id"] or 0, r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), bytes(r["decoded"])) for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect())
    want = []
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id or 0, len(ids), hashlib.sha256(packed).hexdigest(), (text or "").encode()))
    assert got == sorted(want)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).collect() == []


@given(st.integers(1, 10_000))
def test_cut(n):
    parts = packing.cut(n)
    assert sum(size for _, size in parts) == n and all(size == packing.SEQUENCE for _, size in parts[1:]) and 0 < parts[0][1] <= packing.SEQUENCE
    assert all(a + size == b for (a, size), (b, _) in zip(parts, parts[1:], strict=False))


@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_is_the_plain_rule(lengths):
    lengths = sorted(lengths, reverse=True)
    room: list[int] = []
    for n, sequence, offset in zip(lengths, *packing.best_fit(lengths, 64), strict=True):
        fits = [r for r in room if r >= n]
        if not fits:
            room.append(64)
            assert sequence == len(room) - 1 and offset == 0
        else:
            assert room[sequence] == min(fits) and offset == 64 - room[sequence]
        room[sequence] -= n


@pytest.mark.parametrize("shard", [4_096, 5])
def test_packed_rows(docs, rows, empty, shard):
    got = packing.pack(packing.pieces(docs, RANKS, public_tokenizers.PATTERN), shard=shard).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])].append(1)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode_ordinary(text or "") + [0]
        for k, (start, size) in enumerate(packing.cut(len(ids))):
            packed = b"".join(i.to_bytes(4, "little") for i in ids[start : start + size])
            want[(doc_id, k, start, size, zlib.crc32(packed))].append(1)
    assert pieces == want
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= packing.SEQUENCE
    if shard > len(got):
        tokens = sum(r["length"] for r in got)
        assert len(sequences) <= -(-tokens // packing.SEQUENCE) + 1
    assert packing.pack(packing.pieces(empty, RANKS, public_tokenizers.PATTERN)).collect() == []


def test_short_and_long_merges_agree():
    """Both ways of merging, around the length where one gives way to the other."""
    rng = random.Random(8)
    for n in (1, 2, 3, bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1, 90):
        for letters in (b"a", b"ab", b"thernigos", bytes(range(256))):
            word = bytes(rng.choice(letters) for _ in range(n))
            assert VOCABULARY.merge_short(word) == VOCABULARY.merge_long(word) == VOCABULARY.merge(word)


def test_words_merge_together_as_one_by_one():
    """Words of all lengths in one call, repeated and of one byte, equal pairs side by side; ``merge_all`` also takes long ones."""
    rng = random.Random(9)
    words = [bytes(rng.choice(letters) for _ in range(n)) for n in range(1, bpe.SHORT + 1) for letters in (b"a", b"ab", b"thernigos", bytes(range(256))) for _ in range(5)]
    rng.shuffle(words)
    assert VOCABULARY.merge_together(words) == [VOCABULARY.merge_long(w) for w in words]
    assert VOCABULARY.merge_together([]) == []
    words[3:3] = [b"ab" * bpe.SHORT, words[0]]
    assert VOCABULARY.merge_all(words) == [VOCABULARY.merge_long(w) for w in words]


def test_pairs_make_the_tokens_that_the_ranks_name():
    rng, ranks = random.Random(10), VOCABULARY.ranks
    pairs = [(rng.randrange(len(TOKENS)), rng.randrange(300)) for _ in range(3_000)]
    pairs += [(ranks[t[:i]], ranks[t[i:]]) for t in TOKENS[::17] for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right = np.array(pairs).T
    assert VOCABULARY.joined.ranks(left, right).tolist() == [ranks.get(TOKENS[a] + TOKENS[b], len(TOKENS)) for a, b in pairs]


def test_ascii_texts_are_split_by_the_same_pattern():
    """All pairs and many runs of ASCII characters, control characters included."""
    rng, split = random.Random(11), bpe.for_ascii(public_tokenizers.PATTERN)
    letters = [chr(i) for i in range(128)]
    texts = [a + b + c for a in letters for b in letters for c in ("", "a", " 1")]
    texts += ["".join(rng.choices(letters + list(" \n's  reAB12") * 20, k=rng.randint(1, 60))) for _ in range(5_000)]
    assert all(split.findall(t) == VOCABULARY.split.findall(t) for t in texts)
    assert bpe.for_ascii(r"(?i)a|\p{Lu}") is None and bpe.for_ascii(r"[^\S]") is None
