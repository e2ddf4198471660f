"""Token files against the tokenizers library and by random access."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tagloom.llm import token_files

FILE, END = public_tokenizers.path("word_bpe_49k.json"), 2


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def expected(library, rows):
    """(doc_id, start, n_tokens, crc) in file order, and all ids."""
    coded = []
    for r in rows:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, END], dtype="<u4")
        coded.append((r["doc_id"], len(ids), zlib.crc32(ids), ids, len((r["text"] or "").encode())))
    coded.sort(key=lambda c: (c[0] is not None, c[0] or 0, c[4]))
    out, start = [], 0
    for doc_id, n, crc, *_ in coded:
        out.append((doc_id, start, n, crc))
        start += n
    return out, np.concatenate([c[3] for c in coded]) if coded else np.empty(0, "<u4")


def test_files_hold_what_the_library_gives(spark, docs, library, tmp_path):
    rows, ids = expected(library, docs.collect())
    shape = {"length": 64, "per_file": 32, "per_batch": 8}  # long texts span files
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = token_files.build(docs, FILE, END, str(tmp_path), **shape)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [tuple(r) for r in token_files.read_documents(spark, folder).orderBy("start").collect()]
    assert got == rows and max(r[2] for r in rows) > 2 * 64 * 32
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("part", "k").collect()
    assert sum(r["n_tokens"] for r in manifest) == len(ids) and sum(r["n_documents"] for r in manifest) == len(rows)
    assert max(r["k"] for r in manifest) > 1 and len({r["part"] for r in manifest}) > 1
    before = pa.total_allocated_bytes()
    for part in {r["part"] for r in manifest}:
        ahead = next(r["ahead"] for r in manifest if r["part"] == part)
        n = sum(r["n_tokens"] for r in manifest if r["part"] == part)
        own, files = ids[ahead : ahead + n], token_files.TokenFiles(folder, part, **shape)
        for s in range(-(-n // 64)):
            piece, mask = files.sequence(s)
            want = own[64 * s : 64 * (s + 1)]
            assert len(piece) == len(mask) == 64 and mask.true_count == len(want) and np.array_equal(piece[mask.to_numpy(zero_copy_only=False)], want)
            assert not piece.flags.owndata  # mapped, not read
        with pytest.raises((ValueError, FileNotFoundError, pa.ArrowInvalid)):
            list(files.tokens(n - 1, 66))
    assert pa.total_allocated_bytes() - before < 65_536


def test_default_shape_and_file_uri(spark, docs, library, tmp_path):
    rows, _ = expected(library, docs.collect())
    folder = token_files.build(docs, FILE, END, f"file://{tmp_path}/deeper")
    assert [tuple(r) for r in token_files.read_documents(spark, folder).orderBy("start").collect()] == rows


def test_empty_table(spark, empty, tmp_path):
    folder = token_files.build(empty, FILE, END, str(tmp_path))
    assert token_files.read_documents(spark, folder).collect() == []


def test_word_by_word_is_the_whole_text(library):
    encoder = token_files.Encoder(open(FILE, encoding="utf-8").read()).ready()
    texts = [
        "", " ", "a<|endoftext|>b <|startoftext|>", "It's we'll 'S 12 3.4", "é ́x y z\x85w\x1cq\x00r", "A\x0b\x0cB\r\n\tC",
        "İΣ σΣ", "x" * 5_000, "你好 \U0001f600\U0001f600", "<|ENDOFTEXT|>", "...!?, a,b;c",
    ]
    ids, sizes = encoder.encode(pa.array(texts).slice(1))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts[1:]]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert encoder.encode(pa.array(texts))[0].tolist() == ids.tolist()  # remembered words


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError):
        token_files.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()).ready()
