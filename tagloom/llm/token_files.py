"""Token ids of a corpus as Arrow files of equal-length sequences, open to random access without copying.

Documents are dealt by ranges of their ids to parts, and each part is sorted. A task takes the documents of its part
as they come, tokenises them (see :class:`Encoder`), closes each with an end id, and writes the ids one after
another as sequences of equal length:

- ``tokens-<part>-<k>.arrow`` (Arrow IPC file): ``ids`` and ``mask``, both fixed-size lists, in batches of BATCH
  sequences. Token t of a part is in file t // (length * per_file) at a place that follows from t alone, so a reader
  maps the file and takes a view. The mask (bits) is true for a token and false for the filling of a part's last sequence.
- ``documents-<part>-<k>.arrow``: doc_id, start (in the part) and n_tokens of the documents that begin in that file.
- ``manifest``: a Parquet table with a row per file; what lies before a part is the sum over the parts before it.

Texts are shuffled once and tokenised once. A task holds one batch of sequences, however many documents its part has
and however long they are, and parts are cut into files of bounded size; rows of one id are dealt by further keys.
Files are written under another name and moved into place whole; a repeated task writes the same bytes.

Defined results: null and empty texts have the end id alone; texts of any length are encoded whole and may
span sequences and files; rows without an id come first, equal ids are ordered by the length and hash of their texts,
repeated rows are written each; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.bpe import spread
from tagloom.llm.common import stored
from tagloom.session import scratch_folder

#: Ids in a sequence, sequences in a batch and in a file.
LENGTH, BATCH, PER_FILE = 2_048, 64, 4_096
#: Bytes of text that are split at a time; words whose ids a Python worker remembers (only speed depends on it).
SLICE_BYTES, REMEMBERED, LONG_WORD = 8 << 20, 800_000, 64
INDEX_ROWS = 65_536


class Encoder:
    """Ids by the tokenizers library, each different word of a slice once.

    Words are what stands between ASCII white space. A tokenizer file whose rules drop white space and look at no
    character beyond it gives a text the ids of its words, one after another; :meth:`check` tests that, and that letters are folded.
    """

    def __init__(self, definition: str):
        self.definition = definition

    def __getstate__(self):
        return {"definition": self.definition}

    def ready(self) -> Encoder:
        if not hasattr(self, "library"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.definition)
            self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
            marks = [self.library.encode(m, add_special_tokens=False).ids for m in ".,"]
            self.marks = np.array([m[0] for m in marks], dtype=self.kind)
            self.memory: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}
            self.check()
        return self

    def check(self) -> None:
        probe = "It's  a\ttest,\n42 words' ends\r\n<|x|> été é ...\x0b9th \x0c"
        words = [w for w in pc.ascii_split_whitespace(pa.array([probe]))[0].as_py() if w]
        apart = [i for e in self.library.encode_batch(words, add_special_tokens=False) for i in e.ids]
        folded = self.library.encode(probe.lower(), add_special_tokens=False).ids
        one_each = all(len(self.library.encode(m, add_special_tokens=False).ids) == 1 for m in ".,")
        if self.library.encode(probe, add_special_tokens=False).ids != apart or apart != folded or not one_each:
            raise ValueError("this tokenizer keeps white space: texts cannot be encoded word by word")

    def _learn(self, words: list[str]) -> list[bytes]:
        encoded = self.library.encode(words, add_special_tokens=False, is_pretokenized=True)
        ids = np.array(encoded.ids, dtype=self.kind).tobytes()
        ends = np.searchsorted(np.array(encoded.word_ids, dtype=np.int64), np.arange(1, len(words) + 1)) * self.kind.itemsize
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        found = list(map(self.memory.get, words))
        unknown = [k for k, ids in enumerate(found) if ids is None]
        if len(self.memory) >= REMEMBERED // 2:  # what was asked for lately stays a generation longer
            self.older, self.memory = self.memory, {}
        missing = []
        for k in unknown:
            found[k] = self.older.get(words[k])
            if found[k] is None:
                missing.append(k)
        for a in range(0, len(missing), 20_000):
            part = missing[a : a + 20_000]
            for k, ids in zip(part, self._learn([words[k] for k in part]), strict=True):
                found[k] = ids
        self.memory.update((words[k], found[k]) for k in unknown if len(words[k]) <= LONG_WORD)
        return found

    def _stems(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Different words to fewer ones with the same ids, and which of them end in a full stop or comma.

        The library folds A-Z itself; in words of ASCII without an added token it can be done before. After a letter
        or digit of ASCII a closing mark is a piece of its own.
        """
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        closed = pc.match_substring_regex(words, "[A-Za-z0-9][.,]$")
        stems = pc.if_else(closed, pc.utf8_slice_codeunits(words, 0, -1), words)
        full = pc.ends_with(words, ".").to_numpy(zero_copy_only=False)
        return stems.dictionary_encode(), np.where(closed.to_numpy(zero_copy_only=False), np.where(full, 0, 1), -1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of ids of each."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        stems, mark = self._stems(words.dictionary)
        found = [*self._ids_of(stems.dictionary.to_pylist()), b""]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.kind.itemsize
        flat, codes = np.frombuffer(b"".join(found), dtype=self.kind), words.indices.to_numpy()
        stem_of = stems.indices.to_numpy()[codes] if len(codes) else codes
        tail = mark[codes]
        n = sizes[stem_of]
        whole = n + (tail >= 0)
        ends = np.r_[0, np.cumsum(whole)]
        ids = np.empty(int(ends[-1]), dtype=self.kind)
        at = spread(ends[:-1], n)
        ids[at] = flat[spread((np.cumsum(sizes) - sizes)[stem_of], n)]
        ids[ends[1:][tail >= 0] - 1] = self.marks[tail[tail >= 0]]
        offsets = np.asarray(lists.offsets)
        return ids, np.diff(ends[offsets - offsets[0]])


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, texts) of about SLICE_BYTES at a time (one text at least); null is empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, side="right")))
            yield batch.column(0).slice(a, b - a), texts.slice(a, b - a)
            a = b


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within; local paths may come with or without ``file:``."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Output:
    """An Arrow file under a temporary name, moved into place when closed."""

    def __init__(self, path: str, schema: pa.Schema):
        self.files, self.path = place(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.files.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.stream, schema)

    def close(self) -> None:
        self.writer.close()
        self.stream.close()
        self.files.move(self.part, self.path)


class _PartWriter:
    """The files of one part; tokens arrive in order."""

    def __init__(self, folder: str, part: int, kind: np.dtype, id_kind: pa.DataType, fill: int, shape: tuple[int, int, int]):
        self.folder, self.part, self.kind, self.fill = folder, part, kind, fill
        self.length, per_file, per_batch = shape
        self.per_file = self.length * per_file
        token = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(token, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])
        self.index_schema = pa.schema([("doc_id", id_kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.buffer, self.used, self.n_tokens = np.empty(per_batch * self.length, dtype=kind), 0, 0
        self.rows: tuple[list, list, list] = ([], [], [])
        self.tokens = self.index = None
        self.n_documents = 0
        #: (part, k, n_tokens, n_documents) of the closed files
        self.closed: list[tuple[int, int, int, int]] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        """A document with its end id."""
        self._open()
        for column, value in zip(self.rows, (doc_id, self.n_tokens, len(ids)), strict=True):
            column.append(value)
        self.n_documents += 1
        if len(self.rows[0]) >= INDEX_ROWS:
            self._flush_index()
        while len(ids):
            self._open()
            n = min(len(ids), len(self.buffer) - self.used)
            self.buffer[self.used : self.used + n] = ids[:n]
            self.used, self.n_tokens, ids = self.used + n, self.n_tokens + n, ids[n:]
            if self.used == len(self.buffer):
                self._flush()
                if self.n_tokens % self.per_file == 0:
                    self.close()

    def _open(self) -> None:
        if self.tokens is None:
            name = f"{self.part}-{self.n_tokens // self.per_file}.arrow"
            self.tokens = _Output(f"{self.folder}/tokens-{name}", self.schema)
            self.index = _Output(f"{self.folder}/documents-{name}", self.index_schema)
            self.n_documents = 0

    def _flush(self) -> None:
        if not self.used:
            return
        n = -(-self.used // self.length) * self.length
        self.buffer[self.used : n] = self.fill
        mask = np.zeros(n, dtype=bool)
        mask[: self.used] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (self.buffer[:n], mask)]
        self.tokens.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.used = 0

    def _flush_index(self) -> None:
        if self.rows[0]:
            columns = [pa.array(c, t) for c, t in zip(self.rows, self.index_schema.types, strict=True)]
            self.index.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.index_schema))
            self.rows = ([], [], [])

    def close(self) -> None:
        if self.tokens is not None:
            self._flush()
            self._flush_index()
            self.tokens.close()
            self.index.close()
            self.tokens = None
            k = (self.n_tokens - 1) // self.per_file
            self.closed.append((self.part, k, self.n_tokens - k * self.per_file, self.n_documents))


MANIFEST = "part bigint, k bigint, n_tokens bigint, n_documents bigint"


def write(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_file: int = PER_FILE, per_batch: int = BATCH) -> DataFrame:
    """Write the files of ``docs`` below ``folder``; returns the manifest.

    The manifest has a row per file: part, k, n_tokens, n_documents, length, per_file, per_batch, and ahead, the number of
    tokens in the parts before.
    """
    if per_file % per_batch:
        raise ValueError("a file holds whole batches")
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(Encoder(f.read()))
    id_kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.ready()
        end, out = np.array([end_id], dtype=encoder.kind), None
        for batch in batches:
            if len(batch):
                part = batch.column("part")[0].as_py()
                out = out or _PartWriter(folder, part, encoder.kind, id_kind, end_id, (length, per_file, per_batch))
            for keys, texts in text_slices([batch]):
                ids, sizes = encoder.encode(texts)
                stops = np.cumsum(sizes)
                for key, n, stop in zip(keys.to_pylist(), sizes.tolist(), stops.tolist(), strict=True):
                    out.add(key, np.concatenate([ids[stop - n : stop], end]))
        if out:
            out.close()
        columns = list(zip(*out.closed, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "k", "n_tokens", "n_documents"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = ["doc_id", "size", "hash", "row"]
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("part"))
    files = stored(ranged.mapInArrow(run, MANIFEST), "files")
    # one row per shuffle partition reaches this window and the broadcast
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = files.join(F.broadcast(sizes.select("part", ahead.alias("ahead"))), "part")
    shape = {"length": length, "per_file": per_file, "per_batch": per_batch}
    manifest = manifest.withColumns({name: F.lit(value) for name, value in shape.items()})
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class TokenFiles:
    """Random access to the tokens of one part: local files are mapped, views are returned, nothing is copied."""

    def __init__(self, folder: str, part: int, length: int = LENGTH, per_file: int = PER_FILE, per_batch: int = BATCH):
        self.folder, self.part, self.length, self.per_file, self.per_batch = folder, part, length, per_file, per_batch
        self._file = self._batch = None

    def _open(self, name: str) -> pa.ipc.RecordBatchFileReader:
        files, path = place(f"{self.folder}/{name}")
        local = isinstance(files, pafs.LocalFileSystem)
        return pa.ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))

    def batch(self, sequence: int) -> tuple[np.ndarray, pa.BooleanArray, int]:
        """Flat ids and mask of the batch that holds ``sequence``, and its first sequence."""
        file, inside = divmod(sequence, self.per_file)
        if self._file is None or self._file[0] != file:
            self._file, self._batch = (file, self._open(f"tokens-{self.part}-{file}.arrow")), None
        number = inside // self.per_batch
        if self._batch is None or self._batch[0] != number:
            columns = self._file[1].get_batch(number).columns
            self._batch = (number, columns[0].flatten().to_numpy(zero_copy_only=True), columns[1].flatten())
        return self._batch[1], self._batch[2], file * self.per_file + number * self.per_batch

    def sequence(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence."""
        ids, mask, first = self.batch(number)
        a = (number - first) * self.length
        return ids[a : a + self.length], mask.slice(a, self.length)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """``n`` ids from place ``start`` of the part, a batch at a time."""
        while n > 0:
            ids, mask, first = self.batch(start // self.length)
            a = start - first * self.length
            taken = ids[a : a + n]
            if mask.slice(a, n).false_count:
                raise ValueError("tokens beyond the last document were asked for")
            yield taken
            start, n = start + len(taken), n - len(taken)

    def documents(self, file: int) -> Iterator[pa.RecordBatch]:
        """(doc_id, start, n_tokens) of the documents that begin in a file."""
        reader = self._open(f"documents-{self.part}-{file}.arrow")
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)


def read_documents(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    names = ["part", "k", "ahead", "length", "per_file", "per_batch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, k, ahead, *shape in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                files = TokenFiles(folder, part, *shape)
                for rows in files.documents(k):
                    sums = []
                    for start, n in zip(rows.column("start").to_pylist(), rows.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for ids in files.tokens(start, n):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id"), pc.add(rows.column("start"), ahead), rows.column("n_tokens"), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    manifest = spark.read.parquet(f"{folder}/manifest").select(*names)
    return manifest.repartition("part", "k").mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def build(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None, **shape: int) -> str:
    """Write ``docs``; returns the folder (a new one below the shared scratch folder by default)."""
    folder = folder or scratch_folder(docs.sparkSession, "token_files")
    write(docs, tokenizer_file, end_id, folder, **shape)
    return folder
