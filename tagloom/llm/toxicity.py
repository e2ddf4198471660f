"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Fitting uses a bounded sample of labelled rows. One half of it makes the dictionaries: the ordinary one
holds the commonest words of ordinary documents, the toxic one the same words and after them words of
toxic documents that are over-represented there. Representation is counted over different pairs of
neighbouring words, so copies of a text do not count, and over word beginnings too, so inflected forms
support each other. The other half calibrates a logistic regression.

A window is a word with its blanks, written in ``VERSIONS`` disjoint byte alphabets one after another (in the
dictionaries too), because one short word alone compresses to whole bytes that hide the difference. The gain
of a window is its compressed length under the ordinary dictionary less that under the toxic one. A document's
score comes from its largest gains and the numbers of windows that exceed fixed gains, over all windows.

Defined results: null and empty texts have no window and the lowest score; repeated rows are scored each;
labels that are null or lack a document are not used; without toxic or without ordinary labelled rows every
score is 0; an empty table gives an empty result; other columns are not read by ``score`` and passed on by
``keep_clean``.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.bpe import slices
from tagloom.llm.simhash import words_of

#: The sample: labelled rows of each kind at most, taken by a hash of their ids, and characters of each at most.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1_500, 4_500, 20_000
ORDINARY_WORDS, TOXIC_WORDS, VERSIONS, LEVEL = 2_000, 500, 3, 19
PREFIXES, MIN_PAIRS, MIN_RATIO, MARGIN = range(4, 9), 3, 8.0, 4.0
STEPS = (6, 9, 12, 15, 20)
CUT = 0.3
#: Gains of words that a Python worker remembers; only speed depends on it.
REMEMBERED = 300_000
ALPHABETS = [bytes((i + 61 * k) % 256 for i in range(256)) for k in range(VERSIONS)]


def window(word: bytes) -> bytes:
    spaced = b" " + word + b" "
    return b"".join([spaced.translate(a) for a in ALPHABETS])


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=3
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def ready(self) -> Model:
        """Once per Python worker."""
        if not hasattr(self, "memory"):
            self.lengths = (_compressor(self.ordinary).compress, _compressor(self.toxic).compress)
            self.memory: dict[bytes, int] = {}
        return self

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ordinary", "toxic", "mean", "scale", "weights")}

    def gain(self, word: bytes) -> int:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            text = window(word)
            ordinary, toxic = self.lengths
            found = self.memory[word] = len(ordinary(text)) - len(toxic(text))
        return found

    def features(self, text: str) -> np.ndarray:
        gain = self.gain
        gains = np.array([gain(w) for w in words_of(text)] or [0])
        top = np.sort(gains)[::-1][:3].clip(0)
        over = [(gains >= s).sum() for s in STEPS]
        return np.array([top[0], top.sum(), *np.log1p(over), 100 * over[2] / len(gains), math.log1p(len(gains))])

    def score(self, text: str) -> float:
        if not len(self.weights):
            return 0.0
        z = float(self.weights[0] + ((self.features(text) - self.mean) / self.scale).clip(-6, 6) @ self.weights[1:])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def pair_counts(texts: list[tuple[str, int]]) -> tuple[list[bytes], np.ndarray]:
    """Different words, and per label (ordinary, toxic) how many different words each one follows."""
    number: dict[bytes, int] = {}
    seen: tuple[list, list] = ([], [])
    for text, label in texts:
        ids = np.array([number.setdefault(w, len(number) + 1) for w in words_of(text)], dtype=np.int64)
        seen[label].append(np.stack([np.r_[0, ids[:-1]], ids]) if len(ids) else np.empty((2, 0), dtype=np.int64))
    size = len(number) + 1
    counts = np.zeros((2, size), dtype=np.int64)
    for label in (0, 1):
        if seen[label]:
            before, word = np.concatenate(seen[label], axis=1)
            counts[label] = np.bincount(np.unique(before * size + word) % size, minlength=size)
    return list(number), counts[:, 1:]


def over_represented(words: list[bytes], counts: np.ndarray) -> dict[bytes, float]:
    """Word beginnings and words that toxic pairs of neighbours hold far more often, with their weight."""

    def parts(word: bytes) -> list[bytes]:
        return [word[:k] for k in PREFIXES if k <= len(word)] + ([word] if len(word) >= PREFIXES.stop else [])

    toxic: Counter = Counter()
    for i in np.flatnonzero(counts[1]).tolist():
        for part in parts(words[i]):
            toxic[part] += int(counts[1][i])
    ordinary: Counter = Counter()
    for i in np.flatnonzero(counts[0]).tolist():
        for part in parts(words[i]):
            if part in toxic:
                ordinary[part] += int(counts[0][i])
    share = max(1, int(counts[0].sum())) / max(1, int(counts[1].sum()))
    least, found = math.log(max(1, len(toxic))) + MARGIN, {}
    for part, n in toxic.items():
        ratio = n * share / (ordinary[part] + 0.5)
        if n >= MIN_PAIRS and ratio >= MIN_RATIO and (weight := n * math.log(ratio)) >= least:
            found[part] = weight
    return found


def _dictionaries(texts: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    words, counts = pair_counts(texts)
    marks = over_represented(words, counts)
    weight = [max([marks.get(w, 0.0), *(marks.get(w[:k], 0.0) for k in PREFIXES)]) for w in words]
    common = sorted((i for i in np.flatnonzero(counts[0]).tolist() if not weight[i]), key=lambda i: (counts[0][i], words[i]))
    marked = sorted((i for i in np.flatnonzero(counts[1]).tolist() if weight[i]), key=lambda i: (weight[i], counts[1][i], words[i]))
    base = b"".join(window(words[i]) for i in common[-ORDINARY_WORDS:]) or b" " * 8
    return base, base + b"".join(window(words[i]) for i in marked[-TOXIC_WORDS:])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with a constant first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step.clip(-2, 2)
        if abs(step).max() < 1e-6:
            break
    return w


def train(rows: list[tuple[str, int]], holdout: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows for the dictionaries and others for the calibration."""
    model = Model(*_dictionaries(rows), np.zeros(0), np.ones(0), np.zeros(0))
    if {label for _, label in holdout} == {0, 1}:
        model.ready()
        x = np.array([model.features(text) for text, _ in holdout])
        model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        y = np.array([label for _, label in holdout], dtype=float)
        model.weights = _logistic(((x - model.mean) / model.scale).clip(-6, 6), y)
    return model


def held_out(id_column: Column) -> Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4)) == 2


def _train_drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of the drawn rows, which one task meets together; every other row calibrates."""
    drawn: dict[int, list[tuple[int, int, str]]] = {1: [], 0: []}
    for batch in batches:
        for label, *rest in zip(*(batch.column(k).to_pylist() for k in ("_label", "_order", "_id", "_text")), strict=True):
            drawn[label].append(tuple(rest))
    parts = [[(text, label) for _, _, text in sorted(rows)] for label, rows in drawn.items()]
    model = train([r for part in parts for r in part[::2]], [r for part in parts for r in part[1::2]])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit, in one task, on at most SAMPLE_TOXIC + SAMPLE_ORDINARY labelled rows that are not held out.

    Labelled texts of more than SAMPLE_CHARS characters are not fitted on; all are scored.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") <= SAMPLE_CHARS)
    known = labels.where(~held_out(F.col("_id"))).withColumn("_order", F.xxhash64("_id"))
    parts = []
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        # ids are chosen first, so that only the chosen texts move
        ids = known.where(F.col("_label") == label).orderBy("_order", "_id").limit(most)
        parts.append(texts.join(F.broadcast(ids), "_id").orderBy("_order", "_id", "_text").limit(most).select("_label", "_order", "_id", "_text"))
    trained = parts[0].unionByName(parts[1]).coalesce(1).mapInArrow(_train_drawn, "model binary").collect()
    return pickle.loads(trained[0]["model"]) if trained else train([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few tens of kilobytes
    kind = docs.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = sent.value.ready()
        for keys, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow_kind), pa.array([ready.score(t) for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows whose score reaches ``cut``; rows stay in their tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = sent.value.ready()
        for batch in batches:
            yield batch.filter(pa.array([ready.score(t.as_py() or "") < cut for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
