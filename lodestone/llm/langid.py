"""Language identification with a blended-spectrum string kernel.

A text's features are the character n-grams (n = 1..ORDER) of its lower-cased letters that occur in
it at all (presence, not counts), hashed to BITS bits.  The kernel of two texts is the number of shared
n-grams over the geometric mean of their own numbers.  Landmarks (Nystroem) are a bounded part of the
training sample; one-versus-rest kernel ridge regression is fitted on the kernel columns of the
landmarks.  Scoring is a batch of presence rows times the landmark matrix, times the coefficients.

Learning is bounded: the LANGUAGES most frequent values of the label, at most SAMPLE texts of each (those
with the smallest hash of the key) and SAMPLED in all, at most LANDMARKS landmarks of each and MARKED in
all; of a text longer than its share of CHARACTERS (PART at most), windows at hashed places all over it
are read.  So there are fewer texts and landmarks of a language where there are many, and the model is at
most 2^BITS x MARKED bits.  Everything else covers all rows and whole texts.

Defined cases: a text that is null or has no letter gets ``und`` with score 0, and so does every
text if there is nothing to learn from; rows with a null key are never learned from and never held
out; very long texts are read whole; repeated rows get equal results; a tie goes to the first language
in order; an empty table gives no rows; other columns are kept by ``identify``, where columns of the
results' names are replaced, and dropped by the query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import slices, table
from .textvec import sums

ORDER = 3
BITS = 16
SAMPLE = 240
LANDMARKS = 32
PART = 20_000
WINDOW = 1000
CHARACTERS = 24_000_000
LANGUAGES = 256
SAMPLED = 8192
MARKED = 2048
BLOCK = 256
SALTS = 64
RIDGE = 1e-3
ROWS = 128
FEW = 32
GAP = " " * (ORDER + 1)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hashed n-gram) of all n-grams for each n; white space counts, other marks are spaces."""
    lower = [GAP + t.lower() for t in texts]
    # Every text is followed by a gap, the last one too, so its n-grams don't depend on its neighbours.
    cps = np.frombuffer(("".join(lower) + GAP).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    code = np.where(_letters()[cps], cps, 32).astype(np.uint32)
    h = np.zeros(len(code), np.uint32)
    for n in range(1, ORDER + 1):
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
        yield doc, (mixed[: len(doc)] >> np.uint32(32 - BITS)).astype(np.int64)


def _has_letter(texts: list[str]) -> np.ndarray:
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return sums(_letters()[cps], np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))) > 0


@dataclass
class Model:
    languages: list[str]
    used: np.ndarray  # hashed n-grams of the landmarks
    bits: np.ndarray  # used n-grams x landmarks, 8 landmarks a byte
    sizes: np.ndarray  # n-grams of each landmark
    coefficients: np.ndarray  # landmarks x languages

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def marks(self, at: int) -> np.ndarray:
        """Columns of BLOCK landmarks from at on; one block is kept unpacked."""
        if getattr(self, "kept", (None,))[0] != at:
            self.kept = at, np.unpackbits(self.bits[:, at // 8 : (at + BLOCK) // 8], axis=1, count=min(BLOCK, len(self.sizes) - at)).astype(np.float32)
        return self.kept[1]

    def kernel(self, texts: list[str]) -> np.ndarray:
        held = np.zeros((len(texts), 1 << BITS), bool)
        for doc, gram in _grams(texts):
            held[doc[: len(gram)], gram] = True
        own = np.maximum(np.count_nonzero(held, axis=1), 1)
        rows = held[:, self.used].astype(np.float32)
        shared = [rows @ self.marks(at) for at in range(0, len(self.sizes), BLOCK)]
        return np.concatenate(shared, axis=1) / np.sqrt(own[:, None] * self.sizes[None, :]).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        known = np.flatnonzero(_has_letter(texts))
        # Rows of a block: bounded characters as well as bounded texts.
        at = 0
        while at < len(known):
            to, size = at, 0
            while to < len(known) and to - at < ROWS and (to == at or size + len(texts[known[to]]) <= 1 << 20):
                size += len(texts[known[to]])
                to += 1
            block = known[at:to]
            margins = self.kernel([texts[d] for d in block]) @ self.coefficients
            best = margins.argmax(axis=1)
            odds = np.exp(4.0 * (margins - margins.max(axis=1, keepdims=True)).astype(np.float64))
            scores[block] = 1.0 / odds.sum(axis=1)
            for d, b in zip(block, best):
                names[d] = self.languages[b]
            at = to
        return names, scores


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """texts in a fixed order; the first landmarks texts of each language are its landmarks.

    Texts are read a few at a time, as the arrays of their characters are many times their size.
    """
    languages = sorted(set(labels))
    most = max(1, min(landmarks, MARKED // max(len(languages), 1)))
    chosen, taken = [], dict.fromkeys(languages, 0)
    for k, name in enumerate(labels):
        if taken[name] < most:
            taken[name] += 1
            chosen.append(k)
    chosen.sort(key=lambda k: (labels[k], k))
    if not chosen:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.uint8), np.zeros(0), np.zeros((0, 0), np.float32))
    columns, sizes = [], []
    for k in range(0, len(chosen), 8):
        held = np.zeros((8, 1 << BITS), bool)
        for doc, gram in _grams([texts[i] for i in chosen[k : k + 8]]):
            held[doc[: len(gram)], gram] = True
        columns.append(np.packbits(held, axis=0)[0])
        sizes += np.count_nonzero(held, axis=1).tolist()
    bits = np.stack(columns, axis=1)
    used = np.flatnonzero(bits.any(axis=1))
    model = Model(languages, used, bits[used], np.maximum(np.array(sizes[: len(chosen)], np.float64), 1), np.zeros((0, 0), np.float32))
    inner = np.concatenate([model.kernel([texts[i] for i in chosen[k : k + FEW]]) for k in range(0, len(chosen), FEW)]).astype(np.float64)
    system, aim = ridge * len(texts) * (inner + 1e-6 * np.eye(len(chosen))), np.zeros((len(chosen), len(languages)))
    for k in range(0, len(texts), FEW):
        outer = model.kernel(texts[k : k + FEW]).astype(np.float64)
        system += outer.T @ outer
        aim += outer.T @ np.where(np.array(labels[k : k + FEW])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    model.coefficients = np.linalg.solve(system, aim).astype(np.float32)
    return model


def held_out(key):
    """Rows kept from learning: crc32 of the key as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def windows(text: Column, key: Column, part: int) -> Column:
    """The text, or part characters of it (at least one window) in windows at hashed places, if it is longer."""
    width = min(WINDOW, part)
    places = F.array(*(F.lit(k) for k in range(max(part // width, 1))))
    pick = lambda k: F.substring(text, (F.pmod(F.xxhash64(key, k), F.length(text) - width + 1) + 1).cast("int"), F.lit(width))
    return F.when(F.length(text) <= part, text).otherwise(F.array_join(F.transform(places, pick), " "))


def train(docs: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, part: int = PART, languages: int = LANGUAGES) -> Model:
    """Fitted in one task over at most SAMPLED texts and about CHARACTERS characters; the driver sees the model alone.

    The smallest hashes of a label are taken from those of its SALTS parts, so no task orders all its texts.
    """
    k = F.col(key)
    pool = docs.filter(k.isNotNull() & ~held_out(k) & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    most = [r["label"] for r in pool.groupBy(F.col(label).alias("label")).count().orderBy(F.desc("count"), "label").limit(languages).collect()]
    if not most:
        return fit([], [])
    sample = max(1, min(sample, SAMPLED // len(most)))
    part = max(1, min(part, CHARACTERS // (len(most) * sample)))
    rows = pool.filter(F.col(label).isin(most)).select(F.col(label).alias("label"), F.xxhash64(k.cast("string")).alias("h"), k.alias("key"), windows(F.col(text), k, part).alias("text"))
    for salt in (F.pmod("h", F.lit(SALTS)), F.lit(0)):
        order = W.partitionBy("label", salt).orderBy("h", "key", "text")
        rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, labels))], pa.binary())], ["model"])

    found = rows.repartition(1).sortWithinPartitions("label", "n").select("label", "text").mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [])


def identify(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """All columns of docs, with lang_pred and score; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BITS and MARKED
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("lang_pred", "score") and c != text))
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small parts: only their texts are Python objects at a time.
        for batch in (part for whole in batches for part in slices(whole, at)):
            names, scores = shared.value.predict(["" if t is None else t for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, "doc_id", "text", "lang")
    rows = identify(docs.select("doc_id", "text"), "text", model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
