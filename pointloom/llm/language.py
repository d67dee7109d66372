"""Operator 5: language ID by multinomial naive Bayes over hashed character n-grams.

Characters are lowered and everything but letters becomes a space; bigrams and trigrams are
hashed into `buckets` cells. Training counts come from a bounded sample of the labelled rows
(`max_train_docs` whole texts in expectation, drawn by a hash of id and text), and
give one log-probability row per cell and one column per language. That matrix has a fixed
size (buckets x languages, float32), is broadcast, and a batch of texts is scored by gathering
its cells' rows and summing them per document.

lang_pred is `und` (score 0) for null texts and texts without any letter, and for all texts if
there is nothing to learn from. Ties go to the language that sorts first. The score is the
posterior probability of the predicted language. Only the text decides a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import arrow_map, keyed_mod, released, slices, texts
from pointloom.session import table

BUCKETS, MAX_TRAIN_DOCS, ORDERS, SMOOTHING = 1 << 15, 8192, (2, 3), 0.5
#: Characters scored at once.
PIECE = 1 << 18
_lut: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point up to 0xFFFF: its lower-case letter, or a space; 0xFFFF stands for all above."""
    global _lut
    if _lut is None:
        _lut = np.array([ord(c.lower()[0]) if (c := chr(x)).isalpha() else 32 for x in range(0xFFFF)] + [0xFFFF], np.uint32)
    return _lut


def cells(chars: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """The hashed cell of every n-gram."""
    n = len(chars) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = np.full(n, order, np.uint32)
    for j in range(order):
        x = (x ^ chars[j : j + n]) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0x85EBCA77)) >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64)


def lowered(text: bytes) -> np.ndarray:
    """Letters and spaces of a text, with a space at either end."""
    points = np.frombuffer((" " + text.decode("utf-8", "replace") + " ").encode("utf-32-le"), np.uint32)
    return letters()[np.minimum(points, 0xFFFF)]


def count_cells(text: bytes, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """How often each cell occurs in a text; long texts are counted in pieces."""
    chars, out = lowered(text), np.zeros(buckets, np.int64)
    for order in orders:
        for at in range(0, len(chars), PIECE):
            out += np.bincount(cells(chars[at : at + PIECE + order - 1], order, buckets), minlength=buckets)
    return out


class Model:
    """Languages, their log priors, and the log probability of each cell in each language."""

    def __init__(self, langs: list[str], priors: np.ndarray, matrix: np.ndarray, orders: tuple[int, ...], buckets: int) -> None:
        self.langs, self.priors, self.matrix, self.orders, self.buckets = langs, priors, matrix, orders, buckets

    def scores(self, rows: list[bytes]) -> np.ndarray:
        """Log joint probability of each text and language; no row for a text without letters is meaningful."""
        chars = [lowered(x) for x in rows]
        out = np.tile(self.priors, (len(rows), 1))
        for i, j in slices([len(x) for x in chars], PIECE):
            flat = np.concatenate(chars[i:j])
            begins = np.zeros(j - i + 1, np.int64)
            np.cumsum([len(x) for x in chars[i:j]], out=begins[1:])
            for order in self.orders:
                for at in range(0, len(flat), 4 * PIECE):
                    part = cells(flat[at : at + 4 * PIECE + order - 1], order, self.buckets)
                    if not len(part):
                        continue
                    lo = np.clip(begins[:-1] - at, 0, len(part))
                    hi = np.maximum(np.clip(begins[1:] - at - (order - 1), 0, len(part)), lo)
                    rows_of = self.matrix.take(part, axis=0)
                    total = np.zeros((len(part) + 1, len(self.langs)))
                    np.cumsum(rows_of, axis=0, dtype=np.float64, out=total[1:])
                    out[i:j] += total[hi] - total[lo]
        return out

    def predict(self, rows: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(rows), [0.0] * len(rows)
        logs = self.scores(rows)
        best = logs.argmax(1)
        score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        plain = [(letters()[np.minimum(np.frombuffer(x.decode("utf-8", "replace").encode("utf-32-le"), np.uint32), 0xFFFE)] != 32).any() or any(map(str.isalpha, x.decode("utf-8", "replace"))) for x in rows]
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), plain)], [float(s) if ok else 0.0 for s, ok in zip(score.tolist(), plain)]


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int = MAX_TRAIN_DOCS, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Model:
    """Counts cells per language over a sample of max_docs rows in expectation, drawn by hash."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.count()
    share = min(1.0, max_docs / n) if n else 1.0
    sample = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                if lang not in own:
                    own[lang] = np.zeros(buckets + 1, np.int64)
                own[lang][:-1] += count_cells(text, orders, buckets)
                own[lang][-1] += 1
        for lang, counts in own.items():
            cell = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(counts[cell], pa.int64())], names=["lang", "cell", "n"])

    sums = arrow_map(sample, [text_col, lang_col], run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    found = np.array(sums.column("lang").to_pylist(), object)
    langs = sorted(set(found))
    counts = np.zeros((buckets + 1, len(langs)))
    for k, lang in enumerate(langs):
        own = found == lang
        counts[np.asarray(sums.column("cell"))[own], k] = np.asarray(sums.column("n"))[own]
    docs, counts = counts[-1], counts[:-1] + SMOOTHING
    return Model(langs, np.log(docs / docs.sum()) if len(langs) else docs, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32), orders, buckets)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row; map-only."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(1))
            langs, scores = [], []
            for i, j in slices([len(x) for x in rows]):
                a, b = shared.value.predict(rows[i:j])
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df, [id_col, text_col], run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose language is identified with a score of at least `least`."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ok = texts(batch.column(at)), []
            for i, j in slices([len(x) for x in rows]):
                langs, scores = shared.value.predict(rows[i:j])
                ok += [lang != "und" and score >= least for lang, score in zip(langs, scores)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return df.mapInArrow(released(run), df.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(keyed_mod("doc_id", 4) != 2), "doc_id", "text", "lang")
    return identify(docs, model).withColumn("held_out", keyed_mod("doc_id", 4) == 2)
