"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of character n-grams (n = 1 .. 3, over letters with runs of anything
else as one space) that both contain, each text counted by presence and the kernel normalised by both
texts' own values. Presence is kept in hashed positions. Nystrom landmarks map texts to a finite space in
which ridge regressions, one against the rest for every language, are solved; prediction is two matrix
products over a batch of texts.

The fit takes a bounded sample of labelled rows: at most ``per_language`` texts of each language and
``total`` in all, chosen by a hash of the id at a rate from the languages' counts over all rows. Only
their presence bits reach the driver. Every text is scored whole.

Defined results: a null text or one without letters is ``und`` with score 0; rows without a language teach
nothing; rows without an id are not learned from and count as held out; with nothing to learn from, all is
``und``; repeated rows give a row each; further columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table
from ringwave.llm.text import Kinds, bounded, code_points, mix, texts

ORDERS = (1, 2, 3)
SIZE = 1 << 14
ROWS = 512
_letters: list[Kinds] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(Kinds(str.isalpha))
    return _letters[0](codes)


def presence(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which hashed n-grams each text holds (rows x SIZE, 0 or 1), and which texts have a letter."""
    codes, begins = code_points([p.lower() for p in parts])
    letter = _is_letter(codes)
    gap = codes == 0
    gap[begins[1:] - 1] = True
    codes = np.where(letter, codes, 32).astype(np.uint64)
    row = np.repeat(np.arange(len(parts)), np.diff(begins))
    ends = np.zeros(len(codes), bool)
    ends[begins[1:] - 1] = True
    keep = letter | ends | np.r_[True, letter[:-1]]  # runs of other characters become one space
    codes, row, ends = codes[keep], row[keep], ends[keep]
    out = np.zeros((len(parts), SIZE), np.float32)
    rolled = np.zeros(len(codes), np.uint64)
    crossing = np.zeros(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m < 1:
            break
        rolled = mix(rolled[:m] + codes[n - 1 :] + np.uint64(1))
        crossing = crossing[:m] | ends[n - 1 :]
        if n in ORDERS:
            at = (rolled >> np.uint64(64 - SIZE.bit_length() + 1)).astype(np.int64)
            out[row[:m][~crossing], at[~crossing]] = 1
    return out, np.bincount(row[codes != 32], minlength=len(parts))[: len(parts)] > 0


@dataclass
class Model:
    """Landmarks (their bits and norms) and the weights of every language."""

    languages: list[str]
    landmarks: np.ndarray
    norm: np.ndarray
    weights: np.ndarray

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(bits.sum(1), 1))
        return (bits @ self.landmarks.T) / (own[:, None] * self.norm)

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return self.kernel(bits) @ self.weights


def solve(bits: np.ndarray, languages: list[str], of: np.ndarray, landmarks: int, ridge: float) -> Model:
    """Nystrom features of the sample and one ridge regression per language."""
    rank = np.zeros(len(of), np.int64)
    for k in range(len(languages)):
        rank[of == k] = np.arange((of == k).sum())
    chosen = np.lexsort((of, rank))[:landmarks]  # the same number of every language, as far as there are
    model = Model(languages, bits[chosen], np.sqrt(np.maximum(bits[chosen].sum(1), 1)), np.zeros((0, 0)))
    value, vector = np.linalg.eigh(model.kernel(bits[chosen]).astype(np.float64))
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    feature = model.kernel(bits) @ root
    target = (of[:, None] == np.arange(len(languages))).astype(float)
    weight = 1 / np.bincount(of, minlength=len(languages))[of]  # languages count alike
    left = feature.T @ (feature * weight[:, None]) + ridge * np.eye(feature.shape[1])
    model.weights = (root @ np.linalg.solve(left, feature.T @ (target * weight[:, None]))).astype(np.float32)
    return model


def _sample_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "body", rows=ROWS):
        bits, lettered = presence(texts(batch, "body"))
        packed = [np.packbits(b).tobytes() for b in bits.astype(bool)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("order"), batch.column("lang"), pa.array(packed, pa.binary()), pa.array(lettered)],
            ["order", "lang", "bits", "lettered"])


def fit(rows: DataFrame, per_language: int = 300, total: int = 6000, landmarks: int = 256, ridge: float = 1e-3) -> Model | None:
    """``rows``: id, lang, body. Learns from a bounded sample; see the module's text."""
    rows = rows.where("lang is not null and id is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(total).collect()}
    if not counts:
        return None
    most = max(1, min(per_language, total // len(counts)))
    rate = rows.sparkSession.createDataFrame([(k, min(1.0, 1.3 * most / n)) for k, n in counts.items()], "lang string, rate double")
    order = F.xxhash64(F.lit("sample"), "id")
    taken = (
        rows.withColumn("order", order)
        .join(F.broadcast(rate), "lang")  # at most ``total`` rows
        .where(F.col("order") / F.lit(2.0**64) + 0.5 < F.col("rate"))
        .select("order", "lang", "body")
        .mapInArrow(_sample_bits, "order long, lang string, bits binary, lettered boolean")
        .where("lettered")
        .limit(2 * total + 1000)  # the rate already keeps it below
        .toPandas()
        .sort_values(["order", "lang"])
        .groupby("lang")
        .head(most)
    )
    if not len(taken):
        return None
    languages = sorted(set(taken.lang))
    bits = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in taken.bits]).astype(np.float32)
    return solve(bits, languages, np.array([languages.index(x) for x in taken.lang]), landmarks, ridge)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in bounded(batches, "body", rows=ROWS):
            bits, lettered = presence(texts(batch, "body"))
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if model is not None:
                found = model.scores(bits)
                best = found.argmax(1)
                names = np.where(lettered, np.array(model.languages, object)[best], "und")
                score = np.where(lettered, np.clip(found.max(1), 0, 1), 0).astype(float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x SIZE floats at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_predict(shared), "id long, lang_pred string, score double")


def remainder(column: str, n: int):
    """crc32 of the id's decimal text modulo n; -1 without an id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


@query("op7_language")
def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~remainder("doc_id", 4).isin(2, -1)).select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("body"))
    found = predict(docs, fit(learn))
    return found.select(F.col("id").alias("doc_id"), remainder("id", 4).isin(2, -1).alias("held_out"), "lang_pred", "score")
