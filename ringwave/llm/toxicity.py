"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms of a text are its lower-cased words, cut to their first four letters, each with its count. A term
weighs count * idf; its idf is counted over all documents. No term of an example is left out.
The examples lie in an inverted index: short posting lists are walked whole and give every example's partial
similarity; long ones are stored with a value for each example, cut into blocks of examples with each block's
largest value. A block is opened for a query only if its best partial similarity plus the product with the
block's maxima passes the query's k-th best known similarity, so the neighbours are exact. The nearest
examples of each label vote with the square of their similarity, as labels are uneven; votes are calibrated by monotone
regression on the examples themselves, each left out of its own vote. Terms in no example lengthen a text's vector by the same factor for all examples
and so change neither order nor votes; similarities are taken within the examples' terms.

The fit takes a bounded sample: at most about ``examples`` labelled rows, chosen by a hash of the id at a
rate from the number of all labelled rows, and fewer if these hold over ``characters`` characters. Document
frequencies and scores cover all documents whole.

Defined results: a null or empty text, or one without a term of an example, gets the rate of toxic examples;
a document labelled twice counts as toxic if any label says so; rows with a null label or id teach nothing,
a row without an id counts as held out; without labels all scores are 0; repeated rows give a row each;
equally near examples are taken by smallest id within the order of blocks; further columns are not read; an
empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwave.llm.language import remainder
from ringwave.llm.registry import query, table
from ringwave.llm.text import Kinds, Rolling, bounded, code_points, mix, runs, texts

#: Letters that a term keeps of a word.
LETTERS = 4
#: Bytes of text handled at once; hashes of all words are kept of them.
TEXT_BYTES = 1 << 19
#: Queries and postings walked at once.
QUERIES, WALK = 128, 1 << 21
#: Similarities count as equal within this step.
STEP = 1 << 20
_wordly: list[Kinds] = []


def terms(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms (64-bit hashes) and counts of all texts, sorted by row and term."""
    codes, begins = code_points([p.lower() for p in parts])
    if not _wordly:
        _wordly.append(Kinds(str.isalnum))
    start, end = runs(_wordly[0](codes))
    row = (np.searchsorted(begins, start, "right") - 1).astype(np.int64)
    rolled = Rolling(codes)
    key = mix(rolled.spans(start, np.minimum(end, start + LETTERS)))
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])][: len(key)])
    return row[at], key[at], np.diff(np.r_[at, len(key)])


def _known(vocabulary: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the sorted vocabulary holds, and their places."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(vocabulary, key)
    at[at == len(vocabulary)] = 0
    known = np.flatnonzero(vocabulary[at] == key)
    return known, at[known]


def _unit(row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    return weight / np.sqrt(np.maximum(np.bincount(row, weight * weight, rows), 1e-30))[row]


@dataclass
class Index:
    """Examples' terms as posting lists with block maxima, and the calibration of votes."""

    vocabulary: np.ndarray  # sorted hashes of all terms of the examples
    idf: np.ndarray
    ids: np.ndarray  # of the examples, by place; each label has blocks of its own
    labels: np.ndarray
    sides: list[tuple[int, int]]  # range of places of each label
    edges: np.ndarray  # each term's range of the two below; empty for terms with a long list
    places: np.ndarray
    values: np.ndarray
    long: np.ndarray  # each term's row of the table below, -1 without
    table: np.ndarray  # long lists: terms x examples, filled up to whole blocks
    maxima: np.ndarray  # terms x blocks
    steps: np.ndarray  # votes and their calibrated scores
    scores: np.ndarray
    rest: float = 0.0  # score of a text without any of the terms
    block: int = 64
    neighbours: int = 15

    def vectors(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places of the terms in the vocabulary and weights, each row of unit length."""
        row, key, count = terms(parts)
        known, at = _known(self.vocabulary, key)
        row = row[known]
        return row, at, _unit(row, count[known] * self.idf[at], len(parts))

    def _partial(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """Products over the short lists, for all places."""
        width = self.table.shape[1]
        out = np.zeros(rows * width)
        size = self.edges[at + 1] - self.edges[at]
        walk = np.cumsum(size) // WALK
        for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[0, np.flatnonzero(np.diff(walk)) + 1, len(at)])):
            n = size[lo:hi]
            total = int(n.sum())
            if not total:
                continue
            item = np.arange(total) + np.repeat(self.edges[at[lo:hi]] - np.r_[0, np.cumsum(n)[:-1]], n)
            cell = np.repeat(row[lo:hi] * width, n) + self.places[item]
            first = int(row[lo]) * width
            found = np.bincount(cell - first, np.repeat(weight[lo:hi], n) * self.values[item])
            out[first : first + len(found)] += found
        return out.reshape(rows, width).astype(np.float32)

    def _best(self, near: np.ndarray, k: int) -> np.ndarray:
        """Keys of the k nearest places of each row, falling: similarity in steps, then smaller place."""
        width = near.shape[1]
        key = np.rint(near * STEP).astype(np.int64) * width + np.arange(width - 1, -1, -1)
        return -np.sort(-np.partition(key, width - k, axis=1)[:, width - k :], axis=1)

    def nearest(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact nearest examples of each label for each row's vector: places and similarities, by label, nearest first."""
        near = self._partial(row, at, weight, rows)
        dense = np.zeros((rows, len(self.table)), np.float32)
        high = self.long[at] >= 0
        dense[row[high], self.long[at[high]]] = weight[high]
        sides = [self._side(near[:, lo : lo + -(-(hi - lo) // self.block) * self.block], dense, lo, hi, k) for lo, hi in self.sides]
        return tuple(np.concatenate(x, 1) for x in zip(*sides))

    def _side(self, near: np.ndarray, dense: np.ndarray, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        width, k, ahead = near.shape[1], min(k, hi - lo), lo // self.block
        bound = near.reshape(len(near), -1, self.block).max(2) + dense @ self.maxima[:, ahead : ahead + width // self.block] + 2.0 / STEP
        near[:, hi - lo :] = -1
        shut = np.ones(bound.shape, bool)
        for first in (True, False):
            if first:
                open_ = bound >= bound.max(1, keepdims=True)
            else:  # partial similarities are lower bounds, so the k-th best one is passed by all neighbours
                open_ = shut & (bound >= np.floor_divide(self._best(near, k)[:, -1:], width) / STEP)
            for b in np.flatnonzero(open_.any(0)):
                who = np.flatnonzero(open_[:, b])
                part = slice(b * self.block, min((b + 1) * self.block, hi - lo))
                near[who, part] += dense[who] @ self.table[:, lo + part.start : lo + part.stop]
            shut &= ~open_
        place = width - 1 - self._best(near, k) % width
        return lo + place, np.take_along_axis(near, place, 1)

    def neighbourhood(self, parts: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of the texts that have terms, places of their neighbours and similarities."""
        row, at, weight = self.vectors(parts)
        some = np.unique(row)
        for lo in range(0, len(some), QUERIES):
            part = some[lo : lo + QUERIES]
            a, b = np.searchsorted(row, [part[0], part[-1] + 1])
            place, near = self.nearest(np.searchsorted(part, row[a:b]), at[a:b], weight[a:b], len(part), k)
            yield part, place, near

    def vote(self, place: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Share of toxic neighbours, by squared similarity, of the nearest ones of each label."""
        weight = np.maximum(near, 0).astype(float) ** 2
        toxic = self.labels[place[0]] > 0  # places come by label
        of, rest = (-np.sort(-weight[:, side], axis=1)[:, : self.neighbours].sum(1) for side in (toxic, ~toxic))
        return of / np.maximum(of + rest, 1e-12)

    def score(self, parts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """Calibrated scores and, as evidence, the ids of the nearest examples."""
        out = np.full(len(parts), self.rest)
        evidence: list[list[int]] = [[] for _ in parts]
        for some, place, near in self.neighbourhood(parts, self.neighbours):
            out[some] = np.interp(self.vote(place, near), self.steps, self.scores)
            for i, p, s in zip(some, place, near):
                evidence[i] = self.ids[p[s > 0]].tolist()
        return out, evidence


def build(ids: np.ndarray, labels: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, row: np.ndarray, at: np.ndarray,
          count: np.ndarray, lists: int = 1024, block: int = 64) -> Index:
    """Index of the examples' terms; the ``lists`` longest lists get a value for each example."""
    value = _unit(row, count * idf[at], len(ids))
    # examples with the same heaviest term come into one block, so that maxima are close to the values
    heavy = np.full(len(ids), -1)
    order = np.lexsort((at, value, row))
    heavy[row[order]] = at[order]  # the last entry of a row stays
    toxic = labels > 0
    place, sides, full = np.empty(len(ids), np.int64), [], 0
    for label in (True, False):
        own = np.flatnonzero(toxic == label)
        if len(own):
            place[own[np.lexsort((ids[own], heavy[own]))]] = full + np.arange(len(own))
            sides.append((full, full + len(own)))
            full += -(-len(own) // block) * block
    named, marked = np.zeros(full, np.int64), np.zeros(full)
    named[place], marked[place] = ids, toxic
    size = np.bincount(at, minlength=len(vocabulary))
    far = np.sort(np.lexsort((np.arange(len(size)), -size))[:lists])
    far = far[size[far] > 1]
    long = np.full(len(vocabulary), -1, np.int32)
    long[far] = np.arange(len(far))
    held = np.zeros((len(far), full), np.float32)
    dense = long[at] >= 0
    held[long[at[dense]], place[row[dense]]] = value[dense]
    at, where, value = at[~dense], place[row[~dense]], value[~dense]
    order = np.lexsort((where, at))
    return Index(
        vocabulary, idf, named, marked, sides, np.r_[0, np.cumsum(np.bincount(at, minlength=len(vocabulary)))],
        where[order].astype(np.int32), value[order].astype(np.float32), long, held, held.reshape(len(far), full // block, block).max(2),
        np.zeros(1), np.zeros(1), float(toxic.mean()) if len(ids) else 0.0, block)


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rising fit of labels to votes by pooling adjacent violators; equal votes go together."""
    x, back = np.unique(votes, return_inverse=True)
    pools: list[list[float]] = []
    for total, n in zip(np.bincount(back, labels), np.bincount(back)):
        pools.append([total, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, n, k = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, pools[-1][2] + k]
    return x, np.concatenate([np.full(int(k), t / n) for t, n, k in pools])


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example's terms and counts in one row."""
    for batch in bounded(batches, "body", TEXT_BYTES, 1024):
        row, key, count = terms(texts(batch, "body"))
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
        cut = list(zip(edges[:-1], edges[1:]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("toxic"), pa.array([key[a:b].tobytes() for a, b in cut], pa.binary()),
             pa.array([count[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary())], ["id", "toxic", "keys", "counts"])


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        total = np.zeros(len(vocabulary), np.int64)
        n = 0
        for batch in bounded(batches, "body", TEXT_BYTES):
            _, key, _ = terms(texts(batch, "body"))
            np.add.at(total, _known(vocabulary, key)[1], 1)
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], ["at", "n"])

    return run


def _votes(shared):
    """Votes for the examples, each without its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in bounded(batches, "body", TEXT_BYTES, 1024):
            own = batch.column("id").to_numpy(zero_copy_only=False)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for some, place, near in index.neighbourhood(texts(batch, "body"), index.neighbours + 1):
                near = np.where(index.ids[place] == own[some][:, None], 0, near)
                yield pa.RecordBatch.from_arrays([pa.array(index.vote(place, near)), pa.array(toxic[some])], ["vote", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        examples: int = 6000, characters: int = 1 << 24) -> Index:
    """Index of labelled examples; ``labels`` holds only the rows that may be learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("toxic"))
    rate = examples / max(1, known.count())
    drawn = F.xxhash64(F.lit("example"), "id") / F.lit(2.0**64) + 0.5
    chosen = (
        known.where(drawn < rate)
        .groupBy("id").agg(F.max("toxic").alias("toxic")).limit(2 * examples)  # a bound; the rate keeps it near examples
    )
    sample = rows.join(F.broadcast(chosen), "id").select("id", "toxic", "body").persist()
    try:
        length = sample.agg(F.sum(F.length("body"))).first()[0] or 0
        held = sample if length <= characters else sample.where(drawn < min(1.0, rate) * characters / length)
        taken = held.mapInArrow(_example_terms, "id long, toxic long, keys binary, counts binary").toArrow()
        keys = [np.frombuffer(b, np.uint64) for b in taken.column("keys").to_pylist()]
        counts = [np.frombuffer(b, np.int32) for b in taken.column("counts").to_pylist()]
        ids, toxic = (taken.column(c).to_numpy().astype(np.int64) for c in ("id", "toxic"))
        del taken
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        vocabulary, at = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_inverse=True)
        count = np.concatenate([*counts, np.zeros(0, np.int32)])
        del keys, counts
        if not len(vocabulary):
            return build(ids, toxic, vocabulary, np.zeros(0), row, at, count)
        words = spark.sparkContext.broadcast(vocabulary)
        found = rows.mapInArrow(_frequencies(words), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        place, n = (found.column(c).to_numpy() for c in ("at", "n"))
        many = np.ones(len(vocabulary))
        many[place[place >= 0]] = n[place >= 0]
        idf = np.log((2 + n[place == -1].sum()) / (1 + many))
        index = build(ids, toxic, vocabulary, idf, row, at, count)
        votes = held.mapInArrow(_votes(spark.sparkContext.broadcast(index)), "vote double, toxic long").toArrow()
    finally:
        sample.unpersist()
    if len(ids) > 1:
        index.steps, index.scores = monotone(votes.column("vote").to_numpy(), votes.column("toxic").to_numpy())
    return index


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in bounded(batches, "body", TEXT_BYTES, 1024):
            score, evidence = index.score(texts(batch, "body"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score), pa.array(evidence, pa.list_(pa.int64()))], ["id", "score", "evidence"])

    return run


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, evidence`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by examples and characters
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_score(shared), "id long, score double, evidence array<long>")


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~remainder("doc_id", 3).isin(1, -1))


THRESHOLD = 0.7


def _below(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in bounded(batches, "text", TEXT_BYTES, 1024):
            found, _ = index.score(texts(batch, "text"))
            yield batch.filter(pa.array(found < threshold))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score under the threshold; rows pass whole, so nothing is joined or shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, learnable(labels)))
    return docs.mapInArrow(_below(shared, THRESHOLD), docs.schema)


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, learnable(table(spark, sf_dir, "labels"))))
    return found.select(
        F.col("id").alias("doc_id"),
        remainder("id", 3).isin(1, -1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )
