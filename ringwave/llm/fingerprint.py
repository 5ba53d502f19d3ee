"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the least hash of its s-mers is that of the first or the last one.
Whether a k-mer is an anchor depends on nothing outside it, so equal passages give equal anchors at any
place. Likeness is positional and sees all anchors: two neighbouring anchors with the distance between their
positions form a link, so texts share a link only where two anchors match at the same offset; likeness is the
Dice share of the links, repeats counted. The written fingerprint is a short digest: the smallest 64 distinct
32-bit anchor hashes.

Defined results: null and empty text have the empty fingerprint, two of which are alike to 1; a text
without any anchor is its own anchor and a single anchor its own link; equal texts have equal fingerprints; rows with the same id follow
each other by a hash of their text, rows without an id come last in the order; further columns are not
read; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table
from ringwave.llm.substrings import sliding_least
from ringwave.llm.text import BASE, BATCH_BYTES, Rolling, bounded, code_points, mix, texts

K, S, SIZE = 12, 6, 64


def anchors(parts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions and hashes of all closed syncmers; a text without one is its own anchor."""
    codes, begins = code_points(parts)
    rolled = Rolling(codes)
    n = len(codes) - k + 1
    row = np.repeat(np.arange(len(parts)), np.diff(begins))
    if n > 0:
        inner = np.arange(len(codes) - s + 1)
        value = mix(rolled.spans(inner, inner + s))
        least = sliding_least(value, k - s + 1)
        # the gap after a text belongs to it, so a k-mer must end before it
        inside = (row[:n] == row[k - 1 :]) & (np.arange(k - 1, len(codes)) < begins[1:][row[k - 1 :]] - 1)
        at = np.flatnonzero(inside & ((value[:n] == least) | (value[k - s :][:n] == least)))
    else:
        at = np.zeros(0, np.int64)
    own = row[at]
    hashed = mix(rolled.spans(at, at + k))
    bare = np.flatnonzero((np.bincount(own, minlength=len(parts)) == 0) & (np.diff(begins) > 1))
    if len(bare):
        whole = mix(rolled.spans(begins[bare], begins[bare + 1] - 1))
        order = np.argsort(np.r_[own, bare], kind="stable")
        own, at, hashed = np.r_[own, bare][order], np.r_[at, begins[bare]][order], np.r_[hashed, whole][order]
    return own, at - begins[own], hashed


def sketches(row: np.ndarray, hashed: np.ndarray, rows: int, size: int = SIZE) -> list[np.ndarray]:
    """The smallest distinct 32-bit anchor hashes of each text, rising."""
    key = np.unique((row.astype(np.uint64) << np.uint64(32)) | (hashed >> np.uint64(32)))
    edges = np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(32))
    low = key.astype(np.uint32)
    return [low[a : min(a + size, b)] for a, b in zip(edges[:-1], edges[1:])]


def links(row: np.ndarray, at: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all pairs of neighbouring anchors with their distance; a lone anchor stands alone."""
    same = row[1:] == row[:-1]
    first = np.flatnonzero(same)
    pair = mix(hashed[first] * np.uint64(BASE) + mix(hashed[first + 1] + (at[first + 1] - at[first]).astype(np.uint64)))
    alone = np.flatnonzero(~(np.r_[False, same] | np.r_[same, False])[: len(row)])
    return np.r_[row[first], row[alone]], np.r_[pair, hashed[alone]]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """Dice share of the links of each row's two texts, repeats counted; two texts without any are alike."""
    counted = []
    for row, link in (a, b):
        key, first, n = np.unique(mix(link ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
        counted.append((key, row[first], n))
    (left, row, n), (right, _, m) = counted
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    shared = np.bincount(row[i], np.minimum(n[i], m[j]), rows)
    total = np.bincount(a[0], minlength=rows) + np.bincount(b[0], minlength=rows)
    return np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0)


def _text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _blocks(bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(bounds, np.int64)
        for batch in batches:
            block = np.searchsorted(at, batch.column("place").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32))], [*batch.schema.names, "block"])

    return run


def in_order(rows: DataFrame, columns: str) -> DataFrame:
    """Rows (``place``, ``key``, ...) dealt by ranges of falling ``place``, each range with its follower.

    Ranges come from percentiles of the places; a range ends with a copy (``halo``) of the first row of the
    next one, and the last range with that of the first. Only one place and key per range reach the driver.
    """
    spark = rows.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("place", shares, 10 * ranges)).first()[0] or []
    placed = rows.mapInArrow(_blocks(sorted(set(bounds))), f"{columns}, block int")
    first = placed.groupBy("block").agg(F.max(F.struct("place", (-F.col("key")).alias("back"))).alias("top"))
    tops = sorted(((r.block, r.top.place, -r.top.back) for r in first.collect()), reverse=True)
    # each range's first row goes also to the range before it
    before = [(place, key, tops[i - 1][0]) for i, (_, place, key) in enumerate(tops)]
    if not before:
        return placed.withColumn("halo", F.lit(False))
    to = spark.createDataFrame(before, "place long, key long, before int")
    copies = placed.join(F.broadcast(to), ["place", "key"]).drop("block").withColumnRenamed("before", "block").dropDuplicates(["block"])
    both = placed.withColumn("halo", F.lit(False)).unionByName(copies.withColumn("halo", F.lit(True)))
    return both.repartition("block").sortWithinPartitions("block", "halo", F.desc("place"), "key")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each waits for the one after it."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        """All but the last row, which only follows."""
        old = [r[2] for r in rows]
        kept = [i for i, (r, after) in enumerate(zip(rows[:-1], rows[1:])) if not r[3] and after[0] == r[0]]
        changed = [old[i][: len(old[i]) - len(old[i]) // 2] + old[i + 1][: len(old[i]) // 2] for i in kept]
        own, new = anchors(old), anchors(changed)
        prints, edited = sketches(own[0], own[2], len(old)), sketches(new[0], new[2], len(changed))
        row, link = links(*own)
        place = np.full(len(old) + 1, -1)
        place[kept] = np.arange(len(kept))

        def of(shift: int) -> tuple[np.ndarray, np.ndarray]:
            """Links of the kept rows' own texts, or of those after them."""
            to = place[row - shift]
            return to[to >= 0], link[to >= 0]

        cols = [
            [rows[i][1] for i in kept],
            [len(old[i]) for i in kept],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            [_text(prints[i]) for i in kept],
            [_text(e) for e in edited],
            likeness(of(0), links(*new), len(kept)),
            likeness(of(0), of(1), len(kept)),
        ]
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    waiting: list[tuple] = []
    for batch in bounded(batches, "body", BATCH_BYTES // 2, 4096):
        waiting += zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), texts(batch, "body"), batch.column("halo").to_pylist())
        if len(waiting) > 1:
            yield done(waiting)
            waiting = waiting[-1:]


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of it with its second half replaced, and their likeness, also to the next text's."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("place"),
        F.shiftrightunsigned(F.xxhash64(text_col), 1).alias("key"),
        F.col(text_col).alias("body"),
    )
    ordered = in_order(rows, "id long, place long, key long, body string")
    return ordered.mapInArrow(
        _edited,
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def anchor_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, position, anchor`` of every anchor, for positional matching by a join on ``anchor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            row, at, hashed = anchors(texts(batch, "body"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(at), pa.array(hashed.view(np.int64))], ["id", "position", "anchor"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, "id long, position long, anchor long")


@query("op8_fingerprint")
def op8_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
