"""Removal of repeated word sequences by Rabin-Karp hashes of all windows.

A word goes if it lies in a window of 50 consecutive words whose words also start in a document with a
smaller id. Windows are hashed by rolling polynomials (96 bits), counted in Spark, and repeated windows
are merged to maximal intervals.

To keep unique windows out of the count without missing one, every window is first represented by the
least Rabin-Karp hash of its 10-word parts: equal windows have equal least parts. These are some twentieth
of the words. A window whose least part occurs in one document only is unique; all others are counted.

Hot keys: a window that a text holds many times is one row, and a task first sums up what its own batch of documents holds, so that a part or window shared by
very many documents arrives as one row per batch. Repeats found inside a batch travel as intervals.

Defined results: null or empty text has no words; texts under 50 words stay whole; rows with the same id
are no smaller documents to each other, rows without an id neither cause nor suffer a removal; equal rows
give a row each; further columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table
from ringwave.llm.text import Rolling, bounded, joined, mix, runs

WINDOW, PART = 50, 10
_byte = np.arange(256)
IN_WORD = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    if n < 1:
        return values[:0]
    pad = np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.r_[values, pad].reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Windows:
    """Hashes of all windows of a batch of texts; ``at`` is each window's first word in the batch."""

    def __init__(self, parts: list[bytes], window: int, part: int):
        data, begins = joined(parts)
        start, end = runs(IN_WORD[data])
        self.first = np.searchsorted(start, begins)
        words = mix(Rolling(data).spans(start, end))
        row = np.repeat(np.arange(len(parts)), np.diff(self.first))
        n = max(0, len(words) - window + 1)
        self.at = np.flatnonzero(row[:n] == row[window - 1 :]) if n else np.zeros(0, np.int64)
        self.row = row[self.at]
        self.pos = self.at - self.first[self.row]
        self.window = window
        rolling = Rolling(words)
        grams = np.arange(max(0, len(words) - part + 1))
        least = sliding_least(mix(rolling.spans(grams, grams + part)), window - part + 1)
        self.least = least[self.at]
        self.rolling, self.other = rolling, Rolling(words >> np.uint64(17))

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[which]
        return mix(self.rolling.spans(at, at + self.window)), (mix(self.other.spans(at, at + self.window)) >> np.uint64(33)).astype(np.int32)


def _bodies(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("body").cast(pa.binary()).to_pylist()]


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _parts(window: int, part: int):
    """Rows of a batch: each least part, the smallest and largest id that has it, and all its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            w = Windows(_bodies(batch), window, part)
            new = np.r_[True, (w.least[1:] != w.least[:-1]) | (w.row[1:] != w.row[:-1])][: len(w.least)]
            gram, row = w.least[new], w.row[new]
            order = np.lexsort((row, gram))
            gram, row = gram[order], row[order]
            new = np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])][: len(gram)]
            gram, row = gram[new], row[new]
            begin = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
            ids, key = _ints(batch, "id")[row], _ints(batch, "key")[row]
            edges = pa.array(np.r_[begin, len(gram)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram[begin].view(np.int64)),
                    pa.array(np.minimum.reduceat(ids, begin) if len(begin) else ids),
                    pa.array(np.maximum.reduceat(ids, begin) if len(begin) else ids),
                    pa.ListArray.from_arrays(edges, pa.array(ids)),
                    pa.ListArray.from_arrays(edges, pa.array(key)),
                ],
                ["part", "low", "high", "ids", "keys"],
            )

    return run


def _candidates(window: int, part: int):
    """Rows of windows whose least part is shared; those that repeat within the batch come as intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            w = Windows(_bodies(batch), window, part)
            shared = batch.column("parts")
            n = np.diff(shared.offsets.to_numpy())
            want = np.repeat(np.arange(batch.num_rows), n).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            want ^= shared.flatten().to_numpy().view(np.uint64)
            which = np.flatnonzero(np.isin(w.least ^ (w.row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), want))
            h, check = w.hashes(which)
            row, pos = w.row[which], w.pos[which]
            ids, key = _ints(batch, "id")[row], _ints(batch, "key")[row]
            order = np.lexsort((row, ids, check, h))
            begin = np.r_[True, (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])][: len(h)]
            first = np.empty_like(ids)
            first[order] = ids[order][np.flatnonzero(begin)][np.cumsum(begin) - 1] if len(h) else ids
            known = ids > first
            #: one row of each interval of known repeats, its hash a key of its own
            k_row, k_pos = row[known], pos[known]
            lead = np.r_[True, (k_row[1:] != k_row[:-1]) | (k_pos[1:] != k_pos[:-1] + 1)][: len(k_row)]
            at = np.flatnonzero(lead)
            size = np.diff(np.r_[at, len(k_row)])
            own = mix(key[known][at].view(np.uint64) + k_pos[at].astype(np.uint64))
            #: one row of each window and text; its further places in the text ride along
            new = order[~known[order]]
            begin = np.r_[True, (h[new][1:] != h[new][:-1]) | (check[new][1:] != check[new][:-1]) | (row[new][1:] != row[new][:-1])][: len(new)]
            extra = np.diff(np.r_[np.flatnonzero(begin), len(new)]) - 1
            extra = np.r_[extra, np.zeros(len(at), extra.dtype)]
            more = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(extra)], pa.int32()), pa.array(pos[new[~begin]], pa.int32()), mask=pa.array(extra == 0))
            new = new[begin]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[h[new], own].view(np.int64)),
                    pa.array(np.r_[check[new], np.full(len(at), -1, np.int32)]),
                    pa.array(np.r_[ids[new], ids[known][at]]),
                    pa.array(np.r_[key[new], key[known][at]]),
                    pa.array(np.r_[pos[new], k_pos[at]].astype(np.int32)),
                    pa.array(np.r_[np.zeros(len(new), np.int32), size.astype(np.int32)]),
                    more,
                ],
                ["h", "check", "id", "key", "pos", "known", "more"],
            )

    return run


def _cut(window: int):
    """Each text without the words that its repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            count, removed, kept = [], [], []
            for text, spans, more in zip(_bodies(batch), batch.column("spans").to_pylist(), batch.column("more").to_pylist()):
                words = text.split()
                rest, at, gone = [], 0, 0
                for s in sorted([(s["pos"], s["n"]) for s in spans or ()] + [(p, 1) for p in more or ()]):
                    lo, hi = s[0], s[0] + s[1] - 1 + window
                    if lo > at:
                        rest += words[at:lo]
                    gone += max(0, hi - max(lo, at))
                    at = max(at, hi)
                count.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(rest + words[at:]) if gone else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part: int = PART) -> DataFrame:
    """``id, n_words, n_removed, kept``: every text without repeated windows, words joined by a space."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("body"))
    named = rows.where("id is not null")
    by_part = W.partitionBy("part")
    shared = (
        named.mapInArrow(_parts(window, part), "part long, low long, high long, ids array<long>, keys array<long>")
        .withColumns({"least": F.min("low").over(by_part), "most": F.max("high").over(by_part)})
        .where("least < most")
        .select("part", F.explode(F.arrays_zip("ids", "keys")).alias("doc"))
        .groupBy(F.col("doc.ids").alias("id"), F.col("doc.keys").alias("key"))
        .agg(F.collect_list("part").alias("parts"))
    )
    windows = named.join(shared, ["id", "key"]).mapInArrow(
        _candidates(window, part), "h long, check int, id long, key long, pos int, known int, more array<int>")
    repeated = windows.withColumn("first", F.min("id").over(W.partitionBy("h", "check"))).where("known > 0 or first < id")
    spans = repeated.groupBy("id", "key").agg(
        F.collect_list(F.struct("pos", F.greatest("known", F.lit(1)).alias("n"))).alias("spans"),
        F.flatten(F.collect_list("more")).alias("more"))
    # the same side of a join as above, so that the texts are shuffled once
    cut = named.join(spans, ["id", "key"], "left")
    whole = rows.where("id is null").withColumns({"spans": F.lit(None).cast(cut.schema["spans"].dataType), "more": F.lit(None).cast("array<int>")})
    return cut.unionByName(whole).mapInArrow(_cut(window), "id long, n_words long, n_removed long, kept string")


@query("op5_substrings")
def op5_substrings(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
