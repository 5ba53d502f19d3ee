"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 13 consecutive words of the benchmark items (an item of fewer words is
one window). Per pattern length a block of the last two words indexes a shift table; while the shift is
positive no pattern can end there and the position moves on by it. At shift zero the suffix-hash bucket
of the block names the possible patterns, a prefix hash thins them, and the words are compared.

The benchmark is split into blocks of a checked size; each block is sent to the tasks and meets every
document there, so no document is shuffled. With one block (any benchmark under ``block_bytes``) the
rows are final in the task; with more, each block's hits are written and merged by document.

Defined results: null or empty text has no words, is never hit and is not contaminated; a null item has
no windows; repeated documents give a row each; items are counted once by id; further columns are not
read. An empty benchmark leaves every document clean, an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table
from ringwave.llm.text import Rolling, bounded, joined, mix, runs
from ringwave.session import cut_lineage

WINDOW = 13
BLOCK_BYTES = 16 << 20
_byte = np.arange(256)
#: Lower-cases A-Z and keeps the bytes of words; every byte of a non-ASCII character belongs to words.
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)
IN_WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
SCHEMA = "id long, key long, n_words long, hit_start array<int>, hit_end array<int>, items array<string>"


class Words:
    """The words of many texts: their bytes without gaps, places, hashes and texts."""

    def __init__(self, parts: list[bytes]):
        data, begins = joined(parts)
        data = LOWER[data]
        start, end = runs(IN_WORD[data])
        self.first = np.searchsorted(start, begins)  # of each text, and the end
        self.hash = mix(Rolling(data).spans(start, end)) if len(start) else np.zeros(0, np.uint64)
        self.data, self.start, self.end = data, start, end
        self.text = np.repeat(np.arange(len(parts)), np.diff(self.first))

    def equal(self, at: np.ndarray, other: "Words", there: np.ndarray) -> np.ndarray:
        """Byte by byte comparison of single words with words of another array."""
        n = self.end[at] - self.start[at]
        ok = n == other.end[there] - other.start[there]
        at, there, n = at[ok], there[ok], n[ok]
        if len(at):
            first = np.r_[0, np.cumsum(n)[:-1]]
            step = np.arange(n.sum()) - np.repeat(first, n)
            same = self.data[np.repeat(self.start[at], n) + step] == other.data[np.repeat(other.start[there], n) + step]
            ok[ok] = np.logical_and.reduceat(same, first)
        return ok


def _pair(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the block that ends at a word: two words, or the word itself for patterns of one."""
    return mix(words[at] + np.uint64(3) * words[at - 1]) if length > 1 else words[at]


class Table:
    """Shift table, suffix buckets and prefix hashes of the patterns of one length."""

    def __init__(self, words: Words, starts: np.ndarray, length: int):
        self.length = length
        block = min(2, length)
        whole = np.zeros(len(starts), np.uint64)
        for k in range(length):
            whole = mix(whole + words.hash[starts + k])
        self.pattern, self.of = np.unique(whole, return_inverse=True)  # same windows are one pattern
        order = np.argsort(self.of, kind="stable")
        edges = np.searchsorted(self.of[order], np.arange(len(self.pattern) + 1))
        lead = starts[order[edges[:-1]]]
        #: Items of each pattern, as ranges in one array.
        self.item_of, self.item_edge = words.text[starts[order]], edges
        self.bits = np.uint64(64 - min(22, max(12, int(len(lead) * length * 4).bit_length())))
        shift = np.full(1 << int(np.uint64(64) - self.bits), length - block + 1, np.uint8)
        for k in range(block - 1, length):
            np.minimum.at(shift, _pair(words.hash, lead + k, length) >> self.bits, length - 1 - k)
        self.shift = shift
        suffix = _pair(words.hash, lead + length - 1, length)
        by = np.argsort(suffix, kind="stable")
        self.suffix, self.lead, self.id = suffix[by], lead[by], by
        self.prefix = words.hash[self.lead]
        self.hashes = words.hash

    def ends(self, words: Words, lanes: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Words at which patterns end and the patterns, by skipping along many stretches at once."""
        n, m = len(words.hash), self.length
        if n < m or not len(self.lead):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, lanes)
        stop = np.minimum(at + lanes, n)
        stops = []
        while len(at):
            skip = self.shift[_pair(words.hash, at, m) >> self.bits].astype(np.int64)
            stops.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.concatenate(stops)
        suffix = _pair(words.hash, ends, m)
        lo, hi = np.searchsorted(self.suffix, suffix), np.searchsorted(self.suffix, suffix, "right")
        found, which = [], []
        open_ = np.flatnonzero((lo < hi) & (words.text[ends] == words.text[ends - m + 1]))
        ends, lo, hi = ends[open_], lo[open_], hi[open_]
        while len(ends):  # one candidate of each bucket at a time keeps memory bounded
            same = self.prefix[lo] == words.hash[ends - m + 1]
            e, p = ends[same], lo[same]
            for k in range(m):
                same = words.hash[e - k] == self.hashes[self.lead[p] + m - 1 - k]
                e, p = e[same], p[same]
            found.append(e)
            which.append(p)
            lo = lo + 1
            live = lo < hi
            ends, lo, hi = ends[live], lo[live], hi[live]
        return (np.concatenate(found), np.concatenate(which)) if found else (np.zeros(0, np.int64),) * 2


def search_tables(items: list[tuple[str, bytes]], window: int) -> tuple[Words, list[str], list[Table]]:
    words = Words([t for _, t in items])
    count = np.diff(words.first)
    tables = []
    for length in range(1, window + 1):
        if length < window:
            starts = words.first[:-1][count == length]
        else:
            places = np.arange(len(words.hash))
            starts = places[places + window <= words.first[1:][words.text]] if len(places) else places
        if len(starts):
            tables.append(Table(words, starts, length))
    return words, [i for i, _ in items], tables


def _confirmed(docs: Words, items: Words, t: Table, ends: np.ndarray, which: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """Direct comparison of every candidate's words with the pattern's."""
    step = np.arange(t.length)
    parts = [np.zeros(0, bool)]
    for lo in range(0, len(ends), at_once):
        e, p = ends[lo : lo + at_once, None], t.lead[which[lo : lo + at_once], None]
        same = docs.equal((e - t.length + 1 + step).ravel(), items, (p + step).ravel())
        parts.append(same.reshape(-1, t.length).all(1))
    return np.concatenate(parts)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_words, names, tables = shared.value
        for batch in bounded(batches, "body"):
            docs = Words([t or b"" for t in batch.column("body").cast(pa.binary()).to_pylist()])
            gap = docs.first + np.arange(len(docs.first))  # a gap after each text, so that no stretch spans two
            edge = np.zeros(gap[-1] + 1, np.int32)
            pairs = [np.zeros((0, 2), np.int64)]
            for t in tables:
                ends, which = t.ends(docs)
                ok = _confirmed(docs, item_words, t, ends, which)
                ends, which = ends[ok], which[ok]
                np.add.at(edge, ends - t.length + 1 + docs.text[ends], 1)
                np.add.at(edge, ends + 1 + docs.text[ends], -1)
                met = np.unique(np.stack([docs.text[ends], t.id[which]], 1), axis=0)
                n = t.item_edge[met[:, 1] + 1] - t.item_edge[met[:, 1]]
                flat = np.repeat(t.item_edge[met[:, 1]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                pairs.append(np.stack([np.repeat(met[:, 0], n), t.item_of[flat]], 1))
            begin, end = runs(np.cumsum(edge) > 0)
            met = np.unique(np.concatenate(pairs), axis=0)
            spans, named = np.searchsorted(begin, gap), np.searchsorted(met[:, 0], np.arange(batch.num_rows + 1))
            base = gap[np.searchsorted(gap, begin, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("key"),
                    pa.array(np.diff(docs.first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array((begin - base).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array((end - base).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(named, pa.int32()), pa.array([names[i] for i in met[:, 1]], pa.string())),
                ],
                ["id", "key", "n_words", "hit_start", "hit_end", "items"],
            )

    return run


def find_occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: number of words, hit stretches of words (start, end) and the items that occur."""
    spark = docs.sparkSession
    docs = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("body"))
    items = items.where(F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body"))
    size = items.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # at most about block_bytes
        found = search_tables([(r.item, r.body.encode()) for r in rows], window)
        part = docs.mapInArrow(_search(spark.sparkContext.broadcast(found)), SCHEMA)
        if blocks == 1:
            return part
        parts.append(cut_lineage(part))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _merge_blocks(every, blocks)


def _merge_blocks(parts: DataFrame, blocks: int) -> DataFrame:
    """Join the hit stretches and items of all blocks of the benchmark, by document and text; copies stay."""
    both = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_start", "hit_end"))))
    grown = F.aggregate(
        both,
        F.array().cast("array<struct<hit_start:int,hit_end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["hit_end"] >= x["hit_start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["hit_start"].alias("hit_start"),
                F.greatest(F.element_at(acc, -1)["hit_end"], x["hit_end"]).alias("hit_end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return (
        parts.groupBy("id", "key", "n_words")
        .agg(grown.alias("m"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.count("*").alias("n"))
        .withColumn("copy", F.explode(F.expr(f"sequence(1, int(n / {blocks}))")))
        .select("id", "key", "n_words", F.col("m.hit_start").alias("hit_start"), F.col("m.hit_end").alias("hit_end"), "items")
    )


def report(found: DataFrame) -> DataFrame:
    """Counts, item digest and the contamination rule: a word is hit and at least a twentieth of them."""
    hit = F.aggregate(F.zip_with("hit_end", "hit_start", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that the rule does not find contaminated; every column stays, and rows without an id."""
    bad = report(find_occurrences(docs, items)).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


@query("op1_decontamination")
def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(find_occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
