"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits of the fingerprints that go together are grouped into partitions. If thresholds t_1 .. t_m satisfy
sum(t_i) = limit - m + 1, two fingerprints within ``limit`` bits differ in some partition i by at most t_i
bits; t_i = -1 leaves a partition out. A dynamic program chooses the thresholds with the least work, from
candidate counts estimated with the bit statistics of all fingerprints, over several numbers of
partitions. The choice changes the work and never the links. A partition with threshold t is probed with
all values within ceil(t / 2) bits on both sides; pairs that meet are verified on all 64 bits.

Only distinct fingerprints are compared. Inside a bucket the links are reduced to a forest before they
are emitted, so a group of n gives at most n rows. Buckets over ``bucket_rows`` are dealt out as pairs of
blocks, so no task holds more than two blocks of one.

Defined results: null, empty or blank text has fingerprint zero, which links like any other; repeated
rows give a row each; rows without an id get the component of their fingerprint, and fingerprints that
only such rows have link nothing; further columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwave.llm.components import components
from ringwave.llm.registry import query, table
from ringwave.llm.text import bounded
from ringwave.session import cut_lineage

LIMIT = 4
#: Relative work of one probe row through a shuffle and of one compared pair.
ROW_WORK, PAIR_WORK = 1000.0, 1.0


def _fingerprints(width: int, seed: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in bounded(batches, "body"):
            out = np.zeros(batch.num_rows, np.uint64)
            hashes, first, row = [], [], []
            for i, text in enumerate(batch.column("body").cast(pa.binary()).to_pylist()):
                words = (text or b"").lower().split()  # bytes: A-Z alone is lower-cased, six separators
                if not words:
                    continue
                n = max(1, len(words) - width + 1)
                line = b" ".join(words)
                end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                start = (end - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:n].tolist()
                end = (end[-n:] - 1).tolist()
                first.append(len(hashes))
                row.append(i)
                hashes += [digest(line[s:e], seed) for s, e in zip(start, end)]
            if row:
                bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                n = np.diff(np.r_[first, len(hashes)])
                out[row] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``id, fp``: the 64-bit SimHash of every text as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_fingerprints(width, seed), "id long, fp long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together; 64 x 64 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 1 << 14):
                part = np.ascontiguousarray(fp[lo : lo + (1 << 14)])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(part)
        at = np.arange(64 * 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total.ravel(), n].astype(np.int64))], ["cell", "n"])

    cells = dict(nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    return int(cells.get(-1, 0)), np.array([cells.get(i, 0) for i in range(64 * 64)], float).reshape(64, 64)


def correlated_groups(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of like size; each grows by the bit that goes most with those inside."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(link, 0)
    free, groups = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (link[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (link[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _near(flip: np.ndarray, radius: int) -> float:
    """Chance that two fingerprints differ in at most ``radius`` of some bits, from each bit's chance."""
    dist = np.zeros(len(flip) + 1)
    dist[0] = 1
    for q in flip:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return float(dist[: radius + 1].sum())


def allocate(n: int, together: np.ndarray, limit: int = LIMIT, parts: tuple[int, ...] = (2, 3, 4, 5, 6, 7)) -> list[tuple[list[int], int]]:
    """Partitions and thresholds with the least estimated work, by dynamic programming for each count."""
    p = np.diag(together) / max(n, 1)
    flip = 2 * p * (1 - p)
    best: tuple[float, list] = (np.inf, [])
    for m in parts:
        groups = correlated_groups(n, together, m)
        #: work so far and thresholds by their sum
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            new: dict[int, tuple[float, list[int]]] = {}
            for t in range(-1, limit + 1):
                if t < 0:
                    work = 0.0
                else:
                    radius = -(-t // 2)
                    probes = sum(comb(len(group), j) for j in range(radius + 1))
                    work = ROW_WORK * n * probes + PAIR_WORK * n * n / 2 * _near(flip[group], 2 * radius)
                for total, (w, chosen) in table_.items():
                    if w + work < new.get(total + t, (np.inf,))[0]:
                        new[total + t] = (w + work, [*chosen, t])
            table_ = new
        work, chosen = table_[limit - m + 1]
        if work < best[0]:
            best = (work, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _probes(plan: list[tuple[list[int], int]]):
    masks = []
    for group, t in plan:
        own = sum(1 << b for b in group)
        flips = [sum(1 << b for b in c) for j in range(-(-t // 2) + 1) for c in combinations(group, j)]
        masks.append((own, np.array(flips, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (own, flips) in enumerate(masks):
                step = max(1, (1 << 18) // len(flips))
                for lo in range(0, len(fp), step):
                    value = ((fp[lo : lo + step] & np.uint64(own))[:, None] ^ flips).ravel()
                    rows = pa.array(np.repeat(np.arange(lo, min(lo + step, len(fp))), len(flips)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), part, np.int32)), pa.array(value.view(np.int64)), batch.column("fp").take(rows), batch.column("root").take(rows)],
                        ["part", "value", "fp", "root"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest row that each of n rows reaches over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(limit: int):
    def linked(fp: np.ndarray, root: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        """Links inside consecutive groups of rows, as a forest."""
        begin = np.r_[0, np.cumsum(size)[:-1]]
        last = np.repeat(begin + size, size)
        label = np.arange(len(fp))
        at = np.arange(len(fp))
        a, b, held = [], [], 0
        step = 1
        while True:
            at = at[at + step < last[at]]
            if not len(at):
                break
            hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= limit]
            a.append(hit)
            b.append(hit + step)
            held += len(hit)
            step += 1
            if held > 1 << 20:
                label = _forest(np.concatenate([*a, np.arange(len(fp))]), np.concatenate([*b, label]), len(fp))
                a, b, held = [], [], 0
        label = _forest(np.concatenate([*a, np.arange(len(fp))]), np.concatenate([*b, label]), len(fp))
        own = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(root[own]), pa.array(root[label[own]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
        names = ["bucket", "fp", "root"]
        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            kept = [np.concatenate(x) for x in zip(kept, new)]
            edge = np.flatnonzero(np.diff(kept[0])) + 1
            if len(edge):
                done = edge[-1]
                yield linked(kept[1][:done].view(np.uint64), kept[2][:done], np.diff(np.r_[0, edge]))
                kept = [x[done:] for x in kept]
        if len(kept[0]):
            yield linked(np.ascontiguousarray(kept[1]).view(np.uint64), kept[2], np.array([len(kept[0])]))

    return run


def near_links(nodes: DataFrame, limit: int = LIMIT, bucket_rows: int = 4096, plan: list | None = None) -> DataFrame:
    """``a, b``: links between the roots of fingerprints within ``limit`` bits, a forest of each bucket."""
    plan = plan or allocate(*bit_statistics(nodes), limit)
    rows = nodes.where("root is not null").select("fp", "root").mapInArrow(_probes(plan), "part int, value long, fp long, root long")
    rows = rows.withColumn("bucket", F.xxhash64("part", "value"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    rows = rows.join(sizes, "bucket", "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / bucket_rows).cast("int"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(block, o).alias("i"), F.greatest(block, o).alias("j"))))
    rows = rows.withColumn("cell", cells).select(F.xxhash64("bucket", "cell.i", "cell.j").alias("bucket"), "fp", "root")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(limit), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``id, fp, component``: every row with the smallest id that its fingerprint reaches."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("root")))
    found = components(near_links(nodes, limit))
    of = nodes.join(found, nodes.root == found.node, "left").select("fp", F.coalesce("component", "root").alias("component"))
    return prints.join(of, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group stays, that with the smallest id; every column stays.

    Rows that share an id are one document, rows without an id stay.
    """
    found = near_duplicates(docs)
    rest = found.where(F.col("id") != F.col("component")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(rest, "doc_id", "left_anti").select(*docs.columns)


@query("op3_simhash")
def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
