"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. Words are counted from the first scan on; a
phrase of two words is counted from the scan after both its words have been seen ``least`` times, one of
three words after both its pairs have. Each phrase is counted for one full cycle, so its count is exact
wherever in the cycle it began; scans of several lengths run together, and the work ends when no phrase is
left within its cycle.

What has been reached travels to the tasks as slots of a hash with the scan in which each was first set
(``slots`` bytes a length at most, whatever the corpus). Two phrases that share a slot only begin earlier than
they need to: a wider slot table costs memory, a narrower one work, and neither changes a count.

Running counts need no second shuffle of everything: a phrase of ``least`` occurrences has a ``shards``-th of them in
some shard, so only rows that share a slot with such a phrase are summed up over scans, and for
the decision what to count next only those of slots not set yet.

Defined results: a null text has no words, a null language is ``und``; equal rows count each; ids and further
columns are not read; a text of any length is handled by one task at about 60 times its bytes; ties in score
go by count, then by bytes; an empty table gives no rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table
from ringwave.llm.text import bounded, joined, runs
from ringwave.session import cut_lineage

#: A to Z in lower case; the marks that end a piece as line ends; a tab as a space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
NEVER = 255
#: Bytes of text counted at once: more than elsewhere, since pairs repeat more in longer stretches.
BATCH = 6 << 20
#: Bits of one bitmap of Spark's bitmap functions.
CHUNK = 1 << 15


def _slots(h: np.ndarray, lang: np.ndarray, slots: int) -> np.ndarray:
    return ((h ^ lang) & np.uint64(slots - 1)).astype(np.int64)


def _turned(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(21)) | (h >> np.uint64(43))


def slot_of(lang: Column, phrase: Column, words: Column, slots: int) -> Column:
    """The slot of a word or pair as tasks compute it; of three words any."""
    last = F.xxhash64(F.substring_index(phrase, " ", -1))
    pair = F.xxhash64(F.substring_index(phrase, " ", 1)).bitwiseXOR(F.shiftleft(last, 21).bitwiseOR(F.shiftrightunsigned(last, 43)))
    h = F.when(words == 2, pair).otherwise(F.xxhash64(phrase))
    return h.bitwiseXOR(F.xxhash64(lang)).bitwiseAND(slots - 1)


def _scan(step: int, shards: int, packed: dict[int, bytes]):
    """Counts of a batch: all words in the first cycle, pairs and triples that are within their cycle.

    A key is the language, a tab and the phrase; ``last`` says that this scan ends the phrase's cycle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = {k: np.frombuffer(zlib.decompress(b), np.uint8) for k, b in packed.items()}
        slots = len(began[1])
        for batch in bounded(batches, "body", BATCH):
            data, begins = joined([t.translate(_FOLD) for t in batch.column("body").cast(pa.binary()).to_pylist()])
            ends = data == 10
            inside = ~ends & (data != 32)
            start, end = runs(inside)
            if not len(start):
                continue
            words = pa.Array.from_buffers(pa.binary(), len(start), [
                None, pa.py_buffer(np.r_[0, np.cumsum(end - start)].astype(np.int32)), pa.py_buffer(data[inside])]).dictionary_encode()
            names, ids = words.dictionary, words.indices.to_numpy().astype(np.int64)
            langs = batch.column("lang").cast(pa.binary()).dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64)[np.searchsorted(begins, start, "right") - 1]
            piece = np.cumsum(ends)[start]
            hashes = _hashes(names)[ids]
            own = _hashes(langs.dictionary)[lang]
            n = len(names)

            def table_of(keys: np.ndarray, at: np.ndarray, began_at: np.ndarray | None, length: int) -> pa.RecordBatch:
                _, first, many = np.unique(keys, return_index=True, return_counts=True)
                at = at[first]
                phrase = pc.take(names, pa.array(ids[at]))
                for k in range(1, length):
                    phrase = pc.binary_join_element_wise(phrase, pc.take(names, pa.array(ids[at + k])), b" ")
                key = pc.binary_join_element_wise(pc.take(langs.dictionary, pa.array(lang[at])), phrase, b"\t").cast(pa.string())
                last = np.zeros(len(at), bool) if began_at is None else began_at[at] + shards - 1 == step
                return pa.RecordBatch.from_arrays([key, pa.array(last), pa.array(many, pa.int64())], ["key", "last", "n"])

            def due(began_at: np.ndarray) -> np.ndarray:
                return np.flatnonzero((began_at <= step) & (step < began_at + shards))

            if step < shards:
                yield table_of(lang * n + ids, np.arange(len(ids)), None, 1)
            near = piece[1:] == piece[:-1]
            word_at = began[1][_slots(hashes, own, slots)]
            pair_at = np.where(near, np.maximum(word_at[1:], word_at[:-1]), NEVER).astype(np.int64)
            keys = (lang[:-1] * n + ids[:-1]) * n + ids[1:]
            at = due(pair_at)
            if len(at):
                yield table_of(keys[at], at, pair_at, 2)
            if 2 in began:
                reached = np.where(near, began[2][_slots(hashes[:-1] ^ _turned(hashes[1:]), own[:-1], slots)], NEVER)
                triple_at = np.maximum(reached[1:], reached[:-1]).astype(np.int64)
                at = due(triple_at)
                if len(at):
                    yield table_of(np.unique(keys[at], return_inverse=True)[1] * n + ids[at + 2], at, triple_at, 3)

    return run


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in names.to_pylist()), np.uint64, len(names))


def _bits(rows: DataFrame, slots: int, **tests: Column) -> dict[str, dict[int, np.ndarray]]:
    """Which slots the rows that pass each test set, by length: at most ``slots / 64`` numbers a length come to the driver."""
    one = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    sets = rows.groupBy("words", F.floor(F.col("slot") / 64).alias("at")).agg(
        *(F.bit_or(F.when(test, one).otherwise(0)).alias(name) for name, test in tests.items())).toArrow()
    words, at = sets["words"].to_numpy(), sets["at"].to_numpy()
    found = {}
    for name in tests:
        longs = np.zeros((4, slots // 64), np.int64)
        longs[words, at] = sets[name].to_numpy()
        found[name] = {k: np.unpackbits(longs[k].view(np.uint8), bitorder="little").astype(bool) for k in (1, 2, 3)}
    return found


def _flagged(rows: DataFrame, bits: dict[int, np.ndarray]) -> DataFrame:
    """Add ``flag``: is the row's ``slot`` set? The table of bits is sent to all; its size is fixed by the number of slots."""
    parts = []
    for words, flags in bits.items():
        longs = np.packbits(flags, bitorder="little").view(np.int64).reshape(-1, CHUNK // 64)
        at = np.flatnonzero(longs.any(axis=1))
        edges = np.arange(len(at) + 1, dtype=np.int32) * (CHUNK // 64)
        parts.append(pa.table({
            "_words": pa.array(np.full(len(at), words, np.int8)), "_chunk": pa.array(at),
            "_bits": pa.ListArray.from_arrays(pa.array(edges), pa.array(longs[at].ravel()))}))
    sent = rows.sparkSession.createDataFrame(pa.concat_tables(parts))
    inside = F.col("slot") % CHUNK
    met = rows.join(
        F.broadcast(sent), (F.col("words") == F.col("_words")) & (F.floor(F.col("slot") / CHUNK) == F.col("_chunk")), "left")
    bit = F.getbit(F.get("_bits", F.floor(inside / 64).cast("int")), (inside % 64).cast("int"))
    return met.withColumn("flag", F.coalesce(bit == 1, F.lit(False))).drop("_words", "_chunk", "_bits")


def _among(tables: list[DataFrame], bits: dict[int, np.ndarray]) -> DataFrame:
    """Sums over all scans of the phrases of set slots."""
    rows = reduce(DataFrame.unionByName, tables).where(F.col("words").isin(list(bits)))
    return _flagged(rows, bits).where("flag").groupBy("words", "lang", "phrase", "slot").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, shards: int = 2,
           slots: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of all phrases of at least ``least`` occurrences; and ``lang, total``, all words of a language.

    A text's shard is a hash of it, so shards need no copy of the corpus and a scan run again reads the same texts.
    """
    if longest not in (2, 3) or slots % CHUNK or slots & (slots - 1) or 3 * shards >= NEVER:
        raise ValueError("two or three words, slots a power of two of at least 32768, at most 84 shards")
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("body")).where("body <> ''")
    shard = F.pmod(F.xxhash64("body"), F.lit(shards))
    share = -(-least // shards)
    began = {k: np.full(slots, NEVER, np.uint8) for k in range(1, longest)}
    heavy = {k: np.zeros(slots, bool) for k in (1, 2, 3)}
    tables: list[DataFrame] = []
    step = 0
    while step < shards or any((a[a < NEVER].astype(np.int64) + shards > step).any() for a in began.values()):
        packed = {k: zlib.compress(a.tobytes(), 1) for k, a in began.items()}
        scanned = rows.where(shard == step % shards).mapInArrow(_scan(step, shards, packed), "key string, last boolean, n long")
        phrase = F.substring_index("key", "\t", -1)
        found = scanned.groupBy("key", "last").agg(F.sum("n").alias("n")).select(
            F.expr("left(key, char_length(key) - char_length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"),
            (F.char_length(phrase) - F.char_length(F.replace(phrase, F.lit(" "))) + 1).cast("byte").alias("words"), "last", "n")
        found = found.withColumn("slot", slot_of(F.col("lang"), F.col("phrase"), F.col("words"), slots))
        # at the end of its cycle a phrase that no shard holds a share of cannot be one of those asked for
        found = _flagged(found, heavy).where("flag or not last or n >= {}".format(share))
        tables.append(cut_lineage(found.drop("last", "flag"), codec="zstd"))
        step += 1
        new = _bits(tables[-1], slots, heavy=F.col("n") >= share, reached=F.col("n") >= least)
        for k in heavy:
            heavy[k] |= new["heavy"][k]
        for k, a in began.items():
            a[new["reached"][k] & (a == NEVER)] = step
        waiting = {k: heavy[k] & (a == NEVER) for k, a in began.items()}
        if step > 1 and any(w.any() for w in waiting.values()):
            sums = _bits(_among(tables, waiting), slots, reached=F.col("n") >= least)["reached"]
            for k, a in began.items():
                a[sums[k] & (a == NEVER)] = step
    totals = reduce(DataFrame.unionByName, tables).where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    return cut_lineage(_among(tables, heavy).where(F.col("n") >= least).drop("slot"), codec="zstd"), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, inside_percent: int = 50,
                 **options) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of all phrases that no longer one holds in ``inside_percent`` of their places.

    ``score`` is floor(10**6 a a / (l r)) at the phrase's weakest cut, in decimals of 38 digits: exact up to counts of 10**15.
    """
    known, totals = counts(docs, lang_col, text_col, least, longest, **options)
    phrases = known.where("words > 1")
    longer = phrases.where("words > 2").select(
        "lang", F.explode(F.array_distinct(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))).alias("phrase"),
        F.col("n").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    free = phrases.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < inside_percent * F.col("n"), F.lit(True)))
    cuts = free.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).selectExpr(
        "lang", "phrase", "a", "k", "substring_index(phrase, ' ', k) as first", "substring_index(phrase, ' ', k - words) as rest")
    parts = known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("n_part"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "first", "n_part": "l"}), ["lang", "first"]).join(
        parts.withColumnsRenamed({"part": "rest", "n_part": "r"}), ["lang", "rest"])
    exact = "cast({0} as decimal(15,0))".format
    score = F.expr(f"({exact('a')} * {exact('a')} * cast(1000000 as decimal(7,0))) div ({exact('l')} * {exact('r')})")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return weakest.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def best(found: DataFrame, top: int = 2000, salts: int = 64) -> DataFrame:
    """``rank`` (from 1) of each language's first ``top`` phrases; a language is first ranked in ``salts`` parts."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    first = found.withColumn("salt", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).drop("salt")


PHRASE_SQL = r"""with p as (
  select lang, doc, generate_subscripts(pieces, 1) as piece, unnest(pieces) as body from (
    select coalesce(lang, 'und') as lang, row_number() over () as doc,
           string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') as pieces
    from documents)),
w as (select lang, doc, piece, generate_subscripts(words, 1) as i, unnest(words) as w1 from (
        select lang, doc, piece, regexp_extract_all(body, '[^ 	]+') as words from p)),
s as (select lang, w1, lead(w1) over o as w2, lead(w1, 2) over o as w3 from w window o as (partition by doc, piece order by i)),
f as (
  select lang, w1 as phrase, 1 as words, count(*) as n from s group by all having count(*) >= 10
  union all select lang, w1 || ' ' || w2, 2, count(*) from s where w2 is not null group by all having count(*) >= 10
  union all select lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) from s where w3 is not null group by all having count(*) >= 10),
-- one key, so that no join goes by language alone
keyed as (select lang || chr(9) || phrase as at, n from f),
c as (select *, string_split(phrase, ' ') as ws from f where words > 1),
longer as (
  select lang, phrase, max(n) as around from (
    select lang, ws[1] || ' ' || ws[2] as phrase, n from c where words = 3
    union all select lang, ws[2] || ' ' || ws[3], n from c where words = 3) group by all),
cuts as (
  select c.lang, c.phrase, c.n as a, k, lang || chr(9) || array_to_string(ws[:k], ' ') as first,
         lang || chr(9) || array_to_string(ws[k + 1:], ' ') as rest
  from c left join longer using (lang, phrase), range(1, 3) t(k)
  where k < words and coalesce(100 * around < 50 * c.n, true)),
scored as (
  select cuts.*, x.n as l, y.n as r, cast(cast(a as hugeint) * a * 1000000 // (cast(x.n as hugeint) * y.n) as bigint) as score
  from cuts join keyed x on x.at = first join keyed y on y.at = rest),
weakest as (select *, row_number() over (partition by lang, phrase order by score, k) as weak from scored),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score
  from weakest where weak = 1)
select ranked.lang, rank, phrase, a, l, r, n, score
from ranked join (select lang, count(*) as n from w group by lang) using (lang) where rank <= 2000"""


@query("op12_phrases", sql=PHRASE_SQL)
def op12_phrases(spark, sf_dir: str) -> DataFrame:
    found = best(collocations(table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
