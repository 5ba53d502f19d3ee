"""Personal data by patterns, and information-theoretic sanitisation of what reveals it.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Every value found is a
protected entity. Corpus co-occurrence then estimates how strongly a term reveals an entity: with n
documents, PMI(term, entity) = log(n(t, e) * n / (n(t) * n(e))), where n(t, e) counts documents with the
term among the five words on either side of the entity (within 200 characters). PMI never exceeds the
entity's information IC(e) = log(n / n(e)); their ratio is the disclosure. Terms over ``generalise`` are
generalised to a placeholder, terms over ``remove`` are removed, at all their places in the documents
where they stand beside the entity. All counts are over different texts of all documents, so copies count
once. A pair must occur in ``support`` different texts, and in ``remove_support`` to be removed instead of
generalised; the queries take every pair.

DataFrame operations only. The patterns below are the contract's, with possessive loops and look-behinds
that give the same matches in linear time.

Defined results: a null or empty text has no spans; digits of any length are compared as numbers; term
spans that touch a base span are left out; rows with the same id and text share their terms; rows without
an id get base spans only; further columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table
from ringwave.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
#: Kinds and what they look like; a card's digits are a maximal run of digits with single separators.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
NEAR_WORDS, NEAR_CHARS = 5, 200
WORD = r"\p{L}{3,}"
SPAN = "array<struct<start:int,end:int,hit:string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Check sum: from the right, every second digit doubled, its digits added."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = 2 * d
        return acc + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    if kind == "card":
        return _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda s: _valid(kind, s["hit"])


def _beside(kind: str):
    """The entity of a match with the terms around it."""
    gaps = F.col(f"{kind}_gaps")

    def around(hit: Column, i: Column) -> Column:
        before = F.regexp_extract_all(F.lower(F.right(F.get(gaps, i), F.lit(NEAR_CHARS))), F.lit(WORD), F.lit(0))
        after = F.regexp_extract_all(F.lower(F.left(F.get(gaps, i + 1), F.lit(NEAR_CHARS))), F.lit(WORD), F.lit(0))
        entity = F.lower(hit) if kind in ("email", "ip") else _digits(hit)
        terms = F.concat(F.slice(F.reverse(before), 1, NEAR_WORDS), F.slice(after, 1, NEAR_WORDS))
        return F.struct(F.concat(F.lit(kind + ":"), entity).alias("entity"), terms.alias("terms"), _valid(kind, hit).alias("ok"))

    return around


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _places(hits: Column, gaps: Column) -> Column:
    """Start, end and text of every match, in characters, from the texts of matches and of gaps."""
    hit_size, gap_size = F.transform(hits, lambda x: F.char_length(x)), F.transform(gaps, lambda x: F.char_length(x))

    def place(hit: Column, i: Column) -> Column:
        start = _total(F.slice(gap_size, 1, i + 1)) + _total(F.slice(hit_size, 1, i))
        return F.struct(start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("hit"))

    return F.when(F.size(hits) > 0, F.transform(hits, place)).otherwise(F.array().cast(SPAN))


def _matches(rows: DataFrame, name: str, pattern: Column, when: Column) -> DataFrame:
    """Columns ``name``_hits and ``name``_gaps; the text is split only where something matches."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn(f"{name}_hits", F.when(when, F.regexp_extract_all("body", pattern, F.lit(0))).otherwise(none))
    return rows.withColumn(f"{name}_gaps", F.when(F.size(f"{name}_hits") > 0, F.split("body", pattern, -1)).otherwise(none))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key``, one array of spans per kind, and ``near``: each entity's terms on either side."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("body"))
    for kind in KINDS:
        when = F.contains("body", F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        rows = _matches(rows, kind, F.lit(PATTERNS[kind]), when)
    for kind in KINDS:
        rows = rows.withColumn(kind, F.filter(_places(F.col(f"{kind}_hits"), F.col(f"{kind}_gaps")), _valid_span(kind)))
    near = [F.transform(f"{kind}_hits", _beside(kind)) for kind in KINDS]
    rows = rows.withColumn("near", F.filter(F.concat(*near), lambda n: n["ok"]))
    return rows.select("id", "key", *KINDS, "near")


def disclosing_terms(docs: DataFrame, base: DataFrame, id_col: str, text_col: str, generalise: float = 0.9,
                     remove: float = 0.999, support: int = 2, remove_support: int = 2) -> DataFrame:
    """``id, key, terms``: the terms of each document that disclose an entity they stand beside."""
    found = base.where("id is not null").select("id", "key", F.explode("near").alias("n"))
    entities = found.select("key", F.col("n.entity").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    beside = found.select("id", "key", F.col("n.entity").alias("entity"), F.explode("n.terms").alias("term")).distinct()
    pairs = (
        beside.select("entity", "term", "key").distinct()
        .groupBy("entity", "term").agg(F.count("*").alias("n_te"))
        .where(F.col("n_te") >= support)
    )
    different = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("body")).dropDuplicates(["key"])
    words = different.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(WORD), F.lit(0)))).alias("term"))
    terms = words.groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("n_t"))
    total = F.lit(float(base.where("id is not null").select("key").distinct().count()))
    information = F.log(total / F.col("n_e"))
    pmi = F.log(F.col("n_te") * total / (F.col("n_t") * F.col("n_e")))
    rated = (
        pairs.withColumn("h", F.xxhash64("term")).join(terms, "h").join(entities, "entity")
        .where(information > 0)
        .withColumn("disclosure", pmi / information)
        .where(F.col("disclosure") >= generalise)
        .select("entity", "term", ((F.col("disclosure") >= remove) & (F.col("n_te") >= remove_support)).alias("gone"))
    )
    return beside.join(rated, ["entity", "term"]).groupBy("id", "key").agg(
        F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("term")))).alias("removed"),
        F.array_sort(F.collect_set("term")).alias("all"),
    )


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``id, key`` and one array of spans for each base kind and each kind of term."""
    base = cut_lineage(base_spans(docs, id_col, text_col))
    flagged = cut_lineage(disclosing_terms(docs, base, id_col, text_col, **thresholds))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("body"))
    texts = texts.join(flagged, ["id", "key"]).dropDuplicates(["id", "key"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("all", "|"), F.lit(r")(?!\p{L})"))
    placed = _matches(texts, "term", pattern, F.lit(True)).select("id", "key", "removed", _places(F.col("term_hits"), F.col("term_gaps")).alias("term"))
    rows = base.drop("near").join(placed, ["id", "key"], "left")
    every = F.concat(*KINDS)
    free = F.filter(
        F.coalesce("term", F.array().cast(SPAN)),
        lambda t: ~F.exists(every, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    gone = lambda t: F.array_contains("removed", F.lower(t["hit"]))
    rows = rows.withColumn("free", free)
    return rows.select(
        "id", "key", *KINDS,
        F.filter("free", lambda t: ~gone(t)).alias("generalise"),
        F.filter("free", gone).alias("remove"),
    )


def _listed(kinds: tuple[str, ...]) -> Column:
    def told(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))

    parts = [F.transform(k, told(k)) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and the list of all spans."""
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(KINDS), 256).alias("base_sha256"),
        _listed((*KINDS, *TERM_KINDS)).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """Documents with base spans and generalised terms as placeholders and removed terms gone; ``n_chars`` follows."""
    found = find_spans(docs, support=1).dropDuplicates(["id", "key"])
    def replaced(kind: str):
        put = F.lit("" if kind == "remove" else f"<{kind.upper()}>").alias("put")
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), put)

    every = F.concat(*[F.transform(k, replaced(k)) for k in (*KINDS, *TERM_KINDS)])
    spans = found.select("id", "key", F.array_sort(every).alias("spans")).where(F.size("spans") > 0)
    # the row travels as one struct, so that no column of the caller's meets these names
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("of"),
        F.xxhash64("text").alias("text_key"), F.col("text").alias("body"))
    joined = whole.join(spans, F.col("of").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        """Spans that overlap give the first one's placeholder and go as one."""
        gap = F.substring("body", acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, s["put"])).otherwise(acc["out"]).alias("out"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring("body", acc["at"] + 1, F.char_length("body")))

    text = F.aggregate("spans", start, put, rest)
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")


@query("op4_pii")
def op4_pii(spark, sf_dir: str) -> DataFrame:
    return report(find_spans(table(spark, sf_dir, "documents"), support=1))
