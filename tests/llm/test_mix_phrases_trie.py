"""Mixing, phrases and the prefix trie against brute force, on planted and on odd rows."""
import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ringwave.llm import mixing, phrases, trie

DOCS = "doc_id long, text string, source string, lang string, target double, n int, size long"


# ---- mixing ---------------------------------------------------------------------------
def corpus(seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 20, 21, 300])), rng.choice(["a", "a", "a", "b", "c", "d", None]), "en", 0.5, 1, 7) for i in range(n)]
    return rows + [(None, "x y z", "a", None, None, None, None)] * 3 + [(5, None, "b", "en", 0.0, 0, 0), rows[7], rows[7]]


def brute_targets(size, weights=(1, 2, 3), most=3):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(size.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * size[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: most * size[s] for s in full}
        rest -= sum(most * size[s] for s in full)
        open_ -= full
    return target


def test_mix_meets_targets_and_limits(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.allocate(docs).collect()
    assert len(found) == len(rows)
    size = Counter()
    for r in rows:
        size[r[2]] += len((r[1] or "").split())
    want = brute_targets(size)
    for source in size:
        own = [r for r in found if r.source == source]
        assert all(r.source_size == size[source] and r.target == pytest.approx(want[source]) for r in own)
        assert sum(r.taken for r in own) == round(want[source])
        assert all(r.copies * r.size <= r.taken <= min(3 * r.size, (r.copies + 1) * r.size) for r in own)
        # one document at most gives a part of itself
        assert sum(r.size > 0 and r.taken % r.size > 0 for r in own) <= 1
    assert sorted(found) == sorted(mixing.allocate(docs.repartition(7)).collect())


def test_mix_ranks_by_pareto(spark):
    found = mixing.allocate(spark.createDataFrame([(i, "w " * (1 + i % 9), "s", None, None, None, None) for i in range(3000)], DOCS), weights=(1,), share=0.4)
    sized = found.join(mixing.sizes(spark.createDataFrame([(i, "w " * (1 + i % 9), "s", None, None, None, None) for i in range(3000)], DOCS),
                                    "doc_id", "text", "source", "mix").select("doc_id", "u", "bits"), "doc_id").collect()
    words = sum(r.size for r in sized)
    scale = 0.4 * words / sum(r.bits * r.size for r in sized)
    rank = sorted(sized, key=lambda r: r.u * (1 - scale * r.bits) / ((1 - r.u) * scale * r.bits))
    left = round(0.4 * words)
    for r in rank:
        assert r.taken == min(r.size, left)
        left -= r.taken
    for bits in range(1, 5):  # inclusion goes with the bits of the size
        part = [r.taken > 0 for r in sized if r.bits == bits]
        assert sum(part) / len(part) == pytest.approx(scale * bits, abs=0.06)


def test_mixed_texts(spark):
    rows = corpus(2, 60)
    docs = spark.createDataFrame(rows, DOCS)
    mix = mixing.mixed_texts(docs)
    assert mix.columns == docs.columns
    got, want = Counter(), Counter()
    for r in mix.collect():
        got[r.source] += len(r.text.split())
    for r in mixing.allocate(docs).collect():
        want[r.source] += r.taken
    assert got == +want


def test_mix_of_nothing(spark):
    assert mixing.allocate(spark.createDataFrame([], DOCS)).count() == 0
    none = mixing.allocate(spark.createDataFrame([(1, None, None, None, None, None, None), (2, "", "a", None, None, None, None)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2


# ---- phrases -------------------------------------------------------------------------------
def brute_phrases(rows, least, longest=3):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\x0a\x0b\x0c\x0d":
            folded = folded.replace(mark, "\n")
        for piece in folded.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    known = {p for p, n in count.items() if n >= least and len(p[1]) > 1}
    out = []
    for lang, p in known:
        a = count[lang, p]
        if any(q[0] == lang and len(q[1]) > len(p) and 100 * count[q] >= 50 * a
               and any(q[1][i : i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q in known):
            continue
        cuts = [(10**6 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], total[lang], score))
    return sorted(out)


def talk(seed, n):
    rng = random.Random(seed)
    words = ["A", "b", "ç", "Das", "e f", "g", "hh", "日本", "I'm", "j"]
    rows = [(rng.choice(["en", "de", None, "x\ty", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randrange(60))))
            for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("en", " .;\n"), ("en", "new york city " * 3000)] + [rows[0]] * 30


@pytest.mark.parametrize("shards,longest,slots", [(2, 3, 1 << 23), (3, 3, 1 << 15), (1, 2, 1 << 16)])
def test_phrases(spark, shards, longest, slots):
    rows = talk(shards, 250)
    docs = spark.createDataFrame([(lang, text, 1, "s") for lang, text in rows], "lang string, text string, n int, score string")
    found = phrases.collocations(docs, shards=shards, longest=longest, slots=slots)
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows, 10, longest)


def test_best_phrases(spark):
    found = phrases.collocations(spark.createDataFrame(talk(9, 250), "lang string, text string"))
    want, rows = [], found.collect()
    for lang in sorted({r.lang for r in rows}):
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: (-r.score, -r.a, r.phrase.encode()))
        want += [(lang, i + 1, r.phrase) for i, r in enumerate(own[:5])]
    assert sorted((r.lang, r["rank"], r.phrase) for r in phrases.best(found, 5).collect()) == want


def test_phrases_of_nothing(spark):
    assert phrases.best(phrases.collocations(spark.createDataFrame([], "lang string, text string"))).count() == 0


def test_exact_products(spark):
    """Counts whose products pass 64 bits."""
    known = spark.createDataFrame([("en", "a b", 2, 10**14), ("en", "a", 1, 10**14 + 7), ("en", "b", 1, 3 * 10**14)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 5 * 10**14)], "lang string, total long")
    keep = phrases.counts
    phrases.counts = lambda *a, **k: (known, totals)
    try:
        assert phrases.collocations(known).first().score == 10**6 * 10**28 // ((10**14 + 7) * 3 * 10**14)
    finally:
        phrases.counts = keep


# ---- trie -------------------------------------------------------------------------------------
def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
    return {c: convs.get(c - c % 100, [])[: h[c]] + ts[h[c] :] for c, ts in convs.items()}


def brute_trie(rows):
    told = rebuilt(rows)
    members = {}
    for c, ts in told.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(c for c in m if len(told[c]) == len(p)))
                  for p, m in members.items())


def nodes(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, id string")
    found = trie.prefix_trie(trie.rebuilt_turns(trie.ordered_turns(df)), **options)
    return sorted(tuple(r) for r in found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(-1))).collect())


def talks(seed, n, deep):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        length = rng.randrange(1, 4) if kind < 0.5 else rng.randrange(1, deep)
        key = rng.randrange(4)
        rows += [(c, t, "user" if t % 2 else None, f"turn {key}.{t // 7} é" if rng.random() < 0.97 else None) for t in range(length)]
    return rows


@pytest.mark.parametrize("height,deep", [(16, 40), (3, 40)])
def test_trie(spark, height, deep):
    rows = talks(height, 150, deep)
    rows += [(7, None, "user", "late"), (7, None, "user", "late"), (None, 1, "user", "nobody"), (1234, 0, "", ""), (20, 3, "a", "same"), (20, 3, "a", "same")]
    assert nodes(spark, rows, height=height) == brute_trie(rows)


def test_trie_of_copies_and_bare_conversations(spark):
    rows = [(c, t, "user", f"{t}") for c in range(5000, 9500) for t in range(2)]
    assert nodes(spark, rows) == brute_trie(rows)
    rows = [(11, 0, "u", "x")]  # its first turns come from a conversation that does not exist
    assert nodes(spark, rows) == brute_trie(rows) and len(brute_trie(rows)) == 1


def test_trie_over_blocks(spark):
    rows = [(0, t, "u", f"{t % 3}") for t in range(1060)] + [(100, t, "u", f"{t % 3}") for t in range(1040)] + [(100, 1040, "u", "else")]
    assert nodes(spark, rows) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert nodes(spark, []) == []
