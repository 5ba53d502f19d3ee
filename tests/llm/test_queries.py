"""Registered queries on the provided tables against brute force, held-out truth or SQL."""
import zlib

import numpy as np
import pytest

import brute
from ringwave.llm import fingerprint, packing, toxicity
from ringwave.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(spark, name, columns=None):
    df = QUERIES[name](spark, SF)
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    from compare import compare, connect

    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLE[name]) is None


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows(spark, "op1_decontamination") == sorted(brute.occurrences(docs, items))


def test_simhash(spark, docs):
    prints = [(d, brute.simhash(t)) for d, t in docs]
    label = brute.near_components(prints, 4)
    assert rows(spark, "op3_simhash") == sorted((d, f"{f:016x}", label[d]) for d, f in prints)


def test_pii(spark, docs):
    found = {r[0]: r for r in rows(spark, "op4_pii")}
    for d, text in docs:
        counts, listed = brute.base_pii(text)
        assert found[d][1:6] == (*counts, brute.sha(listed))
        assert found[d][6].startswith(listed)


def test_substrings(spark, docs):
    assert rows(spark, "op5_substrings") == sorted(brute.cut_repeats(docs))


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    talk = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = rows(spark, "op6_chat")
    assert [r[:5] for r in found] == brute.conversations(talk + [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    assert all(r[5] > 0 for r in found)


def test_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = rows(spark, "op7_language")
    assert all(r[1] == (brute.remainder(r[0], 4) == 2) and 0 <= r[3] <= 1 for r in found)
    held = [r for r in found if r[1]]
    assert sum(truth[r[0]] == r[2] for r in held) >= 0.97 * len(held)


def test_fingerprint(spark, docs):
    found = {r[0]: r for r in rows(spark, "op8_fingerprint")}
    assert len(found) == len(docs)
    docs = sorted(docs, key=lambda d: -d[0])
    for (d, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert found[d][1:3] == (len(text), brute.sha(edited))
        if len(text) <= 64 or d % 5 == 0:  # values by brute force
            assert found[d][3:5] == (brute.digest(text), brute.digest(edited))
            assert np.allclose(found[d][5:7], (brute.dice(text, edited), brute.dice(text, after)))
    near = [r for r in found.values() if r[1] > 200]
    assert np.mean([r[5] for r in near]) > 0.4 > 10 * np.mean([r[6] for r in near])


def test_shared_passage_of_long_texts(spark):
    """200 words shared by texts of 21,000 words, at other places, are always seen."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (4000, 5))])
    made = []
    for i in range(8):
        shared = list(rng.choice(words, 200))
        for at in (1000, 15000):
            own = list(rng.choice(words, 21000))
            made.append((2 * i + (at > 1000), " ".join([*own[:at], *shared, *own[at:]])))
    found = fingerprint.compare_with_edited(spark.createDataFrame(made, "doc_id long, text string")).collect()
    # half of the followers are the text with the same passage
    assert sum(r.near_next > 0.004 for r in found) >= 8 and all(r.near_next > 0.004 for r in found if r.id % 2)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op9_toxicity"](spark, sf).collect()
    assert all(r.held_out == (brute.remainder(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in label]
    hit = sum(r.predicted and label[r.doc_id] for r in held)
    assert hit >= 0.5 * sum(label[r.doc_id] for r in held)
    assert hit >= 0.9 * sum(r.predicted for r in held)


@pytest.mark.parametrize("lists", [0, 40, 1024])
def test_neighbours_by_brute_force(docs, lists):
    """Terms, weights, neighbours, votes and evidence against dictionaries, with none, some and all lists long."""
    sample, rest = docs[:70], docs[70:]
    sample = [*sample, (900, "zorp quax blem drast"), (901, "zorp quax blem drast"), (902, "zorp")]
    counted = [brute.toxic_terms(t) for _, t in docs + sample[-3:]]
    idf = brute.idf(counted)
    label = np.array([i % 3 == 0 for i, _ in sample])
    row, key, count = toxicity.terms([t for _, t in sample])
    vocabulary, at = np.unique(key, return_inverse=True)
    named = {w: k for t in [brute.toxic_terms(t) for _, t in sample] for w, k in brute.keyed(t)}
    assert len(named) == len(set(named.values())) == len(vocabulary)
    weights = np.zeros(len(vocabulary))
    for w, k in named.items():
        weights[np.searchsorted(vocabulary, np.uint64(k))] = idf[w]
    index = toxicity.build(np.array([i for i, _ in sample]), label, vocabulary, weights, row, at, count, lists=lists, block=8)
    index.steps = index.scores = np.array([0.0, 1.0])
    asked = [t for _, t in rest] + ["zorp quax blem drast", "", "!!", "zorp zorp neverseen"]
    found, evidence = index.score(asked)
    toxic = dict(zip((i for i, _ in sample), label))
    for text, got, ids in zip(asked, found, evidence):
        near = {i: s for s, i in brute.neighbours(text, sample, idf)}
        if not any(near.values()):
            assert got == label.mean() and not ids
            continue
        sums = []
        for side in (True, False):
            top = sorted((s for i, s in near.items() if toxic[i] == side), reverse=True)[: index.neighbours]
            mine = [near[i] for i in ids if toxic[i] == side]
            assert len(mine) >= sum(s > 1e-5 for s in top) and np.allclose(mine, top[: len(mine)], atol=3e-6)
            sums.append(sum(x * x for x in top))
        assert abs(got - sums[0] / sum(sums)) < 1e-4
    assert set(evidence[len(rest)]) >= {900, 901}


def test_rare_words_teach(spark):
    """An exact copy of labelled toxic texts of words that stand nowhere else is found, with evidence."""
    sf = "/root/testdata/sf0.001"
    own = [(10**6 + i, "zorp quax blem drast") for i in range(4)]
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(own, "doc_id long, text string"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    labels = labels.union(spark.createDataFrame([(i, 1) for i, _ in own[:3]], "doc_id long, toxic int"))
    found = {r.id: r for r in toxicity.score(table, toxicity.fit(table, labels)).where("id >= 1000000").collect()}
    assert all(found[i].score >= 0.7 and {j for j, _ in own[:3]} <= set(found[i].evidence) for i, _ in own)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: brute.token_bytes(tokenizer, t) for d, t in docs}
    at, places = {}, {}
    for r in QUERIES["op10_packing"](spark, SF).orderBy("doc_id", "start").collect():
        own = ids[r.doc_id]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(own) // 4
        assert r.ids_crc32 == zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)])
        at[r.doc_id] = r.start + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {d: len(b) // 4 for d, b in ids.items()}
    total = padding = 0
    for parts in places.values():
        size = 0
        for offset, length in sorted(parts):
            assert offset == size
            size += length
        assert size <= 2048 and len(parts) <= packing.Limits().segments
        total += size
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding <= 0.01 * total
