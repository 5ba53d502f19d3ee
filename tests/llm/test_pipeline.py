"""Every stage of the pipeline on what the stage before it kept, against brute force; then the whole run."""
import re

import pytest

import brute
import corpus_pipeline as pipeline
from ringwave.llm import packing, toxicity
from ringwave.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name, input and result of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        done = cut_lineage(stage(spark, docs, SF))
        out[name] = (docs, done)
        docs = done
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order(stages):
    assert list(stages) == ["toxicity", "simhash", "decontamination", "pii", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][0].columns == stages[name][1].columns


def test_toxicity(spark, stages):
    docs, kept = stages["toxicity"]
    index = toxicity.fit(docs, toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    low = {r.id for r in toxicity.score(docs, index).collect() if r.score < 0.7}
    assert texts(kept) == {d: t for d, t in texts(docs).items() if d in low}


def test_simhash(stages):
    docs, kept = stages["simhash"]
    label = brute.near_components([(d, brute.simhash(t)) for d, t in texts(docs).items()], 4)
    assert texts(kept) == {d: t for d, t in texts(docs).items() if label[d] == d}


def test_decontamination(spark, stages):
    docs, kept = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute.occurrences(list(texts(docs).items()), items) if not r[5]}
    assert texts(kept) == {d: t for d, t in texts(docs).items() if d in clean}


def test_pii(stages):
    docs, done = stages["pii"]
    done = {r.doc_id: r for r in done.collect()}
    for d, text in texts(docs).items():
        spans = [s.split(":") for s in brute.base_pii(text)[1].split(",") if s]
        for kind, start, end in sorted(spans, key=lambda s: -int(s[1])):
            text = text[: int(start)] + f"<{kind.upper()}>" + text[int(end) :]
        got = re.sub("<GENERALISE>", "", done[d].text)
        assert got == text if "<GENERALISE>" not in done[d].text else len(got) < len(text)
        assert done[d].n_chars == len(done[d].text)


def test_packing(stages):
    from tokenizers import Tokenizer

    docs, pieces = stages["packing"]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {d: len(brute.token_bytes(tokenizer, t)) // 4 for d, t in texts(docs).items()}
    got = {}
    for r in pieces.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_run(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = {r.doc_id: 0 for r in stages["packing"][1].collect()}
    assert {r.doc_id for r in pipeline.run(spark, SF).select(*key).collect()} == set(whole)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
