"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from ringwave.llm import (chat, decontaminate, fingerprint, language, licences, packing, pii, simhash, substrings, toxicity)

LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
LINE = " ".join(f"shared{i}" for i in range(70))
ROWS = [
    (1, "plain words of one text"), (2, None), (3, ""), (4, " \n\t "), (5, "plain words of one text"),
    (6, f"before {LINE} after"), (7, f"other {LINE} end"), (7, f"other {LINE} end"), (8, LONG), (9, LONG),
    (10, "of " * 300), (11, "OF " * 300), (12, "é😀 x@y.zz 1.2.3.4 +1 (234) 555-1234; 4111 1111 1111 1111"), (13, "!!! ..."),
]
SCHEMA = "doc_id long, text string"


def frame(spark, rows=ROWS, null_id=True):
    """The rows with columns whose names operators use inside."""
    rows = rows + ([(None, "a text without id"), (None, None)] if null_id else [])
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "key", "body", "row", "spans", "score", "of", "term", "value", "fp", "part", "lang", "block"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_decontamination(spark, docs, block_bytes):
    items = [("a", LINE), ("b", "of"), ("c", None), ("d", ""), ("b2", "of"), ("e", "One Text"), ("f", " ".join(["of"] * 14))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.report(decontaminate.find_occurrences(docs, bench, block_bytes=block_bytes)).collect()
    assert ordered(found) == ordered(brute.occurrences([*ROWS, (None, "a text without id"), (None, None)], items))
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {2, 3, 4, 8, 9, 12, 13, None}


def test_decontamination_empty(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.report(decontaminate.find_occurrences(docs, bench)).where("n_hit > 0").count() == 0
    assert decontaminate.report(decontaminate.find_occurrences(empty, bench)).collect() == []


def test_licences(spark, docs, empty):
    text = "Hello.  Licensed under the MIT License.\nLicensed under CC BY-NC 4.0.\r\nReleased under the MIT License."
    found = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(1, text), (2, None), (3, "All rights reserved. See the GNU General Public License for more details.")], SCHEMA)).collect()}
    assert (found[1].licences, found[1].status, found[1].n_licence_sentences) == ("MIT,CC-BY-NC-4.0", "recognised", 3)
    assert (found[2].n_sentences, found[2].status) == (0, "none")
    assert (found[3].licences, found[3].status) == ("Proprietary", "unknown")
    assert licences.scan(docs).count() == docs.count() and licences.scan(empty).count() == 0


def test_licences_wrapped(spark):
    """Verbatim texts wrapped near 78 columns, also in comments; a blank line still parts sentences."""
    mit = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
    bsd = """Copyright (c) 2020, A Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License. You may obtain
a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
    want = {mit: "MIT", gpl: "GPL-3.0-or-later", bsd: "BSD-3-Clause", apache: "Apache-2.0"}
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), *[lambda t, c=c: "".join(f"{c} {x}\n" for x in t.split("\n")) for c in (" *", "//", "#", ";;")]]
    rows = [(form(t), name) for t, name in want.items() for form in forms] + [("MIT License", "MIT"), ("Released under the\n\nMIT License or not", "")]
    found = licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], SCHEMA)).collect()
    for r in found:
        assert (r.licences, r.status) == (rows[r.doc_id][1], "recognised" if rows[r.doc_id][1] else "none"), rows[r.doc_id][0]


def test_simhash(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    prints = [(d, brute.simhash(t)) for d, t in ROWS]
    label = brute.near_components(prints, 4)
    want = [(d, f, label[d]) for d, f in prints]
    assert ordered((r.id, r.fp % 2**64, r.component) for r in found if r.id is not None) == ordered(want)
    assert len(found) == len(ROWS) + 2 and simhash.near_duplicates(empty).collect() == []
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*label.values(), None}


@pytest.mark.parametrize("plan", [None, [(list(range(32)), 1), (list(range(32, 64)), 2)], [(list(range(20)), -1), (list(range(20, 42)), 2), (list(range(42, 64)), 1)]])
@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_simhash_links(spark, plan, bucket_rows):
    """Any thresholds that sum as they must, and split buckets, give the same components."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12)
    prints = list({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), False)) for b in base for _ in range(12)})
    rows = [(i, p) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, i) for i, p in rows], "fp long, root long")
    plan = plan and [(g, t) for g, t in plan if t >= 0]
    links = simhash.near_links(nodes, plan=plan, bucket_rows=bucket_rows)
    found = dict(map(tuple, simhash.components(links).collect()))
    assert {i: found.get(i, i) for i, _ in rows} == brute.near_components(rows, 4)


def test_thresholds():
    together = np.full((64, 64), 250.0) + np.eye(64) * 250
    for n in (1000, 10**6, 10**9):
        plan = simhash.allocate(n, together * n / 1000)
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits)) and sum(t + 1 for _, t in plan) == 5


def test_pii(spark, docs, empty):
    nasty = [(i, t) for i, t in enumerate([
        "a@b.c_d@e.f", "x@1.2.3.4 1.2.3.4.5.6.7.8.9", "256.1.1.1 001.002.003.0255", "+1 (234) 555-1234 +12 3 +1234567890123456",
        "4111 1111 1111 1111 4111-1111-1111-1111-11 9", "a@b@c.d.e @x.y", "12 3456789012345678 4111111111111111x", "5" * 5000, "a" * 50_000, "1." * 3000, "😀a@b.c😀"])]
    found = {r.doc_id: r for r in pii.report(pii.find_spans(spark.createDataFrame(nasty, SCHEMA))).collect()}
    for i, text in nasty:
        counts, listed = brute.base_pii(text)
        assert (*found[i][1:6], found[i].spans) == (*counts, brute.sha(listed), listed)
    assert pii.report(pii.find_spans(docs)).count() == docs.count() and pii.report(pii.find_spans(empty)).count() == 0
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("doc_id = 12").first().text == "é😀 <EMAIL> <IP> <PHONE>; <CARD>"
    assert clean.where("doc_id = 2").first().text is None


def test_pii_terms(spark):
    """A term that stands only beside one address goes; one that is somewhat freer is generalised."""
    rows = [(i, f"number {i} said zanzibar kim@a.org quokka today") for i in range(4)]
    rows += [(10 + i, f"number {i} said nothing today") for i in range(300)] + [(400, "quokka alone")]
    found = pii.find_spans(spark.createDataFrame(rows, SCHEMA)).where("id < 4 or id = 400").collect()
    for r in found:
        assert [s.hit for s in r.remove] == (["zanzibar"] if r.id < 4 else [])
        assert [s.hit for s in r.generalise] == (["quokka"] if r.id < 4 else [])
    copies = spark.createDataFrame([(i, "zanzibar kim@a.org quokka") for i in range(4)] + rows[4:], SCHEMA)
    assert pii.find_spans(copies).where("size(remove) + size(generalise) > 0").count() == 0


def test_pii_terms_of_one_text(spark, tmp_path):
    """A value in one text, or in copies of it, is enough for the queries; common words stay."""
    rows = [(i, f"number {i} said nothing today") for i in range(300)]
    for copies in (1, 4):
        told = [(400 + i, "today zanzibar kim@a.org said nothing") for i in range(copies)]
        df = spark.createDataFrame(rows + told, SCHEMA)
        assert {r.text for r in pii.sanitise(df).where("doc_id >= 400").collect()} == {"today <GENERALISE> <EMAIL> said nothing"}
        path = f"{tmp_path}/{copies}"
        df.write.parquet(f"{path}/documents.parquet")
        found = pii.op4_pii(spark, path).collect()
        assert all(("generalise:6:14" in r.spans) == (r.doc_id >= 400) and r.spans.count("generalise") <= 1 for r in found)


def test_substrings(spark, docs, empty):
    found = substrings.remove_repeats(docs).select("id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert ordered(found) == ordered(brute.cut_repeats([*ROWS, (None, "a text without id"), (None, None)]))
    assert substrings.remove_repeats(empty).collect() == []
    short = [(1, "a b c d"), (2, "x b c d"), (3, "b c"), (1, "z c d")]
    got = substrings.remove_repeats(spark.createDataFrame(short, SCHEMA), window=2, part=1).select("id", "n_words", "n_removed", F.sha2("kept", 256))
    assert ordered(got.collect()) == ordered(brute.cut_repeats(short, 2))


@pytest.mark.parametrize("limits", [{}, {"budget": 700, "history": 100, "turn_tokens": 200, "block_turns": 7}])
def test_chat(spark, limits):
    rng = np.random.default_rng(1)
    bits = ["a\\", "<|im_end|>", "x\n\n", "\\n", "<|", "|>", "word word", "<\\|"]
    rows = [(1, 0, "system", "be nice " * 20)] + [(1, i + 1, ("user", "assistant")[i % 2], " ".join(rng.choice(bits, rng.integers(0, 500)))) for i in range(40)]
    rows += [(2, i, "assistant", None if i == 1 else f"t{i}") for i in range(3)] + [(3, 0, "as\nsis\\tant", ""), (3, 1, "user", "big " * 3000), (None, 0, "user", "x"), (5, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("tokens", F.lit(1))
    windows = chat.format_windows(df, packing.default_tokenizer(), **limits).cache()
    got = {r.conv_id: tuple(r)[:5] for r in chat.read_back(windows).collect()}
    want = {r[0]: r for r in brute.conversations([r for r in rows if r[0] is not None and r[1] is not None])}
    assert {k: v for k, v in got.items() if k in want} == want and set(got) == {*want, None, 5}
    assert windows.agg(F.max("tokens")).first()[0] <= limits.get("budget", 4096)
    assert chat.format_windows(df.limit(0), packing.default_tokenizer()).collect() == []


def test_chat_budget(spark):
    """Real tokens of each window keep within the budget, and each repeats the system turn whole."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    system = " ".join(f"rule{i} holds" for i in range(400))
    rows = [(1, 0, "system", system)] + [(1, i + 1, ("user", "assistant")[i % 2], "ok" if i % 3 else "\\" * 900) for i in range(400)]
    rows += [(2, i, ("user", "assistant")[i % 2], "ok") for i in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.format_windows(df, packing.default_tokenizer()).collect()
    assert len([r for r in found if r.conv == 1]) > 3 and len([r for r in found if r.conv == 2]) > 1
    for r in found:
        assert len(whole.encode(r.formatted).ids) <= 4096
        turns = chat.TURN.findall(r.formatted)
        if r.conv == 1 and any(role != "system" for _, role, _ in turns):
            assert "".join(body for _, role, body in turns if role == "system") == system


def test_chat_of_huge_system_turns_and_roles(spark):
    """One odd conversation neither ends the job nor changes the others; everything reads back exactly."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    system = " ".join(f"rule{i} holds" for i in range(4000))
    rows = [(1, 0, "system", system)] + [(1, i + 1, ("user", "assistant")[i % 2], f"word{i} " * 300) for i in range(30)]
    rows += [(2, 0, "assistant " * 900, "said " * 900), (2, 1, "assistant " * 900, "said"), (2, 1, "assistant " * 900, "said")]
    rows += [(3, 0, "system", "short"), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, 2, None, None), (4, 0, "system", system)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, packing.default_tokenizer())
    assert ordered(tuple(r)[:5] for r in chat.read_back(windows).collect()) == ordered(brute.conversations(rows))
    found = windows.collect()
    assert {r.conv: r.system_cut for r in found} == {1: True, 2: False, 3: False, 4: True}
    for r in found:
        if r.conv != 2:
            assert len(whole.encode(r.formatted).ids) <= 4096
        if r.conv == 1:  # the beginning of the system turn stands in front of every window
            assert r.formatted.startswith("<|im_start|>system\n" + system[:1000])


def test_language(spark, docs, empty):
    learn = [(i, "en", "the cat and the dog of this house") for i in range(9)] + [(20 + i, "fr", "le chat et la souris dans une maison") for i in range(9)] + [(50, "en", None), (51, None, "x")]
    model = language.fit(spark.createDataFrame(learn, "id long, lang string, body string"))
    found = {r.id: r for r in language.predict(docs, model).collect()}
    assert found[1].lang_pred in ("en", "fr") and {found[i].lang_pred for i in (2, 3, 4, 13)} == {"und"} and found[2].score == 0
    assert language.predict(docs, model).count() == docs.count() and language.predict(empty, model).count() == 0
    assert language.fit(spark.createDataFrame([], "id long, lang string, body string")) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_kernel_is_presence_of_shared_grams():
    """Without hash collisions in so short texts the kernel equals counted common n-grams."""
    def grams(t):
        return {(n, t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    a, b = "the cat sat", "a cat spat"
    bits, _ = language.presence([a, b, "1 2", ""])
    assert bits[0] @ bits[1] == len(grams(a) & grams(b)) and bits[0].sum() == len(grams(a)) and bits[3].sum() == 0


def test_fingerprint(spark, docs, empty):
    found = fingerprint.compare_with_edited(docs).collect()
    assert len(found) == docs.count() and fingerprint.compare_with_edited(empty).collect() == []
    by = {}
    for r in found:
        by.setdefault(r.id, []).append(r)
    assert by[2][0].fingerprint == by[3][0].fingerprint == "" and by[8][0].fingerprint == by[9][0].fingerprint
    assert by[9][0].near_next == 1 and by[1][0].fingerprint == by[5][0].fingerprint and all(0 <= r.near_edited <= 1 for r in found)
    one = fingerprint.compare_with_edited(spark.createDataFrame([(1, "abcd")], SCHEMA)).first()
    assert one.edited_sha256 == brute.sha("abab") and one.near_next == 1
    moved = fingerprint.anchor_table(spark.createDataFrame([(1, LINE), (2, "some words before " + LINE)], SCHEMA))
    met = moved.alias("a").where("id = 1").join(moved.where("id = 2").alias("b"), "anchor").where("b.position - a.position = 18")
    assert met.count() >= moved.where("id = 1").count()


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None), (None, 1), (5, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    rows = [(i, f"vile brute number {i} vile" if i % 2 else f"kind friend number {i}") for i in range(200)] + [(300, None), (301, ""), (None, "vile brute")]
    index = toxicity.fit(spark.createDataFrame(rows, SCHEMA), labels)
    found = {r.id: r for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), index).collect()}
    assert found[7].score >= 0.7 > 0.3 > found[8].score and found[300].score == found[301].score < 0.7 and set(found[7].evidence) <= set(range(200))
    assert toxicity.score(docs, index).count() == docs.count() and toxicity.score(empty, index).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_monotone_calibration():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0, 1, 0, 0, 1.0]))
    assert list(x) == [0.1, 0.2, 0.3, 0.9] and np.allclose(y, [0, 1 / 3, 1 / 3, 1])


def test_packing(spark, docs, empty):
    limits = packing.Limits(tokens=64, segments=3, loss_tokens=40)
    df = docs.withColumn("from", F.lit(2))
    got = packing.pack(df, packing.default_tokenizer(), limits, loss_from_col="from", keep_ids=True).collect()
    by = {}
    for r in got:
        assert len(r.ids) == r.length > 0
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        assert sum(p.length for p in parts) <= 64 and len(parts) <= 3 and sum(p.loss_tokens for p in parts) <= 40
    whole = {}
    for r in got:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert len(whole) == len({(d, t) for d, t in ROWS}) + 2
    assert all(sum(n for _, n in parts) % d[1] == 0 for d, parts in whole.items())
    assert packing.pack(empty, packing.default_tokenizer()).collect() == []


def test_tokens_equal_the_tokenizer(spark):
    ids = packing.Ids(packing.default_tokenizer(), limit=20)
    strange = ["it's a test's end", "A\x1cB! !\x1c!", "<|endoftext|> x<|endoftext|>", "Éé ÀÜß œ Ω", "é x y z", "3.14 foo?! 'tis", "ﬁ ǅ İ ſ", "\u0085a", None, ""]
    for text in strange + [LONG[:2000]]:
        assert ids([text or ""])[0] + (1).to_bytes(4, "little") == brute.token_bytes(ids.whole, text)
