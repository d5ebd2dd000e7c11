"""Token counts, language ID and quality: exact against the library, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollgrid.llm import language_id as L
from rollgrid.llm import quality as Q
from rollgrid.llm import token_counts as T
from tests.llm import edge_cases as E

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return T.Counter(T.vocabulary_path(T.VOCABULARY))


ODD = [
    "", "Don't you'll we've I'M '''s ''t a'b 'tis", "naïve ÀÉ ΑΣ ΣΑΣ İstanbul ǅ", "日本語テキスト 한국어 العربية हिन्दी", "a" * 3000, "ab" * 900 + "!" * 700 + "'s" * 300,
    "<|endoftext|>x<|startoftext|> y <|endoftext|", "12345 6.7 ٣٤ ½ Ⅷ", "é Å ﬁ ẛ̣", "\x00\x1f​﻿  　 x\x85y\xa0z", "🎉🎉👍🏽 👩‍👩‍👧", "the" * 900, "x" * 255 + " " + "y" * 256 + "." * 257,
]


def test_tokens_are_those_of_the_library(counter, library):
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz '.,!?0123456789éüßñçΣσ日本\n\tABC’<|>"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.choice([3, 40, 700]))) for _ in range(150)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(600)) for _ in range(20)]
    want = library(texts)
    for chunk in (7, 256):
        counter.chunk = chunk
        assert counter.count(texts).tolist() == want


def test_one_word_of_five_megabytes(counter, library):
    """Chunks without a word start: their maps are composed, and agree with the library on words it can take."""
    rng = random.Random(8)
    unit = "".join(rng.choice("aeinrstlo") for _ in range(977))
    counter.chunk = 256
    for text in (unit * 41, "a" * 40_000, "ab" * 20_000):
        assert counter.count([text]).tolist() == library([text])
    for text in (unit * 5400, "ha" * 2_600_000):  # the same chunks in runs of another size
        whole = counter.count([text])
        counter.chunk = 1000
        assert counter.count([text]).tolist() == whole.tolist()
        counter.chunk = 256


def test_unknown_vocabularies_are_refused():
    import json

    spec = json.load(open(T.vocabulary_path(T.VOCABULARY), encoding="utf-8"))
    T.refuse_unknown(spec)
    for change in ({"normalizer": None}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"type": "Unigram"}}):
        with pytest.raises(ValueError):
            T.refuse_unknown(spec | change)


def test_tokens_survive_flushes_and_slices(counter, library, monkeypatch):
    texts = ODD + ["word after word, " * 400]
    want = library(texts)
    monkeypatch.setattr(T, "RUN", 300)
    monkeypatch.setattr(counter.transducer, "max_states", 200)
    assert counter.count(texts).tolist() == want


def test_token_query_takes_every_row(spark, library):
    docs = E.documents(spark, clashing=True)
    got = T.count_tokens(docs)
    texts = [r.text for r in docs.collect()]
    assert sorted(r.n_tokens for r in got.collect()) == sorted(library(texts))
    assert {r.doc_id: (r.n_bytes, r.over_limit) for r in got.collect() if r.doc_id in (2, 3, 5)} == {2: (0, False), 3: (0, False), 5: (len(E.LONG), True)}
    assert T.count_tokens(E.empty(spark)).count() == 0


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = L.Network(["a", "b", "c"], hidden=3, embedding=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, target = rng.integers(97, 105, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    mask = np.ones((6, 4), bool)
    mask[4:, 1] = False
    _, g = net.gradients(data, target, mask)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in rng.choice(flat.size, min(6, flat.size), replace=False):
            if k == "e":
                i = int(data[0, 0]) * 3
            old = flat[i]
            losses = []
            for d in (1e-4, -1e-4):
                flat[i] = old + d
                losses.append(net.gradients(data, target, mask)[0])
            flat[i] = old
            assert g[k].reshape(-1)[i] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=0.02, abs=2e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang is not null").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_are_unknown(spark):
    net = L.train(["one text", "und ein"], ["en", "de"], epochs=1)
    names, scores = L.pooled(net, ["½ ² Ⅷ ① 12 __ !?", "", None, "1 ª", "日本", "x"])
    assert names[:3] == ["und"] * 3 and scores[:3].tolist() == [0, 0, 0] and "und" not in names[3:]


def plain_language(net, text):
    """The network over one text, byte by byte and with scalars' formulas."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    data, h, p = text.encode(), net.hidden, {k: v.astype(np.float64) for k, v in net.p.items()}
    total, n = np.zeros(len(net.languages)), 0
    for at in range(0, len(data), L.SEGMENT):
        part = data[at : at + L.SEGMENT].ljust(L.SEGMENT, b" ")
        sides = {}
        for side in "fb":
            state, out = np.zeros(h), {}
            for t in range(len(part)) if side == "f" else reversed(range(len(part))):
                x, y = p["e"][part[t]] @ p[f"w{side}"] + p[f"b{side}"], state @ p[f"u{side}"]
                z, r = sig(x[:h] + y[:h]), sig(x[h : 2 * h] + y[h : 2 * h])
                state = out[t] = (1 - z) * np.tanh(x[2 * h :] + r * y[2 * h :]) + z * state
            sides[side] = out
        for t, byte in enumerate(part):
            if byte >= 128 or chr(byte).isalpha():
                scores = np.exp(np.concatenate([sides["f"][t], sides["b"][t]]) @ p["o"] + p["c"])
                total, n = total + scores / scores.sum(), n + 1
    return net.languages[int(total.argmax())], float(total.max() / n)


def test_language_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = L.fitted(docs, L.remainder("doc_id", 3) != 1, "doc_id", "text", "lang", 10)
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    some = [r for r in docs.collect() if r.text and L.has_letter(r.text)][:40]
    for r in some:
        lang, score = plain_language(net, r.text[:3000]) if len(r.text) <= 3000 else (got[r.doc_id].lang_pred, got[r.doc_id].score)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-4)


def test_samples_depend_on_the_rows_alone(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang label")
    one, two = L.sample(rows.repartition(3), 20, 60), L.sample(rows.repartition(7), 20, 60)
    assert one == two and 30 < len(one) <= 60 and max(len(t) for t, _ in L.sample(rows)) > 20_000


def test_language_edge_cases(spark):
    docs = E.documents(spark, clashing=True)
    got = L.identify(docs, epochs=1).collect()
    assert len(got) == len(E.ROWS)
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"} and all(r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert L.identify(E.empty(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}
    kept = L.known_language(docs, epochs=1)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.score_quality(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(r.predicted == int(r.score >= Q.THRESHOLD) for r in rows)


def test_quality_by_brute_force(spark):
    """Scores of whole texts, each encoded and weighed alone by the plain formulas."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = Q.fitted(docs, labels, "doc_id", "text", "quality", L.remainder("doc_id", 5) != 0)
    got = {r.doc_id: r.score for r in Q.score_quality(docs, labels).collect()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    for r in docs.collect()[:60]:
        words = (r.text or "").encode()
        x, owner = Q.passages([r.text])
        assert len(x) == max(1, -(-len(words.split()) // Q.PASSAGE)) and not owner.any()
        h = np.tanh((x - model.center) / model.scale @ p["w"] + p["b"])
        e = [np.exp((np.tanh(v @ p["v"]) * sig(v @ p["u"])) @ p["a"][:, 0]) for v in h]
        z = sum(w * v for w, v in zip(e, h)) / sum(e)
        assert got[r.doc_id] == pytest.approx(float(sig(z @ p["s"][:, 0] + p["c"][0])), abs=1e-4)


def test_quality_edge_cases(spark):
    docs = E.documents(spark, clashing=True)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (9, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.score_quality(docs, labels).collect()
    assert len(got) == len(E.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert Q.score_quality(E.empty(spark), labels).count() == 0
    flat = Q.score_quality(docs, labels.limit(0)).collect()
    assert len({r.score for r in flat}) == 1


def test_attention_gradients():
    rng = np.random.default_rng(1)
    model = Q.Model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, bag, y, w = rng.standard_normal((9, Q.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        out = model.forward(x, bag, 3)["y"]
        return -np.mean(y * np.log(out) + (1 - y) * np.log(1 - out))

    g = model.gradients(x, bag, y, w)
    for k in model.p:
        flat = model.p[k].reshape(-1)
        i = int(rng.integers(flat.size))
        old, losses = flat[i], []
        for d in (1e-4, -1e-4):
            flat[i] = old + d
            losses.append(loss())
        flat[i] = old
        assert g[k].reshape(-1)[i] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=0.02, abs=1e-5)
