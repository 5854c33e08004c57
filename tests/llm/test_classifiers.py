import math
import random
import zlib

import numpy as np
import pytest

from assetloom.llm import byte_cnn, labelled, toxicity


def junk_sample(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("aeioutnsrl") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
        bad = i % 3 == 0
        text = " ".join(w + rng.choice(["###", "$$$"]) for w in words) if bad and i % 2 else " ".join([words[0]] * 60) if bad else " ".join(words)
        out.append((text, 0 if bad else 1))
    return out


def test_cnn_learns_held_out_junk():
    train, test = junk_sample(1, 360), junk_sample(2, 120)
    model = byte_cnn.fit([t for t, _ in train], [y for _, y in train])
    right = (model.scores([t.encode() for t, _ in test]) >= 0.7) == np.array([y == 1 for _, y in test])
    assert right.mean() > 0.95


def test_cnn_gradients():
    model = byte_cnn.ByteCnn(3)
    texts, y = [b"some text here", b"another one, longer than the first by far"], np.array([1.0, 0.0])
    blocks, starts = byte_cnn.blocks_of(texts)
    match, weight = byte_cnn.self_match(blocks), np.ones(2)

    def loss():
        p = np.clip(model.scores(texts), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = model.gradients(blocks, starts, match, y, weight)
    for name in ("out", "dense", "filters", "shift", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        step, kept = 1e-2, model.p[name][at]
        model.p[name][at] = kept + step
        up = loss()
        model.p[name][at] = kept - step
        down = loss()
        model.p[name][at] = kept
        assert abs((up - down) / (2 * step) - g[name][at]) < 0.1 * abs(g[name][at]) + 1e-3


def test_cnn_scores_whole_documents(monkeypatch):
    train = junk_sample(1, 240)
    model = byte_cnn.fit([t for t, _ in train], [y for _, y in train])
    clean = train[1][0]
    texts = [(clean + " ").encode() * k for k in (1, 40)] + [b"", (clean + " ").encode() * 40 + b"aaa### bbb### ccc### ddd###"]
    alone = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(model.scores(texts), alone, atol=1e-5) and alone[3] < alone[1]
    monkeypatch.setattr(byte_cnn, "SCORE_BYTES", 1 << 10)
    assert np.allclose(model.scores(texts), alone, atol=1e-5)


def test_self_match_sees_repeats():
    blocks, _ = byte_cnn.blocks_of([b"word word word word word word"])
    assert byte_cnn.self_match(blocks)[4] == 1.0


def toxic_sample(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("aeioutnsrl") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(80, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum"]) if i % 4 == 0 else "zorgl" + rng.choice(["a", "es", "on", "ir"])
        out.append((" ".join(words), int(bad)))
    return out


def test_toxicity_learns_unlisted_words():
    train, test = toxic_sample(1, 900), toxic_sample(2, 300)
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    wrong = [(y, model.score(t)) for t, y in test if (model.score(t) >= 0.5) != (y == 1)]
    assert len(wrong) <= 3


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    vote = lambda accuracy: np.where(rng.random(4000) < accuracy, np.where(y, 1, -1), np.where(y, -1, 1))
    good, fair, poor = vote(0.9), vote(0.75), vote(0.6)
    v = np.stack([good, fair, poor, poor, poor], axis=1)
    model = toxicity.LabelModel()
    p = model.fit(v, (v.mean(axis=1) > 0) * 0.6 + 0.2)
    assert model.share[2] < 0.5 < model.share[0]
    assert ((p > 0.5) == y).mean() >= (np.where(good > 0, True, False) == y).mean() - 0.01


def test_lexicons_alone():
    model = toxicity.fit(["a b", "c d"], [0, 0])
    assert model.score("you idiot, you scum") > 0.5 > model.score("a quiet day") and model.score("") < 0.5


def test_held_out_rows_do_not_train(spark, documents, labels):
    for label, folds, out in (("quality", 4, 2), ("toxic", 5, 0)):
        found, _ = labelled.labelled_sample(documents, labels, label, folds, out, 10_000)
        held = {r["text"] for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % folds == out}
        train = {r["text"] for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % folds != out}
        assert found and not set(found) & (held - train)


def test_labels_beside_the_documents(spark):
    """Labels of many other ids do not use up the sample; its bytes are bounded by whole texts."""
    rows = [(i, f"text {i} " * (500 if i == 7 else 1)) for i in range(100)]
    docs = spark.createDataFrame([*rows, rows[3], (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20_000)] + [(None, 1)], "doc_id long, quality int")
    want = {t: i % 2 for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    texts, found = labelled.labelled_sample(docs, labels, "quality", 4, 2, 300)
    assert dict(zip(texts, found)) == want and len(texts) == len(want)
    short, _ = labelled.labelled_sample(docs, labels, "quality", 4, 2, 300, most_bytes=400)
    assert rows[7][1] not in short and 300 < sum(map(len, short)) <= 400 and set(short) < set(want)
    few, _ = labelled.labelled_sample(docs, labels, "quality", 4, 2, 10)
    assert len(few) == 10 and few == texts[:10]


def plain_scores(model, texts):
    """The network chunk by chunk: inputs, filters, maxima and dense layers without any sharing."""
    p, out = model.p, []
    for text in texts:
        gap = bytes((byte_cnn.SPAN - 1) * byte_cnn.BLOCK)
        padded = gap + text + bytes(-len(text) % byte_cnn.BLOCK or (0 if text else byte_cnn.BLOCK)) + gap
        blocks = []
        for at in range(0, len(padded), byte_cnn.BLOCK):
            own = padded[at : at + byte_cnn.BLOCK]
            lags = [sum(padded[i] == padded[i - lag] != 0 for i in range(at, at + byte_cnn.BLOCK) if i >= lag) for lag in range(1, byte_cnn.LAGS + 1)]
            blocks.append(np.concatenate([p["embed"][b] for b in own] + [[max(lags) / byte_cnn.BLOCK]]))
        chunks = [sum(blocks[s + i] @ p["filters"][i] for i in range(byte_cnn.SPAN)) for s in range(len(blocks) - byte_cnn.SPAN + 1)]
        pooled = np.maximum(np.max(chunks, axis=0) + p["shift"], 0)
        hidden = np.maximum(pooled @ p["dense"] + p["dense_shift"], 0)
        out.append(1 / (1 + np.exp(-(hidden @ p["out"] + p["out_shift"][0]))))
    return np.array(out)


def test_cnn_against_plain(texts):
    train = junk_sample(1, 60)
    model = byte_cnn.fit([t for t, _ in train], [y for _, y in train], epochs=1)
    some = [b"", b"short", b"exactly8", "é ü word word word".encode() * 9, *(t.encode() for t in list(texts.values())[:6])]
    assert np.allclose(model.scores(some), plain_scores(model, some), atol=1e-4)


def test_toxicity_against_plain(documents, labels, texts):
    """Scores of the query are the logistic of the summed weights of every word and beginning."""
    model = toxicity.fit_documents(documents, labels)
    some = dict(list(texts.items())[:40])
    by_id = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents, labels).collect()}
    for i, text in some.items():
        words = toxicity.WORD.findall(text.lower())
        total = sum(model.weights.get(f, 0.0) for w in words for f in toxicity.stems(w))
        assert by_id[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.bias + 100 * total / max(1, len(words)))))))


def contract(frame, docs, folds, out, cut):
    rows = frame.collect()
    assert len(rows) == docs.count()
    for r in rows:
        name = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(name.encode()) % folds == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_contracts(documents, labels, messy, few_labels):
    contract(byte_cnn.quality(documents, labels), documents, 4, 2, 0.7)
    contract(toxicity.toxicity(documents, labels), documents, 5, 0, 0.5)
    for own in (few_labels, few_labels.limit(0)):
        contract(byte_cnn.quality(messy, own), messy, 4, 2, 0.7)
        contract(toxicity.toxicity(messy, own), messy, 5, 0, 0.5)
    assert byte_cnn.quality(messy.limit(0), few_labels).count() == 0 == toxicity.toxicity(messy.limit(0), few_labels).count()


def test_drop_toxic(messy, few_labels, documents, labels):
    out = toxicity.drop_toxic(messy, few_labels)
    assert out.columns == messy.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents, labels).collect()}
    kept = {r["doc_id"] for r in toxicity.drop_toxic(documents, labels).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.5}
