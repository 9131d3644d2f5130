import math
import random
import re
import zlib

import numpy as np

from graphloom.llm import common, toxicity

SCHEMA = "doc_id long, text string, score double, toxic int"


def scalar_features(text):
    """Each sentence's hashed words and prefixes, by plain string work: the first bits of a polynomial hash."""
    out = []
    for sentence in re.split(rb"(?<=[.!?])(?=[\t-\r ])|(?<=\n)", text.encode()):
        found = []
        for word in re.findall(rb"[A-Za-z0-9\x80-\xff]+", sentence):
            word = word.lower()
            for part in [word, *(word[:k] for k in toxicity.PREFIXES if len(word) > k)]:
                value = sum((b + 1) * pow(int(common.BASE), i, 1 << 64) for i, b in enumerate(part)) % (1 << 64)
                found.append(int(common.mix(np.array([(value + len(part) * int(common.GOLDEN)) % (1 << 64)], dtype=np.uint64))[0]) >> 64 - toxicity.BITS)
        if found:
            out.append(sorted(found))
    return out


def scalar_score(text, weights):
    """1 - prod(1 - p) over the sentences."""
    clean = 1.0
    for features in scalar_features(text):
        clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, sum(weights[f] for f in features) + weights[-1]))))
    return 1 - clean


def test_scores_equal_the_scalar_ones(spark):
    rng = np.random.default_rng(4)
    weights = np.append(rng.normal(0, 0.4, 1 << toxicity.BITS), -2.0).astype(np.float32).astype(float)
    texts = ["", "One word", "Ab cd. Éf gh! ij\nkl? . mn", "no end.of it", "A" * 40 + " tail.\n\nNext\tone!? Yes", " . ! ?", "über Straße 日本語 x1"] + [t for _, t, _ in corpus(20, 9)]
    for t in texts:
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        owner, feature, *_ = toxicity.tokens(raw, np.array([0, len(raw)]))
        assert [sorted(feature[owner == s].tolist()) for s in range(owner.max(initial=-1) + 1)] == scalar_features(t)
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)] + [(99, "long words here. " * 60_000, None, None)], SCHEMA)
    got = {r.doc_id: r for r in toxicity.score(df, weights).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i].score - scalar_score(t, weights)) < 1e-9 and got[i].predicted == int(got[i].score >= 0.5)
    assert got[99].n_sentences == 60_000


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    local, word, row = np.array([0, 0, 1, 2, 2, 3, 4]), np.array([1, 2, 2, 0, 3, 3, 1]), np.array([0, 0, 1, 1, 2])
    toxic, weights = np.array([1.0, 0.0, 1.0]), rng.normal(0, 1, 6)

    def loss(w):
        clean = [1.0] * 3
        for s, d in enumerate(row):
            clean[d] *= 1 - 1 / (1 + math.exp(-(w[word[local == s]].sum() + w[-1])))
        return -sum(math.log(1 - c) if t else math.log(c) for c, t in zip(clean, toxic, strict=True))

    got = toxicity.gradient(local, word, row, toxic, weights)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        assert abs(got[k] - (loss(weights + step) - loss(weights - step)) / 2e-6) < 1e-6


def corpus(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        bad = rng.random() < 0.3
        lines = [" ".join(f"w{rng.randrange(300)}x" for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(2, 9))]
        at = rng.randrange(len(lines))
        if bad:
            lines[at] += f" vile{rng.choice(['st', 'r', 'ness', 'd'])}"
        yield i, ". ".join(lines) + ".", bad


def test_held_out_accuracy_and_offending_sentences(spark):
    rows = list(corpus(1500, 5))
    docs = spark.createDataFrame([(i, t, None, 7) for i, t, _ in rows] + [(9999, None, 1.0, 1), (10000, "", 1.0, 1), (None, "w1 w2", None, None), (0, rows[0][1], None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(b), "x") for i, _, b in rows] + [(3, 1, None, "x"), (None, 1, 1, "x"), (3, 0, int(rows[3][2]), "y")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows) + 4
    truth = {i: (t, b) for i, t, b in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    for r in held:
        if r.predicted:
            text = truth[r.doc_id][0]
            assert all("vile" in text[s.low : s.high] for s in r.offending if s.score > 0.9)
    by = {r.doc_id: r for r in got}
    assert by[9999].score == by[10000].score == 0 and by[9999].predicted == 0
    assert len([r for r in got if r.doc_id == 0]) == 2 and len({r.score for r in got if r.doc_id == 0}) == 1


def test_no_labels_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b. c", None, 1)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).first().predicted == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_sentences_cover_the_text_whole():
    text = "Ab cd. Éf gh! ij\nkl? . mn"
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    _, _, row, low, high = toxicity.tokens(raw, np.array([0, len(raw)]))
    assert [bytes(raw[a:b]).decode().strip() for a, b in zip(low, high)] == ["Ab cd.", "Éf gh!", "ij", "kl?", "mn"]
    assert set(row) == {0}
