"""The toxicity machine against a plain kernel, on planted insults, and its handling of odd tables."""

import itertools
import random
from collections import Counter

import numpy as np

from tabloom.llm import toxicity

SCHEMA = "doc_id long, text string, toxic int, weights array<int>, nth int"
LABELS = "doc_id long, toxic int, text string"


def plain_kernel(a, b):
    def bag(word):
        line = [toxicity.EDGE, *(c for c in toxicity._LETTERS[np.frombuffer(word.encode("latin-1"), np.uint8)] if c), toxicity.EDGE]
        out = Counter()
        for i, j, k in itertools.combinations(range(len(line)), 3):
            if k - i < toxicity.SPAN:
                out[line[i], line[j], line[k]] += toxicity.DECAY ** (k - i)
        return out

    x, y = bag(a), bag(b)
    dot = sum(x[c] * y[c] for c in x)
    return dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel_is_that_of_subsequences():
    words = ["a", "idiot", "idi0t", "i.d.i.o.t", "idxiot", "größe", "mississippi", "zz"]
    dense = toxicity._dense(words)
    for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(words), 2):
        assert abs(float(dense[i] @ dense[j]) - plain_kernel(a, b)) < 1e-5


def _corpus(seed, n):
    draw = random.Random(seed)
    parts = ["ba", "ko", "lin", "ter", "mo", "sa", "vel", "dra", "qui", "non"]
    rows = []
    for i in range(n):
        words = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            words[draw.randrange(40)] = draw.choice(["scumbag", "worthless", "idiot"])
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_finds_planted_and_gapped_insults():
    rows = _corpus(1, 400)
    model = toxicity._fit([x for x, _ in rows], np.array([t for _, t in rows]))
    known = toxicity.Known(dtype=np.float64)

    def score(texts):
        return [model.score(m) for m in model.margins(texts, known)]

    unseen = _corpus(2, 200)
    right = [(s >= 0.5) == bool(t) for s, (_, t) in zip(score([x for x, _ in unseen]), unseen)]
    assert np.mean(right) > 0.97
    clean = unseen[1][0]
    assert min(score([clean + " " + w for w in ("idiot", "idi0t", "i.d.i.o.t", "worthxless", "i d i o t")])) > 0.5
    assert max(score([clean, "", None, "1234 !!"])) < 0.5


def test_rows_are_chosen_among_usable_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_TOXIC", 3)
    monkeypatch.setattr(toxicity, "FIT_CLEAN", 4)
    monkeypatch.setattr(toxicity, "FIT_CHARS", 10)
    rows = [(i, "x" * (5 if i % 2 else 50), 9, None, 1) for i in range(40)] + [(None, "x", 9, None, 1), (41, None, 9, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, int(i % 4 == 1), "clash") for i in range(40)] + [(3, 1, ""), (None, 1, ""), (5, None, "")]
    chosen = toxicity.chosen_rows(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert Counter(r.toxic for r in chosen) == {1: 3, 0: 4} and all(r.doc_id % 2 for r in chosen)


def test_no_model_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "some words", 1, None, 1), (2, None, 1, None, 1)], SCHEMA)
    one = spark.createDataFrame([(1, 1, "")], LABELS)
    for labels in (one, one.limit(0)):
        model = toxicity.fit_toxicity(docs, labels)
        assert model is None
    assert [r["__toxic"] for r in toxicity.score_texts(docs, None).collect()] == [0.0, 0.0]
    assert toxicity.score_texts(docs.limit(0), None).count() == 0


def test_long_text_and_repeats(spark):
    rows = _corpus(3, 90)
    docs = spark.createDataFrame([(i, x, t, None, 1) for i, (x, t) in enumerate(rows)], SCHEMA)
    labels = spark.createDataFrame([(i, t, "clash") for i, (_, t) in enumerate(rows)], LABELS)
    model = toxicity.fit_toxicity(docs, labels)
    long = " ".join(x for x, t in rows if not t) * 100
    odd = spark.createDataFrame([(1, long, 5, [1], 2), (1, long + " idiot", 5, [1], 2), (1, long, 5, [1], 2)], SCHEMA)
    found = [r["__toxic"] for r in toxicity.score_texts(odd, model).collect()]
    assert found[0] == found[2] < 0.5 < found[1]
