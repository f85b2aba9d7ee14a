"""Operator 6: toxicity by a support vector machine on a string subsequence kernel with Nystroem landmarks.

The kernel compares words by their subsequences of three letters within a span of six, each weighted by a decay to the
power of its span, so letters put in between change little; signs inside a word are left out, digits count as the
letters they imitate, letters spaced out one by one are read as one word. The kernel is normalised. The machine is
linear in the kernel values to the landmarks, whitened by their kernel matrix; its sum over landmarks is folded into
one weight for each subsequence, which gives the same decision for each word at the cost of its own subsequences.

Labels are given for documents, and an item of the machine is one word: the score of a document is that of its worst
word. Training picks in toxic documents witness words, first those that stand significantly more often there, weighted
by the documents they stand in, then, in documents without one, the worst word by the machine itself; counterexamples
are random clean words and, round by round, the worst words of clean documents. Scores are calibrated by a logistic
curve. The fit is one task over at most `FIT_TOXIC` and `FIT_CLEAN` labelled rows, chosen by
hash among those of at most `FIT_CHARS` characters; nothing of the sample comes to the driver.

Null and empty texts score as texts without any word, near 0. Without rows of both labels all scores are 0. Characters
beyond Latin-1 share one letter. Repeated rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.arrays import chunks, flatten, span_hashes, words
from tabloom.llm.pretokens import Known

FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 1200, 2400, 20_000
LANDMARKS = 256
#: Rounds of the fit; clean words drawn at random and, in each round, the clean words with the largest margins that
#: join them; witness words used, the most frequent ones first.
ROUNDS, CLEAN_WORDS, HARD_WORDS, WITNESSES = 5, 6000, 2000, 1500
#: Weight of all witnesses together against all clean words, and of a witness with a letter put in against itself. A
#: clean document has hundreds of words and none of them may look toxic, so clean words weigh most.
TOXIC_SHARE, STRETCHED = 0.1, 0.3
#: Words, dense rows and rows of the machine that are worked on at once.
WORDS, ROWS, BLOCK = 4_000, 150, 2048
DECAY = 0.7
SPAN = 6
EDGE, FOREIGN = 31, 30
#: Words with a log-likelihood ratio above this that stand in toxic documents this many times as often as in clean ones
#: are witnesses at once. Without the second figure a common word that is a little more frequent there would be one.
EVIDENCE, LIFT = 9.0, 5
_BITS = 5
#: Letters with marks: those on e, on other vowels, and the rest are one letter each.
_MARKED = {27: "èéêë", 28: "àáâãäåìíîïòóôõöøùúûüýÿæ", 29: "çñßðþ"}
#: Signs that stand in for letters.
_FOLD = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_LETTERS = np.zeros(256, dtype=np.int64)
for _c in range(256):
    _x = _FOLD.get(chr(_c), chr(_c))
    _LETTERS[_c] = ord(_x) - 96 if "a" <= _x <= "z" else FOREIGN if _x == "?" else 0
for _code, _set in _MARKED.items():
    _LETTERS[[ord(_x) for _x in _set]] = _code


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of one byte a character, starts and ends of words, and the text of each word."""
    raw = [x.lower().replace("?", " ").encode("latin-1", "replace") for x in texts]
    buf, starts = flatten(raw)
    s, e = words(buf)
    owner = np.searchsorted(starts, s, "right") - 1
    lone = e - s == 1
    apart = np.ones(len(s), dtype=bool)
    apart[1:] = (owner[1:] != owner[:-1]) | ~lone[:-1]
    first = np.flatnonzero(lone & apart)
    behind = np.append(apart[1:], True)
    behind[:-1] |= ~lone[1:]
    last = np.flatnonzero(lone & behind)
    first, last = first[last - first >= 3], last[last - first >= 3]
    s, e = np.concatenate((s, s[first])), np.concatenate((e, e[last]))
    return buf, s, e, np.concatenate((owner, owner[first]))


def subsequences(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, code and weight of all distinct subsequences of each word."""
    size = e - s
    word = np.repeat(np.arange(len(s)), size)
    at = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    letter = _LETTERS[buf[at]]
    keep = letter > 0
    word, letter = word[keep], letter[keep]
    n = np.bincount(word, minlength=len(s)) + 2
    end = np.cumsum(n)
    line = np.full(int(end[-1]) if len(s) else 0, EDGE, dtype=np.int64)
    inner = np.ones(len(line), dtype=bool)
    inner[end - 1] = inner[end - n] = False
    line[inner] = letter
    owner = np.repeat(np.arange(len(s)), n)
    keys, weights = [], []
    for b in range(2, SPAN):
        for a in range(1, b):
            i = np.flatnonzero(owner[: len(owner) - b] == owner[b:]) if len(owner) > b else np.zeros(0, dtype=np.int64)
            code = line[i] << 2 * _BITS | line[i + a] << _BITS | line[i + b]
            keys.append(owner[i] << 3 * _BITS | code)
            weights.append(np.full(len(i), DECAY**b))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(back, weights=np.concatenate(weights), minlength=len(key))
    return key >> 3 * _BITS, key & ((1 << 3 * _BITS) - 1), weight


def _dense(items: list[str]) -> np.ndarray:
    """Normalised subsequence vectors of a bounded list of words."""
    buf, starts = flatten([x.encode("latin-1", "replace") for x in items])
    word, code, weight = subsequences(buf, starts[:-1], starts[1:] - 1)
    out = np.zeros((len(items), 1 << 3 * _BITS), dtype=np.float32)
    out[word, code] = weight
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


class ToxicityModel:
    """One weight a subsequence, a bias, and the slope and offset of the logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def word_margins(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Margins of words, a bounded number at a time."""
        blocks = range(0, len(s), WORDS)
        return np.concatenate([np.zeros(0), *(self._margins(buf, s[i : i + WORDS], e[i : i + WORDS]) for i in blocks)])

    def _margins(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        word, code, weight = subsequences(buf, s, e)
        norm = np.sqrt(np.bincount(word, weights=weight**2, minlength=len(s)))
        dot = np.bincount(word, weights=weight * self.weights[code], minlength=len(s))
        return np.where(norm > 0, dot / np.maximum(norm, 1e-9), 0.0) + self.bias

    def margins(self, texts: list[str | None], known: Known) -> Iterator[float]:
        """Margin of the worst word of each text; the bias for texts without words."""
        for lo, hi in chunks(texts):
            part = [x or "" for x in texts[lo:hi]]
            buf, s, e, owner = word_spans(part)
            worst = np.full(len(part), self.bias)
            if len(s):
                hashes, first, back = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
                if known.full:
                    known.clear()
                row = known.rows(hashes)
                new = np.flatnonzero(row < 0)
                if new.size:
                    found = self.word_margins(buf, s[first[new]], e[first[new]])
                    known.add(hashes[new], found, np.ones(len(new), dtype=np.int64))
                    row = known.rows(hashes)
                np.maximum.at(worst, owner, known.pool[known.offset[row]][back])
            yield from worst.tolist()

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def _machine(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the rows inside the margin.

    Rows are taken in blocks, so a step needs little memory besides them.
    """
    size = x.shape[1] + 1
    penalty = np.diag(np.append(np.full(size - 1, ridge), 1e-9))
    w, before = np.zeros(size), None
    for _ in range(30):
        inside = y * (x @ w[:-1] + w[-1]) < 1
        if before is not None and (inside == before).all():
            break
        left, right = penalty.copy(), np.zeros(size)
        for lo in range(0, len(x), BLOCK):
            rows = lo + np.flatnonzero(inside[lo : lo + BLOCK])
            part = np.column_stack((x[rows], np.ones(len(rows))))
            left += (part.T * share[rows]) @ part
            right += part.T @ (share[rows] * y[rows])
        target = np.linalg.solve(left, right)
        w, before = (w + target) / 2 if before is not None else target, inside
    return w[:-1], float(w[-1])


def _curve(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a light damping."""
    x, at = np.column_stack((margin, np.ones(len(margin)))), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        bend = (x.T * (p * (1 - p) + 1e-6)) @ x / len(x) + np.diag([1e-4, 0.0])
        at = at - np.linalg.solve(bend, x.T @ (p - target) / len(x) + np.array([1e-4 * at[0], 0.0]))
    return float(at[0]), float(at[1])


def _stretched(word: str, draw: np.random.Generator) -> str:
    """The word with one letter put in."""
    at = int(draw.integers(1, max(2, len(word))))
    return word[:at] + chr(97 + int(draw.integers(26))) + word[at:]


def _flat(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, starts = flatten([w.encode("latin-1", "replace") for w in items])
    return buf, starts[:-1], starts[1:] - 1


def _witnesses(bad: list[set[str]], in_bad: Counter, in_good: Counter, share: float) -> dict[str, int]:
    """Words that stand significantly and several times more often in toxic documents, with their counts there;
    where there are none, the most telling word of each toxic document."""

    def evidence(w: str) -> float:
        k, n = in_bad[w], in_bad[w] + in_good.get(w, 0)
        if k * (1 - share) <= LIFT * (n - k) * share:
            return 0.0
        rest = (n - k) * np.log((n - k) / (n * (1 - share))) if n > k else 0.0
        return k * np.log(k / (n * share)) + rest

    certain = {w: in_bad[w] for w in in_bad if evidence(w) > EVIDENCE}
    return certain or dict(Counter(max(b, key=lambda w: (evidence(w), w)) for b in bad))


def _fit(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS) -> ToxicityModel:
    bags, same = [], {}
    for x in texts:
        buf, s, e, _ = word_spans([x])
        found = {buf[a:b].tobytes().decode("latin-1") for a, b in zip(s.tolist(), e.tolist())}
        bags.append({same.setdefault(w, w) for w in found})  # each word is held once
    bad, good = ([b for b, t in zip(bags, toxic) if b and t == value] for value in (1, 0))
    in_bad, in_good = Counter(w for b in bad for w in b), Counter(w for b in good for w in b)
    witness = _witnesses(bad, in_bad, in_good, len(bad) / max(len(bad) + len(good), 1))
    draw = np.random.default_rng(11)
    clean, of_bad = sorted(in_good), sorted(in_bad)
    sample = [clean[i] for i in draw.permutation(len(clean))[:CLEAN_WORDS]]
    against, hard = [w for w in sample if w not in witness], []
    flat_clean, flat_bad = _flat(clean), _flat(of_bad)
    model = ToxicityModel(np.zeros(1 << 3 * _BITS), -1.0)
    for _ in range(ROUNDS if witness else 0):
        first = sorted(witness, key=lambda w: (-witness[w], w))[:WITNESSES]
        marks = list(dict.fromkeys(first[: landmarks // 2] + hard[: landmarks // 4] + sample[:landmarks]))[:landmarks]
        base = _dense(marks)
        values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
        white = vectors / np.sqrt(np.maximum(values, 1e-3))
        items = first + [_stretched(w, draw) for w in first] + against
        y = np.where(np.arange(len(items)) < 2 * len(first), 1.0, -1.0)
        often = np.array([witness[w] for w in first], dtype=float)
        share = np.concatenate((often, STRETCHED * often, np.ones(len(against))))
        for side, part in ((1, TOXIC_SHARE), (-1, 1 - TOXIC_SHARE)):
            share[y == side] *= part / max(share[y == side].sum(), 1e-9)
        x = np.vstack([(_dense(items[i : i + ROWS]) @ base.T) @ white for i in range(0, len(items), ROWS)])
        w, b = _machine(x, y, share)
        model = ToxicityModel((base.T @ (white @ w)).astype(np.float64), b)
        margin = model.word_margins(*flat_clean)
        hard = [clean[i] for i in np.argsort(-margin, kind="stable")[:HARD_WORDS]]
        taken = set(against)
        against += [v for v in hard if v not in taken and v not in witness]
        # Toxic documents without a witness give their worst word if no clean word is as bad.
        worst = dict(zip(of_bad, model.word_margins(*flat_bad)))
        more = Counter(max(b, key=lambda v: (worst[v], v)) for b in bad if witness.keys().isdisjoint(b))
        witness |= {v: n for v, n in more.items() if v not in in_good and worst[v] > margin.max(initial=0.0)}
    margins = np.array(list(model.margins(texts, Known(dtype=np.float64))))
    model.slope, model.offset = _curve(margins, toxic.astype(float))
    return model


def chosen_rows(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and toxic of the rows to fit on: of each label those with the smallest hashes among the usable ones."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.where(F.length(text).between(1, FIT_CHARS)).select("doc_id").distinct().join(known, "doc_id")
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    most = ((1, FIT_TOXIC), (0, FIT_CLEAN))
    toxic, clean = (usable.where(F.col("toxic") == value).orderBy(*order).limit(n) for value, n in most)
    return toxic.unionByName(clean)


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> ToxicityModel | None:
    """A model from the texts of `docs` and the column toxic of `labels`; null without both kinds of rows.

    The fit is one task on an executor over at most `FIT_TOXIC` + `FIT_CLEAN` rows; one row of weights comes back.
    """
    chosen = F.broadcast(chosen_rows(docs, labels, text))  # bounded by the sample sizes
    short = docs.where(F.length(text).between(1, FIT_CHARS)).select("doc_id", F.col(text).alias("text"))
    sample = short.join(chosen, "doc_id").select("doc_id", "text", "toxic")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted({r for frame in frames for r in zip(frame["doc_id"], frame["text"], frame["toxic"])})
        toxic = np.array([t for _, _, t in rows], dtype=np.int64)
        if 0 < toxic.sum() < len(rows):
            model = _fit([x for _, x, _ in rows], toxic)
            figures = {"weights": [model.weights], "bias": model.bias, "slope": model.slope, "offset": model.offset}
            yield pd.DataFrame(figures)

    names = "weights array<double>, bias double, slope double, `offset` double"
    found = sample.repartition(1).mapInPandas(fit, names).collect()  # one row, one number a subsequence
    return ToxicityModel(np.array(found[0]["weights"]), *found[0][1:]) if found else None


def score_texts(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """All columns of `docs` and `__toxic`, a score from 0 to 1; texts stay in their partitions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a subsequence

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known(dtype=np.float64)
        for texts in batches:
            if shared.value is None:
                yield pd.Series(np.zeros(len(texts)))
            else:
                yield pd.Series([shared.value.score(m) for m in shared.value.margins(list(texts), known)])

    return docs.withColumn("__toxic", score(F.col(text)))
