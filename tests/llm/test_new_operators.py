"""First-fit packing, the filter audit and centroid clustering against plain versions, with nulls, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import audit, centroids, first_fit, queries

DOCS = "doc_id long, text string, lang string, draw double, length long, `group` long, word long, doc int, digest string"
LABELS = "doc_id long, quality int, toxic int, part string, good boolean"


def table(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


# ---- first-fit packing ------------------------------------------------------------------------------------------


def plain_first_fit(lengths, capacity):
    rooms, out = [], []
    for item, n in enumerate(lengths):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(capacity)
            out.append([])
            at = len(rooms) - 1
        rooms[at] -= n
        out[at].append(item)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tournament_is_first_fit(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 64) for _ in range(draw.randint(0, 300))]
    if seed % 2:
        lengths.sort(reverse=True)
    assert first_fit.first_fit(lengths, 64) == plain_first_fit(lengths, 64)


@pytest.mark.parametrize("seed", range(8))
def test_fill_up_pads_nothing(seed):
    draw = random.Random(seed)
    lengths = sorted((draw.randint(1, 63) for _ in range(draw.choice([0, 1, 2, 50, 300]))), reverse=True)
    placed = first_fit.first_fit(lengths, 64)
    parts = first_fit.fill_up([[(i, 0, lengths[i]) for i in one] for one in placed], 64)
    sizes = [sum(n for _, _, n in one) for one in parts]
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes) and sum(n < 64 for n in sizes) <= 6
    seen = defaultdict(list)
    for item, lo, n in itertools.chain(*parts):
        assert n > 0
        seen[item].append((lo, n))
    for i, length in enumerate(lengths):
        at = 0
        for lo, n in sorted(seen[i]):
            assert lo == at
            at += n
        assert at == length


def check_places(rows, texts, capacity):
    """All ids of all documents lie in one piece each, pieces lie side by side; `texts` counts (doc_id, text)."""
    tokenizer = Tokenizer.from_file(queries.vocabulary_path(queries.WORD_VOCABULARY))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    for key, copies in texts.items():
        wanted = Counter()
        for text in copies:
            ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
            wanted.update(range(len(ids)))
            if len(set(copies)) == 1:
                for r in by_doc[key]:
                    piece = ids[r.start : r.start + r.length]
                    assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(piece.tobytes())
        assert wanted == Counter(i for r in by_doc[key] for i in range(r.start, r.start + r.length))
    assert set(by_doc) == set(texts)
    return len(by_sequence)


def test_first_fit_packing(spark):
    draw = random.Random(5)
    words = ["alpha", "Beta", "the", "x1", "été", "日本", "gamma-ray", "it's"]
    some = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 5, 40, 200, 900]))) for _ in range(60)]
    rows = [(i, x) for i, x in enumerate([None, "", " \n", "x" * 5000, "a b " * 30_000, *some])]
    rows += [rows[7]] * 4 + [(None, "no id"), (None, "no id"), (None, None), (3, "another text of one id")]
    docs = table(spark, rows).repartition(4)
    texts = defaultdict(list)
    for key, x in rows:
        texts[key].append(x)
    path = queries.vocabulary_path(queries.WORD_VOCABULARY)
    for group_rows, capacity in ((4096, 2048), (8, 2048), (16, 64)):
        got = first_fit.pack_first_fit(docs, path, capacity, group_rows=group_rows).collect()
        check_places(got, texts, capacity)
    assert first_fit.pack_first_fit(docs.limit(0), path).count() == 0


def test_first_fit_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op11_first_fit_packing(spark, folder).collect()
    texts = defaultdict(list)
    for r in docs:
        texts[r.doc_id].append(r.text)
    total = sum(r.length for r in rows)
    assert check_places(rows, texts, 2048) <= -(-total // 2048) + 11


# ---- filter audit -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1000])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    plain = [sum(int(w) >> b & 1 for w in words) for b in range(32)]
    assert audit.positional_popcount(words).tolist() == plain


def plain_audit(docs, labels):
    first, good, toxic = {}, set(), set()
    for key, x, _ in docs:
        if key is not None:
            first[x or ""] = min(key, first.get(x or "", key))
    for key, q, t in labels:
        good |= {key} if q == 1 and key is not None else set()
        toxic |= {key} if t == 1 and key is not None else set()
    items = defaultdict(list)
    for key, x, lang in docs:
        x = x or ""
        w = [v for v in re.split(r"[\x20\x09-\x0D]+", x) if v]
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in x) > 3 * len(x)) + "D" * any(c in "#$%&*|" for c in x)
        fails += "E" * (key is not None and key > first[x])
        items[lang or ""].append((set(fails), key in good, key in toxic))
    out = set()
    for part, rows in items.items():
        counts, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                here = [r for r in rows if f in r[0] and not r[0] & set(order[: step - 1])]
                shapley[f] += len(here)
                failing = sum(f in r[0] for r in rows)
                kept = sum(not r[0] & set(order[:step]) for r in rows)
                unique = sum(r[0] == {f} for r in rows)
                lost = sum(r[1] for r in here), sum(r[2] for r in here)
                counts.append((part, "".join(order), step, kept, len(here), failing - len(here), unique, *lost))
        out |= {(*c, shapley[c[1][c[2] - 1]]) for c in counts}
    return out


def test_filter_audit(spark):
    draw = random.Random(2)
    texts = [None, "", " ", "one", "A#", "UPPER CASE", "the " * 250, "W%d " * 220]
    texts += [" ".join(f"w{draw.randint(0, 400)}" for _ in range(draw.choice([150, 199, 200, 260]))) for _ in range(12)]
    texts += [" ".join(["Xy"] * n + [f"w{i}" for i in range(n)]) for n in (99, 100, 101)]
    docs = [(i, draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in range(160)]
    docs += [(None, draw.choice(texts), "en") for _ in range(12)] + [docs[3], docs[3], (200, "the " * 250, "only")]
    docs += [(200 + i, "copied text", "en") for i in range(60)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 240, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got = audit.audit_filters(table(spark, docs).repartition(5), table(spark, labels, LABELS))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_audit(docs, labels)
    assert audit.audit_filters(table(spark, []), table(spark, labels, LABELS)).count() == 0
    bare = audit.audit_filters(table(spark, docs), table(spark, [], LABELS))
    assert bare.where("good_lost + toxic_lost <> 0").count() == 0


def test_parts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS", 3)
    batch = [(f"p{i % 20}", audit.ALL if i % 2 else 1, i % 3 == 0, False) for i in range(300)]
    words = spark.createDataFrame(batch, "part string, word long, good boolean, toxic boolean").repartition(3)
    left = {r.part: r.left for r in audit.subset_survivors(words).collect()}
    assert len(left) == 20 and sum(x[0].n for x in left.values()) == 300 and sum(x[31].n for x in left.values()) == 150
    assert sum(x[0].good for x in left.values()) == 100


# ---- centroid clustering ----------------------------------------------------------------------------------------


def plain_clusters(rows, clusters, rounds):
    kept = []
    for key, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x):
            kept.append((key, [int(np.floor(64 * float(np.float32(v)))) for v in x]))
    digest = lambda k: hashlib.sha256(f"1:{k}".encode()).hexdigest()
    start = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]) if r[0] is not None else "", r[1]))
    middle = [v for _, v in start[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(middle))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for k, own in groups.items():
            middle[k] = [sum(col) // len(own) for col in zip(*own)]
    found = [(key, *near(v)) for key, v in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    total = sum(inertia.values())
    return Counter((key, k, d, inertia[k], total, tuple(middle[k])) for key, d, k in found)


VECTORS = "vec_id long, embedding array<float>, label int, key long, v int, cluster string, distance int"


@pytest.mark.parametrize("clusters,seed", [(4, 0), (16, 1), (80, 2)])
def test_clusters(spark, clusters, seed):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.normal(0, 1, 64).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(25)] + [rows[1], rows[1], (None, rows[2][1]), (None, [0.5] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [float("nan")] * 64)]
    rows += [(205, [float("inf")] + [0.0] * 63), (206, [0.0] * 64)]
    df = table(spark, rows, VECTORS).repartition(4)
    got = centroids.cluster_vectors(df, clusters=clusters).collect()
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia")
    assert Counter((*(r[n] for n in names), tuple(r.centroid)) for r in got) == plain_clusters(rows, clusters, 3)


def test_clusters_of_nothing(spark):
    empty = table(spark, [(1, None), (2, [1.0])], VECTORS)
    assert centroids.cluster_vectors(empty).count() == 0
    huge = table(spark, [(1, [1e30] * 64), (2, [1.0] * 64)], VECTORS)
    assert [r.vec_id for r in centroids.cluster_vectors(huge).collect()] == [2]
    few = table(spark, [(1, [1.0] * 64), (2, [1.0] * 64), (3, [1.0] * 64)], VECTORS)
    assert {r.cluster for r in centroids.cluster_vectors(few).collect()} == {0}


def test_centroid_print(spark):
    row = spark.range(1).select(centroids.centroid_print(F.array(F.lit(-3), F.lit(20))).alias("p")).first()
    assert row.p == hashlib.sha256(b"-3,20").hexdigest()
