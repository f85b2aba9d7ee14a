"""The operators against brute force on small fixtures with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import bpe, language, lines, near, packing, personal, queries, sharding, spots, toxicity, vectors
from tabloom.llm.components import components
from tabloom.llm.pretokens import Known

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, pos int, rank int, h1 long"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    words = ["alpha", "beta", "the", "of", "Gamma", "delta", "and", "omega", "x1", "Zeta", "kappa", "io"]
    base = [" ".join(draw.choice(words) + str(draw.randint(0, 30)) for _ in range(60)) for _ in range(12)]
    out = [None, "", " ", "\n\n", "one", "One two", base[0], base[0], "é" * 50, "z" * 3000, "日本 語"]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[draw.randrange(len(w))] = "edit%d" % draw.randint(0, 99)
            out.append(" ".join(w) + draw.choice(["", "\nAll rights  ", "\n all RIGHTS\nmore"]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, x, "en", "s", None, "clash", 1, 2, 3) for i, x in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], (None, "no id", None, None, None, "", 0, 0, 0)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards(docs, empty, texts):
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == len(texts) + 2 and sharding.assign_shards(empty).count() == 0
    for r in rows:
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    by = Counter(r.shard for r in rows)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in by.items())
    crc = {r.doc_id: (r.text_crc32, r["size"]) for r in rows if r.doc_id is not None}
    for i, x in enumerate(texts):
        assert crc[i] == (zlib.crc32((x or "").encode()), len((x or "").encode()) + 1)


def test_jump_moves_only_into_new_shard():
    keys = np.arange(-5000, 5000, dtype=np.int64) * 7919
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(b[a != b]) == {16} and 300 < (a != b).sum() < 900


def test_bpe_equals_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path(queries.BYTE_VOCABULARY)
    library = Tokenizer.from_file(path)
    odd = ["don't we'll 'tis \"'s", " \n a  b ", "<|endoftext|> x", "½² 12", "\x1c\x85 ", "a  b   "]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(900 + i, x) for i, x in enumerate(odd)], "a long, b string"))
    want = {r.doc_id: r.text or "" for r in table.collect()}
    for r in bpe.encode_documents(table, path).collect():
        ids = library.encode(want[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == want[r.doc_id]
    assert bpe.encode_documents(empty, path).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path(queries.WORD_VOCABULARY)
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=64).collect()
    places, total = {}, 0
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    least = max(total / 64, sum(r.length > 32 for r in rows))  # pieces over half the capacity need one each
    assert len(places) <= 11 / 9 * least + 1
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        ids = [*library.encode(want[r.doc_id], add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == r.ids_crc32
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines(spark, docs, empty, keep_first):
    many = spark.range(300).select(
        (F.col("id") + 1000).alias("doc_id"),
        F.concat(F.lit("Hot line\nown "), F.col("id"), F.lit("\n hot LINE \n\nx "), F.col("id") % 40).alias("text"),
    )
    table = docs.select("doc_id", "text").union(many)
    source = sorted({(r.doc_id, r.text) for r in table.collect()}, key=lambda r: (r[0] is None, r[0] or 0))
    key = lambda x: x.strip(" \t\n\v\f\r").encode().lower()
    count = Counter(k for _, x in source for k in {key(y) for y in (x or "").split("\n")})
    want, seen = {}, set()
    for i, x in source:
        kept = []
        for y in (x or "").split("\n"):
            k = key(y)
            if not k or count[k] < 5 or (keep_first and k not in seen):
                kept.append(y)
            seen.add(k)
        want[i] = "\n".join(kept) if x is not None else None
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    got = lines.drop_repeated_lines(table, min_docs=5, keep_first=keep_first).select("doc_id", "__kept.text").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.doc_id: r.text for r in got} == want
    assert lines.drop_repeated_lines(empty).count() == 0


def brute_components(rows, size):
    sets = {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("long", [64, 2])
def test_near_duplicates(docs, empty, texts, monkeypatch, long):
    monkeypatch.setattr(near, "LONG", long)
    want = brute_components(list(enumerate(texts)), 4)
    got = near.named(near.near_duplicates(docs, 4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert near.near_duplicates(empty, 4).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_language(spark, empty):
    draw = random.Random(1)
    parts = {"en": ["the", "ing", "th", "and"], "de": ["sch", "ung", "ein", "ß"]}
    rows = [(i, " ".join(draw.choice(parts[k]) for _ in range(9)), k) for i in range(200) for k in parts]
    rows = [(n, x, k) for n, (_, x, k) in enumerate(rows)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(labelled.where("doc_id % 4 <> 2"))
    more = spark.createDataFrame([(9000, None, None), (9001, "12 !", None), (9002, "", None)], labelled.schema)
    table = labelled.union(more).withColumn("held_out", F.col("doc_id") % 4 == 2)
    got = {r.doc_id: r for r in language.predict_languages(table, model).collect()}
    assert all(got[n].lang_pred == k and 0.5 < got[n].score <= 1 for n, _, k in rows)
    assert all(got[n].lang_pred == "und" for n in (9000, 9001, 9002))
    none = language.fit_languages(empty)
    assert {r.lang_pred for r in language.predict_languages(table, none).collect()} == {"und"}


def test_toxicity_tolerates_gaps(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("aeinrst") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(300):
        w = [draw.choice(words) for _ in range(20)]
        if i % 3 == 0:
            w[5] = draw.choice(["scoundrel", "wretch", "buffoon"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    probe = ["buffoon", "a b.u.f.f.o.o.n b", "b u f f o o n", "wre7ch", "scoundrrel", " ".join(words[:50]), "", None]
    scores = [model.score(m) for m in model.margins(probe, Known(dtype=np.float64))]
    assert min(scores[:5]) > 0.5 > max(scores[5:])
    scored = toxicity.score_texts(docs, model).collect()
    assert sum((r["__toxic"] >= 0.5) == r.toxic for r in scored) >= 297
    assert toxicity.fit_toxicity(docs.limit(0), docs.limit(0)) is None
    assert {r["__toxic"] for r in toxicity.score_texts(docs, None).collect()} == {0.0}


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 300)
    draw = np.random.default_rng(4)
    points = draw.normal(size=(900, 16))
    points[200:500] = points[200]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    bad = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] + [1.0] * 15), (1300, [None] + [1.0] * 15), (1400, [])]
    table = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>")
    got = vectors.nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect()
    hit = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert np.allclose([r.score for r in mine], d[[r.vec_id for r in mine]])
        hit += len({r.vec_id for r in mine} & set(want))
    assert hit >= 81 and {r.query_id for r in got} == set(range(0, 900, 100))
    assert vectors.nearest_neighbours(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_fingerprints(docs, empty, texts):
    rows = spots.fingerprint_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    by = {r.doc_id: r for r in rows}
    for i, x in enumerate(texts):
        x, after = x or "", texts[(i + 1) % len(texts)] or ""
        half = len(x) // 2
        assert by[i].n_chars == len(x) and by[i].edited == x[: len(x) - half] + after[:half]
    assert by[6].signatures == by[7].signatures
    assert spots.fingerprint_documents(docs).count() == docs.count() and spots.fingerprint_documents(empty).count() == 0


def test_successors_in_groups(spark, monkeypatch):
    monkeypatch.setattr(spots, "FEW", 3)
    keys = sorted({0, 1, 5, 600, 601, 1 << 40, (1 << 40) + 7, -9, 5000})
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    assert {r["key"]: r["next"] for r in spots.successors(table).collect()} == dict(zip(keys, [*keys[1:], None]))


def test_similar_prints(spark):
    draw = random.Random(5)
    sets = []
    for _ in range(15):
        base = {draw.randint(0, 400) for _ in range(40)}
        for _ in range(4):
            s = set(base)
            for _ in range(draw.randint(0, 8)):
                s.add(draw.randint(401, 900))
            sets.append(sorted(s))
    sets = [list(t) for t in dict.fromkeys(map(tuple, sets))]
    table = spark.createDataFrame(list(enumerate(sets)), "id long, signatures array<int>")
    want = {
        (a, b)
        for a in range(len(sets))
        for b in range(a + 1, len(sets))
        if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    }
    assert {(r.a, r.b) for r in spots.similar_pairs(table).collect()} == want and want


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def base_spans(x):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, x):
            n = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(n) <= 19 and luhn(n),
                "phone": 10 <= len(n) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data(spark, empty):
    draw = random.Random(6)
    bits = ["a@b.c", "x_a@b.c-d.e_y@f.g", "1.2.3.4", "256.1.1.1", "0010.2.3.4.5", "4111 1111 1111 1111", "4111-1111 11111111"]
    bits += ["+1 (555) 010-9999", "+12", "é", "@", "12", " ", ".", "-", "+", "77777777777777777777777", "日"]
    texts = ["".join(draw.choice(bits) + draw.choice(["", " ", "", "\n"]) for _ in range(12)) for _ in range(300)]
    texts += [None, "", "9" * 20000, "a." * 20000]
    rows = list(enumerate(texts))
    table = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    for r in personal.find_personal_data(table).collect():
        x = texts[r.doc_id] or ""
        assert [tuple(s) for s in r.base] == base_spans(x)
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert personal.find_personal_data(empty).count() == 0


def test_addresses_with_zero_parts(spark):
    bits = ["10.0.0.1", "192.168.0.1", "0.1.2.3", "0.0.0.0", "000.00.0.0", "0255.1.1.1", "255.255.255.0", "0256.0.0.0", "10.0.0.256"]
    bits += ["8.8.8.8", "010.1.1.1", "10.0.0", "1.0.0.300", "10..0.0.1"]
    texts = [*bits, " ".join(bits), "é at 10.0.0.1, then 0.0.0.0."]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = personal.find_personal_data(table)
    spans = {r.doc_id: [tuple(s) for s in r.base] for r in found.select("doc_id", "base").collect()}
    assert spans == {i: base_spans(x) for i, x in enumerate(texts)}
    assert [len(spans[i]) for i in range(len(bits))] == [1] * 7 + [0] * 2 + [1] * 2 + [0] * 3
    masked = table.join(found.select("doc_id", "base"), "doc_id").select("doc_id", personal.mask(F.col("text"), F.col("base")).alias("m"))
    assert {r.doc_id: r.m for r in masked.collect()}[len(texts) - 1] == "é at [IP], then [IP]."


def test_contexts_find_unseen(spark):
    rows = [(i, f"seen badge user{i}@mail.example x") for i in range(30)] + [(99, "seen badge AB-7731-C, and page 12345678 x")]
    found = personal.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: [s.kind for s in r.spans] for r in found.collect()}[99] == ["context"]


def test_mask(spark):
    table = spark.createDataFrame([(1, "é mail a@b.c, +1 555 010 9999 end")], "doc_id long, text string")
    found = personal.find_personal_data(table).select("doc_id", "spans")
    masked = table.join(found, "doc_id").select(personal.mask(F.col("text"), F.col("spans")).alias("m")).first().m
    assert masked == "é mail [EMAIL], [PHONE] end"


def test_shards_keep_texts_out_of_python(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(sharding, "pin", lambda df: stored.append(df) or df)
    docs = spark.createDataFrame([(1, "abc"), (2, None), (None, "x")], "doc_id bigint, text string")
    assert sharding.assign_shards(docs).count() == 3

    def below_python(plan):
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        own = [c.output().mkString(",") for c in children] if "Python" in plan.nodeName() or "InArrow" in plan.nodeName() else []
        return own + [x for c in children for x in below_python(c)]

    inputs = below_python(stored[0]._jdf.queryExecution().optimizedPlan())
    assert inputs and not any("text#" in columns for columns in inputs)
