"""The registered queries of the operators; each digest is derived from its operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(folds: int) -> Column:
    """Checksum of the id modulo `folds`; a null id has none and counts as -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.language import fit_languages, predict_languages

    docs = table(spark, folder, "documents")
    model = fit_languages(docs.where(remainder(4).between(0, 1) | (remainder(4) == 3)))
    return predict_languages(docs.withColumn("held_out", remainder(4) == 2), model)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.toxicity import fit_toxicity, score_texts

    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, table(spark, folder, "labels").where(remainder(5) > 0))
    score = F.col("__toxic")
    return score_texts(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (remainder(5) == 0).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )


def op2_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.spots import fingerprint_documents, likeness, printed

    return fingerprint_documents(table(spark, folder, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed("signatures").alias("fingerprint"),
        printed("edited_signatures").alias("edited_fingerprint"),
        likeness("signatures", "edited_signatures").alias("near_edited"),
        likeness("signatures", "next_signatures").alias("near_next"),
    )


def op3_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.personal import KINDS, find_personal_data, listed, of_kind

    found = find_personal_data(table(spark, folder, "documents"))
    counts = [
        F.size(F.filter("base", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op4_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.sharding import assign_shards

    return assign_shards(table(spark, folder, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.near import named, near_duplicates

    return named(near_duplicates(table(spark, folder, "documents"), words=4))


NEAR_DEDUP_SQL = """
with recursive words as (
    select doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [w]
                        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) end as s
    from words
), items as materialized (
    select doc_id, len(s) as n, unnest(s) as shingle from sets
), pairs as materialized (
    select a.doc_id as a, b.doc_id as b
    from items a join items b on a.shingle = b.shingle and a.doc_id < b.doc_id
    where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges as materialized (
    select a, b from pairs union all select b, a from pairs
), reach as (
    select doc_id, doc_id as other from documents
    union
    select r.doc_id, e.b from reach r join edges e on r.other = e.a
)
select s.doc_id, len(s.s) as n_shingles, min(r.other) as component_id, s.doc_id = min(r.other) as kept
from sets s join reach r on s.doc_id = r.doc_id
group by s.doc_id, len(s.s)
"""


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.packing import pack

    return pack(table(spark, folder, "documents"), vocabulary_path(WORD_VOCABULARY))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.lines import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, folder, "documents"))
    return kept.select(
        "doc_id",
        F.col("__kept.n_lines"),
        F.col("__kept.n_dropped"),
        F.sha2(F.coalesce(F.col("__kept.text"), F.lit("")), 256).alias("kept_sha256"),
    )


LINE_DEDUP_SQL = """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
), keyed as (
    select doc_id, pos, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), common as (
    select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10
), marked as (
    select k.*, c.key is not null as gone from keyed k left join common c using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op9_pruned_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.vectors import nearest_neighbours

    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.bpe import encode_documents

    docs = table(spark, folder, "documents")
    return encode_documents(docs, vocabulary_path(BYTE_VOCABULARY), keep_ids=False)


def op11_first_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.first_fit import pack_first_fit

    return pack_first_fit(table(spark, folder, "documents"), vocabulary_path(WORD_VOCABULARY))


def op12_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.audit import audit_filters

    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


FILTER_AUDIT_SQL = """
with texts as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents
), words as (
    select *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from texts
), earliest as (
    select text, min(doc_id) as first from texts group by text
), marked as (
    select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), failing as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
           [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] as fails
    from words join earliest using (text) left join marked using (doc_id)
), kinds as (
    select part, good, toxic, fails, count(*) as n from failing group by all
), letters(letter, i) as (
    values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)
), orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.i, b.i, c.i, d.i, e.i] as filters
    from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps as (
    select filter_order, step::int as step, filters[step] as own, filters[1:step - 1] as earlier
    from orders, range(1, 6) s(step)
), seen as (
    select part, good, toxic, n, filter_order, step, own, fails[own] as failed,
           len(list_filter(earlier, lambda i: fails[i])) > 0 as gone, len(list_filter(fails, lambda f: f)) = 1 as lone
    from kinds, steps
), counted as (
    select part, filter_order, step, own,
           coalesce(sum(n) filter (not failed and not gone), 0)::bigint as kept,
           coalesce(sum(n) filter (failed and not gone), 0)::bigint as removed,
           coalesce(sum(n) filter (failed and gone), 0)::bigint as redundant,
           coalesce(sum(n) filter (failed and lone), 0)::bigint as unique_fails,
           coalesce(sum(n) filter (failed and not gone and good), 0)::bigint as good_lost,
           coalesce(sum(n) filter (failed and not gone and toxic), 0)::bigint as toxic_lost
    from seen group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from counted
"""


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    from tabloom.llm.centroids import centroid_print, cluster_vectors

    found = cluster_vectors(table(spark, folder, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_print(F.col("centroid")).alias("centroid_sha256")
    )


def _centroid_sql(rounds: int) -> str:
    """The rounds written out: assignment to the nearest centroid, then floors of means."""
    near = """near{r} as materialized (
    select vec_id, v, arg_min(k, (d, k)) as k, min(d) as d from (
        select vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
        from vectors, centroids{r}
    ) group by vec_id, v
)"""
    move = """sums{r} as (
    select k, i, sum(x)::hugeint as s, count(*) as n
    from (select k, unnest(v) as x, generate_subscripts(v, 1) as i from near{r}) group by k, i
), centroids{q} as materialized (
    select o.k, coalesce(m.c, o.c) as c from centroids{r} o left join (
        select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from sums{r} group by k
    ) m using (k)
)"""
    parts = [p.format(r=r, q=r + 1) for r in range(rounds) for p in (near, move)]
    return f"""
with vectors as materialized (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), centroids0 as materialized (
    select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, v as c
    from vectors order by sha256('1:' || vec_id) limit 16
), {", ".join(parts)}, {near.format(r=rounds)}
select vec_id, n.k::int as cluster, d as distance, (sum(d) over (partition by n.k))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from near{rounds} n join centroids{rounds} c on n.k = c.k
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_spot_signatures,
        op3_contextual_pii,
        op4_jump_sharding,
        op5_minhash_near_dedup,
        op6_toxicity,
        op7_best_fit_packing,
        op8_line_dedup,
        op9_pruned_graph_search,
        op10_bpe_round_trip,
        op11_first_fit_packing,
        op12_filter_interaction_audit,
        op13_centroid_clustering,
    )
}
SQL: dict[str, str] = {
    "op5_minhash_near_dedup": NEAR_DEDUP_SQL,
    "op8_line_dedup": LINE_DEDUP_SQL,
    "op12_filter_interaction_audit": FILTER_AUDIT_SQL,
    "op13_centroid_clustering": _centroid_sql(3),
}
