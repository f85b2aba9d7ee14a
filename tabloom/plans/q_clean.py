"""Column roles, cleaning and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.fixed import IMAGE_PATTERN
from tabloom.operators import clean as C
from tabloom.operators import roles as R
from tabloom.plans.registry import query

UNION = "\nunion all "


@query(
    "c1_column_roles",
    """select 'doc_id' as "column", 'numeric' as role union all select 'n_chars', 'numeric'
       union all select 'text', case when 2 * count(distinct text) > count(*) then 'text' else 'categorical' end from documents
       union all select 'source', case when 2 * count(distinct source) > count(*) then 'text' else 'categorical' end from documents""",
)
def c1(t):
    return R.column_roles(t.documents, target="lang")


def _multimodal_sql(table: str, strings: list[str], others: list[str]) -> str:
    parts = []
    for c in strings + others:
        text = (
            f"(select avg(length(v)) from s) >= 25 or (select count(distinct {c}) from {table}) > greatest(20, (select count(*) // 2 from {table}))"
            if c in strings
            else "false"
        )
        parts.append(
            f"""select * from (with s as (select {c}::varchar as v from {table} where {c} is not null)
            select '{c}' as "column", case when (select avg(regexp_matches(lower(v), '{IMAGE_PATTERN}')::int) from s) >= 0.5 then 'image'
            when {text} then 'text' else 'other' end as role)"""
        )
    return UNION.join(parts)


@query(
    "c2_infer_multimodal_documents",
    _multimodal_sql("documents", ["text", "lang"], ["doc_id", "n_chars"]),
)
def c2_documents(t):
    return R.infer_multimodal(t.documents, "doc_id", target="source")


@query(
    "c2_infer_multimodal_pages",
    _multimodal_sql("(select page_id, url, html, url || '.PNG' as picture from pages)", ["url", "html", "picture"], ["page_id"]),
)
def c2_pages(t):
    return R.infer_multimodal(t.pages.withColumn("picture", F.concat("url", F.lit(".PNG"))), "page_id")


_TARGETS = [
    ("orders", "o_orderstatus", False),
    ("orders", "o_totalprice", True),
    ("labels", "quality", True),
    ("lineitem", "l_discount", True),
    ("lineitem", "l_linenumber", True),
    ("customer", "c_nationkey", True),
    ("events", "event_type", False),
]


def _problem_sql(rule: str) -> str:
    test = {
        "integral": "count(distinct {c}) <= 20 and bool_and({c}::double % 1 = 0)",
        "few_values": "count(distinct {c}) <= 20",
        "factor": "count(distinct {c}) < 20",
    }[rule]
    return UNION.join(
        f"select '{c}' as target, '{rule}' as rule, case when {test.format(c=c) if number else 'count(*) >= 0'} "
        f"then 'classification' else 'regression' end as problem_type from {table}"
        for table, c, number in _TARGETS
    )


def _problem(t, rule):
    out = None
    for table, c, _ in _TARGETS:
        one = R.detect_problem_type(getattr(t, table), c, rule)
        out = one if out is None else out.unionByName(one)
    return out


@query("c3_detect_problem_type", _problem_sql("integral"))
def c3(t):
    return _problem(t, "integral")


@query("c3_detect_problem_type_few_values", _problem_sql("few_values"))
def c3_few(t):
    return _problem(t, "few_values")


@query("c3_detect_problem_type_factor", _problem_sql("factor"))
def c3_factor(t):
    return _problem(t, "factor")


@query(
    "c5_ordered_unique",
    "select event_type as value, min(event_id) as first_position from events group by 1 order by 2",
)
def c5(t):
    return R.ordered_unique(t.events, "event_type", "event_id")


@query(
    "d1_drop_null_target",
    "select d.doc_id, d.lang, l.quality, l.toxic from documents d join labels l using (doc_id) where quality is not null",
)
def d1(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return C.drop_null_target(joined, ["quality", "toxic"])


HOLED_EVENTS_SQL = """holed as (select event_id, ts, case when event_type = 'view' then null else value end as value,
    nullif(event_type, 'signup') as event_type from events)"""


def holed_events(t):
    return t.events.select(
        "event_id",
        "ts",
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
        F.nullif("event_type", F.lit("signup")).alias("event_type"),
    )


@query(
    "d3_impute",
    f"""with {HOLED_EVENTS_SQL}, m as (select median(value) as med from holed where ts < timestamp '2024-01-20')
    select event_id, round(coalesce(value, med), 4) as value, coalesce(event_type, '') as event_type from holed, m""",
)
def d3(t):
    holed = holed_events(t)
    train = holed.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    imputer = C.Imputer.fit(train, target="event_id")
    return imputer.transform(holed).select("event_id", F.round("value", 4).alias("value"), "event_type")


@query(
    "d4_impute_or_zero",
    f"""with {HOLED_EVENTS_SQL}, m as (select median(value) as med from holed)
    select event_id, round(coalesce(value, med), 4) as value, 0.0::double as event_type, 0.0::double as void from holed, m""",
)
def d4(t):
    holed = holed_events(t).drop("ts").withColumn("void", F.lit(None).cast("double"))
    out = C.impute_or_zero(holed, ["value", "event_type", "void"])
    return out.withColumn("value", F.round("value", 4))


@query(
    "d5_normalise_text_columns",
    """select doc_id, coalesce(nullif(lang, 'en'), '') as lang, n_chars::varchar as n_chars, source
       from documents where nullif(source, 'src0') is not null""",
)
def d5(t):
    docs = t.documents.select(
        "doc_id",
        F.nullif("lang", F.lit("en")).alias("lang"),
        "n_chars",
        F.nullif("source", F.lit("src0")).alias("source"),
    )
    return C.normalise_text_columns(docs, ["lang", "n_chars"], target="source")


def _words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda x: x <> ''))::bigint"


@query(
    "d6_text_features",
    f"""select doc_id, n_chars, source, length(coalesce(text, ''))::bigint as text_length, {_words('text')} as text_word_count,
    length(coalesce(nullif(lang, 'en'), ''))::bigint as lang_length, {_words("nullif(lang, 'en')")} as lang_word_count from documents""",
)
def d6(t):
    docs = t.documents.withColumn("lang", F.nullif("lang", F.lit("en")))
    return C.text_features(docs, target="source")


@query(
    "d6_text_features_conversations",
    f"""select conv_id, turn, role, length(text)::bigint as text_length, {_words('text')} as text_word_count from conversations""",
)
def d6_conversations(t):
    return C.text_features(t.conversations, target="role")


@query(
    "d8_numeric_coerce",
    """select event_id, coalesce(try_cast(case when event_type = 'error' then props else props ->> '$.k' end as double), 0.0) as raw from events""",
)
def d8(t):
    raw = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.get_json_object("props", "$.k"))
    return C.numeric_coerce(t.events.select("event_id", raw.alias("raw")), ["raw"])


@query("d9_drop_targets", "select doc_id from labels")
def d9(t):
    return C.drop_targets(t.labels, ["quality", "toxic", "not_there"])


@query(
    "d10_union_train_valid",
    """select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders where o_orderstatus <> 'F'
       union all select o_orderkey, null, o_totalprice, o_orderpriority from orders where o_orderstatus = 'F'""",
)
def d10(t):
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    train = t.orders.where("o_orderstatus <> 'F'").select(*cols)
    valid = t.orders.where("o_orderstatus = 'F'").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return C.union_train_valid(train, valid)


@query("d11_per_label_subset", "select doc_id, toxic from labels")
def d11(t):
    return C.per_label_subset(t.labels, "toxic", ["quality", "toxic"])


@query(
    "d13_format_timestamp",
    "select event_id, epoch_us(ts) // 1000 as started_ms, strftime(ts, '%Y-%m-%d %H:%M:%S') as started from events",
)
def d13(t):
    millis = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    events = t.events.select("event_id", millis.alias("started_ms"))
    return events.withColumn("started", C.format_epoch_millis(F.col("started_ms")))
