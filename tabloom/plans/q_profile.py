"""Profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabloom.operators import profile as P
from tabloom.plans.registry import query

CUSTOMER = [
    ("c_custkey", "bigint"),
    ("c_name", "string"),
    ("c_nationkey", "int"),
    ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
PART = [
    ("p_partkey", "bigint"),
    ("p_name", "string"),
    ("p_brand", "string"),
    ("p_type", "string"),
    ("p_size", "int"),
    ("p_retailprice", "double"),
]
# No table has nulls, so the same values are blanked in both engines.
HOLED_SQL = """holed as (select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus,
    case when o_totalprice > 300000 then null else o_totalprice end as o_totalprice,
    nullif(o_orderpriority, '5-LOW') as o_orderpriority from orders)"""
HOLED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def holed_orders(t):
    return t.orders.select(
        "o_orderkey",
        "o_custkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(~(F.col("o_totalprice") > 300000), F.col("o_totalprice")).alias("o_totalprice"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
    )


def union(parts: list[str]) -> str:
    return "\nunion all ".join(parts)


@query(
    "b1_dataset_summary",
    union(
        f"select {i}::bigint as position, '{c}' as \"column\", '{d}' as dtype, count(*) - count({c}) as missing, "
        f"count(*) as n_rows, {len(CUSTOMER)}::bigint as n_columns from customer"
        for i, (c, d) in enumerate(CUSTOMER)
    ),
)
def b1(t):
    return P.dataset_summary(t.customer)


_per_column = union(
    f"select '{d}' as dtype, count(*) - count({c}) as missing from customer" for c, d in CUSTOMER
)


@query(
    "b1_columns_per_type",
    f"select dtype, count(*) as n_columns, sum(missing)::bigint as missing from ({_per_column}) group by 1",
)
def b1_types(t):
    return P.columns_per_type(t.customer)


_pct = union(
    f"select '{c}' as \"column\", 100.0 * (count(*) - count({c})) / count(*)::double as missing_pct from holed"
    for c in HOLED
)


@query(
    "b2_missing_pct",
    f'with {HOLED_SQL}, m as ({_pct}) select "column", round(missing_pct, 6) as missing_pct from m',
)
def b2(t):
    return P.missing_pct(holed_orders(t)).withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "b3_missing_report",
    f'with {HOLED_SQL}, m as ({_pct}) select "column", round(missing_pct, 2) as missing_pct from m where missing_pct > 0',
)
def b3(t):
    return P.missing_report(holed_orders(t))


@query(
    "b5_column_summary",
    union(
        f"select '{c}' as \"column\", '{d}' as dtype, count(*) - count({c}) as missing, count(distinct {c}) as n_unique from customer"
        for c, d in CUSTOMER
    ),
)
def b5(t):
    return P.column_summary(t.customer)


@query(
    "b6_overview",
    """select count(*) as n_rows, 6::bigint as n_columns,
       round(100.0 * sum(miss) / (count(*) * 6), 6)::double as mean_missing_pct, sum(miss)::bigint as missing_cells,
       round(sum(bytes) / 1048576.0, 6)::double as size_mb,
       (100.0 * sum(miss) / (count(*) * 6) > 5)::int as health_alert
       from (select (case when p_type = 'ECONOMY' then 1 else 0 end) as miss,
             8 + strlen(p_name) + strlen(p_brand) + coalesce(strlen(nullif(p_type, 'ECONOMY')), 0) + 4 + 8 as bytes from part)""",
)
def b6(t):
    part = t.part.withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY")))
    return (
        P.overview(part)
        .withColumn("mean_missing_pct", F.round("mean_missing_pct", 6))
        .withColumn("size_mb", F.round("size_mb", 6))
    )


@query("b7_preview", "select * from orders order by o_orderkey limit 10")
def b7(t):
    return P.preview(t.orders, "o_orderkey")


@query(
    "b8_histogram",
    """with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
    c as (select least(floor((l_extendedprice - lo) / ((hi - lo) / 40))::bigint, 39) as bin, count(*) as n from lineitem, b group by 1)
    select r.range as bin, round(lo + r.range * ((hi - lo) / 40), 4) as lower, round(lo + (r.range + 1) * ((hi - lo) / 40), 4) as upper,
    coalesce(c.n, 0)::bigint as n from range(40) r cross join b left join c on c.bin = r.range""",
)
def b8(t):
    return (
        P.histogram(t.lineitem, "l_extendedprice")
        .withColumn("lower", F.round("lower", 4))
        .withColumn("upper", F.round("upper", 4))
    )


def _describe_sql(table: str, names: list[str]) -> str:
    return union(
        f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
        min({c})::double as min, round(quantile_cont({c}::double, 0.25), 4) as p25, round(quantile_cont({c}::double, 0.5), 4) as p50,
        round(quantile_cont({c}::double, 0.75), 4) as p75, max({c})::double as max from {table}"""
        for c in names
    )


def _rounded(df, names):
    return df.select(*[F.round(c, 4).alias(c) if c in names else F.col(c) for c in df.columns])


@query("b9_describe", _describe_sql("events", ["value"]))
def b9(t):
    return _rounded(P.describe(t.events, ["value"]), ["mean", "std", "p25", "p50", "p75"])


_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query("b9_describe_wide", _describe_sql("lineitem", _NUMBERS))
def b9_wide(t):
    return _rounded(P.describe(t.lineitem, _NUMBERS), ["mean", "std", "p25", "p50", "p75"])


@query(
    "b11_correlation_matrix",
    union(
        f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as pearson from lineitem"
        for a, b in combinations(_NUMBERS, 2)
    ),
)
def b11(t):
    return P.correlation_matrix(t.lineitem).withColumn("pearson", F.round("pearson", 6))


@query(
    "b11_spearman",
    """with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rx,
       rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as ry from lineitem)
       select 'l_quantity' as column_a, 'l_extendedprice' as column_b, round(corr(rx, ry), 6) as spearman from r""",
)
def b11_spearman(t):
    return P.spearman(t.lineitem, "l_quantity", "l_extendedprice").withColumn("spearman", F.round("spearman", 6))


@query(
    "b12_value_frequencies",
    """select o_orderpriority as value, count(*) as n, round(count(*) / (select count(*) from orders)::double, 6) as share
       from orders group by 1 order by n desc, value limit 10""",
)
def b12(t):
    return P.value_frequencies(t.orders, "o_orderpriority").withColumn("share", F.round("share", 6))


@query(
    "b12_class_imbalance",
    """with c as (select o_orderpriority, count(*) as n from orders group by 1)
       select count(*) as n_classes, max(n) as largest, min(n) as smallest, round(max(n) / min(n)::double, 6) as imbalance_ratio from c""",
)
def b12_imbalance(t):
    return P.class_imbalance(t.orders, "o_orderpriority").withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))


@query(
    "b13_duplicate_rows",
    """select count(*) as n_groups, sum(n)::bigint as n_rows, sum(n - 1)::bigint as n_extra
       from (select text, count(*) as n from documents group by 1 having count(*) > 1)""",
)
def b13(t):
    return P.duplicate_rows(t.documents, ["text"])


@query(
    "b14_column_alerts",
    union(
        f"""select '{c}' as "column", (count(distinct {c}) <= 1)::int as is_constant, (count(distinct {c}) = count(*))::int as is_unique,
        ({f'2 * count(distinct {c}) > count(*)' if d == 'string' else 'false'})::int as high_cardinality,
        ({f'2 * count(*) filter ({c} = 0) > count(*)' if d != 'string' else 'false'})::int as many_zeros,
        (100.0 * (count(*) - count({c})) > 5.0 * count(*))::int as missing_alert
        from (select * replace (nullif(p_type, 'ECONOMY') as p_type) from part)"""
        for c, d in PART
    ),
)
def b14(t):
    return P.column_alerts(t.part.withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY"))))


@query(
    "b15_target_cardinality",
    "select 'o_orderstatus' as target, count(distinct o_orderstatus) as n_unique from orders union all select 'absent', 2::bigint",
)
def b15(t):
    return P.target_cardinality(t.orders, "o_orderstatus").unionByName(P.target_cardinality(t.orders, "absent"))


@query(
    "b16_entry_defaults",
    """select 'c_nationkey' as feature, 1::bigint as position, round(median(c_nationkey), 4) as median, null::varchar as option from customer
       union all select 'c_acctbal', 1, round(median(c_acctbal), 4), null from customer
       union all select 'c_name', row_number() over (order by v), null, v from (select distinct c_name as v from customer)
       union all select 'c_mktsegment', row_number() over (order by v), null, v from (select distinct c_mktsegment as v from customer)""",
)
def b16(t):
    return P.entry_defaults(t.customer, ["c_custkey"]).withColumn("median", F.round("median", 4))


_REPORT = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


@query(
    "b_profile_report",
    union(
        f"""select '{c}' as "column", '{'string' if c in _REPORT[2:] else 'double'}' as dtype, count(*) as n_rows,
        count(*) - count({c}) as missing, count(distinct {c}) as n_unique,
        """
        + (
            f"round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as min, max({c}) as max, "
            f"count(*) filter ({c} = 0) as zeros, null::double as mean_length from lineitem"
            if c in _REPORT[:2]
            else f"null::double as mean, null::double as std, null::double as min, null::double as max, null::bigint as zeros, "
            f"round(avg(length({c})), 4) as mean_length from lineitem"
        )
        for c in _REPORT
    ),
)
def b_report(t):
    return _rounded(P.profile_report(t.lineitem.select(*_REPORT), rsd=None), ["mean", "std", "mean_length"])


_WHOLE = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


def _whole_sql(c: str, dtype: str) -> str:
    number, text = dtype in ("bigint", "int", "double"), dtype == "string"
    figures = [f"round(avg({c}), 4)", f"round(stddev_samp({c}), 4)", f"min({c})::double", f"max({c})::double"]
    named = zip(figures, ("mean", "std", "min", "max"))
    return (
        f"""select '{c}' as "column", '{dtype}' as dtype, count(*) as n_rows, count(*) - count({c}) as missing, count(distinct {c}) as n_unique, """
        + ", ".join(f"{x if number else 'null::double'} as {n}" for x, n in named)
        + f", {f'count(*) filter ({c} = 0)' if number else 'null::bigint'} as zeros, "
        + f"{f'round(avg(length({c})), 4)' if text else 'null::double'} as mean_length from lineitem"
    )


@query("b_profile_report_whole", union(_whole_sql(c, dtype) for c, dtype in _WHOLE.items()))
def b_report_whole(t):
    return _rounded(P.profile_report(t.lineitem, rsd=None), ["mean", "std", "mean_length"])
