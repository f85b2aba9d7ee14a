"""Splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.columns import row_key
from tabloom.operators import split as S
from tabloom.plans.registry import query

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_KEY_SQL = "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


def sql_hash(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat({key}, '|{seed}')), 1, 7))::bigint"


@query(
    "e1_random_split",
    f"""with r as (select *, row_number() over (order by {sql_hash(LINE_KEY_SQL)}, {LINE_KEY_SQL}) as rk, count(*) over () as n from lineitem),
    c as (select *, (n * 20 + 99) // 100 as nt from r), d as (select *, ((n - nt) * 10 + 79) // 80 as nv from c)
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when rk <= nt then 'test' when rk <= nt + nv then 'valid' else 'train' end as split from d""",
)
def e1(t):
    return S.random_split(t.lineitem.select(*LINE_KEY), row_key(*LINE_KEY), 20, 10)


@query(
    "e1_approximate_split",
    f"""with r as (select o_orderkey, {sql_hash('o_orderkey::varchar')} as h from orders)
    select o_orderkey, case when h * 100 < 20 * 268435456::bigint then 'test' when h * 100 < 30 * 268435456::bigint then 'valid' else 'train' end as split from r""",
)
def e1_approximate(t):
    return S.approximate_split(t.orders.select("o_orderkey"), F.col("o_orderkey"), 20, 10)


@query(
    "e2_stratified_split",
    f"""with r as (select o_orderkey, o_orderstatus, count(*) over (partition by o_orderstatus) as n,
    row_number() over (partition by o_orderstatus order by {sql_hash('o_orderkey::varchar')}, o_orderkey::varchar) as rk from orders)
    select o_orderkey, o_orderstatus, case when rk <= (n * 40 + 100) // 200 then 'test' else 'train' end as split from r""",
)
def e2(t):
    return S.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", F.col("o_orderkey"))


_SOURCE_SQL = "case when source = 'src1' then 'Validation' when source = 'src2' then 'TEST set' when source = 'src3' then 'val-test' when source = 'src4' then null else source end"


@query(
    "e3_manual_split",
    f"""with m as (select doc_id, {_SOURCE_SQL} as part from documents)
    select doc_id, part, case when contains(lower(part), 'val') then 'valid' when contains(lower(part), 'test') then 'test' else 'train' end as split from m""",
)
def e3(t):
    part = (
        F.when(F.col("source") == "src1", "Validation")
        .when(F.col("source") == "src2", "TEST set")
        .when(F.col("source") == "src3", "val-test")
        .when(F.col("source") != "src4", F.col("source"))
    )
    return S.manual_split(t.documents.select("doc_id", part.alias("part")), "part")


@query(
    "e4_chronological_split",
    """with r as (select o_orderkey, o_orderdate, row_number() over (order by o_orderdate nulls last, o_orderkey) as rk, count(*) over () as n from orders)
    select o_orderkey, o_orderdate, case when rk <= n * 75 // 100 then 'train' when rk <= n * 85 // 100 then 'valid' else 'test' end as split from r""",
)
def e4(t):
    return S.chronological_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 15, 10)


@query(
    "e4_chronological_split_events",
    """with r as (select event_id, case when event_type <> 'view' then ts end as ts from events),
    q as (select *, row_number() over (order by ts nulls last, event_id) as rk, count(*) over () as n from r)
    select event_id, ts, case when rk <= n * 85 // 100 then 'train' when rk <= n * 90 // 100 then 'valid' else 'test' end as split from q""",
)
def e4_events(t):
    events = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("ts")).alias("ts"))
    return S.chronological_split(events, "ts", "event_id", 10, 5)


@query(
    "e5_kfold_assign",
    f"""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, ((row_number() over (partition by l_returnflag
    order by {sql_hash(LINE_KEY_SQL)}, {LINE_KEY_SQL}) - 1) % 5)::int as fold from lineitem""",
)
def e5(t):
    return S.kfold_assign(t.lineitem.select(*LINE_KEY, "l_returnflag"), row_key(*LINE_KEY), 5, "l_returnflag")


@query(
    "e5_hash_folds",
    f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, ({sql_hash(LINE_KEY_SQL)} % 5)::int as fold from lineitem",
)
def e5_hash(t):
    return S.hash_folds(t.lineitem.select(*LINE_KEY), row_key(*LINE_KEY), 5)


@query(
    "e6_bounded_sample",
    f"select * from customer order by {sql_hash('c_custkey::varchar')}, c_custkey::varchar limit 100",
)
def e6(t):
    return S.bounded_sample(t.customer, F.col("c_custkey"), 100)


@query(
    "e7_class_weights",
    """with c as (select o_orderstatus, count(*) as n_class from orders group by 1)
    select o_orderstatus, n_class, round((select sum(n_class) from c)::double / ((select count(*) from c) * n_class), 6) as weight from c""",
)
def e7(t):
    return S.class_weights(t.orders, "o_orderstatus").withColumn("weight", F.round("weight", 6))


@query(
    "e7_balance_classes",
    """with q as (select o_orderkey, case when o_totalprice > 400000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band from orders),
    c as (select band, count(*) as n from q group by 1),
    r as (select band, (2 * (select max(n) from c) + n) // (2 * n) as times from c)
    select o_orderkey, band, unnest(range(1, times + 1))::int as copy from q join r using (band)""",
)
def e7_balance(t):
    band = F.when(F.col("o_totalprice") > 400000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low")
    return S.balance_classes(t.orders.select("o_orderkey", band.alias("band")), "band")


@query(
    "e8_split_summary",
    """with r as (select count(*) as n from orders), c as (select n, (n * 20 + 99) // 100 as nt from r)
    select 'test' as split, nt::bigint as n_rows, 'o_totalprice' as target from c union all select 'train', (n - nt)::bigint, 'o_totalprice' from c""",
)
def e8(t):
    split = S.random_split(t.orders.select("o_orderkey"), F.col("o_orderkey"), 20)
    return S.split_summary(split, "o_totalprice")
