"""Sources and sinks: round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.plans.derived import runs
from tabloom.plans.registry import query
from tabloom.operators import tracking
from tabloom.session import scratch_path
from tabloom.sources import images, snapshots, tables


@query("a1_read_table", "select c_custkey::int as c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def a1(t):
    path = scratch_path(t.spark, "customer") + ".csv"
    tables.write_predictions(t.customer, path)
    return tables.read_table(t.spark, path)


@query("a2_read_headerless", "select n_nationkey as col_0, n_name as col_1, n_regionkey as col_2 from nation")
def a2(t):
    path = scratch_path(t.spark, "nation") + ".csv"
    t.nation.write.option("header", False).csv(path)
    return tables.read_headerless(t.spark, path)


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _fingerprint_sql(table: str, columns: list[str]) -> str:
    cells = ", ".join(f"coalesce('=' || {c}::varchar, '~')" for c in columns)
    return f"""(select count(*) || '|' || sum(('0x' || substr(md5(concat_ws(chr(31), {cells})), 1, 15))::bigint)::decimal(38,0)::varchar from {table})"""


_HOLED = "(select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus, o_orderpriority from orders)"


@query(
    "a6_fingerprint",
    f"select count(*) as n_rows, md5({_fingerprint_sql(_HOLED, _ORDER_COLUMNS)}) as fingerprint from orders",
)
def a6(t):
    orders = t.orders.select(*_ORDER_COLUMNS).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return snapshots.fingerprint(orders)


@query(
    "a5_write_snapshot",
    f"""select 'orders_1700000000' as name, 'table' as kind, count(*) as n_rows, md5({_fingerprint_sql('orders', _ORDER_COLUMNS)}) as fingerprint,
    substr(md5({_fingerprint_sql('orders', _ORDER_COLUMNS)}), 1, 8) as short8, 1700000000::bigint as created_at from orders""",
)
def a5(t):
    lake = scratch_path(t.spark, "lake")
    snapshots.write_snapshot(t.orders.select(*_ORDER_COLUMNS), lake, "orders", 1700000000)
    return snapshots.list_snapshots(t.spark, lake).drop("path")


@query(
    "a7_list_snapshots",
    """select 'customer_1700000002' as name, count(*) as n_rows from customer union all select 'nation_1700000001', count(*) from nation""",
)
def a7(t):
    lake = scratch_path(t.spark, "lake")
    snapshots.write_snapshot(t.nation, lake, "nation", 1700000001)
    snapshots.write_snapshot(t.customer, lake, "customer", 1700000002)
    return snapshots.list_snapshots(t.spark, lake, "table").select("name", "n_rows")


@query(
    "a9_write_predictions",
    "select o_orderkey::int as o_orderkey, case when o_totalprice > 150000 then 'high' else 'low' end as \"Predictions\" from orders",
)
def a9(t):
    path = scratch_path(t.spark, "predictions") + ".csv"
    scored = t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 150000, "high").otherwise("low").alias("Predictions"))
    tables.write_predictions(scored, path)
    return tables.read_table(t.spark, path)


@query(
    "a10_write_leaderboard",
    """with r as (select o_orderpriority as experiment, 'model_' || (o_custkey % 9) as model, min(o_totalprice / 1000) as rmse from orders group by 1, 2),
    q as (select *, row_number() over (partition by experiment order by rmse, model) as rank from r) select * from q where rank <= 5""",
)
def a10(t):
    board = runs(t).groupBy("experiment", "model").agg(F.min("rmse").alias("rmse"))
    path = scratch_path(t.spark, "leaderboard") + ".parquet"
    tables.write_leaderboard(tracking.leaderboard(board, "rmse", "rmse", ["experiment"], "model", 5), path)
    return tables.read_table(t.spark, path)


def _image_tree(t) -> str:
    """A folder of small .png files, one sub-folder per label, written from the embeddings (5 vectors a file)."""
    folder = scratch_path(t.spark, "images")
    vectors = t.embeddings.select("label", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ";").alias("v"))
    spread = vectors.repartition("label").sortWithinPartitions("label", "v")
    spread.write.partitionBy("label").option("extension", "png").option("maxRecordsPerFile", 5).csv(folder)
    return folder


@query("a3_image_index", "select 'label=' || label as label, ((count(*) + 4) // 5)::bigint as n_images from embeddings group by label")
def a3(t):
    return images.images_per_label(images.image_index(t.spark, _image_tree(t)))


@query("a8_image_set_fingerprint", "select sum((n + 4) // 5)::bigint as n_rows, 1::bigint as n_prints from (select count(*) as n from embeddings group by label)")
def a8(t):
    folder = _image_tree(t)
    twice = images.image_set_fingerprint(t.spark, folder).unionByName(images.image_set_fingerprint(t.spark, folder))
    return twice.groupBy("n_rows").agg(F.count_distinct("fingerprint").alias("n_prints"))
