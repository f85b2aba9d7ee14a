"""Encoders."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.functions.fixed import STOP_WORDS
from tabloom.operators import encode as E
from tabloom.operators.tfidf import TfIdf
from tabloom.plans.registry import query


@query(
    "f1_label_encode",
    """with dims as (select o_orderpriority as v, row_number() over (order by o_orderpriority) - 1 as idx from (select distinct o_orderpriority from orders))
    select o_orderkey, idx as o_orderpriority from orders join dims on v = o_orderpriority""",
)
def f1(t):
    orders = t.orders.select("o_orderkey", "o_orderpriority")
    # '5-LOW' appears only in the second table, so the numbering must be fitted on both.
    _, train, test = E.label_encode(
        orders.where("o_orderpriority <> '5-LOW'"), orders.where("o_orderpriority = '5-LOW'"), "o_orderpriority"
    )
    return train.unionByName(test)


@query(
    "f2_ordinal_encode",
    """with p as (select distinct p_name as v from part where p_size <= 25), b as (select distinct p_brand as v from part where p_size <= 25),
    pi as (select v, row_number() over (order by v) - 1 as i from p), bi as (select v, row_number() over (order by v) - 1 as i from b)
    select p_partkey, coalesce(pi.i, -1) as p_name, coalesce(bi.i, -1) as p_brand from part
    left join pi on p_name = pi.v left join bi on p_brand = bi.v""",
)
def f2(t):
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    index = E.CategoryIndex.fit(part.where("p_size <= 25"), ["p_name", "p_brand"])
    return index.transform(part).drop("p_size")


_SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "f3_standard_scale",
    "select l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(f"round(({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem), 5) + 0.0 as {c}" for c in _SCALED)
    + " from lineitem",
)
def f3(t):
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_SCALED)
    scaled = E.Scaler.standard(line, _SCALED).transform(line)
    return scaled.withColumns({c: F.round(c, 5) + 0.0 for c in _SCALED})


@query(
    "f4_minmax_scale",
    """select p_partkey, round((p_size - (select min(p_size) from part)) / (select max(p_size) - min(p_size) from part)::double, 6) as p_size,
    round((p_retailprice - (select min(p_retailprice) from part)) / (select max(p_retailprice) - min(p_retailprice) from part), 6) as p_retailprice,
    0.0::double as flat from part""",
)
def f4(t):
    part = t.part.select("p_partkey", "p_size", "p_retailprice", F.lit(7).alias("flat"))
    names = ["p_size", "p_retailprice", "flat"]
    scaled = E.Scaler.minmax(part, names).transform(part)
    return scaled.withColumns({c: F.round(c, 6) for c in names})


def tfidf_sql(table: str, key: str, column: str, max_features: int = 500) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""with w as (select {key}, list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'),
      lambda x: not list_contains([{stop}], x)) as ws from {table}),
    g as (select {key}, unnest(ws) as term from w union all
      select {key}, ws[i] || ' ' || ws[i + 1] from (select {key}, ws, unnest(range(1, len(ws))) as i from w)),
    tf as (select {key}, term, count(*) as n from g group by 1, 2),
    v as (select term, count(*) as df from tf group by 1 order by sum(n) desc, term limit {max_features}),
    raw as (select {key}, term, n * (ln((1 + (select count(*) from {table})) / (1 + df)::double) + 1) as x from tf join v using (term))
    select {key}, term, round(x / sqrt(sum(x * x) over (partition by {key})), 6) as weight from raw"""


@query("f5_tfidf", tfidf_sql("documents", "doc_id", "text"))
def f5(t):
    docs = t.documents
    model = TfIdf.fit(docs, "text")
    return model.long_form(docs, "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("f6_pca")
def f6(t):
    vectors = E.vector_from_array(t.embeddings, "embedding")
    _, scored = E.pca(vectors, "features", 2)
    xy = vector_to_array("components")
    return scored.select("vec_id", F.round(xy[0], 6).alias("pc1"), F.round(xy[1], 6).alias("pc2"))


@query("f7_feature_assembly")
def f7(t):
    joined = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    table = joined.select(
        "o_orderkey", "c_nationkey", "c_acctbal", "c_mktsegment", "o_orderpriority", "o_totalprice", "o_orderstatus"
    )
    assembly = E.FeatureAssembly.fit(table, target="o_orderstatus", exclude=["o_orderkey"])
    values = F.transform(vector_to_array("features"), lambda x: F.round(x, 6))
    return assembly.transform(table).select("o_orderkey", "o_orderstatus", F.array_join(values, ",").alias("features"))


@query(
    "f8_vector_from_array",
    """select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 5) as squared_norm, len(embedding)::int as dims
    from embeddings""",
)
def f8(t):
    vectors = E.vector_from_array(t.embeddings, "embedding")
    values = vector_to_array("features")
    norm = F.aggregate(F.transform(values, lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    return vectors.select("vec_id", F.round(norm, 5).alias("squared_norm"), F.size(values).alias("dims"))
