"""Exact ranks, running totals and cut rows without a one-task window.

A global `row_number` or a window over one hot group would sort everything in a single task. The
helpers here use range partitions, 65,536 hash slices or quantile brackets instead, so the largest
sort is one slice of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tabloom.functions.columns import literal, seeded_digest
from tabloom.session import pin, spread

SLICE_DIGITS = 4  # hex digits: 65,536 slices
SMALL_SIDE_ROWS = 100_000
#: Types that quantile sketches take.
SKETCHED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def small_side(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> tuple[DataFrame, bool]:
    """Local copy of a lookup table when it has at most `max_rows` rows, else the table itself."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return df, False


SALTS = 16


def join_lookup(
    big: DataFrame, lookup: DataFrame, on, how: str = "inner", max_rows: int = SMALL_SIDE_ROWS, salts: int = SALTS
) -> DataFrame:
    """Join a table of any skew to a lookup table with one row per key.

    Up to `max_rows` lookup rows (checked) the lookup is broadcast. Beyond that it is repeated once per
    salt and joined on key and salt, where the salt of a row is its input partition: a key that holds a
    third of all rows is spread over `salts` tasks, also when an aggregation by the same key follows.
    The copies are never broadcast: Spark estimates them at the size of one.
    """
    side, small = small_side(lookup, max_rows)
    if small:
        return big.join(F.broadcast(side), on, how)
    salted = big.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    copies = side.withColumn("_salt_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if isinstance(on, str):
        on = [on]
    if isinstance(on, list) and all(isinstance(c, str) for c in on):
        joined = salted.join(copies.withColumnRenamed("_salt_copy", "_salt").hint("merge"), [*on, "_salt"], how)
    else:
        conditions = on if isinstance(on, list) else [on]
        joined = salted.join(copies.hint("merge"), [*conditions, F.col("_salt") == F.col("_salt_copy")], how)
    return joined.drop("_salt", "_salt_copy")


def _range_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id is (partition << 33) + position; the checkpoint makes both a stored fact.
    return pin(ranged.withColumn("_slot", F.monotonically_increasing_id()))


def _range_offsets(fixed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier ranges; one row per shuffle partition."""
    part = F.shiftright("_slot", 33)
    totals = fixed.groupBy(part.alias("_part")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in the total order `order` (which must end in a unique key)."""
    fixed = _range_sorted(df, order)
    offsets = _range_offsets(fixed, {"_before": F.lit(1).cast("long")})
    placed = fixed.withColumn("_part", F.shiftright("_slot", 33)).join(F.broadcast(offsets), "_part")
    position = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, (F.col("_before") + position + 1).cast("long")).drop("_part", "_slot", "_before")


def group_rank(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position inside each group; a group may be spread over many tasks."""
    ranked = global_rank(df, [F.col(c) for c in by] + order, "_global")
    first = ranked.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min("_global").alias("_first"))
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    joined = join_lookup(ranked, first, on, "left")
    return joined.withColumn(name, F.col("_global") - F.col("_first") + 1).drop(
        "_global", "_first", *[f"_by_{c}" for c in by]
    )


def dense_index(df: DataFrame, by: list[str], order: list[Column], name: str, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """`group_rank` for lookup tables: a plain window when the table is checked to be small."""
    side, small = small_side(df, max_rows)
    if small:
        return side.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    return group_rank(df, by, order, name)


def running_totals(
    df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, max_rows: int = SMALL_SIDE_ROWS
) -> DataFrame:
    """Totals over all earlier rows (of the group); `df` has one row per distinct (group, `order`) value."""
    by = by or []
    side, small = small_side(df, max_rows)
    if small:
        earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return side.withColumns({out: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for out, c in sums.items()})
    if by:
        totals = running_totals(_flat(df, by, order), "_flat", sums, None, max_rows).drop("_flat")
        starts = totals.groupBy(*[F.col(c).alias(f"_b_{c}") for c in by]).agg(*[F.min(o).alias(f"_s_{o}") for o in sums])
        on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
        joined = join_lookup(totals, starts, on)
        joined = joined.withColumns({o: F.col(o) - F.col(f"_s_{o}") for o in sums})
        return joined.drop(*[f"_b_{c}" for c in by], *[f"_s_{o}" for o in sums])
    fixed = _range_sorted(df, [F.col(order)])
    offsets = _range_offsets(fixed, {f"_off_{out}": F.col(c) for out, c in sums.items()})
    placed = fixed.withColumn("_part", F.shiftright("_slot", 33)).join(F.broadcast(offsets), "_part")
    inside = W.partitionBy("_part").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    for out, c in sums.items():
        placed = placed.withColumn(out, F.col(f"_off_{out}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return placed.drop("_part", "_slot", *[f"_off_{out}" for out in sums])


def _flat(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.withColumn("_flat", F.struct(*[F.col(c) for c in by], F.col(order)))


def with_hash(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """Adds `_key`, its seeded digest `_hash` (hex text sorts like the number) and the digest's slice."""
    keyed = spread(df).withColumn("_key", key.cast("string")).withColumn("_hash", seeded_digest(F.col("_key"), seed))
    return keyed.withColumn("_slice", F.substring("_hash", 1, SLICE_DIGITS))


def hash_position(df: DataFrame, by: list[str], key: Column, seed: int, name: str, partitions: int | None = None) -> DataFrame:
    """0-based position inside each group in seeded order: slice offset plus place inside the slice. With `partitions`
    the rows lie in that many parts afterwards, dealt by slice, and are shuffled only once."""
    hashed = with_hash(df, key, seed)
    keys = [*by, "_slice"]
    sizes = hashed.groupBy(*keys).agg(F.count("*").alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_slice") if by else W.partitionBy(F.lit(0)).orderBy("_slice")
    earlier = earlier.rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_o_{c}") for c in keys], F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    if partitions is not None:
        hashed = hashed.repartition(partitions, "_slice")
        offsets = offsets if by else F.broadcast(offsets)  # a row a slice
    inside = hashed.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy("_hash", "_key")))
    on = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in keys]
    joined = inside.join(offsets, on)
    return joined.withColumn(name, F.col("_offset") + F.col("_place") - 1).drop(
        "_key", "_hash", "_slice", "_place", "_offset", *[f"_o_{c}" for c in keys]
    )


def hash_cuts(hashed: DataFrame, by: list[str], takes: dict[str, Column]) -> DataFrame:
    """Per group and named cut the last (hash, key) of the group's first rows in seeded order.

    Each value of `takes` is a row count as an expression over `_n`, the group size. Only counts per slice
    are shuffled, then the rows of the one slice per group in which a cut falls.
    """
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    sizes = hashed.groupBy(*by, "_slice").agg(F.count("*").alias("_size"))
    wanted = F.array(*[F.struct(F.lit(name).alias("_cut"), take.alias("_take")) for name, take in takes.items()])
    edges = (
        sizes.withColumn("_n", F.sum("_size").over(part))
        .withColumn("_upto", F.sum("_size").over(part.orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)))
        .select("*", F.inline(wanted))
        .where((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_size") < F.col("_take")))
        .select(
            "_cut",
            *[F.col(c).alias(f"_e_{c}") for c in by],
            F.col("_slice").alias("_e_slice"),
            (F.col("_take") - F.col("_upto") + F.col("_size")).alias("_need"),
        )
    )
    on = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in by] + [F.col("_slice") == F.col("_e_slice")]
    members = join_lookup(hashed.select(*by, "_slice", "_hash", "_key"), edges, on)
    inside = W.partitionBy("_cut", *by).orderBy("_hash", "_key")
    placed = members.withColumn("_place", F.row_number().over(inside))
    return placed.where(F.col("_place") == F.col("_need")).select(
        "_cut", *[F.col(c).alias(f"_c_{c}") for c in by], F.col("_hash").alias("_cut_hash"), F.col("_key").alias("_cut_key")
    )


class _Bracket:
    """Values of a column strictly between two found ones (None: open end), with the ranks that are sought in it."""

    def __init__(self, column: str, low, high, below: int, size: int, labels: dict[str, int]):
        self.column, self.low, self.high, self.below, self.size, self.labels = column, low, high, below, size, labels

    def holds(self, data_type) -> Column:
        c, inside = F.col(f"`{self.column}`"), F.col(f"`{self.column}`").isNotNull()
        if self.low is not None:
            inside = inside & (c > literal(self.low, data_type))
        if self.high is not None:
            inside = inside & (c < literal(self.high, data_type))
        return inside

    def shares(self, accuracy: int) -> list[float]:
        """Places to cut at: a margin to both sides of the sought ranks that a sketch does not miss; ranks within half a
        margin of each other share theirs."""
        margin, cuts = 2.0 / accuracy, []
        for place in sorted((rank - self.below) / self.size for rank in self.labels.values()):
            if cuts and place - cuts[-1][0] < margin / 2:
                cuts[-1][1] = place
            else:
                cuts.append([place, place])
        return sorted({min(1.0, max(0.0, x)) for first, last in cuts for x in (first - margin, last + margin)})


def _pivots(df: DataFrame, brackets: list[_Bracket], types: dict, accuracy: int) -> list[list]:
    """Values that lie in each bracket, near the sought ranks: from one quantile sketch a bracket in a single scan, or,
    for types without sketches, from a bounded random sample of the bracket."""
    sketched = [b for b in brackets if isinstance(types[b.column], SKETCHED)]
    asks = [
        F.percentile_approx(F.when(b.holds(types[b.column]), F.col(f"`{b.column}`")), b.shares(accuracy), accuracy).alias(f"q{i}")
        for i, b in enumerate(sketched)
    ]
    row = df.agg(*asks).first() if asks else []
    found = {id(b): sorted(set(values)) for b, values in zip(sketched, row)}
    for b in brackets:
        if id(b) not in found:
            column = F.col(f"`{b.column}`")
            sample = df.where(b.holds(types[b.column])).select(column.alias("v")).orderBy(F.rand(7)).limit(accuracy)
            values = sample.agg(F.array_sort(F.collect_list("v"))).first()[0]  # at most `accuracy` values
            found[id(b)] = list(dict.fromkeys(values[round(s * (len(values) - 1))] for s in b.shares(accuracy)))
    return [found[id(b)] for b in brackets]


def _narrowed(df: DataFrame, brackets: list[_Bracket], types: dict, accuracy: int) -> tuple[dict, list[_Bracket]]:
    """One round: cut every bracket at its pivots by exact counts. A pivot that has a sought rank settles it; other
    ranks go to the brackets between pivots, which are smaller as no pivot belongs to them."""
    pivots = _pivots(df, brackets, types, accuracy)
    counts = []
    for i, (b, values) in enumerate(zip(brackets, pivots)):
        inside, c = b.holds(types[b.column]), F.col(f"`{b.column}`")
        for k, v in enumerate(values):
            at = literal(v, types[b.column])
            counts += [F.count_if(inside & (c < at)).alias(f"lt{i}_{k}"), F.count_if(inside & (c <= at)).alias(f"le{i}_{k}")]
    got = df.agg(*counts).first()
    found, smaller = {}, []
    for i, (b, values) in enumerate(zip(brackets, pivots)):
        low, below, left = b.low, 0, dict(b.labels)
        for k, v in enumerate([*values, None]):
            lt, le = (got[f"lt{i}_{k}"], got[f"le{i}_{k}"]) if k < len(values) else (b.size, b.size)
            own = {n: r for n, r in left.items() if r - b.below <= lt}
            if own:
                smaller.append(_Bracket(b.column, low, v if k < len(values) else b.high, b.below + below, lt - below, own))
            found |= {n: v for n, r in left.items() if n not in own and r - b.below <= le}
            left = {n: r for n, r in left.items() if r - b.below > le}
            low, below = v, le
    return found, smaller


def _settled(df: DataFrame, brackets: list[_Bracket], data_type) -> dict[str, object]:
    """Values at the sought ranks of small brackets of one type: a single scan and a window over each bracket."""
    items = [
        F.when(b.holds(data_type), F.struct(F.lit(i).alias("b"), F.col(f"`{b.column}`").alias("v"))) for i, b in enumerate(brackets)
    ]
    rows = df.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
    counts = rows.groupBy("b", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("b").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    wanted = F.array(*[F.array(*[F.lit(r - b.below).cast("long") for r in b.labels.values()]) for b in brackets])
    hits = counts.withColumn("upto", upto).withColumn("rank", F.explode(F.get(wanted, F.col("b"))))
    hits = hits.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    values = {(r["b"], r["rank"]): r["v"] for r in hits.select("b", "rank", "v").distinct().collect()}  # one a target
    return {n: values[i, r - b.below] for i, b in enumerate(brackets) for n, r in b.labels.items()}


def order_statistics(
    df: DataFrame, targets: dict[str, tuple[str, int]], small: int = 50_000, accuracy: int = 2_000
) -> dict[str, object]:
    """Exact values at given 1-based ranks: `targets` maps a label to (column, rank among non-null values).

    All targets of all columns go together. Each round takes two scans: quantile sketches give pivots around the open
    ranks, and exact counts at the pivots settle ranks or leave brackets that hold about 4/accuracy of the rows. Once
    all brackets have at most `small` rows, one more scan finds what is left. So 10^7 rows need one round, 10^12
    three, whatever the number of columns and targets; columns may have any type with an order.
    """
    types = {c: df.schema[c].dataType for c, _ in targets.values()}
    sizes = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in types]).first().asDict()
    for c, rank in targets.values():
        if not 1 <= rank <= sizes[c]:
            raise ValueError(f"rank {rank} is outside 1..{sizes[c]} of {c}")
    of_column = {c: {n: r for n, (own, r) in targets.items() if own == c} for c in types}
    brackets = [_Bracket(c, None, None, 0, sizes[c], labels) for c, labels in of_column.items()]
    found: dict[str, object] = {}
    while wide := [b for b in brackets if b.size > small]:
        settled, smaller = _narrowed(df, wide, types, accuracy)
        found |= settled
        brackets = [b for b in brackets if b.size <= small] + smaller
    for kind in dict.fromkeys(types[b.column] for b in brackets):
        found |= _settled(df, [b for b in brackets if types[b.column] == kind], kind)
    return found


def cut_row(df: DataFrame, order: list[str], rank: int, **tuning) -> list[tuple[str, object]]:
    """The values of `order` at a 1-based rank of the lexicographic order (nulls last).

    One column at a time: ties on the first column are resolved among the tied rows only.
    """
    values: list[tuple[str, object]] = []
    rows = df
    for c in order:
        present = rows.agg(F.count(c)).first()[0]
        if rank > present:
            values.append((c, None))
            rows, rank = rows.where(F.col(c).isNull()), rank - present
            continue
        v = order_statistics(rows, {"cut": (c, rank)}, **tuning)["cut"]
        lit = literal(v, df.schema[c].dataType)
        rank -= rows.where(F.col(c) < lit).count()
        rows = rows.where(F.col(c) == lit)
        values.append((c, v))
    return values


def at_or_before(df: DataFrame, cut: list[tuple[str, object]]) -> Column:
    """True for rows that sort at or before the cut row (nulls last)."""
    result = F.lit(True)
    for c, v in reversed(cut):
        col = F.col(c)
        if v is None:
            result = col.isNotNull() | result
        else:
            lit = literal(v, df.schema[c].dataType)
            result = F.coalesce((col < lit) | ((col == lit) & result), F.lit(False))
    return result
