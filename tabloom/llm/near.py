"""Operator 5: near-duplicates through an inverted join of MinHash coordinates.

Texts with equal shingle sets form a class. Every class posts a signature of `COORDINATES` minima under its (coordinate,
value) pairs. Pairs that agree in fewer than `MATCHES` coordinates are not looked at: at a similarity of 0.8 the
number of agreements is binomial, and fewer than 24 of 48 come up with a probability below 0.000002. Such a threshold
allows prefix and skip merging: of each class, postings are ordered from the rarest value to the most frequent one, and
two classes with 24 agreements share one of the first 25. The 23 most frequent ones are skipped and only looked up, in
the stored signatures, for pairs that the merged lists bring together. Values that one class has alone are never
posted. All pairs that pass are confirmed on the full sets.

Long lists are not expanded into all pairs. Shingles that a class shares with no other class of the long lists bound
its similarity to all of them; classes out of reach leave such lists, and pairs out of reach are not made. Parity
sketches bound each pair: two sets differ in at least as many shingles as their sketches do in bits. Then each
list ties its members to the one whose shingles are the most common there; confirmed links are contracted to components.
Only members that lie in different components are still compared, those outside the list's largest component with all
others. No link between components is lost, whatever the length of the lists.

Rows that share an id belong to one component. Rows without an id are told apart by their text and never name a
component; texts without words are linked with nothing. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import NO_ID, pin, row_key
from tabloom.llm.components import components
from tabloom.llm.shingles import parity_sketches, seeds, set_prints, shingle_sets, signatures

COORDINATES = 48
MATCHES = 24
PERCENT = 80
#: Lists of more classes are thinned by what their classes share with nobody.
LONG = 64
#: 64-bit numbers of a parity sketch.
SKETCH = 16
_SEEDS = seeds(COORDINATES)


def signed_documents(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """doc, n, p1, p2 (print of the shingle set) and sig (null for empty sets) of each row."""
    schema = "doc long, n long, p1 long, p2 long, sig array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for values, counts in shingle_sets(batch.column(1).to_pylist(), words):
                p1, p2 = set_prints(values, counts)
                sig = signatures(values, counts, _SEEDS)
                ends = np.cumsum(np.where(counts > 0, COORDINATES, 0), dtype=np.int32)
                offsets = pa.array(np.concatenate((np.zeros(1, np.int32), ends)), mask=np.append(counts == 0, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))
                columns = [batch.column(0).slice(done, len(counts)), pa.array(counts), pa.array(p1), pa.array(p2), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "p1", "p2", "sig"])
                done += len(counts)

    return docs.select(row_key(text=text), F.col(text)).mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """doc, p1, p2, the sorted shingle set and its parity sketch of each row with shingles."""
    schema = "doc long, p1 long, p2 long, shingles array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for values, counts in shingle_sets(batch.column(1).to_pylist(), words):
                p1, p2 = set_prints(values, counts)
                offsets = pa.array(np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32))))
                lists = pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))
                ends = np.arange(0, SKETCH * len(counts) + 1, SKETCH, dtype=np.int32)
                flat = pa.array(parity_sketches(values, counts, SKETCH).ravel())
                sketches = pa.ListArray.from_arrays(pa.array(ends), flat)
                columns = [batch.column(0).slice(done, len(counts)), pa.array(p1), pa.array(p2), lists, sketches]
                whole = pa.RecordBatch.from_arrays(columns, names=["doc", "p1", "p2", "shingles", "sketch"])
                yield whole.filter(pa.array(counts > 0))
                done += len(counts)

    return docs.select(row_key(text=text).alias("doc"), F.col(text)).mapInArrow(run, schema)


def _merged_postings(classes: DataFrame) -> DataFrame:
    """pos, val, cid, n of the postings in merged lists: prefixes by rarity, without values that occur once."""
    posted = classes.select("cid", "n", F.posexplode("sig").alias("pos", "val"))
    often = posted.groupBy("pos", "val").agg(F.count("*").alias("freq")).where("freq > 1")
    shared = posted.join(often, ["pos", "val"])
    of_class = Window.partitionBy("cid")
    order = F.row_number().over(of_class.orderBy("freq", "pos"))
    alone = COORDINATES - F.count("*").over(of_class)
    prefix = shared.select("*", order.alias("nth"), alone.alias("alone"))
    return prefix.where(F.col("alone") + F.col("nth") <= COORDINATES - MATCHES + 1).select("pos", "val", "cid", "n")


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that agree in enough coordinates and, on full sets, are similar enough."""

    def side(table: DataFrame, key: str, column: str) -> DataFrame:
        return table.select(F.col("cid").alias(key), F.col(column).alias(f"{column}_{key}"))

    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    likely = pairs.distinct().join(side(classes, "a", "sig"), "a").join(side(classes, "b", "sig"), "b")
    likely = likely.where(agree >= MATCHES).select("a", "b")
    both = likely.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return both.where(100 * common.cast("long") >= PERCENT * union.cast("long")).select("a", "b")


def _within_reach(n_a: str, own_a: str, n_b: str, own_b: str):
    """Whether sets of these sizes can be similar if `own` of their shingles do not occur in the other one."""
    most = F.least(F.col(n_a) - F.col(own_a), F.col(n_b) - F.col(own_b))
    return 100 * most >= PERCENT * (F.col(n_a) + F.col(n_b) - most)


def _sketches_near(n_a: str, sketch_a: str, n_b: str, sketch_b: str):
    """Whether sets of these sizes can be similar if they differ in every bit of their sketches; null ones can."""
    bits = [F.bit_count(F.get(sketch_a, k).bitwiseXOR(F.get(sketch_b, k))) for k in map(F.lit, range(SKETCH))]
    near = (100 + PERCENT) * sum(bits[1:], bits[0]) <= (100 - PERCENT) * (F.col(n_a) + F.col(n_b))
    return F.coalesce(near, F.lit(True))


def _with_own(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Add `own` to postings: in long lists how many shingles a class shares with no other class of any long list, else
    0, `mass`, how often their shingles occur there on average, and `sketch` (null in other lists). Classes with too
    many shingles of their own can have no partner in such a list and leave it."""
    long = lists.groupBy("pos", "val").agg(F.count("*").alias("members")).where(F.col("members") > LONG)
    marked = lists.join(long, ["pos", "val"], "left")
    crowd = marked.where("members is not null").select("cid").distinct()
    spread = sets.join(crowd, "cid").select("cid", F.explode("shingles").alias("shingle"))
    times = spread.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    shared = spread.join(times, "shingle").groupBy("cid").agg(F.count("*").alias("shared"), F.sum("times").alias("mass"))
    drawn = sets.join(crowd, "cid").select("cid", "sketch").join(shared, "cid", "left")
    counted = marked.join(drawn, "cid", "left")
    long_one = F.col("members").isNotNull()
    own = F.when(long_one, F.col("n") - F.coalesce("shared", F.lit(0))).otherwise(F.lit(0))
    mass = F.when(long_one, F.coalesce("mass", F.lit(0)) / F.col("n")).otherwise(F.lit(0.0))
    sketch = F.when(long_one, F.col("sketch")).alias("sketch")
    counted = counted.select("pos", "val", "cid", "n", own.cast("long").alias("own"), mass.alias("mass"), sketch)
    return counted.where(100 * (F.col("n") - F.col("own")) >= PERCENT * F.col("n"))


def links_between_classes(docs: DataFrame, classes: DataFrame, words: int, text: str = "text") -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs of classes."""
    posted = pin(_merged_postings(classes))
    wanted = posted.select("cid").distinct().join(classes.select("cid", "p1", "p2"), "cid")
    rows = docs.withColumn("__cid", row_key(text=text)).join(
        wanted.select(F.col("cid").alias("__cid")), "__cid", "left_semi"
    )
    sets = full_sets(rows, words, text).withColumnRenamed("doc", "cid").join(wanted, ["cid", "p1", "p2"])
    sets = pin(sets.select("cid", "shingles", "sketch").dropDuplicates(["cid"]))
    lists = pin(_with_own(posted, sets))

    first = lists.groupBy("pos", "val").agg(F.min(F.struct((-F.col("mass")).alias("mass"), "own", "cid", "n")).alias("lead"))
    first = first.select(
        "pos", "val", F.col("lead.cid").alias("x"), F.col("lead.n").alias("n_x"), F.col("lead.own").alias("own_x")
    )
    stars = lists.join(first, ["pos", "val"]).where(
        (F.col("x") != F.col("cid")) & _within_reach("n_x", "own_x", "n", "own")
    )
    ends = (F.least("x", "cid").alias("a"), F.greatest("x", "cid").alias("b"))
    near = pin(_confirmed(stars.select(*ends), classes, sets))

    found = components(near).withColumnRenamed("node", "cid")
    placed = lists.join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    counted = placed.groupBy("pos", "val", "component").agg(F.count("*").alias("members"))
    main = counted.groupBy("pos", "val").agg(
        F.max(F.struct("members", "component")).alias("top"), F.count("*").alias("parts")
    )
    main = main.where("parts > 1").select("pos", "val", F.col("top.component").alias("main"))
    split = pin(placed.join(main, ["pos", "val"]))
    outside = split.where("component <> main").select(
        "pos", "val", F.col("cid").alias("x"), F.col("n").alias("n_x"), F.col("own").alias("own_x"),
        F.col("component").alias("of_x"), F.col("sketch").alias("sketch_x"),
    )
    inside = F.col("component") == F.col("main")
    rest = outside.join(split, ["pos", "val"]).where(
        (F.col("of_x") != F.col("component"))
        & (inside | (F.col("x") < F.col("cid")))
        & _within_reach("n_x", "own_x", "n", "own")
        & _sketches_near("n_x", "sketch_x", "n", "sketch")
    )
    return near.union(_confirmed(rest.select(*ends), classes, sets))


def near_duplicates(docs: DataFrame, words: int = 5, text: str = "text") -> DataFrame:
    """doc, n_shingles and component_id (smallest id that similar texts lead to) of each row; doc is the id, or a
    number above all ids for rows without one."""
    signed = pin(signed_documents(docs, words, text))
    some = signed.where("n > 0")
    classes = some.groupBy("p1", "p2").agg(F.min("doc").alias("cid"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = pin(classes)
    links = links_between_classes(docs, classes, words, text)
    same = some.join(classes.select("p1", "p2", "cid"), ["p1", "p2"])
    members = same.select(F.col("cid").alias("a"), F.col("doc").alias("b"))
    found = components(links.union(members.where("a <> b"))).withColumnRenamed("node", "doc")
    placed = signed.join(found, "doc", "left")
    component = F.coalesce("component", "doc")
    return placed.select("doc", F.col("n").alias("n_shingles"), component.alias("component_id"))


def named(found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept; ids made for rows without one become null."""

    def real(c: str):
        return F.when(F.col(c) < NO_ID, F.col(c))

    kept = (F.col("doc") == F.col("component_id")).alias("kept")
    return found.select(real("doc").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), kept)
