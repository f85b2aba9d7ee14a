"""Operator 12: how quality filters interact, from truth-table survival words and positional popcounts.

Five filters have 32 subsets. A document becomes a word of 32 bits: bit S is set if it fails no filter of the subset S
(bit i of S stands for filter i). A filter that a document fails clears the bits of all subsets that hold it, so the
word is the conjunction of one mask a failed filter. Counting the set bits of each position over all words tells how
many documents survive each subset, and these counts answer every question about any order of the filters.

Positions are counted inside tasks with carry-save adders: three words become one of sums and one of carries, level
by level, so a word takes part in about one addition instead of 32. Counts are kept for each part of the table, over
all documents and over those with each label; a task hands on 32 rows a part, which Spark adds up. Orders are worked
out from the counts alone.

Filter E (a copy of an earlier document) needs the smallest id of each text. Texts are compared by SHA-256. Texts with
more than a thousandth of all rows, at most a thousand texts, are looked up by a broadcast; all others are joined by
their hash, so no group of copies meets in one task.

Null texts count as empty, null parts as the empty string. Rows without an id fail filter E never, and no row because
of them; rows that share the smallest id of a text both stay. They have no labels. An id with several labels counts as
having each. An empty table has no parts and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import pin

LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
ALL = (1 << SUBSETS) - 1
#: A task hands on its counts when it holds this many parts.
PARTS = 10_000
SALTS = 1024

WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without(filter_number: int) -> int:
    """Mask of the subsets that leave a filter out."""
    return sum(1 << s for s in range(SUBSETS) if not s >> filter_number & 1)


def survival_word(fails: dict[str, Column]) -> Column:
    """Bits of the subsets that a document survives, from its failure of each named filter."""
    word = F.lit(ALL).cast("long")
    for letter, failed in fails.items():
        word = word.bitwiseAND(F.when(failed, F.lit(without(LETTERS.index(letter)))).otherwise(F.lit(ALL)).cast("long"))
    return word


def text_failures(text: str, words: str) -> dict[str, Column]:
    """Failure of the filters A to D, from a column of text and one of its words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < 200,
        "B": F.lit(100) * distinct < F.lit(50) * n,
        "C": F.lit(100).cast("long") * upper > F.lit(3).cast("long") * F.length(text),
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def survival_words(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """part, word, good and toxic of every document."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    split = slim.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    read = split.select(
        "doc", "part", F.unhex(F.sha2("text", 256)).alias("digest"), survival_word(text_failures("text", "words")).alias("word")
    )
    return with_labels(with_copies(pin(read)), labels)


def with_copies(read: DataFrame) -> DataFrame:
    """The words with filter E taken into account; `read` must be stored."""
    total = read.count()
    copied = read.where("doc is not null").groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    copied = copied.where("n > 1")
    often = F.col("n") * 1000 > total
    hot = F.broadcast(copied.where(often).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first")))
    rare = copied.where(~often).select(F.col("digest").alias("rare_digest"), F.col("first").alias("rare_first"))
    first = read.join(hot, F.col("digest") == F.col("hot_digest"), "left")
    # Rows that found their text in the broadcast look nothing up and are dealt by their id.
    looked = F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("doc"))))
    first = first.withColumn("looked", looked).join(rare, F.col("looked") == F.col("rare_digest"), "left")
    copy = F.coalesce(F.col("doc") > F.coalesce("hot_first", "rare_first"), F.lit(False))
    return first.select("doc", "part", F.col("word").bitwiseAND(survival_word({"E": copy})).alias("word"))


def with_labels(words: DataFrame, labels: DataFrame) -> DataFrame:
    """The words with the labels of their documents."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.bool_or(F.col("quality") == 1).alias("is_good"), F.bool_or(F.col("toxic") == 1).alias("is_toxic")
    )
    known = known.where("is_good or is_toxic").withColumn("of_salt", F.lit(0))
    # Rows without an id match nothing; the salt keeps them out of one task.
    salt = F.when(F.col("doc").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)
    joined = words.withColumn("salt", salt.cast("int")).join(
        known, (F.col("doc") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left"
    )
    flags = [F.coalesce(f"is_{c}", F.lit(False)).alias(c) for c in ("good", "toxic")]
    return joined.select("part", "word", *flags)


def positional_popcount(words: np.ndarray, bits: int = SUBSETS) -> np.ndarray:
    """How many words have each bit set, by carry-save addition."""
    counts, weight = np.zeros(bits, dtype=np.int64), 1
    places = np.arange(bits, dtype=np.uint32)
    while words.size:
        carries = []
        while words.size > 2:
            third = words.size // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            words = np.concatenate((odd ^ c, words[3 * third :]))
        counts += weight * (words[:, None] >> places & 1).sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def count_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, subset, n, good, toxic) of one task from rows (part, word, good, toxic)."""
    held: dict[str, np.ndarray] = {}

    def hand_on() -> pa.RecordBatch:
        found = np.concatenate([np.zeros((0, 3), dtype=np.int64), *(c.T for c in held.values())])
        names = pa.array([p for p in held for _ in range(SUBSETS)], pa.string())
        subset = pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held)))
        return pa.RecordBatch.from_arrays(
            [names, subset, *(pa.array(found[:, k]) for k in range(3))], names=["part", "subset", "n", "good", "toxic"]
        )

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        word = batch.column(1).to_numpy().astype(np.uint32)[order]
        flags = [batch.column(k).to_numpy(zero_copy_only=False).astype(bool)[order] for k in (2, 3)]
        ends = np.cumsum(np.bincount(code, minlength=len(names)))
        for name, lo, hi in zip(names, [0, *ends[:-1]], ends):
            own = word[lo:hi]
            counts = [positional_popcount(own), *(positional_popcount(own[f[lo:hi]]) for f in flags)]
            held[name] = held.get(name, 0) + np.array(counts)
        if len(held) > PARTS:
            yield hand_on()
            held.clear()
    yield hand_on()


def subset_survivors(words: DataFrame) -> DataFrame:
    """For each part an array over the subsets, in order, of the documents that survive: all, good and toxic ones."""
    counted = words.mapInArrow(count_positions, "part string, subset int, n long, good long, toxic long")
    added = counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    rows = F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic")))  # one a subset
    return added.groupBy("part").agg(rows.alias("left"))


def _orders() -> list[dict]:
    """Every step of every order, with the subsets before and after it."""
    out = []
    for order in itertools.permutations(range(len(LETTERS))):
        before = 0
        for step, number in enumerate(order, 1):
            after = before | 1 << number
            out.append(
                {"filter_order": "".join(LETTERS[i] for i in order), "step": step, "number": number, "before": before, "after": after}
            )
            before = after
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """One row per part, order and step with the counts of the step's filter."""
    survivors = subset_survivors(survival_words(docs, labels, part, text))

    def left(subset, field: str = "n") -> Column:
        return F.get("left", subset if isinstance(subset, Column) else F.lit(subset))[field]

    def shared(number: int) -> Column:
        """Documents that a filter removes, over all orders: each subset before it stands for as many orders."""
        others = len(LETTERS) - 1
        total = F.lit(0).cast("long")
        for s in range(SUBSETS):
            if not s >> number & 1:
                orders = factorial(s.bit_count()) * factorial(others - s.bit_count())
                total = total + F.lit(orders) * (left(s) - left(s | 1 << number))
        return total

    figures = survivors.withColumn("shapley", F.array(*[shared(i) for i in range(len(LETTERS))]))
    kind = "array<struct<filter_order: string, step: int, number: int, before: int, after: int>>"
    steps = figures.select("part", "left", "shapley", F.inline(F.from_json(F.lit(json.dumps(_orders())), kind)))
    single = F.get(F.array(*[F.lit(1 << i) for i in range(len(LETTERS))]), F.col("number"))
    full = SUBSETS - 1
    before, after = F.col("before"), F.col("after")
    removed = left(before) - left(after)
    return steps.select(
        "part",
        "filter_order",
        "step",
        left(after).alias("kept"),
        removed.alias("removed"),
        (left(0) - left(single) - removed).alias("redundant"),
        (left(F.lit(full) - single) - left(full)).alias("unique_fails"),
        (left(before, "good") - left(after, "good")).alias("good_lost"),
        (left(before, "toxic") - left(after, "toxic")).alias("toxic_lost"),
        F.get("shapley", F.col("number")).alias("shapley"),
    )
