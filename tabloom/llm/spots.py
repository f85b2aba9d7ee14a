"""Operator 2: SpotSigs fingerprints, with DataFrame functions only.

A spot is a common word (the anchor); its signature is the anchor with the chain of the next three content words. The
fingerprint of a text is the set of its signatures. The j-th anchor at word i has i - j content words before it, so a
chain is three lookups in the array of content words. Texts without a spot take their words one by one, texts without
a word themselves as a whole; a null or empty text has no signature. Two empty fingerprints are alike (1.0).

`similar_pairs` compares fingerprints of a corpus: they are partitioned by set length so that two sets of Jaccard
`threshold` lie in one or in neighbouring partitions; inside, a pair must share one of its rarest signatures, and pairs
that their lengths or places rule out are pruned before the intersection is computed.

Rows are put in order by id and, for repeated ids, by text; null ids come first. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import pin

#: Anchors: common words of English, German, French and Spanish.
ANCHORS = (
    "the a an of and to in is are was were be by for with that this it as at on or from not have has had which "
    "der die das und ist ein eine den dem des von zu mit im für auf nicht sich auch als "
    "le la les un une de du et est en que qui dans pour par sur pas avec "
    "el los las y es una uno con por para del al se su lo como más"
).split()
CHAIN = 3
STEP = 512
FEW = 4096


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted distinct signatures (32-bit hashes) of `text` as column `name`."""
    base = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.lower(base), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = rows.withColumn("__words", words)
    marked = F.transform("__words", lambda w, i: F.struct(w.alias("w"), i.alias("i"), w.isin(ANCHORS).alias("s")))
    rows = rows.withColumn("__marked", marked)
    rows = rows.withColumns(
        {
            "__content": F.transform(F.filter("__marked", lambda m: ~m.s), lambda m: m.w),
            "__anchors": F.filter("__marked", lambda m: m.s),
        }
    )

    def signature(anchor: Column, j: Column) -> Column:
        first = anchor.i - j
        chain = [F.get(F.col("__content"), first + k) for k in range(CHAIN)]
        return F.when(chain[0].isNotNull(), F.hash(anchor.w, *chain))

    spots = F.filter(F.transform("__anchors", signature), lambda s: s.isNotNull())
    rows = rows.withColumn("__spots", spots)
    single = F.when(F.size("__words") > 0, F.transform("__words", lambda w: F.hash(w)))
    whole = F.when(base != "", F.array(F.hash(base))).otherwise(F.array().cast("array<int>"))
    found = F.when(F.size("__spots") > 0, F.col("__spots")).otherwise(F.coalesce(single, whole))
    rows = rows.withColumn(name, F.array_sort(F.array_distinct(found)))
    return rows.drop("__words", "__marked", "__content", "__anchors", "__spots")


def printed(signatures: str) -> Column:
    """The fingerprint as a string: the signatures in hexadecimal, in order."""
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)))), ".")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def successors(keys: DataFrame) -> DataFrame:
    """(key, next): the next larger one of distinct long keys, null for the largest; no task gets all keys.

    Keys are put in groups of `STEP` neighbouring values; the first key of the next group comes from the same question
    about the groups.
    """
    keys = pin(keys.select("key"))
    if keys.count() <= FEW:
        return keys.withColumn("next", F.lead("key").over(Window.orderBy("key")))  # at most FEW rows
    keys = keys.withColumn("group", F.floor(F.col("key") / STEP).cast("long"))
    heads = pin(keys.groupBy("group").agg(F.min("key").alias("head")))
    after = successors(heads.select(F.col("group").alias("key")))
    follow = after.join(heads, after["next"] == heads["group"]).select(F.col("key").alias("group"), "head")
    inside = F.lead("key").over(Window.partitionBy("group").orderBy("key"))
    known = keys.withColumn("inside", inside).join(follow, "group", "left")
    return known.select("key", F.coalesce("inside", "head").alias("next"))


def with_next(rows: DataFrame, columns: list[str], order: list[str], key: str = "doc_id") -> DataFrame:
    """Add next_<column> of the next row by `order`, which begins with `key`; the last row is followed by the first.

    Rows are dealt by blocks of neighbouring ids; the last row of a block looks up the first row of the next one.
    """
    block = F.coalesce(F.floor(F.col(key) / STEP).cast("long"), F.lit(-(1 << 62)))
    dealt = rows.withColumn("__block", block)
    following = pin(successors(dealt.select(F.col("__block").alias("key")).distinct()))
    first = following.agg(F.min("key").alias("first"))
    following = following.crossJoin(F.broadcast(first)).select(  # one row
        F.coalesce("next", "first").alias("__head"), F.col("key").alias("__before")
    )
    in_block = Window.partitionBy("__block").orderBy(*order)
    whole = F.struct(*columns)
    heads = dealt.select("__block", *order, whole.alias("__first")).withColumn("__n", F.row_number().over(in_block))
    heads = heads.where("__n = 1").select(F.col("__block").alias("__head"), "__first")
    heads = heads.join(following, "__head").select(F.col("__before").alias("__block"), "__first")
    led = dealt.withColumn("__next", F.lead(whole).over(in_block))
    led = led.join(heads, "__block", "left").withColumn("__next", F.coalesce("__next", "__first"))
    return led.withColumns({f"next_{c}": F.col(f"__next.{c}") for c in columns}).drop("__block", "__next", "__first")


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited text, signatures of the text, of the edited and of the next text of each row."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_signatures(rows, "text", "signatures")
    rows = with_next(rows, ["text", "signatures"], ["doc_id", "text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signatures", "next_signatures"
    )
    return with_signatures(rows, "edited", "edited_signatures")


def length_partition(size: Column, threshold: float) -> Column:
    """Number of the partition of a set length; borders grow by the largest ratio that two similar sets can have."""
    return F.floor(F.log(size.cast("double")) / math.log(1 / threshold)).cast("int")


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, jaccard) with a < b of all pairs of rows (id, signatures) that are similar enough.

    Equal fingerprints are compared once: ids are the smallest of each class of equal sets.
    """
    classes = prints.where(F.size("signatures") > 0).groupBy("signatures").agg(F.min("id").alias("id"))
    classes = pin(classes.withColumn("n", F.size("signatures")))
    posted = classes.select("id", "n", F.explode("signatures").alias("s"))
    often = posted.groupBy("s").agg(F.count("*").alias("times"))
    placed = F.row_number().over(Window.partitionBy("id").orderBy("times", "s"))
    posted = posted.join(often, "s").withColumn("place", placed)
    part = length_partition(F.col("n"), threshold)
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefix = pin(posted.where((F.col("times") > 1) & (F.col("place") <= keep)).withColumn("part", part))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"), "s", "part")
    right = prefix.select(
        F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("p_b"), "s", F.col("part").alias("of_b")
    ).withColumn("part", F.explode(F.array(F.col("of_b"), F.col("of_b") - 1, F.col("of_b") + 1)))
    most = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) + F.least("p_a", "p_b")
    enough = (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9
    met = left.join(right, ["s", "part"]).where((F.col("a") < F.col("b")) & (most >= enough))
    pairs = met.select("a", "b").distinct()
    a = classes.select(F.col("id").alias("a"), F.col("signatures").alias("sig_a"))
    b = classes.select(F.col("id").alias("b"), F.col("signatures").alias("sig_b"))
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", likeness("sig_a", "sig_b").alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold)
