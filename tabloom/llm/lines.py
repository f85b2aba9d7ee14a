"""Operator 8: line deduplication that returns keep bitmaps.

Line keys are hashed (128 bits) and range-partitioned by hash, document and position, so even one line that stands in a
third of all documents is dealt over many tasks. Each sorted partition is streamed once for its runs of equal hashes;
only the runs at the edges of partitions (two a partition) can go on in the next one, and their counts are joined on
the driver. A second stream marks the lines to drop. What goes back to the documents is a compressed bitmap for each
document that loses lines, never text.

A document is a pair of doc_id and text: repeated rows count once and get the same result; rows without an id are told
apart by their text. A null or empty text is one empty line; keys shorter than `min_length` are never dropped; a
document that loses all lines has an empty text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import pin, row_key

MIN_DOCS = 10
MIN_LENGTH = 1
BLANKS = " \t\n\v\f\r"
_LINE = ["h1", "h2", "doc", "print", "pos"]


def text_print(text: str = "text") -> Column:
    return F.xxhash64(F.lit("text"), F.col(text))


def line_hashes(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """h1, h2 (hash of the key), doc, print, pos of every line whose key is long enough."""
    schema = "h1 long, h2 long, doc long, print long, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            digests, owner, pos = [], [], []

            def out() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                who = np.array(owner, dtype=np.int64)
                columns = [h[:, 0], h[:, 1], doc[who], prints[who], np.array(pos, dtype=np.int32)]
                return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=_LINE)

            for i, x in enumerate(batch.column(2)):
                for k, line in enumerate((x.as_py() or "").split("\n")):
                    key = line.strip(BLANKS)
                    if len(key) >= max(1, min_length):
                        lowered = key.encode("utf-8", "surrogatepass").lower()
                        digests.append(hashlib.blake2b(lowered, digest_size=16).digest())
                        owner.append(i)
                        pos.append(k)
                if len(pos) > 200_000:
                    yield out()
                    digests, owner, pos = [], [], []
            if pos:
                yield out()

    return docs.select(row_key(text=text), text_print(text), F.col(text)).mapInArrow(run, schema)


def _doc_starts(h1, h2, doc, prints) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted lines: places where a new hash begins, and whether a line is the first of its document there."""
    if not len(h1):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    run = np.ones(len(h1), dtype=bool)
    run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    fresh = run.copy()
    fresh[1:] |= (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1])
    return np.flatnonzero(run), fresh


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy() for i in range(batch.num_columns)]


def edge_runs(lines: DataFrame) -> DataFrame:
    """The first and the last run of each partition of sorted lines: hash, documents, first and last document."""
    names = ["part", "h1", "h2", "docs", "first_doc", "first_print", "last_doc", "last_print", "only", "last"]
    schema = ", ".join(f"{n} {'boolean' if n in ('only', 'last') else 'long'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # [h1, h2, docs, first doc, first print, last doc, last print]
        part = -1
        for batch in batches:
            h1, h2, doc, prints, _, parts = _columns(batch)
            if not len(h1):
                continue
            part = int(parts[0])
            starts, fresh = _doc_starts(h1, h2, doc, prints)
            sums = np.add.reduceat(fresh.astype(np.int64), starts)
            ends = np.append(starts[1:], len(h1)) - 1
            for k in sorted({0, len(starts) - 1}):
                a, z, n = starts[k], ends[k], int(sums[k])
                if last is not None and (last[0], last[1]) == (h1[a], h2[a]):
                    n -= (last[5], last[6]) == (doc[a], prints[a])
                    last[2] += n
                    last[5], last[6] = doc[z], prints[z]
                else:
                    last = [h1[a], h2[a], n, doc[a], prints[a], doc[z], prints[z]]
                    if first is None:
                        first = last
        if last is not None:
            rows = [first] if first is last else [first, last]
            values = [[part, *map(int, r), len(rows) == 1, r is last] for r in rows]
            kinds = [pa.bool_() if n in ("only", "last") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values), kinds)], names=names)

    return lines.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, schema)


def _joined(edges: list) -> dict[tuple[int, int], int]:
    """Documents of each run that goes over an edge, from the edge runs in order of the partitions."""
    totals: dict[tuple[int, int], int] = {}
    before = None
    for e in sorted(edges, key=lambda e: (e["part"], e["last"])):
        key = (e["h1"], e["h2"])
        again = before is not None and (before["h1"], before["h2"]) == key
        same = again and (before["last_doc"], before["last_print"]) == (e["first_doc"], e["first_print"])
        totals[key] = totals.get(key, 0) + e["docs"] - bool(same)
        before = e
    return totals


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """doc, print, pos of the lines to drop: those whose key stands in `min_docs` documents or more.

    With `keep_first` the first occurrence, by document and position, stays.
    """
    ordered = pin(lines.repartitionByRange(*_LINE).sortWithinPartitions(*_LINE))
    edges = sorted(edge_runs(ordered).collect(), key=lambda e: (e["part"], e["last"]))  # two rows a partition at most
    totals = _joined(edges)
    goes_on, previous = {}, None  # whether the first run of a partition began in an earlier one
    for e in edges:
        goes_on.setdefault(e["part"], previous == (e["h1"], e["h2"]))
        previous = (e["h1"], e["h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            h1, h2, doc, prints, pos, parts = _columns(batch)
            if not len(h1):
                continue
            starts, fresh = _doc_starts(h1, h2, doc, prints)
            ends = np.append(starts[1:], len(h1))
            sums = np.add.reduceat(fresh.astype(np.int64), starts)
            drop = np.repeat(sums >= min_docs, ends - starts)
            if keep_first:
                drop[starts] = False
            rows, found = (doc, prints, pos), []
            for k in sorted({0, len(starts) - 1}):  # runs that other batches may share
                part = slice(starts[k], ends[k])
                drop[part] = False
                key = (int(h1[starts[k]]), int(h2[starts[k]]))
                if now is None or now.key != key:
                    spare = keep_first and not (now is None and goes_on[int(parts[0])])
                    now = _Run(key, totals.get(key), spare, min_docs)
                found += now.add([c[part] for c in rows], int(sums[k]))
            found.append([c[drop] for c in rows])
            whole = [np.concatenate(c) for c in zip(*found)]
            if len(whole[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in whole], names=["doc", "print", "pos"])

    with_part = ordered.withColumn("part", F.spark_partition_id().cast("long"))
    return with_part.mapInArrow(run, "doc long, print long, pos int")


class _Run:
    """A run of equal hashes that arrives in parts. Its lines wait only until `min_docs` documents are seen."""

    def __init__(self, key: tuple[int, int], total: int | None, spare: bool, min_docs: int):
        self.key, self.spare, self.min_docs = key, spare, min_docs
        self.decided = None if total is None else total >= min_docs
        self.docs, self.last, self.waiting = 0, None, []

    def add(self, rows: list[np.ndarray], docs: int) -> list[list[np.ndarray]]:
        """The lines to drop that are known by now."""
        doc, prints, _ = rows
        self.docs += docs - (self.last == (doc[0], prints[0]))
        self.last = (doc[-1], prints[-1])
        if self.spare:
            rows, self.spare = [c[1:] for c in rows], False
        if self.decided is None and self.docs >= self.min_docs:
            self.decided = True
        if self.decided is None:
            self.waiting.append(rows)
            return []
        out, self.waiting = [*self.waiting, rows], []
        return out if self.decided else []


@F.pandas_udf(T.BinaryType())
def _bitmap(positions: pd.Series) -> pd.Series:
    def pack(dropped) -> bytes:
        keep = np.ones((int(max(dropped)) // 8 + 1) * 8, dtype=np.uint8)  # whole bytes, so padding keeps
        keep[np.asarray(dropped)] = 0
        return zlib.compress(np.packbits(keep).tobytes())

    return positions.map(pack)


def keep_bitmaps(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_length: int = MIN_LENGTH,
    keep_first: bool = False,
    text: str = "text",
) -> DataFrame:
    """doc, print and keep of the documents that lose lines. `keep` is a zlib-compressed bitmap, one bit a line up to
    the last dropped one, highest bit first."""
    gone = dropped_lines(line_hashes(docs, text, min_length), min_docs, keep_first)
    # Positions of one document, as many as it has lines at most; a set, since repeated rows give them again.
    grouped = gone.groupBy("doc", "print").agg(F.collect_set("pos").alias("gone"))
    return grouped.select("doc", "print", _bitmap("gone").alias("keep"))


_KEPT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
    ]
)


@F.pandas_udf(_KEPT)
def _keep(texts: pd.Series, bitmaps: pd.Series) -> pd.DataFrame:
    kept, total, dropped = [], [], []
    for x, bits in zip(texts, bitmaps):
        lines = (x or "").split("\n")
        total.append(len(lines))
        if bits is not None:
            keep = np.ones(len(lines), dtype=np.uint8)
            known = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype=np.uint8))[: len(lines)]
            keep[: len(known)] = known
            lines = [line for line, k in zip(lines, keep) if k]
        dropped.append(total[-1] - len(lines))
        kept.append("\n".join(lines) if x is not None else None)
    return pd.DataFrame({"text": kept, "n_lines": total, "n_dropped": dropped})


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` and a struct `__kept` of the text left, n_lines and n_dropped."""
    bits = bitmaps.withColumnsRenamed({"doc": "__doc", "print": "__print", "keep": "__keep"}).hint("shuffle_hash")
    keyed = docs.withColumns({"__doc": row_key(text=text), "__print": text_print(text)})
    joined = keyed.join(bits, ["__doc", "__print"], "left")
    return joined.withColumn("__kept", _keep(F.col(text), F.col("__keep"))).drop("__doc", "__print", "__keep")


def drop_repeated_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_length: int = MIN_LENGTH,
    keep_first: bool = False,
    text: str = "text",
) -> DataFrame:
    bitmaps = keep_bitmaps(docs, min_docs, min_length, keep_first, text)
    return apply_bitmaps(docs, bitmaps, text)
