"""Operator 7: best-fit packing of tokenised documents into sequences of bounded length.

Lengths are whole numbers from 1 to the capacity, so documents of one length and gaps of one size are alike. Spark
counts the pieces of each length and ranks the pieces of a length. Rounds then go from the longest length down: all
pieces of the length are matched at once with their successor gaps (the smallest gaps that still hold them), which of
them get a gap is decided by rank, the gaps shrink, and pieces without a gap open new sequences. A round touches
classes of equal sequences, never single rows: there are at most two new classes a length, so the plan has a proven
bound (capacity squared rows, in practice a few a length) whatever the number of documents. Each piece finds its place
by length and rank in the broadcast plan. The outcome is that of best-fit decreasing.

Null texts count as empty: their only id is the closing one. Repeated rows are packed as often as they occur; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.arrays import chunks, flatten, ragged, span_hashes
from tabloom.llm.bpe import byte_letters
from tabloom.llm.common import dense_ranks, once_a_worker, pin, share_file
from tabloom.llm.pretokens import Known, pieces, simple

CAPACITY = 2048
CLOSING = 0


class WordTokens:
    """Ids of texts as the tokenizers library gives them for a lower-casing vocabulary that drops white space.

    Pieces do not influence each other, so the library's model encodes each distinct piece once. Texts with characters
    from U+0140 on or with names of special ids go through the library as a whole.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.known = Known()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo, hi in chunks(texts):
            part = [x or "" for x in texts[lo:hi]]
            raw = [x.lower().encode("utf-8", "surrogatepass") for x in part]
            hard = [i for i, (b, x) in enumerate(zip(raw, part)) if not simple(b) or any(s in x for s in self.special)]
            for i in hard:
                raw[i] = b""
            ids, counts = self._easy(raw)
            if hard:
                found = np.split(ids, np.cumsum(counts)[:-1])
                for i in hard:
                    found[i] = np.array(self.tokenizer.encode(part[i], add_special_tokens=False).ids, dtype=np.int32)
                    counts[i] = len(found[i])
                ids = np.concatenate(found)
            yield ids, counts

    def _easy(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf, starts = flatten(raw)
        s, e = pieces(buf, starts, bare=True)
        if not len(s):
            return np.zeros(0, dtype=np.int32), np.zeros(len(raw), dtype=np.int64)
        hashes, first, back = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
        if self.known.full:
            self.known.clear()
        row = self.known.rows(hashes)
        new = np.flatnonzero(row < 0)
        if new.size:
            written = buf.tobytes().decode("latin-1").translate(self.letters)
            spans = zip(s[first[new]].tolist(), e[first[new]].tolist())
            found = [[t.id for t in self.tokenizer.model.tokenize(written[a:b])] for a, b in spans]
            length = np.array([len(x) for x in found], dtype=np.int64)
            self.known.add(hashes[new], np.array([i for x in found for i in x], dtype=np.int32), length)
            row = self.known.rows(hashes)
        row = row[back]
        length = self.known.length[row]
        owner = np.searchsorted(starts, s, "right") - 1
        ids = self.known.pool[ragged(self.known.offset[row], length)]
        return ids, np.bincount(owner, weights=length, minlength=len(raw)).astype(np.int64)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of all pieces. Only documents over the capacity are cut."""
    content, stamp = share_file(docs.sparkSession, path)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = once_a_worker("word tokens", content, stamp, WordTokens)
        for batch in batches:
            keys, done = batch.column(0).to_pylist(), 0
            for ids, counts in tokens.encode(batch.column(1).to_pylist()):
                out, at = [], 0
                for key, n in zip(keys[done:], counts):
                    wire = np.append(ids[at : at + n], CLOSING).astype("<u4").tobytes()
                    for k, lo in enumerate(range(0, n + 1, capacity)):
                        hi = min(lo + capacity, n + 1)
                        out.append((key, k, lo, hi - lo, zlib.crc32(wire[4 * lo : 4 * hi])))
                    at += n
                done += len(counts)
                columns = zip(*out)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in schema.split(", ")]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema)


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, behind last rank, sequence of the first, offset) that place all counted pieces.

    Consecutive ranks of a row go to consecutive sequences at one offset. A class of sequences is a run of numbers with
    the same gap; `gaps` has the classes by gap size.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    opened, rows = 0, []
    for length in range(capacity, 0, -1):
        left, rank = counts.get(length, 0), 0
        size = length
        while left:
            while size <= capacity and not gaps[size]:
                size += 1
            if size > capacity:
                gaps[capacity - length].append((opened, left))
                rows.append((length, rank, rank + left, opened, 0))
                opened += left
                break
            first, n = gaps[size].pop()
            taken = min(n, left)
            if taken < n:
                gaps[size].append((first + taken, n - taken))
            gaps[size - length].append((first, taken))
            rows.append((length, rank, rank + taken, first, capacity - size))
            left, rank = left - taken, rank + taken
            size = length
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Pieces of all documents with sequence_id and offset in it."""
    spark = docs.sparkSession
    cut = pin(cut_pieces(docs, path, capacity, text))
    counted = cut.groupBy("length").count().collect()  # at most `capacity` rows
    plan = plan_sequences({r["length"]: r["count"] for r in counted}, capacity)
    names = "of_length long, rank_from long, rank_to long, first_sequence long, `offset` long"
    places = F.broadcast(spark.createDataFrame(plan, names))  # bounded by the capacity, not by the data
    ranked = dense_ranks(cut, "length", ["doc_id", "piece", "ids_crc32"], "rank")
    fits = (
        (F.col("length") == F.col("of_length"))
        & (F.col("rank") >= F.col("rank_from"))
        & (F.col("rank") < F.col("rank_to"))
    )
    sequence = F.col("first_sequence") + F.col("rank") - F.col("rank_from")
    return ranked.join(places, fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset"
    )
