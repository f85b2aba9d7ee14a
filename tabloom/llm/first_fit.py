"""Operator 11: first-fit decreasing packing with a tournament tree, in random groups of documents.

Tokenising cuts each document into whole sequences and a rest shorter than the capacity. Documents are dealt over
groups by a seeded draw that looks at no value of theirs, so neither a source, a key nor a group of copies makes a
large group; `GROUP_ROWS` rests are expected in one, which bounds the memory of a task whatever the table. Whole
sequences need no packing; they travel without their ids. Inside a group the rests are placed longest first, each into
the first sequence with room for it. A tournament tree over the free room of the sequences finds that one in
logarithmic time: each inner node holds the larger room of its two sides.

Documents may be cut, so the room that first fit leaves is then filled from the emptiest sequences, whose pieces are
cut at that. One sequence a group stays short; it is cut into sequences whose lengths are powers of two, which need
no padding. So nothing is padded if the capacity itself is a power of two.

Null texts count as empty: their only id is the closing one. Repeated rows are packed as often as they occur, null ids
are kept, an empty table gives no rows. Other columns are not read. Ties of length follow the draw. The draw goes by
the place of a row in its partition, so `docs` should be a stored table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import once_a_worker, share_file
from tabloom.llm.packing import WordTokens

CAPACITY = 2048
CLOSING = 1
#: Rests expected in a group; with two bytes an id a full group holds 16 MB.
GROUP_ROWS = 4096
SEED = 11

_CUT = pa.schema(
    [
        ("group", pa.int64()),
        ("draw", pa.float64()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.binary()),
    ]
)
_CUT_SQL = "group long, draw double, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PLACED = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
_PLACED_SQL = ", ".join(f"`{name}` long" for name in _PLACED.names)

#: A part of a piece: number of the piece, first id in it, number of ids.
Part = tuple[int, int, int]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Tournament:
    """Free room of numbered sequences; finds the first with enough of it."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << max(sequences - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """Number of the first sequence with room for `need`; there is one as long as an empty one is left."""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        return node - self.leaves

    def take(self, sequence: int, used: int) -> None:
        node, room = sequence + self.leaves, self.room
        room[node] -= used
        while node > 1:
            node //= 2
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger


def first_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each sequence; items are placed in the given order."""
    tree, out = Tournament(len(lengths), capacity), []
    for item, length in enumerate(lengths):
        at = tree.first(length)
        tree.take(at, length)
        if at == len(out):
            out.append([])
        out[at].append(item)
    return out


def fill_up(sequences: list[list[Part]], capacity: int) -> list[list[Part]]:
    """Fill free room with parts of the emptiest sequences; the last short one becomes powers of two."""
    fill = [sum(n for _, _, n in parts) for parts in sequences]
    order = sorted(range(len(sequences)), key=lambda i: -fill[i])
    i, j = 0, len(order) - 1
    while i < j:
        into, source = order[i], sequences[order[j]]
        room = capacity - fill[into]
        if not room:
            i += 1
            continue
        item, lo, n = source.pop()
        moved = min(room, n)
        sequences[into].append((item, lo, moved))
        fill[into] += moved
        fill[order[j]] -= moved
        if moved < n:
            source.append((item, lo + moved, n - moved))
        if not source:
            j -= 1
    whole = [sequences[k] for k in order[:i]]
    if not order:
        return whole
    rest, total = sequences[order[i]], fill[order[i]]
    if total == capacity:
        return [*whole, rest]
    for power in reversed(range(total.bit_length())):
        if total >> power & 1:
            size, part = 1 << power, []
            while size:
                item, lo, n = rest.pop(0)
                taken = min(size, n)
                part.append((item, lo, taken))
                size -= taken
                if taken < n:
                    rest.insert(0, (item, lo + taken, n - taken))
            whole.append(part)
    return whole


def pack_group(cut: pa.Table, capacity: int, wide: bool) -> pa.Table:
    """Places of all pieces of one group."""
    doc, start, length, crc, tokens = (
        cut.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    )
    ids, draw = cut.column("ids").to_pylist(), cut.column("draw").to_pylist()
    first_sequence = cut.column("group")[0].as_py() << 32
    # An order of its own, since rows come from a shuffle in any order.
    order = sorted(range(len(doc)), key=lambda i: (-length[i], draw[i], start[i]))
    whole = [i for i in order if ids[i] is None]
    rests = [i for i in order if ids[i] is not None]
    placed = first_fit([length[i] for i in rests], capacity)
    parts = fill_up([[(rests[k], 0, length[rests[k]]) for k in one] for one in placed], capacity)
    rows = []
    for number, sequence in enumerate([[(i, 0, length[i])] for i in whole] + parts):
        offset = 0
        for item, lo, n in sequence:
            if ids[item] is None:
                value = crc[item]
            else:
                value = checksum(np.frombuffer(ids[item], dtype="<u4" if wide else "<u2")[lo : lo + n])
            rows.append((doc[item], start[item] + lo, n, value, tokens[item], first_sequence + number, offset))
            offset += n
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PLACED)


def cut_documents(docs: DataFrame, path: str, groups: int, capacity: int, closing: int, text: str, wide: bool) -> DataFrame:
    """Whole sequences (without ids) and rests (with ids) of all documents, each with its group."""
    content, stamp = share_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = once_a_worker("word tokens", content, stamp, WordTokens)
        for batch in batches:
            keys, draws, done = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for ids, counts in tokens.encode(batch.column(2).to_pylist()):
                out, at = [], 0
                for key, draw, n in zip(keys[done:], draws[done:], counts.tolist()):
                    body = np.append(ids[at : at + n], closing)
                    own = int(draw * groups)
                    for lo in range(0, n + 1, capacity):
                        part = body[lo : lo + capacity]
                        kept = None if len(part) == capacity else part.astype("<u4" if wide else "<u2").tobytes()
                        value = checksum(part) if kept is None else None
                        # The whole sequences of a long document go to one group after the other.
                        group = (own + lo // capacity) % groups
                        out.append((group, draw, key, lo, len(part), value, n + 1, kept))
                    at += n
                done += len(counts)
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _CUT)]
                yield pa.RecordBatch.from_arrays(columns, schema=_CUT)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.rand(SEED).alias("draw"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, _CUT_SQL)


def largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def pack_first_fit(
    docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING, text: str = "text", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every document."""
    wide = max(largest_id(path), closing) > 0xFFFF
    groups = max(1, -(-docs.count() // group_rows))
    cut = cut_documents(docs, path, groups, capacity, closing, text, wide)
    return cut.groupBy("group").applyInArrow(lambda one: pack_group(one, capacity, wide), _PLACED_SQL)
