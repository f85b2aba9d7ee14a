"""Operator 10: byte-level BPE encoding and decoding.

A piece of text starts as its bytes. A segment tree over adjacent pairs holds at each leaf the rank of the pair that
begins there; its root is the leftmost pair of lowest rank. Merging changes three leaves and the paths above them, and
goes on until no pair of the vocabulary is left. Many pieces are merged side by side, one tree a row of a numpy table;
pieces met before in the same worker are looked up in a table of bounded size.

Null texts count as empty; an empty text has no ids. Texts may be of any length, also without white space. Repeated
rows give equal results. The vocabulary is read on the driver from a path given as parameter and broadcast: its size
does not depend on the data. Ids outside the vocabulary cannot occur.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.arrays import chunks, flatten, ragged, span_hashes
from tabloom.llm.common import once_a_worker, share_file
from tabloom.llm.pretokens import Known, pieces, simple

NONE = np.int64(1 << 62)
CELLS = 1 << 21


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids, merges and bytes of a byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, content: str):
        model = json.loads(content)
        vocab = dict(model["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        names: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        names.update({i: t.encode() for t, i in self.special.items()})
        spelled = [names.get(i, b"") for i in range(max(names) + 1)]
        self.spell_length = np.array([len(b) for b in spelled], dtype=np.int64)
        self.spell_start = np.cumsum(self.spell_length) - self.spell_length
        self.spelling = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE; a negative symbol pairs with nothing."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], NONE)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merge each row of a table of ids (-1 behind the end) as far as it goes; merged-away places become -1."""
        rows, width = symbols.shape
        wide = np.full((rows, width + 2), -1, dtype=np.int64)
        wide[:, :width] = symbols
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        before = np.tile(np.arange(-1, width + 1), (rows, 1))
        place = np.arange(width)
        tree = np.full((rows, 2 * width), NONE)
        ranks = self.rank(wide[:, :width].ravel(), wide[:, 1 : width + 1].ravel()).reshape(rows, width)
        tree[:, width:] = np.where(ranks == NONE, NONE, ranks << 32 | place)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        live = np.flatnonzero(tree[:, 1] != NONE)
        while live.size:
            top = tree[live, 1]
            at = top & 0xFFFFFFFF
            gone = after[live, at]
            right = after[live, gone]
            left = before[live, at]
            new = self.merged[top >> 32]
            wide[live, at], wide[live, gone] = new, -1
            after[live, at] = right
            before[live, right] = at
            follow = self.rank(new, wide[live, right])
            lead = self.rank(np.where(left < 0, -1, wide[live, left]), new)
            tree[live, width + gone] = NONE
            tree[live, width + at] = np.where(follow == NONE, NONE, follow << 32 | at)
            some = left >= 0
            tree[live[some], width + left[some]] = np.where(lead == NONE, NONE, lead << 32 | left)[some]
            row = np.concatenate((live, live, live[some]))
            node = np.concatenate((width + at, width + gone, width + left[some])) // 2
            for _ in range(width.bit_length() - 1):
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node = node // 2
            live = live[tree[live, 1] != NONE]
        return wide[:, :width]

    def encode_spans(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans one after the other, and how many each span has."""
        size = end - start
        counts = np.ones(len(start), dtype=np.int64)
        width = np.where(size <= 1, 1, 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.unique(width):
            of_width = np.flatnonzero(width == w)
            step = max(1, CELLS // int(w))
            for lo in range(0, len(of_width), step):
                pick = of_width[lo : lo + step]
                cell = np.arange(int(w))
                inside = cell < size[pick, None]
                table = np.where(inside, self.first[buf[np.where(inside, start[pick, None] + cell, 0)]], -1)
                if w > 1:
                    table = self.merge(table)
                counts[pick] = (table >= 0).sum(axis=1)
                done.append((pick, table[table >= 0]))
        flat = np.zeros(int(counts.sum()), dtype=np.int64)
        offset = np.cumsum(counts) - counts
        for pick, ids in done:
            flat[ragged(offset[pick], counts[pick])] = ids
        return flat, counts

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after the other, and how many each id has."""
        length = self.spell_length[ids]
        return self.spelling[ragged(self.spell_start[ids], length)], length


PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Encoder:
    """Encodes lists of texts; keeps the ids of pieces between calls."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known = Known()
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each chunk of texts the ids of all, one after the other, and the number of ids of each."""
        for lo, hi in chunks(texts):
            part = [x or "" for x in texts[lo:hi]]
            raw = [x.encode("utf-8", "surrogatepass") for x in part]
            named = list(self.vocabulary.special)
            easy = np.array([simple(b) and not any(s in x for s in named) for b, x in zip(raw, part)], dtype=bool)
            if easy.all():
                yield self._easy(raw)
                continue
            counts = np.zeros(len(part), dtype=np.int64)
            found: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(part)
            for which, run in ((np.flatnonzero(easy), self._easy), (np.flatnonzero(~easy), self._general)):
                if which.size:
                    ids, n = run([raw[i] for i in which])
                    counts[which] = n
                    for i, x in zip(which, np.split(ids, np.cumsum(n)[:-1])):
                        found[i] = x
            yield np.concatenate(found), counts

    def _easy(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf, starts = flatten(raw)
        s, e = pieces(buf, starts, bare=False)
        return self._ids(buf, s, e, np.searchsorted(starts, s, "right") - 1, len(raw))

    def _general(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Texts with any characters or with names of special ids, which stay whole."""
        bits, owner = [], []
        for i, b in enumerate(raw):
            text = b.decode("utf-8", "surrogatepass")
            for k, span in enumerate(self.special.split(text) if self.special else [text]):
                own = [span] if k % 2 else PATTERN.findall(span)
                bits += [x.encode("utf-8", "surrogatepass") for x in own]
                owner += [i] * len(own)
        buf, starts = flatten(bits)
        return self._ids(buf, starts[:-1], starts[1:] - 1, np.array(owner, dtype=np.int64), len(raw))

    def _ids(self, buf, s, e, owner, n) -> tuple[np.ndarray, np.ndarray]:
        if not len(s):
            return np.zeros(0, dtype=np.int32), np.zeros(n, dtype=np.int64)
        hashes, first, back = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
        if self.known.full:
            self.known.clear()
        row = self.known.rows(hashes)
        new = np.flatnonzero(row < 0)
        if new.size:
            flat, counts = self.vocabulary.encode_spans(buf, s[first[new]], e[first[new]])
            self.known.add(hashes[new], flat, counts)
            self._name(buf, s[first[new]], e[first[new]], len(self.known.offset) - len(new))
            row = self.known.rows(hashes)
        row = row[back]
        length = self.known.length[row]
        ids = self.known.pool[ragged(self.known.offset[row], length)]
        return ids, np.bincount(owner, weights=length, minlength=n).astype(np.int64)

    def _name(self, buf, s, e, base) -> None:
        """Give new pieces that are names of special ids their one id."""
        for name, number in self.vocabulary.special.items():
            spelled = name.encode()
            for k in np.flatnonzero(e - s == len(spelled)):
                if buf[s[k] : e[k]].tobytes() == spelled:
                    self.known.pool[self.known.offset[base + k]] = number
                    self.known.length[base + k] = 1


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """All columns but `text` that are named doc_id, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids
    (array of int) and decoded (string). One row for each row, without a shuffle."""
    vocabulary, stamp = share_file(docs.sparkSession, path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_a_worker("bpe", vocabulary, stamp, lambda content: Encoder(Vocabulary(content)))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            done = 0
            for ids, counts in encoder.encode(texts):
                ends = np.cumsum(counts)
                spelled, length = encoder.vocabulary.decode_bytes(ids)
                edges = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], ends))]
                wire, spelled = ids.astype("<u4").tobytes(), spelled.tobytes()
                decoded = [spelled[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])]
                spans = list(zip(ends - counts, ends))
                columns = [
                    keys.slice(done, len(counts)),
                    pa.array(counts),
                    pa.array([hashlib.sha256(wire[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if keep_ids:
                    columns.append(pa.array([ids[a:b] for a, b in spans], pa.list_(pa.int32())))
                    columns.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
                done += len(counts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema)
