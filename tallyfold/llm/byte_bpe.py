"""Byte-level BPE by corpus-level merge replay.

The texts of a slice are split into pieces; each distinct piece not met before
goes into one flat array of symbols. An inverted index leads from the rank of
an adjacent pair to its positions. Ranks are replayed in order; each applies its
merge at all positions at once and puts only the pairs of the touched
neighbours into the index. Pieces met before come from a bounded memory that a
worker keeps.

A null text is an empty one and has no ids; decoding gives its bytes back. Rows
that repeat a ``doc_id`` each get a row.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import documents, give_back, held_by_worker, map_texts
from tallyfold.llm.pieces import PieceEncoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MEMORY = 400_000
"""Strings whose ids a worker remembers."""
SLICE = 2 << 20
"""Bytes of text that are encoded at once."""
STEP = 1 << 17
"""Pairs that go into the index of a replay at once."""


class Ranks:
    """A rank file: byte strings by id, and merges by pair of ids."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        pairs = [(ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.room = max(10, (4 * len(pairs)).bit_length())
        self.keys, self.merged = np.full(1 << self.room, -1, np.int64), np.full(1 << self.room, -1, np.int64)
        key, merged = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        while len(key):  # open addressing: whoever lost its slot tries the next
            slot = self.slot(key)
            free = self.keys[slot] < 0
            while not free.all():
                slot = np.where(free, slot, (slot + 1) & (len(self.keys) - 1))
                free = self.keys[slot] < 0
            self.keys[slot], self.merged[slot] = key, merged
            lost = self.keys[slot] != key
            key, merged = key[lost], merged[lost]
        length = np.array([len(x) for x in self.bytes], np.int64)
        self.length, self.start = length, np.cumsum(length) - length
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, -1 where it doesn't merge."""
        key = left * self.size + right
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.merged[slot], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def slot(self, key: np.ndarray) -> np.ndarray:
        """First slot of a key in the table of pairs."""
        return ((key * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> (63 - self.room)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        length = self.length[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(length) - length), length)
        return self.flat[np.arange(len(shift)) + shift]

    def scalar(self, piece: bytes) -> list[int]:
        """The ids of one piece, merge by merge; for the pieces that a replay in rank order can't decide."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self.size), i) for i in range(len(parts) - 1))
            if rank == self.size:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


def replay(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces in a row, and how many each has. Pieces aren't empty."""
    whole = np.fromiter((ranks.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
    todo = np.flatnonzero(whole < 0)
    text = [pieces[i] for i in todo]
    length = np.fromiter(map(len, text), np.int64, len(text))
    n, ends = int(length.sum()), np.cumsum(length)
    owner = np.repeat(np.arange(len(text)), length)
    # one slot more, so that "none" (n, or -1) can be read and written
    symbol = np.append(ranks.single[np.frombuffer(b"".join(text), np.uint8)], -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1], before[ends - length] = n, -1
    pair = np.full(n + 1, -1, np.int64)  # the rank of the pair that begins here
    alive, mark = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    odd: list[np.ndarray] = []
    narrow = np.uint16 if ranks.size <= 1 << 16 else np.int64
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(at: np.ndarray, current: int) -> None:
        """Put the pairs that begin at ``at`` into the index."""
        rank = np.where(after[at] < n, ranks.of_pairs(symbol[at], symbol[after[at]]), -1)
        pair[at] = rank
        early = (rank >= 0) & (rank <= current)
        if early.any():  # its turn has passed: such a piece is done by itself
            odd.append(owner[at[early]])
        good = rank > current
        at, rank = at[good], rank[good]
        if not len(at):
            return
        order = np.argsort(rank.astype(narrow), kind="stable")  # 16 bits sort by radix
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
        for r, lo, hi in zip(rank[cuts].tolist(), cuts, [*cuts[1:], len(at)]):
            if r in index:
                index[r].append(at[lo:hi])
            else:
                index[r] = [at[lo:hi]]
                heapq.heappush(heap, r)

    for a in range(0, n, STEP):  # what a look-up of pairs needs besides is many times the pairs
        note(np.arange(a, min(a + STEP, n)), -1)
    while heap:
        r = heapq.heappop(heap)
        at = np.sort(np.concatenate(index.pop(r)))
        at = at[alive[at] & (pair[at] == r) & np.append(True, at[1:] != at[:-1])]
        if not len(at):
            continue
        joined = np.append(False, after[at[:-1]] == at[1:])
        if joined.any():
            # pairs that overlap, as in a run of one symbol: every other one from the left
            first = np.flatnonzero(~joined)
            at = at[(np.arange(len(at)) - first[np.cumsum(~joined) - 1]) % 2 == 0]
        gone = after[at]
        symbol[at] = r
        alive[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        left = before[at]
        left = left[left >= 0]
        mark[at] = True
        left = left[~mark[left]]
        mark[at] = False
        note(np.concatenate([left, at]), r)
    keep = alive[:n]
    count = np.ones(len(pieces), np.int64)
    count[todo] = np.bincount(owner[keep], minlength=len(text))
    out = np.empty(int(count.sum()), np.int64)
    slow = np.repeat(whole < 0, count)
    out[slow] = symbol[:n][keep]
    out[~slow] = whole[whole >= 0]
    if not odd:
        return out, count
    mend = {int(todo[k]): ranks.scalar(text[k]) for k in np.unique(np.concatenate(odd)).tolist()}
    each = [mend.get(i, x) for i, x in enumerate(np.split(out, np.cumsum(count)[:-1]))]
    return np.concatenate([np.asarray(x, np.int64) for x in each]), np.array([len(x) for x in each], np.int64)


def encoder(path: str, pattern: str) -> tuple[Ranks, PieceEncoder]:
    """This worker's ranks and encoder."""

    def build():
        ranks = Ranks(path)
        return ranks, PieceEncoder(lambda pieces: replay([p.encode() for p in pieces], ranks), pattern, MEMORY)

    return held_by_worker(("byte_bpe", path, pattern), build)


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text; with ``decoded`` also the bytes that the ids decode to."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks, pieces = encoder(path, pattern)
        flat, count = pieces.encode(batch.column("text"))
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(flat, pa.int32()))
        columns = {"doc_id": batch.column("doc_id"), "ids": ids}
        if decoded:
            columns["decoded"] = decode_lists(ids, ranks)
        give_back()
        return pa.RecordBatch.from_pydict(columns)

    return map_texts(documents(docs), work, "doc_id long, ids array<int>" + ", decoded binary" * decoded, limit=SLICE)


def decode_lists(ids: pa.ListArray, ranks: Ranks) -> pa.Array:
    """The bytes of each list of ids; a null list has none."""
    return pa.array([ranks.decode(np.asarray(x.values, np.int64)).tobytes() if x.is_valid else b"" for x in ids], pa.binary())


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """All columns and ``decoded``, the bytes of ``ids``; null ids decode to no bytes."""
    from pyspark.sql.types import BinaryType, StructType

    def run(batches):
        ranks = encoder(path, public_tokenizers.PATTERN)[0]
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                yield pa.RecordBatch.from_arrays([*batch.columns, decode_lists(batch.column("ids"), ranks)], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", BinaryType()))


def token_digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text, encoded and decoded again."""
    both = encode(docs, path, decoded=True)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
