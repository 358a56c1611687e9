"""Alignment of two tokenizers by interval coalescing.

Tokens of both sides are byte ranges of the same text. All ranges of a slice of
texts are sorted by start, then by side; ends run as a maximum; a group breaks
where a start reaches the running maximum. Inside the groups overlapping tokens
are expanded to pairs; a pair whose ranges end together is a link, and there is
one for each group.

Of two linked tokens the shorter one is an ending of the longer one, so the
number of linked id pairs is bounded by the vocabularies whatever the corpus
(:func:`pair_bound`); only that table of pairs, with its counts, is broadcast.
Texts are encoded once: links are written to the shared folder, counted, and read
again to be held against the counts.

A text has no tokens if it is null or empty or if the bytes of either side's
tokens differ from a space and the text; its numbers are zero, its digest empty.
Rows that repeat a ``doc_id`` each count and each get a row; further columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import token_blocks
from tallyfold.llm.common import documents, give_back, held_by_worker, map_texts, release_held, work_folder
from tallyfold.llm.pieces import PieceEncoder, parts_of, runs
from tallyfold.llm.spaced_units import MARK, splits_at_marks

SIDE_A = public_tokenizers.path("byte_bpe_50k.json")
SIDE_B = public_tokenizers.path("piece_bpe_32k.model")
MEMORY = 100_000
"""Strings whose ids a worker remembers, for each side."""
SLICE = 1 << 19
ROWS = 250
"""Texts whose links are held against the counts at once."""


class Spellings:
    """The bytes of every id of a vocabulary."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a row of ids."""
        length = self.length[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(length) - length), length)
        return self.flat[np.arange(len(shift)) + shift]


def spellings_a(path: str = SIDE_A) -> Spellings:
    """The byte-level alphabet undone; an entry with a character outside it stands for its UTF-8 bytes."""
    from tokenizers import Tokenizer

    alphabet = {chr(c): b for b, c in token_blocks.byte_alphabet().items()}
    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    spelled = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        spelled[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return Spellings(spelled)


def spellings_b(path: str = SIDE_B) -> Spellings:
    """Pieces in UTF-8 with a space for each mark; byte pieces are their byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    piece = [model.id_to_piece(i) for i in range(model.vocab_size())]
    return Spellings([bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(piece)])


def pair_bound(a: Spellings, b: Spellings) -> int:
    """How many id pairs can be linked at all: one spelling is an ending of the other."""
    from collections import Counter

    of_a, of_b = Counter(a.spelled), Counter(b.spelled)
    shorter_b = sum(n * of_b[x[i:]] for x, n in of_a.items() for i in range(len(x)))
    shorter_a = sum(n * of_a[x[i:]] for x, n in of_b.items() for i in range(1, len(x)))
    return shorter_a + shorter_b


def splits_at_kinds(pieces: list[str]) -> bool:
    """Whether no piece joins what :func:`runs` cuts, and none holds a line end beside anything."""
    found = [x.replace(MARK, " ") for x in pieces]
    return not any("\n" in x and len(x) > 1 for x in found) and not (runs(pa.array(found, pa.large_string()))[1] > 1).any()


class MarkedUnits(PieceEncoder):
    """Ids of a sentencepiece BPE model, by parts of texts with a space before each; an empty text is that space.

    No piece of the model holds a mark after another character (checked), so
    parts are encoded by themselves. Where no piece joins characters of
    different kinds either, so are their runs. A part that isn't cut into runs
    is asked whole.
    """

    def __init__(self, model, memory: int):
        learned = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if not splits_at_marks(learned):
            raise ValueError("pieces of this model reach across spaces")
        alone, before = [model.piece_to_id(MARK)], len(model.encode("\n"))

        def answer(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
            inner = [u[0] != " " for u in units]
            # the model puts a mark in front; a run inside a part goes behind a line end, whose ids are dropped
            found = model.encode(["\n" + u if x else u[1:] for u, x in zip(units, inner)], num_threads=1)
            if " " in units:
                found[units.index(" ")] = alone
            found = [ids[before:] if x else ids for ids, x in zip(found, inner)]
            count = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.int64, int(count.sum())), count

        super().__init__(answer, public_tokenizers.PATTERN, memory)
        common = "".join(chr(c) for c in range(0x21, 0x280))
        self.plain = splits_at_kinds(learned) and model.normalize(f"a\n{common}").removeprefix(MARK) == f"a\n{common}"

    def encode(self, texts: pa.Array, space: bool = True) -> tuple[np.ndarray, np.ndarray]:
        if not space:
            raise ValueError("the model puts a mark before each text")
        return super().encode(texts, space)

    def learn(self, units: list[str], whole: np.ndarray) -> np.ndarray:
        return super().learn(units, np.ones(len(units), bool))


class Sides:
    """Encoders and spellings of both sides."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.spelled_a = token_blocks.piece_encoder(a, MEMORY), spellings_a(a)
        self.b, self.spelled_b = MarkedUnits(SentencePieceProcessor(model_file=b), MEMORY), spellings_b(b)

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each side's ids of a space and each text, in a row, and how many each text has; texts are cut once for both."""
        parts = parts_of(texts, True, self.a.plain)
        return [self.a.of_parts(parts), self.b.of_parts(parts if self.b.plain == self.a.plain else parts_of(texts, True, self.b.plain))]


def sides(a: str, b: str) -> Sides:
    """This worker's encoders."""
    return held_by_worker(("alignment", a, b), lambda: Sides(a, b))


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each side's tokens' groups: ranges joined as long as one starts before the furthest end so far.

    Each side's ranges are in order and don't overlap among themselves.
    """
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.argsort(start, kind="stable")  # of equal starts the first side's comes first
    reached = np.maximum.accumulate(end[order])
    breaks = np.append(False, start[order][1:] >= reached[:-1])[:len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[:len(start_a)], group[len(start_a):]


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all overlapping ranges."""
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    count = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(start_a)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def spelled_right(ids: np.ndarray, count: np.ndarray, spelled: Spellings, want: pa.Array) -> np.ndarray:
    """Whether each row's ids, given in a row, spell just the bytes wanted."""
    size = pc.binary_length(want).to_numpy(zero_copy_only=False).astype(np.int64)
    length = spelled.length[ids]
    upto = np.append(0, np.cumsum(length))
    ends = np.cumsum(count)
    good = upto[ends] - upto[ends - count] == size
    own = spelled.of(ids[np.repeat(good, count)])
    text = np.frombuffer(b"".join(want.filter(pa.array(good)).cast(pa.large_binary()).to_pylist()), np.uint8)
    differ = np.flatnonzero(own != text)
    rows = np.flatnonzero(good)
    good[rows[np.searchsorted(np.cumsum(size[rows]), differ, "right")]] = False
    return good


@lru_cache(maxsize=4)
def numerals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each number below ``size`` as the first bytes of eight, and how many there are."""
    if size > 10 ** 7:
        raise ValueError("ids of more than seven digits")
    text = [b"%d" % i for i in range(size)]
    return np.frombuffer(b"".join(x.ljust(8, b"\0") for x in text), "<u8"), np.fromiter(map(len, text), np.int64, size)


def written(ids: np.ndarray, group: np.ndarray, side: np.ndarray, text: np.ndarray, texts: int) -> list[str]:
    """The digest of each text's groups, as ``a1,a2|b1;a3|b2,b3``; tokens come in that order. Empty without tokens."""
    if not len(ids):
        return [""] * texts
    cell, length = numerals(1 << int(ids.max()).bit_length())
    digits = length[ids]
    sign = np.full(len(ids), ord(","), np.uint64)
    sign[:-1][side[1:] != side[:-1]] = ord("|")
    sign[:-1][group[1:] != group[:-1]] = ord(";")
    cells = (cell[ids] | sign << (digits * 8).astype(np.uint64)).view(np.uint8)
    out, end = cells[cells != 0], np.cumsum(digits + 1)
    found = [""] * texts
    data = memoryview(out)
    cuts = np.flatnonzero(np.diff(text, prepend=-1))
    for i, a, b in zip(text[cuts].tolist(), (end[cuts] - digits[cuts] - 1).tolist(), end[np.append(cuts[1:], len(ids)) - 1].tolist()):
        found[i] = hashlib.sha256(data[a:b - 1]).hexdigest()
    return found


def pair_type(a: Spellings, b: Spellings) -> str:
    """The type that holds every ``a * size_b + b``."""
    return "int" if len(a.length) * len(b.length) < 1 << 31 else "bigint"


def aligned(docs: DataFrame, a: str = SIDE_A, b: str = SIDE_B) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``links`` (id pairs as ``a * size_b + b``, in order) and ``groups_sha256``."""
    kind = pair_type(spellings_a(a), spellings_b(b))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sides(a, b)
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        n = len(texts)
        wide = len(own.spelled_b.length)
        (ids_a, count_a), (ids_b, count_b) = own.encode(texts)
        want = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        good = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        good = good & spelled_right(ids_a, count_a, own.spelled_a, want) & spelled_right(ids_b, count_b, own.spelled_b, want)
        text_a, text_b = (np.repeat(np.arange(n), x) for x in (count_a, count_b))
        if not (good | (count_a + count_b == 0)).all():
            ids_a, text_a, ids_b, text_b = ids_a[good[text_a]], text_a[good[text_a]], ids_b[good[text_b]], text_b[good[text_b]]
        # both sides spell the same texts in a row, so a text's ranges never meet another's
        end_a, end_b = np.cumsum(own.spelled_a.length[ids_a]), np.cumsum(own.spelled_b.length[ids_b])
        start_a, start_b = end_a - own.spelled_a.length[ids_a], end_b - own.spelled_b.length[ids_b]
        group_a, group_b = coalesce(start_a, end_a, start_b, end_b)
        p, q = overlaps(start_a, end_a, start_b, end_b)
        linked = end_a[p] == end_b[q]
        p, q = p[linked], q[linked]
        per_text = np.bincount(text_a[p], minlength=n)
        order = np.argsort(np.concatenate([group_a, group_b]), kind="stable")  # A's tokens of a group come first
        sha = written(np.concatenate([ids_a, ids_b])[order], np.concatenate([group_a, group_b])[order],
                      np.repeat([0, 1], [len(ids_a), len(ids_b)])[order], np.concatenate([text_a, text_b])[order], n)
        first = np.flatnonzero(np.diff(group_a, prepend=-1))
        links = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_text)).astype(np.int32)), pa.array((ids_a[p].astype(np.int64) * wide + ids_b[q]).astype(np.int32 if kind == "int" else np.int64)))
        counts = [pa.array(np.bincount(x, minlength=n).astype(np.int64)) for x in (text_a, text_b, text_a[first])]
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, links, pa.array(sha)], names=["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"])
        give_back()
        return out

    return map_texts(documents(docs), work, f"doc_id long, n_a long, n_b long, n_groups long, links array<{kind}>, groups_sha256 string", limit=SLICE)


def pair_counts(rows: DataFrame, wide: int) -> DataFrame:
    """``pair``, ``n``, its links over all texts, and ``best``: no pair of the same B id has more."""
    pairs = rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("b", F.col("pair") % wide)
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a: str = SIDE_A, b: str = SIDE_B) -> DataFrame:
    """One row per text: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    spark = docs.sparkSession
    folder = f"{work_folder(spark)}/links"
    aligned(docs, a, b).write.parquet(folder)
    rows = spark.read.parquet(folder)
    side_a, side_b = spellings_a(a), spellings_b(b)
    table = pair_counts(rows, len(side_b.length)).toArrow()
    if table.num_rows > pair_bound(side_a, side_b):
        raise AssertionError("more linked pairs than the vocabularies allow")
    pair, n, best = (table.column(x).to_numpy(zero_copy_only=False) for x in ("pair", "n", "best"))
    order = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[order], n[order], best[order]))

    def held_against(batches):
        release_held()  # the encoders of the step before
        pair, n, best = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):  # links by the hundred thousand, not by the million
                batch = whole.slice(first, ROWS)
                links = batch.column("links")
                at = np.searchsorted(pair, links.flatten().to_numpy(zero_copy_only=False))
                size = pc.list_value_length(links).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(size)
                sums = [np.append(0, np.cumsum(x[at].astype(np.int64))) for x in (best, n)]
                own = [batch.column(x) for x in ("doc_id", "n_a", "n_b", "n_groups")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), *(pa.array(x[ends] - x[ends - size]) for x in sums), batch.column("groups_sha256")],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
        give_back()

    return rows.mapInArrow(held_against, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
