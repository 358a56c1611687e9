"""Token counts of every prefix by dynamic programming.

The model's merges give a row of pieces that is the encoding of its text just if
every two neighbours are the encoding of what they spell: a merge across a
border would be the first one in those two pieces as well. So the encoding of a
prefix is that of a shorter prefix and one piece that goes with the piece before
it, and exactly one piece does. For each character of a unit the table holds the
piece that the prefix ends with, found among its endings by the pairs that go
together, and the count; a prefix's count is one more than that of the prefix its
last piece leaves. A character without a piece counts its bytes.

The counts of all prefixes answer how many tokens the first characters have
(:func:`tokens_of_prefix`) and where to cut a text for a budget
(:func:`longest_prefix`) without encoding anything again.

A null text is an empty one and has no tokens. Rows that repeat a ``doc_id`` each
get a row; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import documents, give_back, held_by_worker, map_texts
from tallyfold.llm.spaced_units import MARK, SpacedUnits, splits_at_marks

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
MEMORY = 400_000
"""Units whose prefix counts a worker remembers."""
PAIRS = 1 << 19
"""Pairs of pieces whose fit a worker remembers."""
SLICE = 4 << 20
_NONE: dict[str, bool] = {}


class PrefixTable:
    """The prefix counts of units under a sentencepiece BPE model with byte fallback and plain normalisation."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in usual}
        if not splits_at_marks(list(self.score)):
            raise ValueError("pieces of this model reach across spaces")
        # every ending of a piece: 0 if it isn't a piece itself, 1 for a piece, 2 for one that is the encoding of its text
        self.kind = dict.fromkeys((p[i:] for p in self.score for i in range(len(p))), 0)
        self.kind.update((p, 2 if self.merged(p) == [p] else 1) for p in self.score)
        self.inside = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        self.mates: dict[str, dict[str, bool]] = {}
        self.pairs = 0

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by its merges: the best score first, then the leftmost place."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces are the encoding of what they spell."""
        found = self.merged(left + right) == [left, right]
        self.mates.setdefault(left, {})[right] = found
        self.pairs += 1
        return found

    def answer(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each prefix of each unit, in a row, and how many prefixes each has.

        Units go in alphabetical order: what one shares with the one before it is there already.
        """
        out: dict[str, np.ndarray] = {}
        before = ""
        # by prefix: its tokens, its last piece, where the last border is that no piece reaches across
        total, last, cuts = [0], [""], [0]
        for unit in sorted(units):
            same = 0
            for x, y in zip(before, unit):
                if x != y:
                    break
                same += 1
            del total[same + 1:], last[same + 1:], cuts[same + 1:]
            if self.pairs > PAIRS:
                self.mates, self.pairs = {}, 0
            self._extend(unit, total, last, cuts)
            out[unit] = np.array(total[1:], np.int32)
            before = unit
        return np.concatenate([out[x] for x in units]), np.fromiter((len(out[x]) for x in units), np.int64, len(units))

    def _extend(self, unit: str, total: list[int], last: list[str], cuts: list[int]) -> None:
        kind, inside, mates = self.kind, self.inside, self.mates
        for end in range(len(total), len(unit) + 1):
            cut = cuts[end - 1]
            if end > 1 and unit[end - 2:end] not in inside:
                cut = end - 1
            cuts.append(cut)
            for start in range(end - 1, cut - 1, -1):
                piece = unit[start:end]
                known = kind.get(piece)
                if known is None and start < end - 1:
                    break  # nothing longer ends like this
                if not known and start < end - 1:
                    continue
                if start == cut:
                    good = known == 2 or not known
                else:
                    good = mates.get(last[start], _NONE).get(piece)
                    if good is None:
                        good = self.fits(last[start], piece)
                if good:
                    total.append(total[start] + (1 if known else len(piece.encode())))
                    last.append(piece)
                    break
            if len(total) <= end:
                raise ValueError(f"no last piece for {unit[:end]!r}")


def encoder(path: str) -> SpacedUnits:
    """This worker's units with their prefix counts."""
    return held_by_worker(("prefix_counts", path), lambda: SpacedUnits(PrefixTable(path).answer, MEMORY))


def totals(units: SpacedUnits, places: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The count at the last prefix of each text."""
    known = units.known
    last = known.flat[np.maximum(known.start + known.count - 1, 0)][places].astype(np.int64)
    upto = np.append(0, np.cumsum(last))
    ends = np.cumsum(size)
    return upto[ends] - upto[ends - size]


def text_prefixes(units: SpacedUnits, places: np.ndarray) -> np.ndarray:
    """The counts of all prefixes of one text that isn't empty, from its first character on."""
    known = units.known
    flat, _ = known.get(places, np.ones(len(places), np.int64))
    length = known.count[places]
    last = flat[np.cumsum(length) - 1].astype(np.int64)
    return (flat + np.repeat(np.cumsum(last) - last, length))[1:]  # without the mark in front


def prefix_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id`` and ``counts``: element n is the number of tokens of the first n characters, from one on."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = encoder(path)
        places, size = units.places(batch.column("text"))
        own = [text_prefixes(units, x) if len(x) else np.zeros(0, np.int64) for x in np.split(places, np.cumsum(size)[:-1])]
        offsets = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int32)
        counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).astype(np.int32)))
        give_back()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), counts], names=["doc_id", "counts"])

    return map_texts(documents(docs), work, "doc_id long, counts array<int>", limit=SLICE)


def tokens_of_prefix(counts: Column, characters: Column) -> Column:
    """The tokens of the first ``characters`` of a text; all of them beyond its end."""
    at = F.least(characters, F.size(counts)).cast("int")
    return F.when(at > 0, F.get(counts, at - 1)).otherwise(0)


def longest_prefix(counts: Column, budget: Column) -> Column:
    """The characters of the longest prefix that has at most ``budget`` tokens."""
    fit = F.transform(counts, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fit), F.lit(0))


def token_counts(docs: DataFrame, path: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fits``, the characters of the longest prefix within the limit."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = encoder(path)
        texts = pc.fill_null(batch.column("text"), "")
        places, size = units.places(texts)
        count = totals(units, places, size)
        fits = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        for i in np.flatnonzero(count > limit).tolist():
            within = np.flatnonzero(text_prefixes(units, places[ends[i] - size[i]:ends[i]]) <= limit)
            fits[i] = within[-1] + 1 if len(within) else 0
        columns = {"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": pa.array(count),
                   "over_limit": pa.array(count > limit), "fits": pa.array(fits.astype(np.int64))}
        give_back()
        return pa.RecordBatch.from_pydict(columns)

    return map_texts(documents(docs), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits long", limit=SLICE)
