"""Texts as the units that a sentencepiece BPE model can't join.

The model reads a text as a row of characters with U+2581 for each space and one
more in front. Where no piece holds that mark after another character (checked
when a model is loaded), the row falls into units of marks and the characters up
to the next mark, and each unit is encoded by itself. A slice of texts has
each distinct unit once; a worker remembers a bounded number of them.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyfold.llm.pieces import Memory

MARK = "▁"
ROOM = 8 << 20
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")
_AWKWARD = f"^$|^ |  |{MARK}"


def splits_at_marks(pieces: list[str]) -> bool:
    """Whether no piece holds the mark after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", x) for x in pieces)


class SpacedUnits:
    """Units of texts and their numbers.

    ``answer`` takes distinct units and returns their numbers in a row and how
    many each has. At most ``memory`` units and about ``room`` numbers stay.
    """

    def __init__(self, answer: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], memory: int, room: int = ROOM):
        self.answer, self.limit, self.room = answer, memory, room
        self.known = Memory()

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``known`` of the units of all texts in a row, and how many each text has; an empty or null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        awkward = pc.match_substring_regex(texts, _AWKWARD).to_numpy(zero_copy_only=False)
        easy = pc.split_pattern(pc.if_else(pa.array(awkward), "", texts), " ")
        parts = easy.flatten().dictionary_encode()
        own = parts.indices.to_numpy().astype(np.int64)
        size = pc.list_value_length(easy).to_numpy().astype(np.int64)
        marked = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), parts.dictionary.cast(pa.large_string()), pa.scalar(MARK, pa.large_string()))
        units = marked.to_numpy(zero_copy_only=False).tolist()
        hard = [_UNIT.findall(MARK + texts[i].as_py().replace(" ", MARK)) if len(texts[i].as_py()) else [] for i in np.flatnonzero(awkward).tolist()]
        others = list(chain.from_iterable(hard))
        numbers = self._learn(units, others)
        self.known.uses[numbers] += 1
        numbers = numbers[own]
        if hard:
            # an awkward text's units go where its one empty part stood
            first = (np.cumsum(size) - size)[awkward]
            size[awkward] = [len(x) for x in hard]
            mine = np.repeat(awkward, size)
            out = np.empty(len(mine), np.int64)
            out[mine] = self.known.numbers(others)
            out[~mine] = np.delete(numbers, first)
            numbers = out
        return numbers, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts in a row, and how many each has."""
        places, size = self.places(texts)
        return self.known.get(places, size)

    def _learn(self, units: list[str], others: list[str]) -> np.ndarray:
        """Make sure that all these units are known; the places of the distinct ``units``."""
        gc.disable()  # tens of thousands of lists of numbers, none in a cycle
        try:
            at = self.known.numbers(units)
            new, more = np.flatnonzero(at < 0), {x for x in others if x not in self.known.place}
            if len(self.known) + len(new) + len(more) > self.limit or self.known.used > self.room:
                self.known = self.known.used_again(self.limit // 2) if self.known.used <= self.room else Memory()
                at = self.known.numbers(units)
                new, more = np.flatnonzero(at < 0), {x for x in others if x not in self.known.place}
            keys = [units[i] for i in new.tolist()]
            at[new] = len(self.known) + np.arange(len(new))
            if more:
                keys += more.difference(keys)
            if keys:
                self.known.add(keys, *self.answer(keys))
            return at
        finally:
            gc.enable()
