"""Encoding whole texts through their distinct pieces.

A tokenizer that splits text by a pattern and encodes each match by itself gives
the same ids for equal pieces, so a slice of texts needs each distinct piece
once. Texts are first cut before single spaces, where a piece always ends, and
the distinct parts are found in Arrow. Parts of common characters are cut by
their bytes, all at once; only the distinct pieces, and parts with anything
else, reach Python. Pieces are remembered, parts aren't: most parts of several
pieces never come again.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
# white space before a space: such a text is cut by the pattern above, not at every space
_AWKWARD = r"(^|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) "
KEYS = 1 << 15
"""Keys whose numbers are looked up at once."""
ROOM = 8 << 20
"""Numbers that a worker remembers, about; without spaces, one part can have thousands."""


def _kinds() -> np.ndarray:
    """What each byte of a text is: 1 letter (ASCII, and U+00C0 to U+027F in two bytes), 2 ASCII sign but the apostrophe, 3 digit, 4 line end, 0 other."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 2
    kind[ord("'")] = 0
    kind[ord("0"):ord("9") + 1] = 3
    kind[ord("\n")] = 4
    for letters in (slice(ord("A"), ord("Z") + 1), slice(ord("a"), ord("z") + 1), slice(0xC3, 0xCA), slice(0x80, 0xC0)):
        kind[letters] = 1
    return kind


_KIND = _kinds()


def runs(units: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The pieces of the public pattern of parts of texts in a row, how many each part has, and which pieces are still to be cut by the pattern.

    Where a part has letters, signs and digits of :func:`_kinds` only, a space in front and single line ends, its pieces are
    the runs of one kind. Any other part is one row that is still to be cut; an empty one has no row.
    """
    if not len(units):
        return units, np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.frombuffer(units.buffers()[1], np.int64)[units.offset:units.offset + len(units) + 1]
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    size = np.diff(at)
    kind = _KIND[data]
    second = np.flatnonzero((data == 0x97) | (data == 0xB7))
    kind[second[(second > 0) & (data[second - 1] == 0xC3)]] = 0  # U+00D7 and U+00F7 are signs
    first = at[:-1][size > 0]
    spaced = at[:-1][size > 1]
    spaced = spaced[(data[spaced] == ord(" ")) & (kind[spaced + 1] != 4)]
    kind[spaced] = kind[spaced + 1]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[first] = True
    kind[~new & (kind == 4)] = 0
    narrow = np.int32 if len(data) < 1 << 31 else np.int64
    upto = np.zeros(len(data) + 1, narrow)
    np.cumsum(kind == 0, out=upto[1:])
    hard = upto[at[1:]] > upto[at[:-1]]
    new[np.repeat(hard, size)] = False
    new[first] = True
    np.cumsum(new, out=upto[1:])
    count = (upto[at[1:]] - upto[at[:-1]]).astype(np.int64)
    starts = np.append(np.flatnonzero(new), len(data))
    pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data))
    return pieces, count, np.repeat(hard, count)


def gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray, own: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all keys ``own`` in a row, and how many each group of keys has; ``groups`` has the number of its keys.

    A key's numbers stand in ``flat`` from its ``start`` on, ``count`` of them.
    """
    count = count[own]
    total = np.append(0, np.cumsum(count))
    ends = np.cumsum(groups)
    out = np.empty(total[-1], flat.dtype)
    for a in range(0, len(own), KEYS):  # places of a whole slice's numbers would be many times the numbers
        b = min(a + KEYS, len(own))
        shift = np.repeat(start[own[a:b]] - total[a:b], count[a:b])
        out[total[a]:total[b]] = flat[np.arange(total[a], total[b]) + shift]
    return out, total[ends] - total[ends - groups]


class Memory:
    """Numbers of strings met before: a table from the string to its place, and their numbers in one growing array."""

    def __init__(self):
        self.place = {"": 0}  # the empty string has no ids
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count, self.uses = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def __len__(self) -> int:
        return len(self.place)

    def add(self, keys: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        """Keys that aren't known yet, their numbers in a row, and how many each has."""
        n = len(self.place)
        self.place.update(zip(keys, range(n, n + len(keys))))
        self.start, self.count, self.uses = (_room(x, n + len(keys)) for x in (self.start, self.count, self.uses))
        self.start[n:n + len(keys)] = self.used + np.cumsum(count) - count
        self.count[n:n + len(keys)] = count
        self.flat = _room(self.flat, self.used + len(flat))
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)

    def numbers(self, keys: list[str]) -> np.ndarray:
        """The place of each key, -1 where it isn't known."""
        return np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))

    def used_again(self, most: int) -> Memory:
        """A memory of at most ``most`` strings: those asked for more than once, the often used first."""
        uses = self.uses[:len(self.place)]
        least = 2
        while np.count_nonzero(uses >= least) > most:
            least *= 2
        keep = np.flatnonzero(uses >= least)
        keep = keep[keep > 0]
        out = Memory()
        if len(keep):
            keys = list(self.place)
            flat, _ = self.get(keep, np.ones(len(keep), np.int64))
            out.add([keys[i] for i in keep.tolist()], flat, self.count[keep])
        return out

    def get(self, own: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all keys, given by their places, in a row, and how many each group of keys has; ``groups`` has the number of its keys."""
        return gathered(self.flat, self.start, self.count, own, groups)


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """The same values with place for ``size``, at least half as many again where it has to grow."""
    if size <= len(values):
        return values
    out = np.zeros(max(size, len(values) * 3 // 2), values.dtype)
    out[:len(values)] = values
    return out


class Parts(NamedTuple):
    """Texts as parts, and parts as distinct strings."""

    strings: list[str]
    whole: np.ndarray
    """Whether each string is a piece of the pattern already."""
    own: np.ndarray
    """The strings of the distinct parts in a row, by their places, ..."""
    count: np.ndarray
    """... and how many each part has."""
    numbers: np.ndarray
    """The parts of all texts in a row, by their places, ..."""
    size: np.ndarray
    """... and how many each text has."""


def parts_of(texts: pa.Array, space: bool = False, plain: bool = True) -> Parts:
    """Cut texts. Null counts as empty. ``space``: as if one stood before each text. ``plain``: parts are cut by :func:`runs`."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    awkward = pc.match_substring_regex(texts, _AWKWARD).to_numpy(zero_copy_only=False)
    easy = pc.split_pattern(pc.if_else(pa.array(awkward), "", texts), " ")
    size = pc.list_value_length(easy).to_numpy().astype(np.int64)
    parts = easy.flatten().dictionary_encode()
    own = parts.indices.to_numpy().astype(np.int64)
    first = np.cumsum(size) - size
    # a text's first part has no space before it, every other one has
    words = parts.dictionary.cast(pa.large_string())
    width = len(words)
    if not space:
        own[first] += width
    used = np.flatnonzero(np.bincount(own, minlength=2 * width))
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string()))
    units = pa.concat_arrays([spaced, words]).take(pa.array(used))
    place = np.zeros(2 * width, np.int64)
    place[used] = np.arange(len(used))
    numbers = place[own]
    if awkward.any():
        # the awkward texts' parts go where their one empty part stood
        hard = [_BEFORE_SPACE.split(" " * space + texts[i].as_py()) for i in np.flatnonzero(awkward).tolist()]
        others = pa.array(chain.from_iterable(hard), pa.large_string()).dictionary_encode()
        size[awkward] = [len(x) for x in hard]
        out = np.empty(int(size.sum()), np.int64)
        mine = np.repeat(awkward, size)
        out[mine] = len(used) + others.indices.to_numpy()
        out[~mine] = np.delete(numbers, first[awkward])
        numbers = out
        units = pa.concat_arrays([units, others.dictionary])
    pieces, count, todo = runs(units) if plain else (units, np.ones(len(units), np.int64), np.ones(len(units), bool))
    pieces = pieces.dictionary_encode()
    own = pieces.indices.to_numpy()
    whole = np.ones(len(pieces.dictionary), bool)
    whole[own[todo]] = False
    return Parts(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), whole, own, count, numbers, size)


class PieceEncoder:
    """Texts to ids, given the ids of pieces; remembers a bounded number of strings.

    ``encode_pieces`` takes distinct pieces and returns their ids in a row and
    how many each has.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], pattern: str, memory: int):
        self.encode_pieces, self.limit = encode_pieces, memory
        self.pattern, self.plain = regex.compile(pattern), pattern == public_tokenizers.PATTERN
        self.known = Memory()

    def encode(self, texts: pa.Array, space: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. Null counts as empty. ``space``: as if one stood before each text."""
        return self.of_parts(parts_of(texts, space, self.plain))

    def of_parts(self, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
        """The same, of texts that have been cut."""
        asked = self.learn(parts.strings, parts.whole)
        self.known.uses[asked] += 1
        flat, count = self.known.get(asked[parts.own], parts.count)
        return gathered(flat, np.cumsum(count) - count, count, parts.numbers, parts.size)

    def learn(self, units: list[str], whole: np.ndarray) -> np.ndarray:
        """Make sure that all these distinct strings are known, and say their places; those that aren't ``whole`` pieces are cut first."""
        gc.disable()  # hundreds of thousands of lists of strings, none in a cycle
        try:
            at = self.known.numbers(units)
            new = at < 0
            if len(self.known) + np.count_nonzero(new) > self.limit or self.known.used > ROOM:
                self.known = self.known.used_again(self.limit // 2) if self.known.used <= ROOM else Memory()
                at = self.known.numbers(units)
                new = at < 0
            ready, todo = np.flatnonzero(new & whole), np.flatnonzero(new & ~whole)
            if len(ready):
                at[ready] = len(self.known) + np.arange(len(ready))
                keys = [units[i] for i in ready.tolist()]
                self.known.add(keys, *self.encode_pieces(keys))
            if len(todo):
                at[todo] = self._learn([units[i] for i in todo.tolist()])
            return at
        finally:
            gc.enable()

    def cut(self, unit: str) -> list[str]:
        """The matches of the pattern."""
        return self.pattern.findall(unit)

    def _learn(self, new: list[str]) -> np.ndarray:
        known = self.known
        parts = list(map(self.cut, new))
        groups = np.fromiter(map(len, parts), np.int64, len(parts))
        pieces = list(chain.from_iterable(parts))
        fresh = [p for p in dict.fromkeys(pieces) if p not in known.place]
        if fresh:
            known.add(fresh, *self.encode_pieces(fresh))
        # a part of one piece is that piece; the others are their pieces in a row
        at = known.numbers(pieces)
        flat, count = known.get(at, groups)
        several = groups > 1
        known.uses[np.unique(at[np.repeat(several, groups)])] += 1
        if several.any():
            known.add([x for x, n in zip(new, groups.tolist()) if n > 1], flat[np.repeat(several, count)], count[several])
        return known.numbers(new)
