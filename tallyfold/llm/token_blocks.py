"""Token ids in files of patched frame-of-reference blocks.

Ids are cut into blocks of 1 024. A block stores its minimum, the width that a
percentile of its differences needs, the differences packed at that width, and
an exception list of positions and differences for the rest. A frame holds the
documents of one slice: their ids and lengths, an index of block starts, and
the blocks. A file is a row of frames, each followed by one newline byte; Spark
writes it with its own commit protocol, so a task that is run again leaves one
copy, on any file system that Spark reaches.

Frame, little-endian: ``PFR1``, u64 bytes after this header, u64 documents, u64
ids, u32 blocks, u32 zero; then document ids i64, validity u8, lengths u64,
block starts u64 (from the start of the first block), blocks. Block: u32
minimum, u8 width, u8 zero, u16 exceptions, packed differences, exception
positions u16, exception differences u32.

A null text is an empty one, so its document is the end id alone; null ids
stand first; rows that repeat a ``doc_id`` follow each other, ordered by text.
An empty table writes no frame and reads back empty.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import documents, give_back, held_by_worker, slices, work_folder
from tallyfold.llm.pieces import PieceEncoder
from tallyfold.session import cut_lineage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BLOCK = 1024
PERCENTILE = 95
END_ID = 0
MEMORY = 600_000
"""Strings whose ids a worker remembers."""
STEP = 1 << 14
"""Strings that are encoded at once; the library's tokens take many times their ids."""
BLOCKS = 256
"""Blocks that are packed at once."""
_ID = attrgetter("id")
_HEAD = struct.Struct("<4sQQQII")


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of eight values in rows of ``width`` bytes."""
    out = np.zeros((len(values), width), np.uint8)
    for i in range(8 if width else 0):
        first, shift = divmod(i * width, 8)
        x = values[:, i] << np.uint64(shift)
        for k in range(first, (i * width + width - 1) // 8 + 1):
            out[:, k] |= (x >> np.uint64(8 * (k - first))).astype(np.uint8)
    return out


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The reverse of :func:`pack`."""
    out = np.zeros((len(packed), 8), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(8 if width else 0):
        first, shift = divmod(i * width, 8)
        x = np.zeros(len(packed), np.uint64)
        for k in range(first, (i * width + width - 1) // 8 + 1):
            x |= packed[:, k].astype(np.uint64) << np.uint64(8 * (k - first))
        out[:, i] = (x >> np.uint64(shift)) & mask
    return out


def write_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks, and the blocks. Ids are unsigned 32-bit numbers; a part block is filled with its last id."""
    parts = [x for a in range(0, len(ids), BLOCKS * BLOCK) for x in _blocks(ids[a:a + BLOCKS * BLOCK], percentile)]
    size = np.fromiter(map(len, parts), np.uint64, len(parts))
    return np.cumsum(size) - size, b"".join(parts)


def _blocks(ids: np.ndarray, percentile: int) -> list[bytes]:
    rows = np.append(ids, np.full(-len(ids) % BLOCK, ids[-1])).astype(np.uint64).reshape(-1, BLOCK)
    low = rows.min(axis=1)
    over = rows - low[:, None]
    at = BLOCK * percentile // 100 - 1
    usual = np.partition(over, at, axis=1)[:, at]
    width = np.ceil(np.log2(usual.astype(np.float64) + 1)).astype(np.int64)
    parts: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        diff = over[mine]
        patch = diff >> np.uint64(w) > 0
        body = pack(np.where(patch, np.uint64(0), diff).reshape(-1, 8), w).reshape(len(mine), -1)
        for i, block in enumerate(mine.tolist()):
            where = np.flatnonzero(patch[i])
            parts[block] = b"".join((struct.pack("<IBBH", int(low[block]), w, 0, len(where)), body[i].tobytes(),
                                     where.astype("<u2").tobytes(), diff[i, where].astype("<u4").tobytes()))
    return parts


def read_blocks(starts: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """All ``count`` ids of a frame's blocks; ``data`` holds their bytes."""
    out = np.zeros((len(starts), BLOCK), np.uint64)
    if not len(starts):
        return out.reshape(-1)[:0].astype(np.uint32)
    start = starts.astype(np.int64)
    head = data[start[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.uint64)
    width, patches = head[:, 4], np.ascontiguousarray(head[:, 6:8]).view("<u2")[:, 0]
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        size = BLOCK // 8 * w
        body = data[start[mine][:, None] + 8 + np.arange(size)]
        out[mine] = unpack(body.reshape(-1, w) if w else np.zeros((len(mine) * BLOCK // 8, 0), np.uint8), w).reshape(-1, BLOCK)
        for block in mine[patches[mine] > 0].tolist():
            n, at = int(patches[block]), int(start[block]) + 8 + size
            where = data[at:at + 2 * n].view("<u2") if at % 2 == 0 else np.frombuffer(data[at:at + 2 * n].tobytes(), "<u2")
            out[block, where] = np.frombuffer(data[at + 2 * n:at + 6 * n].tobytes(), "<u4")
    return (out + low[:, None]).reshape(-1)[:count].astype(np.uint32)


def frame(doc_ids: pa.Array, ids: np.ndarray, length: np.ndarray) -> bytes:
    """One frame."""
    starts, blocks = write_blocks(ids)
    body = b"".join((np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes(), np.asarray(doc_ids.is_valid()).astype(np.uint8).tobytes(),
                     length.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), blocks))
    return _HEAD.pack(b"PFR1", len(body), len(length), len(ids), len(starts), 0) + body


def frames(content: memoryview) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Document ids, all ids in a row, and lengths, of each frame of a file."""
    at = 0
    while at < len(content):
        magic, size, n_docs, n_ids, n_blocks, _ = _HEAD.unpack_from(content, at)
        if magic != b"PFR1":
            raise ValueError("not a frame of token blocks")
        at += _HEAD.size
        data = np.frombuffer(content[at:at + size], np.uint8)
        cut = np.cumsum([8 * n_docs, n_docs, 8 * n_docs, 8 * n_blocks])
        doc_ids = pa.array(data[:cut[0]].view("<i8"), mask=data[cut[0]:cut[1]] == 0)
        length = np.frombuffer(data[cut[1]:cut[2]].tobytes(), "<u8").astype(np.int64)
        starts = np.frombuffer(data[cut[2]:cut[3]].tobytes(), "<u8")
        yield doc_ids, read_blocks(starts, data[cut[3]:], n_ids), length
        at += size + 1


class TextEncoder:
    """Whole texts to ids: added tokens of the file are found first, what stands between them goes by pieces.

    An added token that takes in its surroundings (white space, whole words
    only, normalised text) is left to the library, text by text.
    """

    def __init__(self, pieces: PieceEncoder, tokenizer):
        self.pieces, self.tokenizer = pieces, tokenizer
        added = tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.plain = tokenizer.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        # the longest of those that begin at one place, as in the library
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        hit = np.zeros(len(texts), bool)
        for content in self.added:
            hit |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not hit.any():
            return self.pieces.encode(texts)
        units, ready, size = [], [], []
        for text, special in zip(texts.to_pylist(), hit.tolist()):
            if not special:
                own = [(text, None)]
            elif self.plain:
                own = [("", [self.added[x]]) if n % 2 else (x, None) for n, x in enumerate(self.pattern.split(text))]
            else:
                own = [("", self.tokenizer.encode(text, add_special_tokens=False).ids)]
            units += [x for x, _ in own]
            ready += [x for _, x in own]
            size.append(len(own))
        flat, count = self.pieces.encode(pa.array(units, pa.large_string()))
        given = np.array([x is not None for x in ready])
        count = np.where(given, [len(x or ()) for x in ready], count)
        mine = np.repeat(given, count)
        out = np.empty(len(mine), np.int64)
        out[~mine] = flat
        out[mine] = [i for x in ready for i in x or ()]
        return out, np.add.reduceat(count, np.cumsum(size) - size)


def byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte in the file's vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


_ALPHABET = np.array([c for _, c in sorted(byte_alphabet().items())], "<u2")


def in_alphabet(pieces: list[str]) -> list[str]:
    """Each string's UTF-8 bytes in the byte alphabet, which has no line end."""
    column = pa.array(pieces, pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[1:len(pieces) + 1] + np.arange(len(pieces))
    out = np.empty(ends[-1] + 1, "<u2")
    cut = np.zeros(len(out), bool)
    cut[ends] = True
    out[cut] = ord("\n")
    out[~cut] = _ALPHABET[np.frombuffer(column.buffers()[2] or b"", np.uint8)[:len(out) - len(pieces)]]
    return out[:-1].tobytes().decode("utf-16-le").split("\n")


def piece_encoder(path: str, memory: int = MEMORY, tokenizer=None) -> PieceEncoder:
    """Texts to ids with the strings of added tokens as plain text.

    The file's pre-tokenizer splits by the public pattern and encodes each match
    by itself, so the library's model is asked once a distinct match, written in
    the byte alphabet of the vocabulary.
    """
    from tokenizers import Tokenizer

    model = (tokenizer or Tokenizer.from_file(path)).model

    def ids(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, count = [], []
        for a in range(0, len(pieces), STEP):
            own = list(map(model.tokenize, in_alphabet(pieces[a:a + STEP])))
            count.append(np.fromiter(map(len, own), np.int64, len(own)))
            flat.append(np.fromiter(map(_ID, chain.from_iterable(own)), np.int64, int(count[-1].sum())))
        return np.concatenate(flat), np.concatenate(count)

    return PieceEncoder(ids, public_tokenizers.PATTERN, memory)


def encoder(path: str) -> TextEncoder:
    """This worker's encoder."""

    def build() -> TextEncoder:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return TextEncoder(piece_encoder(path, tokenizer=tokenizer), tokenizer)

    return held_by_worker(("token_blocks", path), build)


def write_tokens(docs: DataFrame, folder: str, path: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode every whole text, append ``end_id``, and write the frames in ascending ``doc_id`` order.

    Texts are dealt by ranges of ``doc_id``, the one shuffle; files are in the
    order of their numbers.
    """

    def run(batches):
        for batch in slices(batches, limit=4 << 20):
            flat, count = encoder(path).encode(batch.column("text"))
            length = count + 1
            ids = np.full(len(flat) + len(count), end_id, np.int64)
            ends = np.zeros(len(ids), bool)
            ends[np.cumsum(length) - 1] = True
            ids[~ends] = flat
            data = frame(batch.column("doc_id"), ids, length)
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["frame"])
            del flat, ids, ends, data
            give_back()

    dealt = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # the text writer puts the bytes of a row and one newline into the file as they are
    dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(folder)


def _read(spark: SparkSession, folder: str, rows, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    files = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), "content")

    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                before = 0
                for doc_ids, ids, length in frames(memoryview(content.as_buffer())):
                    start = before + np.cumsum(length) - length
                    before += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(length), pa.int64()), doc_ids, pa.array(start), *rows(ids, length)],
                                                     names=["file", "doc_id", "start", *[x.split()[0] for x in schema.split(", ")]])

    return files.mapInArrow(run, f"file long, doc_id long, start long, {schema}")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``file``, ``doc_id``, ``start`` within the file and ``ids`` of every document."""

    def rows(ids, length):
        offsets = np.append(0, np.cumsum(length)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64)))]

    return _read(spark, folder, rows, "ids array<bigint>")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` over all files, ``n_tokens``, ``ids_crc32`` of every document, read from the files."""

    def rows(ids, length):
        data = memoryview(ids.astype("<u4").tobytes())
        ends = np.cumsum(length).tolist()
        crc = [zlib.crc32(data[4 * (b - n):4 * b]) for b, n in zip(ends, length.tolist())]
        return [pa.array(length), pa.array(crc, pa.int64())]

    own = cut_lineage(_read(spark, folder, rows, "n_tokens long, ids_crc32 long").withColumnRenamed("start", "start_in_file"))
    # one row a file: the only rows that meet in one task
    files = own.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = files.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("before"))
    return own.join(before, "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, folder: str | None = None, path: str = TOKENIZER) -> DataFrame:
    """Write the files below ``folder`` (a new one in the shared folder if not given) and read their index."""
    spark = docs.sparkSession
    folder = folder or f"{work_folder(spark)}/tokens"
    write_tokens(docs, folder, path)
    return token_index(spark, folder)
