"""Byte-level BPE and token blocks against the public libraries and exact round trips."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry
from llm_data import SF
from tallyfold.llm import byte_bpe, token_blocks
from tallyfold.llm.pieces import Memory, PieceEncoder, runs

RANKS, PIECES = byte_bpe.encoder(byte_bpe.RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS.ranks, special_tokens={})
OTHER = Tokenizer.from_file(token_blocks.TOKENIZER)
OTHER.encode_special_tokens = True


def odd_texts():
    rng = random.Random(3)
    alphabet = " \n\t  \x1c\x85aAbé1٣中\U0001f600'st.,!-́\x00 　"
    fixed = ["", " ", "   ", "a", " a", "a" * 3000, "!" * 999, "a <|endoftext|> b", "it's 12 o'clock  now ", "\n\n x\n", "abab" * 500]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(1500)]


def test_ids_are_those_of_the_library():
    texts = odd_texts()
    flat, count = PIECES.encode(pa.array([*texts, None]))
    own = np.split(flat, np.cumsum(count)[:-1])
    assert [x.tolist() for x in own] == [LIBRARY.encode_ordinary(t) for t in texts] + [[]]
    assert all(RANKS.decode(x.astype(np.int64)).tobytes() == t.encode() for x, t in zip(own, texts))


def test_pieces_out_of_rank_order():
    """A later merge can make an earlier pair; such a piece is done merge by merge."""
    ranks = byte_bpe.Ranks.__new__(byte_bpe.Ranks)
    table = [b"a", b"b", b"c", b"abc", b"bc", b"ca"]
    import base64
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".tiktoken") as f:
        f.write("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(table)))
        f.flush()
        ranks = byte_bpe.Ranks(f.name)
    rng = random.Random(0)
    pieces = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode() for _ in range(300)})
    flat, count = byte_bpe.replay(pieces, ranks)
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [ranks.ranks[p] if False else ([ranks.ranks[p]] if p in ranks.ranks else ranks.scalar(p)) for p in pieces]


def test_memory_is_bounded():
    own = byte_bpe.PieceEncoder(lambda p: byte_bpe.replay([x.encode() for x in p], RANKS), public_tokenizers.PATTERN, 50)
    texts = odd_texts()
    for a in range(0, len(texts), 100):
        flat, count = own.encode(pa.array(texts[a:a + 100]))
        assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [LIBRARY.encode_ordinary(t) for t in texts[a:a + 100]]


def test_token_digests(spark, odd_docs):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        got = sorted((tuple(r) for r in byte_bpe.token_digests(docs).collect()), key=repr)
        want = []
        for r in docs.collect():
            ids = LIBRARY.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(want, key=repr)


def test_decode_as_an_operator(odd_docs):
    decoded = byte_bpe.decode(byte_bpe.encode(odd_docs)).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((r.text or "").encode() for r in odd_docs.collect())


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 32])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 7, 1023, 1024, 1025, 30_000):
        ids = rng.integers(0, top, n)
        if n > 10:
            ids[rng.integers(0, n, n // 30)] = min((1 << 32) - 1, top * 50)
        starts, data = token_blocks.write_blocks(ids)
        assert (token_blocks.read_blocks(starts, np.frombuffer(data, np.uint8), n) == ids).all()
        if n == 30_000 and top == 300:
            assert len(data) < 2 * n  # outliers don't widen their blocks


def expected(docs):
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*OTHER.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = entry.queries()["op2_token_blocks"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_token_files_of_odd_documents(spark, odd_docs, tmp_path):
    folder = str(tmp_path / "tokens")
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted((tuple(r) for r in token_blocks.token_files(odd_docs, folder).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    ids = {r.doc_id: r.ids for r in token_blocks.read_tokens(spark, folder).collect()}
    assert ids[9] == [*OTHER.encode(dict(rows)[9], add_special_tokens=False).ids, 0] and ids[3] == [0]


def test_empty_tables(spark, no_docs, tmp_path):
    assert byte_bpe.token_digests(no_docs).count() == 0
    assert token_blocks.token_files(no_docs, str(tmp_path / "none")).count() == 0


def test_added_tokens_as_in_the_library():
    """The library in its default state finds the file's added tokens in a text."""
    library = Tokenizer.from_file(token_blocks.TOKENIZER)
    end = "<|endoftext|>"
    texts = [f"one {end} two", "none", end, end + end, f" {end}  x", "", f"a{end}b <|endoftext|", *odd_texts(), *(f"{a}{end}{b}" for a, b in zip(odd_texts(), odd_texts()[40:]))]
    flat, count = token_blocks.encoder(token_blocks.TOKENIZER).encode(pa.array([*texts, None]))
    got = [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert got[0] == [505, 220, 50256, 734]
    other = token_blocks.TextEncoder(token_blocks.encoder(token_blocks.TOKENIZER).pieces, library)
    other.plain = False
    flat, count = other.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == got[:-1]


def peak_of(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_little_memory_beside_the_result():
    """A worker's peak: pairs go into the index step by step, and numbers of known strings are gathered key block by key block."""
    rng = random.Random(5)
    pieces = [x.encode() for x in dict.fromkeys(" " + "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", k=rng.randint(4, 13))) for _ in range(55_000))]
    (flat, count), peak = peak_of(lambda: byte_bpe.replay(pieces, RANKS))
    assert peak < 90 * sum(map(len, pieces))
    cuts = np.cumsum(count)
    for i in range(0, len(pieces), 50):
        assert flat[cuts[i] - count[i]:cuts[i]].tolist() == LIBRARY.encode_ordinary(pieces[i].decode())
    known = Memory()
    known.add([x.decode() for x in pieces], flat, count)
    own = np.array(rng.choices(range(len(pieces) + 1), k=400_000))
    (ids, size), peak = peak_of(lambda: known.get(own, np.full(400, 1000)))
    assert peak < 4 * ids.nbytes
    plain = [known.flat[known.start[x]:known.start[x] + known.count[x]] for x in own]
    assert (ids == np.concatenate(plain)).all() and size.tolist() == [sum(map(len, plain[a:a + 1000])) for a in range(0, 400_000, 1000)]


def test_parts_are_cut_by_their_bytes():
    """Runs of one kind are the pattern's matches; what they can't tell is left to the pattern."""
    rng = random.Random(11)
    letters = [chr(c) for c in range(0xA0, 0x2B0)]
    units = ["", " ", "\n", " \n", "a\n", "a\n\n", "a\nb", "it's", " 's", "12st.", "a b", *(f" x{c}y" for c in letters), *letters]
    units += ["".join(rng.choice("ab\n.,!1é×ß'÷Ǿ \xa0") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    units = pa.concat_arrays([pa.array(["before"], pa.large_string()), pa.array(units, pa.large_string())]).slice(1)
    pieces, count, todo = runs(units)
    ends = np.cumsum(count)
    for unit, a, b in zip(units.to_pylist(), ends - count, ends):
        want = regex.findall(public_tokenizers.PATTERN, unit)
        assert pieces[a:b].to_pylist() == ([unit] if todo[a:b].any() else want) and (not todo[a:b].any() or b - a == 1)
    easy = pa.array(["word", " word.", " of,\nThe", " a1", "ß×ß", " naïve", "..."], pa.large_string())
    assert runs(easy)[2].tolist() == [False] * 9 + [True] + [False] * 2


def test_parts_of_several_pieces_are_not_remembered():
    asked = []
    own = PieceEncoder(lambda p: asked.extend(p) or byte_bpe.replay([x.encode() for x in p], RANKS), public_tokenizers.PATTERN, 50)
    own.cut = None  # no part needs the pattern
    texts = ["one two, two. one!", "(two) one;\nTwo 12 two"]
    for _ in range(2):
        flat, count = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert len(asked) == len(set(asked)) and set(own.known.place) == {"", *asked}


def test_byte_alphabet_of_many_strings():
    strings = [*(x for x in odd_texts() if x), "\n", "\x00", "\U0010ffff", "a"]
    alphabet = token_blocks.byte_alphabet()
    assert token_blocks.in_alphabet(strings) == ["".join(chr(alphabet[b]) for b in x.encode()) for x in strings]


def test_blocks_and_pieces_are_done_in_steps(monkeypatch):
    """What a worker needs besides the result doesn't grow with a slice: blocks are packed, and new pieces encoded, some at a time."""
    ids = np.random.default_rng(3).integers(0, 50_000, 2_000_000).astype(np.int64)
    (starts, data), peak = peak_of(lambda: token_blocks.write_blocks(ids))
    assert (token_blocks.read_blocks(starts, np.frombuffer(data, np.uint8), len(ids)) == ids).all()
    assert peak < 2 * ids.nbytes
    want = token_blocks.piece_encoder(token_blocks.TOKENIZER).encode(pa.array(odd_texts()))
    monkeypatch.setattr(token_blocks, "STEP", 7)
    got = token_blocks.piece_encoder(token_blocks.TOKENIZER).encode(pa.array(odd_texts()))
    assert all((a == b).all() for a, b in zip(got, want))
