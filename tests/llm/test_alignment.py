"""Prefix counts and alignment against the public libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
from llm_data import SF
from tallyfold.llm import alignment, prefix_counts

MODEL = SentencePieceProcessor(model_file=prefix_counts.MODEL)
UNITS = prefix_counts.encoder(prefix_counts.MODEL)
SIDE_A = Tokenizer.from_file(alignment.SIDE_A)
SIDE_A.encode_special_tokens = True


def odd_texts():
    rng = random.Random(3)
    alphabet = " \n\t  \x1c\x85aAbé1٣中\U0001f600'st.,!-́\x00 　▁"
    fixed = ["", " ", "   ", "a", " a", "a" * 3000, "!" * 999, "a <s> b </s><unk><0x0A>", "a <|endoftext|> b", "it's 12 o'clock  now ", "\n\n x\n", "abab" * 500,
             " " * 77, "a" + " " * 50 + "b", "the" * 300, "▁▁ x", "<0x41>"]
    return fixed + ["".join(rng.choice(a) for _ in range(rng.randint(1, 80))) for a in (alphabet, "thein ra.") for _ in range(700)]


def test_every_prefix_has_the_library_s_count():
    texts = odd_texts()
    places, size = UNITS.places(pa.array([*texts, None]))
    assert prefix_counts.totals(UNITS, places, size).tolist() == [len(x) for x in MODEL.encode(texts)] + [0]
    for text, own in zip(texts, np.split(places, np.cumsum(size)[:-1])):
        if 0 < len(text) < 200:
            assert prefix_counts.text_prefixes(UNITS, own).tolist() == [len(x) for x in MODEL.encode([text[:i] for i in range(1, len(text) + 1)])]


def test_memory_of_units_is_bounded():
    texts = odd_texts()
    for limit, room in ((40, 1 << 20), (10_000, 300)):
        own = prefix_counts.SpacedUnits(prefix_counts.PrefixTable().answer, limit, room)
        for a in range(0, len(texts), 100):
            places, size = own.places(pa.array(texts[a:a + 100]))
            assert prefix_counts.totals(own, places, size).tolist() == [len(x) for x in MODEL.encode(texts[a:a + 100])]


def test_token_counts(spark, odd_docs):
    for docs, limit in ((spark.read.parquet(f"{SF}/documents.parquet"), 300), (odd_docs, 7), (odd_docs, 0), (odd_docs, 4096)):
        got = sorted(prefix_counts.token_counts(docs, limit=limit).collect(), key=repr)
        texts = {(r.doc_id, len((r.text or "").encode())): r.text or "" for r in docs.collect()}
        assert len(got) == docs.count()
        for r in got:
            text = texts[r.doc_id, r.n_bytes]
            n = len(MODEL.encode(text))
            assert (r.n_tokens, r.over_limit) == (n, n > limit)
            if n <= limit:
                assert r.fits == len(text)
            else:  # no longer prefix is within the limit; one more character adds a few tokens at most and takes a few away
                assert len(MODEL.encode(text[:r.fits])) <= limit
                assert all(len(MODEL.encode(text[:i])) > limit for i in range(r.fits + 1, min(r.fits + 60, len(text)) + 1))
    got = {r.doc_id: r for r in entry.queries()["op11_prefix_counts"](spark, SF).collect()}
    assert all(got[r.doc_id].n_tokens == len(MODEL.encode(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_budgets_from_stored_counts(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id <> 6 and doc_id <> 7")
    table = prefix_counts.prefix_counts(docs).join(docs.select("doc_id", "text").distinct(), "doc_id")
    rows = table.select("text", prefix_counts.tokens_of_prefix(F.col("counts"), F.lit(9)).alias("n"), prefix_counts.longest_prefix(F.col("counts"), F.lit(5)).alias("c")).collect()
    assert len(rows) > 5
    for r in rows:
        text = r.text or ""
        assert r.n == len(MODEL.encode(text[:9]))
        assert r.c == max(i for i in range(len(text) + 1) if len(MODEL.encode(text[:i])) <= 5)
    assert prefix_counts.prefix_counts(no_docs).count() == 0 and prefix_counts.token_counts(no_docs).count() == 0


def plain_alignment(texts):
    """By sets of ends: no sorting, no running maximum."""
    alphabet = {v: k for k, v in ((b, chr(c)) for b, c in alignment.token_blocks.byte_alphabet().items())}
    rows, links = [], Counter()
    for text in texts:
        a = SIDE_A.encode(" " + text, add_special_tokens=False).ids if text else []
        b = MODEL.encode(text) if text else []
        spelled_a = [bytes(alphabet[c] for c in SIDE_A.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if MODEL.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [MODEL.id_to_piece(i)]]
        if not text or b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
            rows.append((0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
        at_a, at_b = ({e: i for i, e in enumerate(ends)} for ends in (ends_a, ends_b))
        groups, own, i, j = [], [], 0, 0
        for high in sorted(at_a.keys() & at_b.keys()):
            x, y = a[i:at_a[high] + 1], b[j:at_b[high] + 1]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            own.append((x[-1], y[-1]))
            i, j = at_a[high] + 1, at_b[high] + 1
        links.update(own)
        rows.append((len(a), len(b), len(groups), own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [(n_a, n_b, n, len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), sha) for n_a, n_b, n, own, sha in rows], links


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_alignment_matches_the_definition(spark, odd_docs, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table == "documents" else odd_docs.select("doc_id", "text", "n").union(
        spark.createDataFrame([(1000 + i, t, 0) for i, t in enumerate(odd_texts())], "doc_id long, text string, n int"))
    rows = docs.select("doc_id", "text").collect()
    want, links = plain_alignment([r.text or "" for r in rows])
    got = entry.queries()["op12_alignment"](spark, SF) if table == "documents" else alignment.alignment(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=repr)
    side_a, side_b = alignment.spellings_a(), alignment.spellings_b()
    assert all(side_a.spelled[a].endswith(side_b.spelled[b]) or side_b.spelled[b].endswith(side_a.spelled[a]) for a, b in links)
    assert len(links) < alignment.pair_bound(side_a, side_b) < 1_000_000


def test_groups_are_the_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.append(np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)) if n > 1 else np.zeros(0, np.int64), n) for _ in range(2)]
        starts = [np.append(0, e[:-1]) for e in ends]
        a, b = alignment.coalesce(starts[0], ends[0], starts[1], ends[1])
        both = np.intersect1d(*ends)
        assert (a == np.searchsorted(both, ends[0])).all() and (b == np.searchsorted(both, ends[1])).all()
        p, q = alignment.overlaps(starts[0], ends[0], starts[1], ends[1])
        want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
        assert set(zip(p.tolist(), q.tolist())) == want and (a[p] == b[q]).all()


def test_units_are_looked_up_once_and_words_not_cut(monkeypatch):
    """A slice's units ask the table once, and a part that is one word needs no matches of the pattern."""
    asked, cut = [], []
    numbers = alignment.token_blocks.PieceEncoder.__init__.__globals__["Memory"].numbers
    monkeypatch.setattr("tallyfold.llm.pieces.Memory.numbers", lambda self, keys: asked.append(len(keys)) or numbers(self, keys))
    own = alignment.Sides(alignment.SIDE_A, alignment.SIDE_B)
    texts = ["the cat sat, here", "a cat  sat", "", None, "naïve cat ..."]
    ids, count = own.b.encode(pa.array(texts[:1]))
    assert len(asked) == 1 and ids.tolist() == MODEL.encode(texts[0])
    whole = own.a.cut
    monkeypatch.setattr(own.a, "cut", lambda unit: cut.append(unit) or whole(unit))
    ids, count = own.a.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in SIDE_A.encode(t or "", add_special_tokens=False).ids]
    assert cut and not any(x[1:].isalpha() and (x[0] == " " or x[0].isalpha()) for x in cut)


def test_both_sides_take_one_cut():
    """Side B asks its model for runs of letters, signs and digits, each once; where its pieces joined them, for whole parts."""
    own, asked = alignment.Sides(alignment.SIDE_A, alignment.SIDE_B), []
    answer = own.b.encode_pieces
    own.b.encode_pieces = lambda units: asked.extend(units) or answer(units)
    texts = ["the cat sat, here", "(cat) sat.\nThe 12st, the", "it's naïve... the"]
    (ids_a, _), (ids_b, _) = own.encode(pa.array(texts))
    assert ids_a.tolist() == [i for t in texts for i in SIDE_A.encode(" " + t, add_special_tokens=False).ids]
    assert ids_b.tolist() == [i for t in texts for i in MODEL.encode(t)]
    assert len(asked) == len(set(asked)) and {" the", " cat", ",", ".", "\n", "The", "st", " 12", " it's"} < set(asked) and " sat," not in asked
    odd = [t for t in odd_texts() if t and "▁" not in t]
    for own.b.plain in (True, False):
        own.b.known = type(own.b.known)()
        ids, count = own.encode(pa.array([*odd, None, ""]))[1]
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [*MODEL.encode(odd), *[[MODEL.piece_to_id("▁")]] * 2]
    assert " sat," not in asked and any(x.startswith(" ") and "." in x and x[1:2].isalpha() for x in asked)


def test_pieces_that_join_kinds_are_found():
    assert alignment.splits_at_kinds(["▁the", "...", "▁(", "é", "▁▁", "\n", "12", "'s.a"])
    assert not any(alignment.splits_at_kinds(["a", x]) for x in ("a.", "▁a1", "\n\n", "▁\n", "\na", "(é"))


def test_numbers_remembered_are_bounded(monkeypatch):
    """Parts without spaces have many numbers each, so the count of strings alone bounds little."""
    monkeypatch.setattr("tallyfold.llm.pieces.ROOM", 2000)
    own = alignment.Sides(alignment.SIDE_A, alignment.SIDE_B)
    for i in range(40):
        text = chr(0x4E00 + i) * 500
        for (ids, _), want in zip(own.encode(pa.array([text])), (SIDE_A.encode(" " + text, add_special_tokens=False).ids, MODEL.encode(text))):
            assert ids.tolist() == want
        assert max(own.a.known.used, own.b.known.used) < 10_000


def test_digests_of_ids_of_any_length():
    rng = np.random.default_rng(3)
    ids = np.concatenate([[0, 9, 10, 99_999, 100_000, 1_234_567], rng.integers(0, 50_000, 94)])
    group, side, text = np.arange(100) // 2, np.arange(100) % 2, np.arange(100) // 20
    want = [hashlib.sha256(";".join(f"{ids[i]}|{ids[i + 1]}" for i in range(a, a + 20, 2)).encode()).hexdigest() for a in range(0, 100, 20)]
    assert alignment.written(ids, group, side, text, 6) == [*want, ""]
    cell, length = alignment.numerals(128)
    assert bytes(cell[[0, 7, 127]]) == b"0".ljust(8, b"\0") + b"7".ljust(8, b"\0") + b"127".ljust(8, b"\0") and length[[0, 7, 127]].tolist() == [1, 1, 3]


def test_empty_tables(no_docs):
    assert alignment.alignment(no_docs).count() == 0
