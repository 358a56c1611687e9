"""Exact, SimHash, suffix and paragraph dedup against plain versions."""

import glob
import hashlib
import os
import random
import re
import tempfile
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck
from llm_data import SF
from tallyfold import session
from tallyfold.llm import common, exact_dedup, paragraph_dedup, passage_dedup, simhash, suffix_dedup


def test_exact_matches_sql(spark):
    assert compare(entry.queries()["op7_exact_dedup"](spark, SF), duck(SF), entry.oracle_sql()["op7_exact_dedup"]) is None


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c).cast("long")])
def test_exact_groups_of_odd_documents(odd_docs, digest):
    """Also with a digest that collides all the time: content decides then."""
    rows = exact_dedup.exact_groups(odd_docs, digest).collect()
    texts = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in odd_docs.collect()]
    want = []
    for doc_id, t in texts:
        ids = [d for d, x in texts if x == t]
        keep = min((d for d in ids if d is not None), default=None)
        want.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_chunks_join_to_the_text(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["bad", "the", "cat", "naïve", "中文"]) for _ in range(30_000)) + "x" * 20_000
    row = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).first()
    assert "".join(row.c) == text and len(row.c) > 20 and max(map(len, row.c)) <= 8192


def test_empty_tables(no_docs):
    for result in (exact_dedup.exact_groups(no_docs), simhash.near_duplicates(no_docs), suffix_dedup.repeated_passages(no_docs), paragraph_dedup.near_paragraphs(no_docs)):
        assert result.count() == 0


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(values, near):
    """Smallest id reachable for each (id, value)."""
    label = {i: i for i, _ in values}
    changed = True
    while changed:
        changed = False
        for i, a in values:
            for j, b in values:
                if near(a, b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    values = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    label = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == {i: (f"{v:016x}", label[i]) for i, v in values}


def test_simhash_of_odd_documents(odd_docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    prints = {r.doc_id: f"{plain_fingerprint(r.text):016x}" for r in odd_docs.collect() if r.doc_id is not None}
    assert all(prints[d] == f for d, f, _ in got if d is not None)
    groups = {d: c for d, _, c in got}
    assert groups[2] == groups[13] == groups[11] == 1 and groups[4] == groups[5] == 3
    assert sorted(c for d, _, c in got if d is None) == [1, 3]


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_simhash_links_of_close_fingerprints(spark, block_rows):
    """One hot bucket and chains, whole or split into blocks."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = {int(b) ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 5))) for b in base for _ in range(60)}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = common.components(simhash.links(frame, block_rows=block_rows))
    got = {r.id % (1 << 64): r.component for r in found.collect()}
    want = plain_components([(v - (1 << 64) if v >> 63 else v,) * 2 for v in values], lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    sizes = list(want.values())
    assert got == {i % (1 << 64): c for i, c in want.items() if sizes.count(c) > 1}


def test_bit_planes_count_distances():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 1000):
        values = rng.integers(0, 1 << 63, n, dtype=np.uint64) & rng.integers(0, 1 << 63, n, dtype=np.uint64) & rng.integers(0, 1 << 63, n, dtype=np.uint64) & rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sliced = simhash.planes(values)
        for radius in (0, 2, 5):
            assert (simhash.within(iter(sliced), sliced.shape[1], radius)[:n] == (np.bitwise_count(values) <= radius)).all()


def passages(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    own = lambda n: [word() for _ in range(n)]
    shared = [own(60), own(51), own(49), own(200)]
    docs = []
    for i in range(60):
        text = own(rng.randint(0, 120))
        for s in rng.sample(shared, rng.randint(0, 2)):
            cut = rng.choice([0, 0, rng.randint(0, len(s))])
            text += s[cut:] + own(rng.randint(0, 70))
        docs.append((i, " ".join(text)))
    docs += [(100, docs[5][1]), (101, docs[5][1] + " more"), (102, "same " * 130), (103, ""), (104, None)]
    return docs


@pytest.mark.parametrize("block_rows", [3, 20_000])
def test_repeated_passages_are_exact(spark, block_rows):
    """Every position in a window of 50 words that stands at two places, and no other; sources too."""
    docs = passages()
    got = suffix_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), block_rows=block_rows).collect()
    places = {}
    for i, t in docs:
        w = (t or "").split()
        for p in range(len(w) - 49):
            places.setdefault(tuple(w[p:p + 50]), []).append((i, p))
    windows = {(i, p, *min(v)) for v in places.values() if len(v) > 1 for i, p in v}
    spans = {(r.doc_id, p, r.source_doc_id, r.source_start + p - r.start) for r in got for p in range(r.start, r.end - 49)}
    assert windows <= spans
    words = {i: (t or "").split() for i, t in docs}
    assert all(r.end - r.start >= 50 and words[r.doc_id][r.start:r.end] == words[r.source_doc_id][r.source_start:r.source_start + r.end - r.start] for r in got)
    assert {(i, p) for i, p, *_ in spans} == {(i, p) for i, p, *_ in windows}
    assert all(r.removed == ((r.doc_id, r.start) != (r.source_doc_id, r.source_start)) for r in got)


def test_only_what_can_repeat_goes_further(spark):
    """Lines of 20 words in many texts are no repeat of 50 words; their suffixes meet no other."""
    rng = random.Random(4)
    own = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    line, passage = own(20), own(70)
    docs = [(i, " ".join(own(60) + line + own(60) + (passage if i in (3, 8) else []))) for i in range(30)]
    anchors = suffix_dedup.anchors(spark.createDataFrame(docs, "doc_id long, text string").withColumn("text_key", F.xxhash64("text")))
    assert {r.doc_id for r in suffix_dedup.recurring(anchors).collect()} == {3, 8}


def test_finished_shuffles_are_removed(spark):
    """Also those of the query that has just ended."""
    folder = f"{spark.conf.get('spark.local.dir', tempfile.gettempdir())}/blockmgr-*/*/shuffle_*"
    before = set(glob.glob(folder))
    rows = spark.range(100_000).repartition("id")
    rows.write.format("noop").mode("overwrite").save()
    mine = set(glob.glob(folder)) - before
    del rows
    common.free_shuffles(spark)
    for _ in range(30):
        if not any(map(os.path.exists, mine)):
            break
        time.sleep(0.1)
    assert mine and not any(map(os.path.exists, mine))


def test_repeated_passages_of_odd_documents(odd_docs):
    got = {(r.doc_id, r.source_doc_id) for r in suffix_dedup.repeated_passages(odd_docs).collect()}
    assert (7, 6) in got and {d for d, _ in got} == {6, 7}


def test_near_paragraphs_match_brute_force(spark):
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefghijklm") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(n)]
    base = [words(n) for n in (20, 25, 60, 90, 150)]
    docs = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(base)) if rng.random() < 0.6 else words(rng.randint(5, 60))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(["edit", "other"])
            lines.append(" ".join(line).upper() if rng.random() < 0.2 else " ".join(line))
        docs.append((i, "\n".join(lines)))
    sets = {(i, n): frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) for i, t in docs for n, line in enumerate(t.split("\n")) if len(w := line.lower().split()) >= 20}
    label = plain_components([(k, v) for k, v in sets.items()], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    sizes = list(label.values())
    want = {(k, c) for k, c in label.items() if sizes.count(c) > 1}
    for block_rows in (5, 1000):
        got = paragraph_dedup.near_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"), block_rows=block_rows).collect()
        assert {((r.doc_id, r.paragraph), (r.keep_doc_id, r.keep_paragraph)) for r in got} == want
        assert all(r.removed == ((r.doc_id, r.paragraph) != (r.keep_doc_id, r.keep_paragraph)) for r in got)


def test_short_lines_are_compared(spark):
    """With ``least`` of one: lines of any number of words, repeats inside a run, hard-wrapped passages."""
    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdefghijklm") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(n)]
    base = [words(n) for n in (1, 2, 4, 5, 6, 8, 9, 10, 12, 15, 19)] + [["a"] * 5, ["a"] * 7, ["a", "b"] * 4, ["a", "b"] * 9, ["a"] * 30]
    docs = []
    for i in range(50):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base)) if rng.random() < 0.7 else words(rng.randint(0, 19))
            if line and rng.random() < 0.3:
                line[rng.choice([0, -1])] = rng.choice(["edit", "other"])
            lines.append(" ".join(line).upper() if rng.random() < 0.2 else " ".join(line))
        docs.append((i, "\n".join(lines)))
    docs += [(100 + i, "\n".join(" ".join(f"w{k}" for k in range(a, a + 9)) for a in range(0, 63, 9))) for i in range(2)]
    sets = {(i, n): frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) for i, t in docs for n, line in enumerate(t.split("\n")) if (w := line.lower().split())}
    label = plain_components([(k, v) for k, v in sets.items()], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    sizes = list(label.values())
    got = paragraph_dedup.near_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"), least=1).collect()
    assert {((r.doc_id, r.paragraph), (r.keep_doc_id, r.keep_paragraph)) for r in got} == {(k, c) for k, c in label.items() if sizes.count(c) > 1}
    assert sum(r.doc_id == 101 and r.keep_doc_id == 100 for r in got) == 7


def test_near_paragraphs_of_odd_documents(odd_docs):
    got = {(r.doc_id, r.keep_doc_id) for r in paragraph_dedup.near_paragraphs(odd_docs).collect()}
    assert got == {(1, 1), (2, 1), (13, 1), (6, 6), (7, 6)}


def planted(seed=11):
    """Clean texts, and passages of 58 words or more that stand in several: in running text, hard-wrapped, in capitals, with a word changed."""
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]
    shared = [words(n) for n in (58, 60, 75, 90, 200)]
    docs, held = [], {}
    for i in range(120):
        body, own = words(rng.randint(0, 200)), []
        if i % 3:
            own = [rng.randrange(len(shared))]
            piece = list(shared[own[0]])
            if i % 4 == 0 and len(piece) > 80:
                piece[len(piece) // 2] = "changed"
            body += piece
        body += words(rng.randint(0, 150))
        text = " ".join(body)
        if i % 5 == 0:
            text = "\n".join(" ".join(body[k:k + 9]) for k in range(0, len(body), 9))
        docs.append((i, text.upper() if i % 7 == 0 else text))
        held[i] = own
    docs += [(500, "of " * 300), (501, "x of " + "of " * 300), (502, None), (503, ""), (504, "a b c"), (None, docs[1][1]), docs[1]]
    return docs, held


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_planted_passages_are_found_and_clean_texts_left_alone(spark, tmp_path, block_rows):
    docs, held = planted()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = passage_dedup.near_passages(frame, block_rows=block_rows).collect() if block_rows < 1000 else entry.queries()["op6_paragraph_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, own in held.items() if own}
    assert all(held[r.keep_doc_id] == held[r.doc_id] and r.keep_doc_id <= r.doc_id and r.removed == (r.doc_id != r.keep_doc_id) for r in got)


def test_passages_match_brute_force(spark):
    """Groups of the same paragraphs by all pairs: what is found is right, equal ones are all found, near ones nearly all."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(2)
    for i, t in docs[:60]:
        w = (t or "").split()
        for at in rng.sample(range(len(w)), len(w) // 60):
            w[at] = "edited"
        docs.append((10_000 + i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts, sets, spelled = dict(docs), {}, {}
    for r in passage_dedup.paragraphs(frame).collect():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]).encode().split()[r.start:r.end]
        sets.setdefault(r.k, frozenset(tuple(w[x:x + 5]) for x in range(len(w) - 4)))
        assert spelled.setdefault(r.k, w) == w and len(w) >= passage_dedup.SHORTEST
        assert len(sets[r.k]) >= passage_dedup.DISTINCT
    holders = {}
    for k, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(k)
    close = {(a, b) for own in holders.values() for a in own for b in own if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    stored = passage_dedup.paragraphs(frame)
    found = {(r.id, r.component) for r in common.components(passage_dedup.near_links(stored, frame)).collect()}
    label = {k: c for k, c in found}
    want = {}
    for a, b in close:
        want.setdefault(a, set()).add(b)
        want.setdefault(b, set()).add(a)
    assert set(label) <= set(want)
    joined = sum(label.get(a) is not None and label.get(a) == label.get(b) for a, b in close)
    assert len(close) > 30 and joined >= 0.97 * len(close)


def test_a_pair_is_compared_once(spark):
    """However many bands it meets in and however many copies there are; a bucket's size is that of its different paragraphs."""
    rows = [(1, 5), (1, 9), (1, 9), (2, 9), (2, 5), (3, 5), (3, 5), (4, 1), (4, 2), (4, 7), (4, 2), (5, 8)]
    for parts in (1, 3):
        got = passage_dedup.shared_buckets(spark.createDataFrame(rows, "bucket long, k long").repartition(parts)).distinct().collect()
        assert sorted((r.n, r.k) for r in got) == [(2, 5), (2, 9), (3, 1), (3, 2), (3, 7)]
        assert len({r.bucket for r in got}) == 2


def test_what_no_text_could_confirm_is_dropped(spark):
    """Paragraphs that meet in a bucket but whose sketches differ too much go no further; near ones do, in groups of their own."""
    rng = random.Random(6)
    words = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("xyz") + str(rng.randrange(50)) for _ in range(n)]
    body = words(20)
    docs = [(i, " ".join(words(20))) for i in range(30)] + [(100, " ".join(body)), (101, " ".join(body[:-1] + ["end"]))]
    rows = passage_dedup.paragraphs(spark.createDataFrame(docs, "doc_id long, text string").repartition(1))
    rows = rows.where("start = 0").withColumn("bucket", F.lit(7).cast("long"))
    own = {r.k: r.doc_id for r in rows.collect()}
    got = passage_dedup.shared_buckets(rows.select("bucket", "k", "sketch")).collect()
    assert sorted((own[r.k], r.n) for r in got) == [(100, 2), (101, 2)]


@pytest.mark.parametrize("direct", [2048, 3])
def test_sketch_groups_match_brute_force(monkeypatch, direct):
    """Any two of a bucket that sketches allow to be near are in one group, also where buckets are dealt by parts of sketches."""
    monkeypatch.setattr(passage_dedup, "DIRECT", direct)
    rng = np.random.default_rng(1)
    limit = passage_dedup.allowed()
    for turn in range(40):
        n = int(rng.integers(0, 120))
        bucket = np.sort(rng.integers(-3, 6, n)) * 10 ** 17
        sketch = rng.integers(0, 1 << 27, 8)[rng.integers(0, 8, n)]
        for _ in range(3):
            sketch = sketch ^ np.where(rng.random(n) < 0.5, 1 << rng.integers(0, 27, n), 0)
        count = rng.integers(10, 23, n)
        if turn % 5 == 0:
            count[:1] = 31
        allowed = lambda i, j: bucket[i] == bucket[j] and (max(count[i], count[j]) == 31 or int(sketch[i] ^ sketch[j]).bit_count() * 9 <= count[i] + count[j])
        want = plain_components([(i, i) for i in range(n)], allowed)
        got = passage_dedup.sketch_groups(bucket, (sketch << 5 | count).astype(np.uint32), limit)
        assert got.tolist() == [want[i] for i in range(n)]


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_forests_of_many_sets(monkeypatch, similarity):
    """The same with and without parities, and few sets are intersected."""
    rng = random.Random(2)
    for _ in range(60):
        base = [frozenset(rng.randrange(300) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 6))]
        sets = [frozenset(b"%d" % x for x in rng.choice(base) ^ {rng.randrange(300) for _ in range(rng.randint(0, 3))}) for _ in range(rng.randint(1, 60))]
        monkeypatch.setattr(paragraph_dedup, "FEW", 1000)
        plain = paragraph_dedup.bucket_forest(sets, similarity)
        monkeypatch.setattr(paragraph_dedup, "FEW", 0)
        assert paragraph_dedup.bucket_forest(sets, similarity) == plain
    met = []

    class Counted(frozenset):
        def __and__(self, other):
            met.append(1)
            return frozenset.__and__(self, other)

    assert paragraph_dedup.bucket_forest([Counted(b"%d %d" % (i, x) for x in range(16)) for i in range(300)], 0.8) == [] and len(met) < 4000


def test_folders_of_finished_steps_are_removed(spark):
    """Texts of paragraphs and what named them don't stay on disk beside the last steps."""
    names = lambda: set(glob.glob(f"{session.shared_folder(spark).removeprefix('file:')}/llm-*/*"))
    before = names()
    docs, _ = planted()
    assert passage_dedup.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert {os.path.basename(x) for x in names() - before} == {"paragraphs"}


def test_every_word_stands_in_a_paragraph(spark):
    """Each word of a text of ``SHORTEST`` words or more, between cuts and at the text's end too."""
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]
    docs = [(i, " ".join(words(n))) for i, n in enumerate([0, 1, 15, 16, 17, 31, 40, 58, 400, 1500, *(rng.randint(16, 300) for _ in range(60))])]
    covered = {i: set() for i, _ in docs}
    for r in passage_dedup.paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r.end - r.start >= passage_dedup.SHORTEST
        covered[r.doc_id] |= set(range(r.start, r.end))
    sizes = {i: len(t.split()) for i, t in docs}
    assert covered == {i: set(range(n if n >= passage_dedup.SHORTEST else 0)) for i, n in sizes.items()}


def test_a_repeat_between_cuts_is_found(spark):
    """Texts that agree just in the words that used to stand between two paragraphs' ends and begins are compared there."""
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]
    shared = words(30)
    docs = [(i, " ".join(words(120) + shared)) for i in range(40)]
    got = passage_dedup.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.end == 150 and r.start >= 120} == set(range(40))


def test_passages_of_odd_documents(odd_docs, no_docs):
    got = {(r.doc_id, r.keep_doc_id) for r in passage_dedup.near_passages(odd_docs).collect()}
    assert got == {(1, 1), (2, 1), (11, 1), (13, 1), (6, 6), (7, 6)}
    assert passage_dedup.near_passages(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {200: 200, 300: 200}
