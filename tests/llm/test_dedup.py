"""Substring, byte-string and SimHash deduplication against brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest_llm import ODD

from querytide.llm import simhash, substring_dedup, suffix_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_substrings(rows, window):
    seen: dict[tuple, list] = {}
    for d, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((d, s))
    low = {k: min(v) for k, v in seen.items()}
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            if low[tuple(w[s : s + window])] < (d, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_match_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [[r.choice("abcde") for _ in range(r.randint(0, 40))] for _ in range(8)]
    rows = [(d, r.choice([" ", "\n", "\t "]).join(r.choice(pool) + [r.choice("xyz")] + r.choice(pool)[:10])) for d in range(60)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 6, 3).collect()
    assert sorted(tuple(x) for x in got) == brute_substrings(rows, 6)


@pytest.mark.parametrize("local", [False, True])
def test_pieces_keep_ids_of_64_bits(local):
    ids = np.array([1 << 63, (1 << 64) - 1, (1 << 53) + 1, 12345], np.uint64)
    mini, piece = np.repeat(np.arange(4, dtype=np.uint64), 2), np.repeat(ids, 2)
    doc, start, length = np.arange(8), np.arange(8, dtype=np.uint32), np.full(8, 5, np.uint16)
    blobs = [b"P" + substring_dedup.deal(np.zeros(8, np.int64), [mini, piece, doc, np.zeros(8, np.int64), start, length]).__next__()[1]]
    if local:  # spans settled in a chunk come in the same batch
        blobs.append(b"L" + next(substring_dedup.deal(np.zeros(1, np.int64), [np.array([9]), np.array([0]), np.array([0], np.uint32), np.array([3], np.uint32), np.array([0], np.uint8)]))[1])
    found = pa.Table.from_batches(substring_dedup._settle_pieces(blobs)).to_pylist()
    claims = {r["piece"] % (1 << 64) for r in found if r["kind"] == substring_dedup.CLAIM}
    assert claims == set(ids.tolist())


def test_long_spans_of_the_test_documents_are_compacted(spark, sf, monkeypatch):
    """Half of the graph under one id would leave nearly every claim a span of its own."""
    seen = {}
    long_spans = substring_dedup.long_spans

    def counted(claims):
        spans = long_spans(claims)
        seen["claims"], seen["spans"] = claims.count(), spans.count()
        seen["most"] = claims.groupBy("piece").count().agg({"count": "max"}).first()[0]
        return spans

    monkeypatch.setattr(substring_dedup, "long_spans", counted)
    larger = os.path.join(os.path.dirname(sf), "sf0.01")  # several chunks, so that claims cross them
    substring_dedup.dedup_substrings(spark.read.parquet(f"{larger}/documents.parquet"), texts=False).count()
    assert seen["spans"] < 0.5 * seen["claims"] and seen["most"] < 0.2 * seen["claims"], seen


def test_substrings_odd_texts(documents):
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(ODD)).collect()}
    assert len(got) == len(ODD)
    assert (got[0].n_words, got[0].n_removed, got[0].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    for (d, n, gone, sha, _), x in zip(brute_substrings(list(enumerate(ODD)), 20), (got[i] for i in range(len(ODD))), strict=True):
        assert (x.doc_id, x.n_words, x.n_removed, x.kept_sha256) == (d, n, gone, sha)


def test_substrings_rows_that_share_an_id(documents):
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.dedup_substrings(documents([text, text, "other " + text, None], ids=[5, 5, 5, None])).collect()
    by = Counter((r.doc_id, r.n_words, r.n_removed) for r in got)
    # equal rows do not remove each other; the longer text of the same document starts its copies later
    assert by == {(5, 30, 0): 2, (5, 31, 30): 1, (None, 0, 0): 1}


def test_substrings_empty_table(documents):
    assert substring_dedup.dedup_substrings(documents([])).count() == 0


def brute_bytes(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_bytes_match_brute_force(spark, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("ab é") for _ in range(r.randint(0, 120))) for _ in range(10)]
    rows = [(d, r.choice(pool)[: r.randint(0, 99)] + r.choice(["x", "y", ""]) + r.choice(pool)[r.randint(0, 30) :]) for d in range(50)]
    rows += [(50, None), (51, ""), (None, pool[0] * 2), (52, "a" * 90), (53, pool[1]), (53, pool[1])]
    got = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 20, 8).drop("kept").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_bytes(rows, 20)


@pytest.mark.parametrize("step", [1 << 20, 200])
def test_bytes_columns_give_the_index_of_the_collection(monkeypatch, step):
    monkeypatch.setattr(suffix_dedup, "COLLECTION_BYTES", step)
    r = np.random.default_rng(0)
    data = r.integers(0, 3, 4000).astype(np.uint8)
    first, wide, offset = np.arange(0, 3900, 100), r.integers(10, 41, 39), r.integers(0, 20, 39)
    collection = suffix_dedup.Collection(data, first, wide, offset, 60)
    collection.build()
    rows = np.zeros((39, 61), int)
    for k in range(39):
        rows[k, offset[k] : offset[k] + wide[k]] = data[first[k] : first[k] + wide[k]] + 1.0
    order_before = np.arange(39)
    for column, transform, order, prefixes in collection.index():
        suffix = [tuple(rows[k, column:]) for k in range(39)]
        assert [suffix[k] for k in order] == sorted(suffix)
        assert (transform == rows[order_before, column]).all()
        for i in range(1, 39):
            a, b = suffix[order[i - 1]], suffix[order[i]]
            common = next((n for n in range(len(a)) if a[n] != b[n] or not a[n]), len(a))
            assert prefixes[i] == common
        order_before = order
    collection.close()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_collide_in_polynomial_hashes(spark):
    one = thue_morse(1024)
    two = one.translate({97: 98, 98: 97})
    spread = lambda w: " ".join(w)
    rows = [(0, f"{one} x y z q"), (1, f"{two} x y z q"), (2, spread(one)), (3, spread(two)), (4, f"p {two} x y z q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in substring_dedup.dedup_substrings(docs, 5, 3).collect()) == brute_substrings(rows, 5)
    assert sorted(tuple(x) for x in suffix_dedup.dedup_bytes(docs, 400, 200, texts=False).collect()) == sorted(brute_bytes(rows, 400))


def test_weak_hashes_are_found_out(spark):
    r = random.Random(7)
    pool = [" ".join(r.choice("abcdef") for _ in range(60)) for _ in range(12)]
    rows = [(d, r.choice(pool)[: r.randint(20, 119)] + f" q{d} " + r.choice(pool)) for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup_substrings(docs, 6, 3, bits=6).collect()
    assert sorted(tuple(x) for x in got) == brute_substrings(rows, 6)
    got = suffix_dedup.dedup_bytes(docs, 20, 8, texts=False, bits=4).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute_bytes(rows, 20))


def test_paths_join_pieces_that_do_not_branch(spark):
    # a chain of 20, a fork after it, a circle of three and a piece that follows itself
    steps = [(i, 2, i + 1) for i in range(20)] + [(20, 2, 21), (20, 2, 22), (30, 1, 31), (31, 1, 32), (32, 1, 30), (40, 1, 40)]
    found = {r.piece: (r.path, r.offset) for r in substring_dedup.paths(spark.createDataFrame(steps, "piece long, count int, next long")).collect()}
    assert found == {i: (0, 2 * i) for i in range(1, 21)}


def test_bytes_odd_texts(documents):
    got = sorted(tuple(x) for x in suffix_dedup.dedup_bytes(documents(ODD + ["z" * 900])).drop("kept").collect())
    assert got == sorted(brute_bytes(list(enumerate(ODD + ["z" * 900])), 400))
    assert suffix_dedup.dedup_bytes(documents([])).count() == 0


def fingerprint(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def test_simhash_fingerprints_and_groups(documents):
    r = random.Random(1)
    base = [f"w{r.randint(0, 400)}" for _ in range(600)]
    texts = [*ODD, "long" * 400 + " b c d"]
    for i in range(40):  # chains of near copies: a word more each time
        texts.append(" ".join(base[: 590 - i] + [f"Q{i}"]))
    got = {x.doc_id: x for x in op6(documents(texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert any(find(i) != i and prints[i] not in prints[:i] for i in range(len(texts))), "the fixture must link different fingerprints"
    for i in range(len(texts)):
        assert got[i]["fp"] & (1 << 64) - 1 == prints[i]
        assert got[i]["component"] == find(i)


def op6(df):
    return simhash.near_duplicates(df).withColumnRenamed("_id", "doc_id")


def test_hot_keys_are_dealt_as_tile_pairs(spark):
    r = np.random.default_rng(2)
    # many fingerprints share two blocks; a small tile forces pairs of tiles
    fps = np.unique((np.uint64(0xABCD1234) << np.uint64(32)) | r.integers(0, 1 << 12, 600).astype(np.uint64)).view(np.int64)
    found = simhash.components(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), tile=50)).collect()
    root = {int(x): int(x) for x in fps} | {x.node: x.root for x in found}
    left, right = simhash.tile_links(fps.view(np.uint64), 2, 64)
    node, top = simhash.forest(left.view(np.int64), right.view(np.int64))
    expect = {int(x): int(x) for x in fps} | dict(zip(node.tolist(), top.tolist(), strict=True))
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(root) == groups(expect)


def test_simhash_representatives(documents):
    texts = ["one two three four"] * 3 + [None, "", "other text entirely here"]
    docs = documents(texts, ids=[9, 4, 4, 2, 7, 1])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert simhash.representatives(documents([])).count() == 0


def test_xxh64_lengths():
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    length = np.concatenate([np.arange(1, 120), [1023, 1024, 1025, 2000]])
    start = r.integers(0, 3000, len(length))
    got = simhash.xxh64(data, start, length)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(start, length, strict=True)]


def test_frequent_anchors_keep_equal_windows_together():
    from querytide.llm import anchors

    r = np.random.default_rng(5)
    grams = r.integers(0, 40, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    frequent = anchors.Frequent(np.unique(grams)[::3])
    assert (frequent.has(grams) == np.isin(grams, np.unique(grams)[::3])).all()
    width = 4
    place = anchors.positions(grams, width, frequent)
    seen = {}
    for i, p in enumerate(place):
        window = tuple(grams[i : i + width].tolist())
        assert seen.setdefault(window, int(p) - i) == int(p) - i
        if not frequent.has(grams[i : i + width]).all():
            assert not frequent.has(grams[p : p + 1])[0]


def test_a_hot_passage_among_different_words(documents):
    hot = " ".join(f"h{i}" for i in range(40))
    texts = [f"a{i} b{i} c{i} {hot} d{i} e{i} f{i}" for i in range(60)]
    got = sorted(tuple(x) for x in substring_dedup.dedup_substrings(documents(texts)).collect())
    assert got == brute_substrings(list(enumerate(texts)), 20)
    raw = sorted(tuple(x) for x in suffix_dedup.dedup_bytes(documents(texts), 40, 16).drop("kept").collect())
    assert raw == sorted(brute_bytes(list(enumerate(texts)), 40))
