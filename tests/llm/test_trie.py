"""The conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from querytide.llm import trie


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], sum(not children[q] for q in below), saved, sha))
    return sorted(out, key=str)


def built(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, label string, depth int")
    return sorted((tuple(r) for r in trie.prefix_trie(df, **sizes).collect()), key=str)


@pytest.mark.parametrize(("members", "seed"), [(1, 0), (3, 1), (12, 2), (256, 3)])
def test_trie_matches_brute_force(spark, members, seed):
    r = random.Random(seed)
    rows = []
    for c in range(120):
        same = c % 3 == 0  # a third are copies
        for t in range(4 if same else r.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"hello turn {t}" if same else r.choice(["a b", "a  b", "c", "hello turn 0"])))
    r.shuffle(rows)
    assert built(spark, rows, members=members) == brute(rows)


def test_trie_bounds_the_heavy_prefixes(spark):
    rows = [(c, t, "user", "same") for c in range(40) for t in range(3)]
    assert built(spark, rows, members=1, most=2) == brute(rows)


def test_trie_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 0, "user", "lost"), (20, 5, "a", "x" * 50_000), (-3, 0, "1:", "b"), (-4, 0, "1", ":b"), (31, 1, "q", "own"), (45, 0, "a", "b c"), (60, 0, "ä", "ü ö d")]
    for members in (1, 256):
        assert built(spark, rows, members=members) == brute([r for r in rows if r[0] is None or r[0] >= 0] + [r for r in rows if r[0] is not None and r[0] < 0])


def test_trie_turnless_conversations_end_at_the_root(spark):
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lost, 0, "user", "goes with its absent base")]
    assert built(spark, rows) == brute(rows) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


def test_trie_empty_table(spark):
    assert built(spark, []) == []


def test_level_order_bits():
    ids, length = np.array([0, 1, 0, 2, 3, 0]), np.array([2, 3, 1])  # 01, 023, 0
    made, labels, end = trie.louds_of(ids, length)
    assert "".join("01"[int(b)] for b in made.bits) == "101100100"
    assert labels.tolist()[1:] == [0, 1, 2, 3]
    assert made.parents().tolist() == [0, 0, 1, 1, 3]
    assert made.children().tolist() == [1, 2, 0, 1, 0]
    assert end.tolist() == [2, 4, 1]
