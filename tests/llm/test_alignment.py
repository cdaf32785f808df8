"""Token alignment against the tokenizers run over whole texts."""

import bisect
import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from conftest_llm import ODD

from querytide.llm import alignment


@pytest.fixture(scope="module")
def both(spark):
    return alignment.Tokenizers(*alignment.files(spark))


def brute(both, rows):
    found, counts = [], Counter()
    for d, text in rows:
        a = both.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = both.b.encode(text or "")
        raw = (" " + (text or "")).encode()
        tokens = []
        for ids, entries in ((a, both.bytes_a), (b, both.bytes_b)):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + len(entries[i]), i))
                at += len(entries[i])
            tokens.append(spans)
        if not text or any(b"".join(e[i] for i in ids) != raw for ids, e in ((a, both.bytes_a), (b, both.bytes_b))):
            found.append((d, [], [], []))
            continue
        links, j = [], 0
        for s, e, i in tokens[0]:
            while tokens[1][j][1] <= s:
                j += 1
            k = j
            while k < len(tokens[1]) and tokens[1][k][0] < e:
                links.append((i, tokens[1][k][2]))
                k += 1
        counts.update(links)
        found.append((d, *tokens, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for d, a, b, links in found:
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        sides = [[[] for _ in cuts] for _ in (a, b)]
        for held, side in zip(sides, (a, b), strict=True):
            for _, e, i in side:
                held[bisect.bisect_left(cuts, e)].append(str(i))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True)]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


ALPHABET = [" ", " ", "  ", "\n", "\t", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​", "a", "the", "It's", "123", "!", "};", "é", "語", "😀", "<|endoftext|>", "<s>", "<0x41>", "\x00", "\x7f", "naïve", "http://x.y"]


@pytest.mark.parametrize("chunk_bytes", [200, 1 << 20])
def test_alignment_matches_whole_texts(spark, both, documents, chunk_bytes):
    r = random.Random(chunk_bytes)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 40))) for _ in range(300)] + ODD[:6] + ["a ▁ b", "▁", " ", "  ", "\n", " \n ", "the the the"]
    got = alignment.token_alignment(documents(texts), chunk_bytes=chunk_bytes).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(both, list(enumerate(texts)))


def test_alignment_of_long_and_repeated_texts_and_shared_ids(spark, both, documents):
    texts, ids = [*ODD, "word " * 10, None], [*range(len(ODD)), 3, None]
    got = alignment.token_alignment(documents(texts, ids)).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(both, list(zip(ids, texts, strict=True)))


def test_alignment_of_an_empty_table(documents):
    assert alignment.token_alignment(documents([])).count() == 0


def test_alignment_of_the_test_documents(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(x) for x in alignment.token_alignment(docs).collect()), key=str) == brute(both, rows)


def test_cuts_follow_the_vocabularies(both):
    assert 32 in both.cuts() and 10 in both.cuts()
    assert 13 not in both.cuts()  # B has entries such as ;\r
    both_with = object.__new__(alignment.Tokenizers)
    both_with.bytes_a, both_with.bytes_b = [b"of the"], [b"x"]
    assert 32 not in both_with.cuts()


def test_segments_cut_before_runs_only():
    found, n = alignment.segments(pa.array(["a  b　 c\nd", "x"]), b" \n")
    assert [x.decode() for x in found.to_pylist()] == [" a", "  b　 c", "\nd", " x"]
    assert n.tolist() == [3, 1]


def test_a_tokenizer_that_changes_text_is_refused(both):
    with pytest.raises(ValueError, match="changes the text"):
        alignment.aligned_slice(both, "a▁".encode(), __import__("numpy").array([4]))
