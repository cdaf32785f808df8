"""The pipeline, stage by stage, and the registered queries."""

import itertools
import math
import os
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import fingerprint
from test_text import brute_contamination

from querytide.llm import langid, mixing, registry, tables, toxicity
from querytide.llm import textkernel as tk


def brute_scores(model, texts):
    """Toxicity by definition: token by token, maximal segments by search, the sum statistic by its formula."""
    lexicon, calibration, out = model.lexicon, model.calibration, []
    known = {}
    for text in texts:
        tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        for t in set(tokens) - set(known):
            raw = np.frombuffer(t.encode(), np.uint8)
            known[t] = int(lexicon.scores(toxicity.Tokens(tk.Chunk(raw, np.array([0, len(raw)]))))[0])
        n = len(tokens)
        found = [sum(known[t] for t in tokens[i:j]) for i, j in brute_maximal([known[t] for t in tokens])]
        normal = [min(max(calibration.rate * s / toxicity.UNIT - math.log(max(n, 1)) - calibration.shift, -20), 40) for s in found]
        some = sorted((x for x in normal if x > toxicity.LEAST_NORMAL), reverse=True)
        if some:
            evidence = max(sum(some[:r]) - (r - 1) * math.log(max(sum(some[:r]), 1)) + math.lgamma(r + 1) + math.lgamma(r) for r in range(1, len(some) + 1))
        else:
            evidence = max(normal, default=-20.0)
        out.append(1 / (1 + math.exp(-(calibration.curve[0] + calibration.curve[1] * evidence))))
    return out


def brute_maximal(scores):
    """Maximal scoring segments: the best one, then those left and right of it. Scores that follow each other with one sign count as one."""
    runs, todo, out = [], [], []
    for sign, group in itertools.groupby(range(len(scores)), key=lambda i: scores[i] > 0):
        i = list(group)
        runs.append((i[0], i[-1] + 1, sum(scores[k] for k in i)))
    todo = [(0, len(runs))]
    while todo:
        a, b = todo.pop()
        best, low, low_at, total = (0, a, a), 0, a, 0
        for k in range(a, b):  # the largest rise of the running sum
            total += runs[k][2]
            if total - low > best[0]:
                best = (total - low, low_at, k + 1)
            if total < low:
                low, low_at = total, k + 1
        if best[0] > 0:
            out.append((runs[best[1]][0], runs[best[2] - 1][1]))
            todo += [(a, best[1]), (best[2], b)]
    return out


def test_stages_against_brute_force(spark, sf):
    docs = tables.table(spark, sf, "documents")
    extra = docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:])
    before, by = docs.unionByName(extra), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "source_mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = tables.written(stage(spark, before, sf), name)
        by[name] = ([(r.doc_id, r.text) for r in before.collect()], after)
        assert k == 4 or after.columns == docs.columns
        before = after
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    start, left = by["toxicity"]
    model = toxicity.learnt(spark, sf, docs.unionByName(extra))
    scores = brute_scores(model, [t for _, t in start])
    assert rows(left) == sorted((r for r, s in zip(start, scores, strict=True) if s < toxicity.THRESHOLD), key=str)
    start, left = by["simhash_near_dedup"]
    prints, least = [fingerprint(t) for _, t in start], {}
    group = list(range(len(start)))
    for i, j in itertools.combinations(range(len(start)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    for (d, _), g in zip(start, group, strict=True):
        least[g] = min(least.get(g, (True, 1 << 62)), (d is not None, d or 0))
    assert sorted(((r.doc_id is not None, r.doc_id or 0) for r in left.collect())) == sorted(least.values())
    start, left = by["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in tables.table(spark, sf, "benchmark").collect()]
    judged = brute_contamination([(k, t) for k, (_, t) in enumerate(start)], items, 13)
    assert rows(left) == sorted((start[k] for k, *_, bad in judged if not bad), key=str)
    start, left = by["pii_surrogates"]
    private = re.compile(r"[\w.%+-]+@[\w.-]+\.[a-z]{2,}|\+?\d[\d ().-]{7,}\d|\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]|\b\d{1,3}(?:\.\d{1,3}){3}\b|[A-Z]{2}\d{2}")
    old, new = sorted(start, key=str), sorted(((r.doc_id, r.text) for r in left.collect()), key=lambda r: str((r[0],)))
    assert sorted(str(d) for d, _ in old) == sorted(str(d) for d, _ in new)
    plain = sorted((r for r in start if not private.search(r[1] or "")), key=str)
    assert plain and not [r for r in plain if r not in set(new)]
    mails = {m for _, t in start for m in re.findall(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}", t or "")}
    assert mails and not any(m in (t or "") for m in mails for _, t in new)
    start, left = by["source_mixing"]
    sizes: dict = {}
    for r in by["pii_surrogates"][1].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expect = dict(zip(order, mixing.targets([sizes[s] for s in order], [3.0, 1.0, 2.0] * len(order)), strict=False))
    taken: dict = {}
    for r in left.collect():
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(abs(taken.get(s, 0) - expect[s]) <= 1 for s in order)


def test_run_returns_what_the_stages_return_and_leaves_no_other_table(spark, sf):
    before = set(os.listdir(tables.shared_folder(spark).removeprefix("file://")))
    n = corpus_pipeline.run(spark, sf).count()
    new = set(os.listdir(tables.shared_folder(spark).removeprefix("file://"))) - before
    assert n > 0 and not [x for x in new if x.rsplit("-", 1)[0] in dict(corpus_pipeline.STAGES[:-1])]


def test_planted_cases_are_found(spark):
    """Recall on the smallest table that has enough labels: held-out toxic documents and languages."""
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = langid.op3_language_id(spark, sf).where("held_out").join(truth, "doc_id").where("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_queries_return_a_row_for_each_document(spark, sf, name):
    found = registry.QUERIES[name](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    expect = c.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, sf).toPandas()[list(expect.columns)]
    same = lambda d: sorted(map(tuple, d.astype(str).to_numpy().tolist()))
    assert same(got) == same(expect)


def test_nothing_else_imports_the_subpackage():
    import re
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    rest = [p for p in (root / "querytide").rglob("*.py") if "llm" not in p.parts]
    assert rest and not any(re.search(r"\bllm\b", p.read_text()) for p in rest)
