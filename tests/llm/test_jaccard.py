"""The Jaccard join against brute force: both halves, both ways to a prefix, odd ids, groups below the threshold."""

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import jaccard
from tests.llm.test_operators import brute_components

LARGER = "/root/testdata/sf0.01"


def corpus(seed, groups=12):
    rng = random.Random(seed)
    texts = {}
    block = [f"b{k}" for k in range(30)]
    for base in range(groups):
        words = [f"v{rng.randrange(60 if base % 3 else 5000)}" for _ in range(rng.choice([1, 2, 3, 6, 9, 15, 40, 90]))]
        words = words + block if base % 4 == 1 else words
        for _ in range(rng.randrange(1, 14)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(100)}"
            texts[len(texts)] = " ".join(copy[: len(copy) - rng.randrange(0, 2)])
    return texts


def components_of(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("bound,width,percent", [(0, 4, 85), (25, 4, 85), (1 << 30, 4, 85), (12, 2, 60)])
def test_forced_boundaries_equal_brute_force(spark, monkeypatch, bound, width, percent):
    monkeypatch.setattr(jaccard, "boundary", lambda classes, percent: bound)
    texts = corpus(4)
    assert components_of(spark, texts, width=width, percent=percent) == brute_components(texts, width, percent)


def test_frequent_shingles_equal_brute_force(spark, monkeypatch, rare=3):
    """With few shingles called rare, most prefixes hold frequent ones, and some follow from whole sets only."""
    ranked = jaccard.ranked
    known = []

    def watched(sets, often, partners, percent):
        out = ranked(sets, often, partners, percent)
        known.append({r["known"] for r in out.select("known").distinct().collect()})
        return out

    monkeypatch.setattr(jaccard, "ranked", watched)
    monkeypatch.setattr(jaccard, "frequent", lambda df, text_col, width, f=jaccard.frequent: f(df, text_col, width, rare=rare))
    texts = corpus(5, 16)
    assert components_of(spark, texts) == brute_components(texts, 4, 85)
    assert known == [{True, False}, {True}]


def test_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 500)
    monkeypatch.setattr(jaccard, "CHUNK", 40)
    texts = list(corpus(6).values()) + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    often, partners = jaccard.frequent(df, "text", 2, rare=3)
    want = collections.Counter(h for t in texts for h in jaccard.shingles(t, 2).view(np.int64).tolist())
    assert {r["h"]: r["c"] for r in often.collect()} == {h: c for h, c in want.items() if c >= 3}
    few = [c for c in want.values() if c < 3]
    assert partners == pytest.approx(sum(c * (c - 1) for c in few) / sum(few))


def test_low_thresholds_lose_no_link(spark, monkeypatch):
    texts = {0: "a b", 1: "b", 2: "a", 3: "c d e f", 4: "c d x y", 5: "q"}
    for bound in (0, 1 << 30):
        monkeypatch.setattr(jaccard, "boundary", lambda classes, percent: bound)
        for percent in (20, 50):
            assert components_of(spark, texts, width=1, percent=percent) == brute_components(texts, 1, percent)


def test_rows_are_documents_whatever_their_ids(spark):
    a, b, c = (" ".join(f"{p}{k}" for k in range(20)) for p in "abc")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (None, c), (None, c + " z"), (9, c + " z y"), (None, "alone here"), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["class_id"]) for r in jaccard.near_duplicates(df, percent=80).collect()), key=repr)
    want = [(1, 17, 1, 1), (1, 17, 1, 1), (2, 18, 1, 2), (3, 18, 1, 3), (None, 17, 9, None), (None, 18, 9, None), (9, 19, 9, 9), (None, 1, None, None), (4, 0, 4, 4), (4, 0, 4, 4)]
    assert got == sorted(want, key=repr)
    named = df.filter("doc_id is not null").select(F.concat(F.lit("doc-"), "doc_id").alias("doc_id"), "text")
    assert {r["component_id"] for r in jaccard.near_duplicates(named, percent=80).filter("n_shingles > 1").collect()} == {"doc-1", "doc-9"}


def test_alike_below_the_threshold_is_not_all_pairs(spark, monkeypatch):
    """A common block makes all pairs alike (0.67); exact counts put its shingles last, so nearly no pair is tested."""
    pairs, verified = [], jaccard.verified

    def counted(df, found, *rest):
        pairs.append(found.count())
        return verified(df, found, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    block = " ".join(f"c{k}" for k in range(200))
    texts = {k: block + " " + " ".join(f"x{k}_{j}" for j in range(50)) for k in range(200)}
    assert components_of(spark, texts) == {k: k for k in texts}
    assert sum(pairs) < 400  # of 19,900


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")
def test_light_half_is_used_on_the_query_table(spark, monkeypatch):
    bounds, boundary = [], jaccard.boundary
    monkeypatch.setattr(jaccard, "boundary", lambda classes, percent: bounds.append(boundary(classes, percent)) or bounds[-1])
    sizes = [r["n_shingles"] for r in jaccard.op2_jaccard(spark, LARGER).filter("doc_id = class_id and n_shingles > 0").collect()]
    assert 0.1 * len(sizes) <= sum(n < bounds[0] for n in sizes) < len(sizes)
