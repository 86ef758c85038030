"""Scores of the trained operators against plain loops and other formulas; rules of hashing and sampling."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import language, mixing, packing, quality_model, quality_rules, toxicity


def test_quality_scores_equal_densities_by_solve(spark):
    """The cached Cholesky factors give the log densities that solving with the covariances does."""
    rng = np.random.default_rng(3)
    d = len(quality_model.STATISTICS)
    y = (rng.random(300) < 0.4).astype(int)
    x = rng.normal(0, 1, (300, d)) @ rng.normal(0, 1, (d, d)) + y[:, None] * rng.normal(0, 1, d)
    model = quality_model.discriminant(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    scatter = [np.cov(z[y == k], rowvar=False, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * s for k, s in enumerate(scatter)) / len(y)
    log = []
    for k, s in enumerate(scatter):
        s = (1 - quality_model.POOLED) * s + quality_model.POOLED * pooled
        s = (1 - quality_model.DIAGONAL) * s + quality_model.DIAGONAL * np.diag(np.diag(s)) + 0.02 * np.eye(d)
        gap = z - z[y == k].mean(0)
        log.append(np.log((y == k).mean()) - 0.5 * (np.linalg.slogdet(s)[1] + (gap * np.linalg.solve(s, gap.T).T).sum(1)))
    gap = log[1] - log[0]
    want = np.sign(gap) * np.sqrt(np.abs(gap))
    assert np.allclose(quality_model.margin(model, x), want, rtol=1e-6, atol=1e-6)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id bigint, x array<double>")
    got = {r["doc_id"]: r["score"] for r in quality_model.scored(rows, model).collect()}
    w = model["logistic"]
    assert all(got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(v * w[0] + w[1], -40, 40)))) for k, v in enumerate(want))


def test_quality_of_odd_rows_with_a_fitted_model(spark):
    rows = [(1, None), (2, ""), (3, "w " * 50_000), (4, "same"), (4, "same"), (None, "same"), (5, "퟿\U0001f600 \x00")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("x", F.lit("x")).withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)], "doc_id bigint, quality int")
    described = quality_model.described(df)
    model = quality_model.fit(described, labels, "quality", F.lit(True))
    got = quality_model.scored(described, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    assert by[1] == by[2] and by[4] == by[None] and len(by[4]) == 1
    assert quality_model.scored(described.limit(0), model).count() == 0


def plain_network(net, data):
    """Probabilities of every position of one sequence, a step at a time, in double precision."""
    h_n = net["Uf"].shape[1]
    states = {}
    for d in "fb":
        h, out = np.zeros(h_n), [None] * len(data)
        for t in range(len(data)) if d == "f" else reversed(range(len(data))):
            g, u = net[f"W{d}"][:, data[t]], net[f"U{d}"] @ h
            z, r = 1 / (1 + np.exp(-(g[:h_n] + u[:h_n]))), 1 / (1 + np.exp(-(g[h_n : 2 * h_n] + u[h_n : 2 * h_n])))
            n = np.tanh(g[2 * h_n :] + r * (u[2 * h_n :] + net[f"q{d}"][:, 0]))
            h = n + z * (h - n)
            out[t] = h
        states[d] = out
    logits = np.array([net["Vf"] @ f + net["Vb"] @ b + net["c"][:, 0] for f, b in zip(states["f"], states["b"])])
    e = np.exp(logits)
    return e / e.sum(1, keepdims=True)


def test_language_scores_equal_a_plain_network(spark):
    rng = np.random.default_rng(1)
    net = language.start(4, language.HIDDEN, rng)
    net = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in net.items()}
    x = rng.integers(1, 256, (9, 5)).astype(np.uint8)
    got = language.label_positions(net, x)
    for b in range(5):
        assert np.allclose(got[:, :, b], plain_network(net, x[:, b]), atol=1e-5)
    texts = [None, "", "kurz", "straße und été " * 40, "x" * 64, "y" * 65, "z" * 1000]
    scores = language.score_texts(net, texts, batch=7)
    for text, p in zip(texts, scores):
        data = np.frombuffer((text or "").encode(), np.uint8)
        if not len(data):
            assert not p.any()
            continue
        windows = []
        for at in range(0, len(data), language.WINDOW):
            part = np.zeros(language.WINDOW, np.uint8)  # the last window ends in zeros, which the backward half reads first
            part[: len(data) - at] = data[at : at + language.WINDOW]
            windows.append(plain_network(net, part)[: min(language.WINDOW, len(data) - at)])
        assert np.allclose(p, np.concatenate(windows).mean(0), atol=1e-5)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in language.predict(df, (["a", "b", "c", "d"], net)).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == "und"
    assert all(rows[k]["lang_pred"] == "abcd"[scores[k].argmax()] and rows[k]["score"] == pytest.approx(scores[k].max(), abs=1e-5) for k in range(2, 7))


def test_toxicity_of_plain_loop(spark):
    """Marks of the grouped automata equal the least edit distance over the lexicon, for every word of a text."""
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randrange(4, 10))) for _ in range(30)})
    automata = toxicity.Automata([(t, False, 1) for t in terms], group=8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 11))) for _ in range(1500)]
    words += [t[:k] + t[k + 1 :] for t in terms for k in range(len(t))]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    codes = toxicity.points(" ".join(words))
    got = automata.run(codes, *toxicity.word_spans(codes)).tolist()
    want = [min((1 + d for t in terms if (d := distance(w, t)) <= toxicity.edits(t, False)), default=0) for w in words]
    assert got == want and len(set(want)) >= 3


def test_rules_count_repeats_when_hashes_collide(spark, monkeypatch):
    rng = random.Random(4)
    texts = {k: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 120))) for k in range(40)}
    monkeypatch.setattr(quality_rules, "WINDOW_HASH", "pmod(hash(get(_w, i), get(_w, i + 1), get(_w, i + 2)), 3) * 1048576")
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_rules(df).collect()}
    for k, t in texts.items():
        w = t.split()
        often = collections.Counter(zip(w, w[1:], w[2:]))
        assert got[k] == len({i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if often[x] > 1 for j in range(3)})


def test_mix_reruns_agree_and_shared_ids_reach_the_target(spark):
    rng = random.Random(5)
    rows = [(None if i % 3 == 0 else i % 7, f"t{i} " + "w " * rng.randrange(1, 40), f"s{i % 2}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one, two = (sorted(map(tuple, mixing.mix(d).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr) for d in (df, df.repartition(7)))
    assert one == two
    for size, target in {(r[2], r[3]) for r in one}:
        assert abs(sum(r[4] for r in one if r[2] == size) - target) <= 40
    assert mixing.mixed(df).count() == mixing.mix(df).agg(F.sum("copies")).first()[0]


def test_both_tokenizers_give_the_same_ids():
    from tokenizers import Tokenizer
    import public_tokenizers

    whole, encode, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(), random.Random(6)
    plain = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2027), 0x20AC]]
    for _ in range(2000):
        text = "".join(rng.choice(plain if rng.random() < 0.7 else "  \n'sté1") for _ in range(rng.randrange(0, 60)))
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
