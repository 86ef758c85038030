"""Operator 4, language ID by a bidirectional gated recurrent network over bytes.

A small network (one gated layer a direction, byte table in, softmax over the languages at every
byte) is trained in numpy by backpropagation through time on slices of a bounded, documented sample of
labelled documents. Scoring reads every byte of every text in windows of ``WINDOW`` bytes, labels each
position, and takes the mean of the positions' probabilities as the document's.

Defined results: a null text or one without letters is ``und`` with score 0; rows without ``lang`` are
scored but not learned from; with no labelled row at all everything is ``und``; repeated rows are scored
alike; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import documents, fold, only, small_batches, unit_hash, tidy

#: Bounds of the training sample: languages (the most frequent), documents a language, characters of a slice.
SAMPLE_LANGS, SAMPLE_DOCS, SLICE_CHARS = 256, 400, 512
HIDDEN, WINDOW, BATCH = 8, 64, 4096
STEPS, TRAIN_BATCH, TRAIN_BYTES, RATE = 260, 384, 32, 0.02
#: Folds of the contract: a document is held out where crc32(doc_id) mod 5 is 0.
FOLDS = 5
#: Documents whose best language has a lower mean probability are rejected by :func:`keep`.
LEAST = 0.4
LETTER = re.compile(r"[^\W\d_]")


def start(langs: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    out = {"c": np.zeros((langs, 1))}
    for d in "fb":
        out[f"W{d}"] = rng.normal(0, 0.3, (3 * hidden, 256))
        out[f"U{d}"] = rng.normal(0, 0.4, (3 * hidden, hidden))
        out[f"q{d}"] = np.zeros((hidden, 1))
        out[f"V{d}"] = rng.normal(0, 0.3, (langs, hidden))
    return {k: v.astype(np.float32) for k, v in out.items()}


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gradients(net: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions and its gradient. x: bytes (time, batch); y: class (batch)."""
    steps, batch = x.shape
    h_n = net["Uf"].shape[1]
    kept: dict[str, list] = {"f": [], "b": []}
    states = {}
    for d in "fb":
        W, U, q = net[f"W{d}"], net[f"U{d}"], net[f"q{d}"]
        h = np.zeros((h_n, batch), np.float32)
        states[d] = np.zeros((steps, h_n, batch), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, u = W[:, x[t]], U @ h
            z, r = sigmoid(g[:h_n] + u[:h_n]), sigmoid(g[h_n : 2 * h_n] + u[h_n : 2 * h_n])
            m = u[2 * h_n :] + q
            n = np.tanh(g[2 * h_n :] + r * m)
            kept[d].append((t, h, z, r, m, n))
            h = n + z * (h - n)
            states[d][t] = h
    logits = np.einsum("ch,thb->tcb", net["Vf"], states["f"]) + np.einsum("ch,thb->tcb", net["Vb"], states["b"]) + net["c"]
    e = np.exp(logits - logits.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    rows = np.arange(batch)
    loss = float(-np.log(p[:, y, rows] + 1e-9).mean())
    p[:, y, rows] -= 1
    p /= steps * batch
    out = {k: np.zeros_like(v) for k, v in net.items()}
    out["c"] = p.sum((0, 2))[:, None]
    for d in "fb":
        out[f"V{d}"] = np.einsum("tcb,thb->ch", p, states[d])
        U, dh = net[f"U{d}"], np.zeros((h_n, batch), np.float32)
        for t, before, z, r, m, n in reversed(kept[d]):
            dh = dh + net[f"V{d}"].T @ p[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            gates, inner = np.concatenate([dz, dr, dn]), np.concatenate([dz, dr, dm])
            out[f"q{d}"] += dm.sum(1, keepdims=True)
            out[f"U{d}"] += inner @ before.T
            hot = np.zeros((batch, 256), np.float32)
            hot[rows, x[t]] = 1
            out[f"W{d}"] += gates @ hot
            dh = dh * z + U.T @ inner
    return loss, out


def train(slices: list[bytes], labels: np.ndarray, langs: int, steps: int = STEPS, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Backpropagation through time with Adam over random windows of the slices."""
    rng = np.random.default_rng(seed)
    net = start(langs, hidden, rng)
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    by_lang = [np.flatnonzero(labels == k) for k in range(langs)]
    data = [np.frombuffer(s, np.uint8) for s in slices]
    for step in range(1, steps + 1):
        y = rng.integers(0, langs, TRAIN_BATCH)
        x = np.zeros((TRAIN_BYTES, TRAIN_BATCH), np.uint8)
        for b, k in enumerate(y):
            s = data[by_lang[k][rng.integers(len(by_lang[k]))]]
            at = rng.integers(0, max(1, len(s) - TRAIN_BYTES + 1))
            part = s[at : at + TRAIN_BYTES]
            x[: len(part), b] = part
        _, grad = gradients(net, x, y)
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = np.clip(g, -0.05, 0.05)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net[k] = (net[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def label_positions(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities (time, language, batch) of every position of x: bytes (time, batch)."""
    steps, batch = x.shape
    h_n, langs = net["Uf"].shape[1], len(net["c"])
    out = np.empty((steps, langs, batch), np.float32)
    for d in "fb":
        half = np.ones((3 * h_n, 1), np.float32)
        half[: 2 * h_n] = 0.5  # the logistic function by tanh of half its argument
        W, U, q, V = net[f"W{d}"] * half, net[f"U{d}"] * half, net[f"q{d}"], net[f"V{d}"]
        table = np.ascontiguousarray(W)
        h = np.zeros((h_n, batch), np.float32)
        g, u = np.empty((3 * h_n, batch), np.float32), np.empty((3 * h_n, batch), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(table, x[t], axis=1, out=g, mode="clip")
            np.matmul(U, h, out=u)
            gates, n, m = g[: 2 * h_n], g[2 * h_n :], u[2 * h_n :]
            gates += u[: 2 * h_n]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            m += q
            m *= gates[h_n:]
            n += m
            np.tanh(n, out=n)
            h -= n
            h *= gates[:h_n]
            h += n
            if d == "f":
                np.matmul(V, h, out=out[t])
            else:
                p = out[t]
                p += V @ h
                p += net["c"]
                np.exp(p, out=p)
                p /= p.sum(0)
    return out


def score_texts(net: dict[str, np.ndarray], texts: list[str | None], window: int = WINDOW, batch: int = BATCH) -> np.ndarray:
    """Mean probabilities (text, language); rows of zeros for empty texts. Memory is bounded by the batch."""
    langs = len(net["c"])
    sums, sizes = np.zeros((len(texts), langs)), np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held_n = 0

    def flush():
        nonlocal held_n
        rows, own = np.concatenate(held), np.concatenate(owner)
        held.clear(), owner.clear()
        held_n = 0
        for at in range(0, len(rows), batch):
            x = np.ascontiguousarray(rows[at : at + batch].T)
            p, real = label_positions(net, x), x != 0
            whole = bool(real.all())
            total = p.sum(0) if whole else np.einsum("tcb,tb->cb", p, real.astype(np.float32))
            np.add.at(sums, own[at : at + batch], total.T)
            np.add.at(sizes, own[at : at + batch], real.sum(0))

    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        n = -(-len(data) // window)
        padded = np.zeros(n * window, np.uint8)
        padded[: len(data)] = np.frombuffer(data, np.uint8)
        held.append(padded.reshape(n, window))
        owner.append(np.full(n, i))
        held_n += n
        if held_n >= 4 * batch:
            flush()
    if held:
        flush()
    return sums / np.maximum(sizes, 1)[:, None]


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, trains) -> list:
    """(lang, slice) of at most about SAMPLE_DOCS documents a language, drawn by hash."""
    rows = only(df, id_col, text_col, lang_col).filter(trains & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(SAMPLE_LANGS).collect()
    counts = {r[lang_col]: r["n"] for r in counts}
    if not counts:
        return []
    part = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, SAMPLE_DOCS / n)])
    rows = rows.filter(unit_hash(F.col(id_col), "language") < F.element_at(part, F.col(lang_col)))
    room = F.greatest(F.length(text_col) - SLICE_CHARS, F.lit(0)) + 1
    at = (unit_hash(F.col(id_col), "slice") * room).cast("int") + 1
    found = rows.select(lang_col, F.substring(F.col(text_col), at, F.lit(SLICE_CHARS)).alias("s")).collect()
    return sorted((r[lang_col], r["s"]) for r in found if r["s"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trains=None) -> tuple[list[str], dict | None]:
    rows = sample(df, id_col, text_col, lang_col, F.lit(True) if trains is None else trains)
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return [], None
    at = {lang: k for k, lang in enumerate(langs)}
    return langs, train([s.encode() for _, s in rows], np.array([at[lang] for lang, _ in rows]), len(langs))


def verdicts(model: tuple[list[str], dict | None], texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of every text."""
    langs, net = model
    known = [t is not None and net is not None and LETTER.search(t) is not None for t in texts]
    best, score = ["und"] * len(texts), [0.0] * len(texts)
    if any(known):
        p = score_texts(net, [t if k else None for t, k in zip(texts, known)])
        top = p.argmax(1)
        for i in np.flatnonzero(known):
            best[i], score[i] = langs[top[i]], min(1.0, float(p[i, top[i]]))
    return best, score


def keep(df: DataFrame, model: tuple[list[str], dict | None], text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``df`` whose language is known with at least this score, with all their columns."""

    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            best, score = verdicts(model, batch.column(text_col).to_pylist())
            good = [lang != "und" and s >= least for lang, s in zip(best, score)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def predict(df: DataFrame, model: tuple[list[str], dict | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            best, score = verdicts(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return only(df, id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, lang_pred string, score double")


def identify(df: DataFrame) -> DataFrame:
    model = fit(df, trains=fold(F.col("doc_id"), FOLDS) != 0)
    return predict(df, model).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")
