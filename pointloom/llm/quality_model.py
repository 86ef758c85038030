"""Operator 3, quality classifier: a regularised quadratic discriminant over document statistics.

One scan turns every whole text into a dozen transformed statistics. Each class gets a Gaussian whose
covariance is shrunk towards the pooled one and towards its diagonal; its Cholesky factor is computed once
and travels with the model, and the score is the difference of the two log densities (Mahalanobis term,
log determinant, prior), put on a probability scale by a one-variable logistic fit.

Defined results: null and empty texts have the statistics of an empty text and get a score like any
other; rows without a label are scored only; without labels of both classes every score is 0.5; with
several labels for an id each counts, an id repeated in the table is learned from once a label; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import documents, fold, only, small_batches, stored, unit_hash, tidy

#: Bound of the labelled rows the model is fitted on.
SAMPLE_ROWS = 20_000
FOLDS, CUT = 5, 0.3
#: Shares of the pooled covariance and of the diagonal in a class covariance.
POOLED, DIAGONAL = 0.1, 0.05
STATISTICS = [
    "log_words", "log_symbols_per_word", "upper_ratio", "log_marks_per_word", "distinct_words", "repeated_next",
    "distinct_triples", "log_word_chars", "dup_lines", "digit_ratio", "log_points_per_word", "other_bytes", "entropy",
]


def classes_of_bytes() -> np.ndarray:
    """Row a class of bytes, column a byte: 1 where the byte belongs to the class."""
    names = [range(97, 123), range(65, 91), range(48, 58), b"#*$%&|<>", b"!?", b".,;:", range(128, 256)]
    out = np.zeros((len(names), 256))
    for k, members in enumerate(names):
        out[k, list(members)] = 1
    return out


CLASSES = classes_of_bytes()


def statistics(text: str | None) -> np.ndarray:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256).astype(float)
    lower, upper, digits, symbols, marks, points, other = CLASSES @ counts
    words = text.split()
    n, total = max(1, len(words)), max(1.0, counts.sum())
    again = sum(map(str.__eq__, words, words[1:]))
    triples = len(words) - 2
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    p = counts[counts > 0] / total
    return np.array([
        np.log1p(len(words)), np.log1p(symbols / n), upper / max(1.0, upper + lower), np.log1p(marks / n), len(set(words)) / n, again / n,
        len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 1.0, np.log1p(sum(map(len, words)) / n),
        1 - len(set(lines)) / len(lines) if lines else 0.0, digits / total, np.log1p(points / n), other / total, float(-(p * np.log(p)).sum()),
    ])


def described(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every row."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], [id_col, "x"])

    return only(df, id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, x array<double>")


def labelled(labels: DataFrame, label_col: str, trains, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most about ``rows`` labelled ids (id, y), drawn by hash."""
    known = only(labels, id_col, label_col).filter(trains & F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y"))
    n = known.count()
    return known.filter(unit_hash(F.col(id_col), "labels") < rows / n) if n > rows else known


def training_rows(rows: DataFrame, sample: DataFrame, id_col: str) -> list:
    """(x, y) of the sample, in one order however the rows lie; an id repeated in the table counts once a label."""
    found = rows.join(F.broadcast(sample), id_col).groupBy(id_col, "y").agg(F.min("x").alias("x")).select("x", "y").collect()
    return sorted(found, key=lambda r: (r["y"], r["x"]))


def discriminant(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Means, Cholesky factors and priors of both classes; None if a class is missing."""
    if len(set(y.tolist())) < 2:
        return None
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    own = [z[y == k] for k in (0, 1)]
    scatter = [np.cov(part, rowvar=False, bias=True) if len(part) > 1 else np.zeros((z.shape[1],) * 2) for part in own]
    pooled = sum(len(part) * s for part, s in zip(own, scatter)) / len(z)
    model = {"centre": centre, "scale": scale, "mean": [], "root": [], "log_det": [], "prior": []}
    for part, s in zip(own, scatter):
        s = (1 - POOLED) * s + POOLED * pooled
        s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.diag(s)) + 0.02 * np.eye(len(s))
        root = np.linalg.cholesky(s)
        model["mean"].append(part.mean(0))
        model["root"].append(np.linalg.inv(root))
        model["log_det"].append(2 * np.log(np.diag(root)).sum())
        model["prior"].append(np.log(len(part) / len(z)))
    model["logistic"] = logistic(margin(model, x)[:, None], y)
    return model


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density of class 1 less that of class 0, signed root scale."""
    z = (x - model["centre"]) / model["scale"]
    log = []
    for k in (0, 1):
        d = (z - model["mean"][k]) @ model["root"][k].T
        log.append(model["prior"][k] - 0.5 * (model["log_det"][k] + (d * d).sum(1)))
    gap = log[1] - log[0]
    return np.sign(gap) * np.sqrt(np.abs(gap))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model, the intercept last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = penalty * np.eye(len(w))
    for _ in range(rounds):
        p = chance(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        step *= min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chance(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def fit(rows: DataFrame, labels: DataFrame, label_col: str, trains, id_col: str = "doc_id") -> dict | None:
    """Fit on described rows (id, x) that have a label."""
    found = training_rows(rows, labelled(labels, label_col, trains, SAMPLE_ROWS, id_col), id_col)
    return discriminant(np.array([r["x"] for r in found]), np.array([r["y"] for r in found])) if found else None


def scored(rows: DataFrame, model: dict | None, id_col: str = "doc_id") -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                x = np.array(batch.column(1).to_pylist())
                w = model["logistic"]
                score = chance(margin(model, x) * w[0] + w[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], [id_col, "score"])

    return only(rows, id_col, "x").mapInArrow(tidy(run), f"`{id_col}` {kind}, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(described(documents(spark, sf_dir)), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(rows, labels, "quality", fold(F.col("doc_id"), FOLDS) != 0)
    out = scored(rows, model)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
