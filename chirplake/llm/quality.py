"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.llm.util import bounded_batches, join_checked, map_rows, saved, unused, utf8

#: Most labelled rows that the classifier is fitted on (a documented bound; the smallest hashes of doc_id are taken).
MAX_LABELLED = 20_000
#: Documents are rejected when the posterior probability of good quality is below this.
THRESHOLD = 0.5
#: Byte classes: blank, newline, digit, lower, upper, non-ASCII, then punctuation in six groups.
_GROUPS = (b" \t\r\x0b\x0c", b"\n", b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 256)), b".,;:", b"!?", b"'\"`-()", b"#$%&*@^~+=", b"<>[]{}|\\/_")
N_CLASSES = len(_GROUPS) + 1
_CLASS_OF = np.full(256, N_CLASSES - 1, np.uint8)
for _k, _group in enumerate(_GROUPS):
    _CLASS_OF[np.frombuffer(_group, np.uint8)] = _k
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + 4


def text_features(text: bytes) -> np.ndarray:
    """Shares of byte classes and of pairs of them, length, word length, repeated words and lines of a whole text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    kinds = _CLASS_OF[np.frombuffer(text, np.uint8)]
    single = np.bincount(kinds, minlength=N_CLASSES)
    pairs = np.bincount(kinds[:-1].astype(np.int16) * N_CLASSES + kinds[1:], minlength=N_CLASSES**2)
    out[: N_CLASSES**2] = np.sqrt(pairs / max(1, len(text) - 1))
    out[N_CLASSES**2 : -4] = np.sqrt(single / len(text))
    words, lines = text.split(), text.split(b"\n")
    out[-4] = math.log1p(len(text)) / 10
    out[-3] = math.log1p(len(text) / max(1, len(words))) / 3
    out[-2] = len(set(words)) / max(1, len(words))
    out[-1] = len(set(lines)) / len(lines)
    return out


@dataclass(frozen=True)
class Classifier:
    """Logistic regression on standardised :func:`text_features`."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, rounds: int = 30) -> Classifier:
    """Ridge logistic regression by Newton steps; a single class (or no row) gives its smoothed prior log odds."""
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return Classifier(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), math.log(prior / (1 - prior)))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    w[-1] = math.log(prior / (1 - prior))
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def label_means(labels: DataFrame) -> DataFrame:
    """doc_id and y, 0 to 1, of all documents of ``labels`` (doc_id, quality). Null numbers and labels do not count; several labels of a document give their mean."""
    rows = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    return rows.groupBy("doc_id").agg(F.avg(F.least(F.greatest("y", F.lit(0.0)), F.lit(1.0))).alias("y"))


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most ``max_labelled`` rows of :func:`label_means`: those of the smallest hashes of doc_id, whatever the partitions."""
    return label_means(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def fit_classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Fit on the documents of :func:`labelled_sample`; labels without a document do not count, and those of one half or more are good."""
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(labelled_sample(labels, max_labelled)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t or b"").astype("<f4").tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], ["doc_id", "x", "y"])

    got = bounded_batches(found.select("doc_id", "text", "y")).mapInArrow(run, "doc_id bigint, x binary, y double").toPandas()
    got = got.sort_values(["doc_id", "y", "x"], kind="stable")
    x = np.array([np.frombuffer(b, "<f4") for b in got["x"]], dtype=float).reshape(len(got), N_FEATURES)
    return fit(x, (got["y"].to_numpy(dtype=float) >= 0.5).astype(float))


def with_logit(rows: DataFrame, model: Classifier, text: str, logit: str) -> DataFrame:
    """``rows`` without the column ``text`` and with ``logit``, the classifier's log odds of good quality for the whole text."""
    others = [c for c in rows.columns if c != text]
    schema = T.StructType([f for f in rows.schema.fields if f.name != text]).add(logit, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t or b"") for t in utf8(batch.column(len(others)))]).reshape(batch.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(model.logits(x), -20, 20))], schema.names)

    return map_rows(rows.select(*[F.col(f"`{c}`") for c in (*others, text)]), run, schema)


def posterior(total: Column, n: Column, vote: Column, prior: Column, strength: float) -> Column:
    """Mean of the beta posterior after ``n`` soft votes that add up to ``total``, but for the one ``vote`` among them."""
    return (F.greatest(total - vote, F.lit(0.0)) + prior * strength) / (F.greatest(n - 1, F.lit(0.0)) + strength)


def _strength(groups: DataFrame, total: str, n: str, mean: float) -> float:
    """Prior strength of a beta-binomial by the method of moments over the groups: small if they differ, large if they agree."""
    row = groups.agg(
        F.sum(n).alias("n"), F.count("*").alias("k"),
        F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - mean, 2)).alias("ss"),
        F.sum(F.col(n) * F.col(n)).alias("nn"),
    ).first()
    if not row["k"] or row["k"] < 2 or not row["n"]:
        return 10.0
    size = row["n"] - row["nn"] / row["n"]
    noise = mean * (1 - mean)
    between = (row["ss"] - (row["k"] - 1) * noise) / max(size, 1e-9)
    return float(min(1e4, max(2.0, noise / max(between, 1e-9) - 1)))


@dataclass(frozen=True)
class Sites:
    """Sums of votes by (host, path): table of host, path, s, n and the host's hs, hn; the totals; and the prior strengths of hosts and paths."""

    table: DataFrame
    total: float
    n: float
    host_strength: float
    path_strength: float


def site_sums(sites: DataFrame) -> Sites:
    """From (host, path, s: sum of soft votes, n: their number). The strengths are fitted to how much hosts (paths) really differ, so that a site of a few documents stays near its prior."""
    hosts = sites.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    row = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    total, n = row["s"] or 0.0, row["n"] or 0.0
    mean = (total + 1) / (n + 2)
    return Sites(sites.join(hosts, "host"), total, n, _strength(hosts, "hs", "hn", mean), _strength(sites, "s", "n", mean))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, columns: list[str], max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list[str]]:
    """``columns`` of docs (doc_id, text, others) with four more, whose names are given back: p_doc, p_host, p_path and p, lengthened where docs has them.

    p_doc is the classifier's probability of good quality. It is fitted on at most
    ``max_labelled`` labels, but all labels vote: a row's vote for its site is its label,
    or else p_doc. p_host
    is the host's posterior under the mean of all rows as the prior, p_path the
    (host, path)'s under the host's; both, and the mean, leave out the row's own
    vote, so that a site of one document stays at its prior. p is the sum of the
    document's log odds and of what the site adds to the mean's, as a probability.

    Two passes over the texts take the place of moving them: the first feeds sums
    per (host, path), combined before they move, so that a host with a third of
    all rows is a few rows by then; the second scores. Null hosts and paths are
    empty ones, null texts empty texts, a null doc_id has no label. Rows that
    repeat vote each. Without labels p_doc is one half. A very long text is counted
    whole. An empty table gives an empty table.
    """
    names = unused(docs, "p_doc", "p_host", "p_path", "p", "host", "path", "number", "body", "logit", "y", "s", "n", "hs", "hn")
    p_doc, p_host, p_path, p, h, w, number, body, logit, y, s, n, hs, hn = names
    model = fit_classifier(docs, labels, max_labelled)
    known = saved(label_means(labels), "labelled").toDF(number, y)
    site = [F.coalesce(host.cast("string"), F.lit("")).alias(h), F.coalesce(path.cast("string"), F.lit("")).alias(w)]
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], *site, F.col("doc_id").cast("bigint").alias(number), F.col("text").cast("string").alias(body))
    chance = 1 / (1 + F.exp(-F.col(logit)))
    vote = F.coalesce(F.col(y), chance)
    votes = join_checked(with_logit(keyed.select(h, w, number, body), model, body, logit), known, [number], "left").select(F.col(h).alias("host"), F.col(w).alias("path"), vote.alias("v"))
    sums = site_sums(saved(votes.groupBy("host", "path").agg(F.sum("v").alias("s"), F.count("*").cast("double").alias("n")), "sites"))
    sites = sums.table.select("host", "path", "s", "n", "hs", "hn").toDF(h, w, s, n, hs, hn)
    scored = join_checked(join_checked(with_logit(keyed, model, body, logit), sites, [h, w], "left"), known, [number], "left")
    mean = (F.greatest(F.lit(sums.total) - vote, F.lit(0.0)) + 1) / (F.lit(max(sums.n - 1, 0.0)) + 2)
    scored = scored.withColumn(p_doc, chance).withColumn(p_host, posterior(F.col(hs), F.col(hn), vote, mean, sums.host_strength))
    scored = scored.withColumn(p_path, posterior(F.col(s), F.col(n), vote, F.col(p_host), sums.path_strength))
    log_odds = lambda x: F.log(x / (1 - x))
    odds = F.col(logit) + log_odds(F.col(p_path)) - log_odds(mean)
    return scored.withColumn(p, 1 / (1 + F.exp(-odds))).select(*[F.col(f"`{c}`") for c in columns], p_doc, p_host, p_path, p), names[:4]


def classify_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_document, p_host, p_path, p_quality, kept for each row of ``docs`` (doc_id, text, source, lang; other columns are ignored). See :func:`score`."""
    scored, names = score(docs, labels, F.col("source"), F.col("lang"), ["doc_id"])
    rounded = [F.round(F.col(a), 6).alias(b) for a, b in zip(names, ("p_document", "p_host", "p_path", "p_quality"), strict=True)]
    return scored.select("doc_id", *rounded, (F.col(names[3]) >= THRESHOLD).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns as they are, whatever their names. See :func:`score`."""
    scored, names = score(docs, labels, F.col("source"), F.col("lang"), docs.columns)
    return scored.where(F.col(names[3]) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
