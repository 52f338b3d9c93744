"""Document quality by hierarchical empirical Bayes.

A logistic regression on countable properties of a text gives each document's evidence, a
log likelihood ratio free of the share of good documents it was trained on.  What is known
of the document's site comes from all documents: the expected number of good ones per host
and per path of a host, by grouped aggregation.  A path's share is drawn towards its
host's and a host's towards the global one, the more the fewer documents it has; how much
follows from the variance between hosts and between paths (method of moments).  A document
does not count towards its own prior.  Evidence and prior log odds add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens.llm.common import binary_rows, forget_process, sampled, sized, written

MAX_TRAINING = 20_000  # labelled documents the regression is fitted on, smallest key hash first
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SPACES = b" \t\n\r\x0b\x0c"
COMMON_MARKS = b".,;:'\"-()?"
FEATURES = ["length", "upper", "digits", "spaces", "marks", "symbols", "word_length", "distinct_words", "distinct_lines", "symbol_words"]


def text_features(data: bytes) -> list[float]:
    """Shares and logarithms; all 0 for an empty text."""
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    share = [(n - len(data.translate(None, some))) / n for some in (UPPER, DIGITS, SPACES, COMMON_MARKS, LETTERS)]
    symbols = max(0.0, 1.0 - share[1] - share[2] - share[3] - share[4])
    words = data.split()
    count = max(1, len(words))
    lines = data.split(b"\n")
    bare = len(data.translate(None, LETTERS + DIGITS + COMMON_MARKS).split())  # words that hold a symbol
    return [
        math.log1p(n), share[0], share[1], share[2], share[3], symbols,
        (n - share[2] * n) / count, len(set(words)) / count, len(set(lines)) / len(lines), bare / count,
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_process()
    for batch in batches:
        values = np.array([text_features(bytes(t)) for t in binary_rows(batch.column("_text"))]).reshape(-1, len(FEATURES))
        at = batch.schema.get_field_index("_text")
        names = [n for n in batch.schema.names if n != "_text"] + FEATURES
        columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(values[:, j]) for j in range(len(FEATURES))]
        yield pa.RecordBatch.from_arrays(columns, names)


@dataclass
class Regression:
    """Log likelihood ratio of good against bad: ``offset + sum(weights * features)``."""

    offset: float
    weights: np.ndarray
    share: float  # of good documents in training

    def column(self) -> Column:
        terms = [F.lit(float(w)) * F.col(name) for w, name in zip(self.weights, FEATURES, strict=True)]
        value = sum(terms, F.lit(self.offset))
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), value))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Regression:
    """Ridge logistic regression by Newton steps; no evidence where a class is missing."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Regression(0.0, np.zeros(len(FEATURES)), min(max(share, 0.5), 0.999))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    w = np.zeros(z.shape[1])
    w[0] = math.log(share / (1 - share))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grown = z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + penalty
        step = np.linalg.solve(grown, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return Regression(float(w[0] - weights @ mean - math.log(share / (1 - share))), weights, share)


def _strength(between: float, within: float) -> float:
    """Documents that the level above counts for."""
    return min(1e9, max(1e-3, within / between)) if between > 1e-12 else 1e9


def site_priors(scored: DataFrame, share: float) -> tuple[DataFrame, dict[str, float]]:
    """Sums per (host, path) and per host of the chance of being good, and the two strengths of shrinkage.

    ``scored`` has host, path and ``chance``.  Counts are of all documents; partial sums
    leave each task, so a host with a third of all rows costs a row per task.
    """
    paths = scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).cast("double").alias("path_n"), F.sum("chance").alias("path_s"), F.sum(F.col("chance") ** 2).alias("path_q")
    )
    paths = written(paths, "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"), F.sum("path_q").alias("host_q")), "hosts")

    def moments(groups: DataFrame, n: str, s: str, q: str, centre: Column) -> tuple[float, float]:
        """Variance between groups around ``centre``, and within them."""
        mean = F.col(s) / F.col(n)
        row = groups.agg(
            F.sum(n), F.sum(F.col(n) ** 2), F.count(F.lit(1)), F.sum(F.col(q) - F.col(n) * mean**2), F.sum(F.col(n) * (mean - centre) ** 2)
        ).first()
        total, squares, count, inner, outer = (float(v or 0) for v in row)
        within = max(inner, 0.0) / max(1.0, total - count)
        return max(0.0, (outer - (count - 1) * within) / max(1.0, total - squares / max(total, 1.0))), within

    all_rows = hosts.agg(F.sum("host_s"), F.sum("host_n")).first()
    overall = (all_rows[0] + share) / (all_rows[1] + 1) if all_rows[1] else share
    overall = min(max(overall, 1e-4), 1 - 1e-4)
    with_host = paths.join(sized(hosts), "host")
    host_strength = _strength(*moments(hosts, "host_n", "host_s", "host_q", F.lit(overall)))
    path_strength = _strength(*moments(with_host, "path_n", "path_s", "path_q", F.col("host_s") / F.col("host_n")))
    sites = written(with_host.select("host", "path", "path_n", "path_s", "host_n", "host_s"), "sites")
    return sites, {"overall": overall, "host": host_strength, "path": path_strength}


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: key, row_hash, evidence, host_prior, path_prior, posterior, keep.

    ``labels`` holds (key, quality 0/1) of some documents; a document labelled several
    times counts with the mean, null labels do not count.  Without labels of both kinds
    there is no evidence and all documents are kept.  A null text counts as empty; a null
    host or path is a site of its own; repeated rows are judged alike and all returned; an
    empty table gives an empty result.  Of other columns nothing is read.
    ``row_hash`` (two 64-bit hashes of key, text, host and path) tells rows apart.
    """
    columns = [F.col(c).cast("string") for c in (key, host, path, text)]
    marked = [F.coalesce(c, F.lit("\0null")) for c in columns]
    source = docs.select(
        F.col(key).alias("_key"),
        marked[1].alias("host"),
        marked[2].alias("path"),
        F.array(F.xxhash64(*marked), F.xxhash64(F.lit(1), *marked)).alias("row_hash"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"),
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    features = written(source.mapInArrow(_features, f"{fields}, " + ", ".join(f"{f} double" for f in FEATURES)), "features")

    known = labels.where("quality is not null").groupBy(F.col(key).alias("_key")).agg(F.avg("quality").alias("quality"))
    labelled = features.join(known, "_key")
    training = sampled(labelled, MAX_TRAINING, ["_key", "row_hash"]).orderBy(F.xxhash64("_key"), "row_hash")
    rows = training.select("quality", *FEATURES).toPandas().to_numpy(dtype=float)
    model = fit(rows[:, 1:], rows[:, 0])

    log_odds = math.log(model.share / (1 - model.share))
    evidence = features.select("_key", "row_hash", "host", "path", model.column().alias("evidence"))
    scored = evidence.withColumn("chance", 1 / (1 + F.exp(-(F.col("evidence") + log_odds))))
    sites, level = site_priors(scored, model.share)

    def odds(column: str) -> Column:
        p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(column)))
        return F.log(p / (1 - p))

    host_prior = (F.col("host_s") - F.col("chance") + level["host"] * level["overall"]) / (F.col("host_n") - 1 + level["host"])
    path_prior = (F.col("path_s") - F.col("chance") + level["path"] * F.col("host_prior")) / (F.col("path_n") - 1 + level["path"])
    judged = scored.join(sized(sites), ["host", "path"]).withColumn("host_prior", host_prior).withColumn("path_prior", path_prior)
    judged = judged.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + odds("path_prior")))))
    return judged.select(
        F.col("_key").alias(key), "row_hash", "evidence", "host_prior", "path_prior", "posterior", (F.col("posterior") >= threshold).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that ``assess`` keeps."""
    rejected = assess(docs, labels, key, text, host, path).where("not keep").select("row_hash").distinct()
    rejected = written(rejected.select(F.col("row_hash")[0].alias("_h1"), F.col("row_hash")[1].alias("_h2")), "rejected")
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in (key, host, path, text)]
    hashed = docs.withColumns({"_h1": F.xxhash64(*marked), "_h2": F.xxhash64(F.lit(1), *marked)})
    return hashed.join(sized(rejected), ["_h1", "_h2"], "left_anti").select(*docs.columns)
