"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its pairs of bytes (hashed) and its runs of four byte classes (upper and lower case, digits, full stops and commas, other signs, blanks, line feeds,
bytes beyond ASCII), all over the whole text, with logs of their counts.  On a bounded sample of labelled rows (``SAMPLE`` rows at most; the bound of the fit) document
frequencies weigh the terms and a truncated singular-value decomposition gives ``rank`` latent directions.  The latent vectors alone carry the vote: projection and
labelled vectors have fixed greatest sizes (``CHARS + RUNS`` x ``rank`` and ``SAMPLE`` x ``rank`` numbers) and are broadcast.  Each text's cosines with all labelled
vectors are exact, from blocked matrix products; the ``k`` nearest vote with their similarity to the power ``sharpness``, each class weighed by its
share in the sample.  Every document is scored by itself, without a shuffle.

The sample is that of the least hashes of (doc_id, label), the same on every run.  Its texts become term counts where they lie; the driver gets at most ``CHARS + RUNS``
numbers for each row, however long its text is.  Null labels are no labels; null texts are empty.  Texts without a term have the latent vector of no terms, and score the
even prior 0.5 unless the sample holds texts like them.  Repeated rows score alike; repeated labels each count.  Without any labelled row every score is 0.5.  An
empty table gives an empty result; ``keep`` carries all other columns.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import text_of
from .textscan import SPACE, Scan, mix, scans

CHARS, RUNS, SAMPLE = 2048, 4096, 3072
BLOCK = 1024


@dataclass(frozen=True)
class Settings:
    """``terms``: ``chars`` (pairs of bytes), ``runs`` (of four byte classes) or ``both``."""

    rank: int = 24
    k: int = 5
    sharpness: float = 8.0
    terms: str = "both"


SETTINGS = Settings()

# classes of bytes: upper case, lower case, digits, full stops and commas, other ASCII signs, blanks, line feeds, beyond ASCII
CLASSES = np.full(256, 4)
CLASSES[ord("A") : ord("Z") + 1] = 0
CLASSES[ord("a") : ord("z") + 1] = 1
CLASSES[ord("0") : ord("9") + 1] = 2
CLASSES[list(b".,")] = 3
CLASSES[SPACE] = 5
CLASSES[10] = 6
CLASSES[128:] = 7


def profiles(scan: Scan) -> np.ndarray:
    """Per text the logs of its terms' counts: CHARS cells of byte pairs, RUNS cells of class runs."""
    data, n = scan.data, scan.n
    out = np.zeros((n, CHARS + RUNS), np.float32)
    doc = np.repeat(np.arange(n), np.diff(scan.off))
    wide, c = data.astype(np.uint64), CLASSES[data]
    for low, size, width in ((0, CHARS, 2), (CHARS, RUNS, 4)):
        if len(data) < width:
            continue
        if width == 2:
            cell = (mix(wide[:-1] << np.uint64(8) | wide[1:]) >> np.uint64(53)).astype(np.int64)
        else:
            cell = c[:-3] * 512 + c[1:-2] * 64 + c[2:-1] * 8 + c[3:]
        inside = doc[width - 1 :] == doc[: len(doc) - width + 1]
        out[:, low : low + size] = np.log1p(np.bincount((doc[width - 1 :] * size + cell)[inside], minlength=n * size).reshape(n, size))
    return out


def weighed(x: np.ndarray, idf: np.ndarray, s: Settings = SETTINGS) -> np.ndarray:
    """Terms by inverse frequency, at unit length."""
    y = x * idf
    if s.terms == "chars":
        y[:, CHARS:] = 0
    elif s.terms == "runs":
        y[:, :CHARS] = 0
    return unit(y)


class Voter:
    """The fitted model; all that is broadcast."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, settings: Settings = SETTINGS):
        self.labels, self.settings = labels.astype(np.float32), settings
        self.empty = not len(x)
        if self.empty:
            return
        df = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + np.float32(0.1)
        w = weighed(x, self.idf, settings)
        self.basis = latent(w, settings.rank)
        self.vectors = unit(w @ self.basis)
        ones = float(self.labels.mean())
        self.class_weight = np.where(self.labels > 0, 0.5 / max(ones, 1e-9), 0.5 / max(1 - ones, 1e-9)).astype(np.float32)

    def narrowed(self, settings: Settings, x: np.ndarray) -> Voter:
        """The same model with fewer directions or another vote; x is what it was fitted on."""
        out = copy.copy(self)
        out.settings, out.basis = settings, self.basis[:, : settings.rank]
        out.vectors = unit(weighed(x, self.idf, settings) @ out.basis)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.full(len(x), 0.5)
        out = []
        for low in range(0, len(x), BLOCK):
            v = unit(weighed(x[low : low + BLOCK], self.idf, self.settings) @ self.basis)
            cos = v @ self.vectors.T
            k = min(self.settings.k, cos.shape[1])
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cos, near, axis=1), 0) ** self.settings.sharpness * self.class_weight[near]
            total = vote.sum(axis=1)
            out.append(np.where(total > 0, (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), 0.5))
        return np.clip(np.concatenate(out).astype(np.float64), 0, 1) if out else np.zeros(0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def latent(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors (columns), by subspace iteration from a fixed start."""
    rng = np.random.default_rng(12345)
    q = np.linalg.qr(rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def profiles_of(texts: list[str]) -> np.ndarray:
    col = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return np.concatenate([np.zeros((0, CHARS + RUNS), np.float32), *(profiles(s) for s in scans(col, rows=BLOCK))])


def cross_validated(x: np.ndarray, labels: np.ndarray, groups: np.ndarray, grid: list[Settings], *, folds: int = 4) -> list[tuple[float, float]]:
    """For each setting the error and mean square error, averaged over both labels, of rows scored by models of other folds.

    Rows of one group share a fold.  Settings of the same terms share a decomposition, of which they take the leading directions.
    """
    fold = (mix(groups.astype(np.uint64)) % np.uint64(folds)).astype(int)
    scores = np.full((len(grid), len(labels)), 0.5)
    for f in range(folds):
        test = fold == f
        if not test.any() or test.all():
            continue
        for terms in sorted({s.terms for s in grid}):
            same = [(i, s) for i, s in enumerate(grid) if s.terms == terms]
            voter = Voter(x[~test], labels[~test], max((s for _, s in same), key=lambda s: s.rank))
            for i, s in same:
                scores[i, test] = voter.narrowed(s, x[~test]).score(x[test])
    out = []
    for got in scores:
        by_label = [(((got >= 0.5) != y)[labels == y].mean(), ((got - y) ** 2)[labels == y].mean()) for y in (0, 1) if (labels == y).any()]
        out.append(tuple(float(np.mean(v)) for v in zip(*by_label, strict=True)))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE, settings: Settings = SETTINGS) -> Voter:
    """Fit on at most ``sample`` labelled rows, those of the least hashes."""

    order = ["__place", "doc_id", "label"]
    rows = sampled(docs, labels, label=label, sample=sample)
    schema = T.StructType([*(rows.schema[c] for c in order), T.StructField("cells", T.BinaryType()), T.StructField("logs", T.BinaryType())])

    def fold(batches):
        for b in batches:
            for s in scans(b, rows=64):
                found = [(np.flatnonzero(x), x[x > 0]) for x in profiles(s)]
                cells = pa.array([c.astype("<u2").tobytes() for c, _ in found], pa.binary())
                logs = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(s.first, s.n) for c in order), cells, logs], names=schema.names)

    got = rows.select(*order, "text").mapInArrow(fold, schema).orderBy(*order, "cells", "logs").limit(sample).collect()
    x = np.zeros((len(got), CHARS + RUNS), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["cells"], "<u2")] = np.frombuffer(r["logs"], "<f4")
    return Voter(x, np.array([r["label"] > 0 for r in got], np.float32), settings)


def sampled(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label, __place) of the rows of at most ``sample`` labels."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label is not null and doc_id is not null")
    known = known.withColumn("__place", F.xxhash64("doc_id", "label")).orderBy("__place", "doc_id", "label").limit(sample)
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")


def score(self, x: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.full(len(x), 0.5)
        out = []
        for low in range(0, len(x), BLOCK):
            v = unit(weighed(x[low : low + BLOCK], self.idf, self.settings) @ self.basis)
            cos = v @ self.vectors.T
            k = min(self.settings.k, cos.shape[1])
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cos, near, axis=1), 0) ** self.settings.sharpness * self.class_weight[near]
            total = vote.sum(axis=1)
            out.append(np.where(total > 0, (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), 0.5))
        return np.clip(np.concatenate(out).astype(np.float64), 0, 1) if out else np.zeros(0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def latent(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors (columns), by subspace iteration from a fixed start."""
    rng = np.random.default_rng(12345)
    q = np.linalg.qr(rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def profiles_of(texts: list[str]) -> np.ndarray:
    col = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return np.concatenate([np.zeros((0, CHARS + RUNS), np.float32), *(profiles(s) for s in scans(col, rows=BLOCK))])


def cross_validated(x: np.ndarray, labels: np.ndarray, groups: np.ndarray, grid: list[Settings], *, folds: int = 4) -> list[tuple[float, float]]:
    """For each setting the error and mean square error, averaged over both labels, of rows scored by models of other folds.

    Rows of one group share a fold.  Settings of the same terms share a decomposition, of which they take the leading directions.
    """
    fold = (mix(groups.astype(np.uint64)) % np.uint64(folds)).astype(int)
    scores = np.full((len(grid), len(labels)), 0.5)
    for f in range(folds):
        test = fold == f
        if not test.any() or test.all():
            continue
        for terms in sorted({s.terms for s in grid}):
            same = [(i, s) for i, s in enumerate(grid) if s.terms == terms]
            voter = Voter(x[~test], labels[~test], max((s for _, s in same), key=lambda s: s.rank))
            for i, s in same:
                scores[i, test] = voter.narrowed(s, x[~test]).score(x[test])
    out = []
    for got in scores:
        by_label = [(((got >= 0.5) != y)[labels == y].mean(), ((got - y) ** 2)[labels == y].mean()) for y in (0, 1) if (labels == y).any()]
        out.append(tuple(float(np.mean(v)) for v in zip(*by_label, strict=True)))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE, settings: Settings = SETTINGS) -> Voter:
    """Fit on at most ``sample`` labelled rows, those of the least hashes."""

    def fold(batches):
        for b in batches:
            for s in scans(b, rows=64):
                x = profiles(s)
                rows = [np.flatnonzero(r) for r in x]
                cells = pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())
                logs = pa.array([x[i][r].astype("<f4").tobytes() for i, r in enumerate(rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("label").slice(s.first, s.n), cells, logs], names=["label", "cells", "logs"])

    got = sampled(docs, labels, label=label, sample=sample).select("text", "label").mapInArrow(fold, "label int, cells binary, logs binary").collect()
    got = sorted(got, key=lambda r: (r["label"], r["cells"], r["logs"]))
    x = np.zeros((len(got), CHARS + RUNS), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["cells"], "<u2")] = np.frombuffer(r["logs"], "<f4")
    return Voter(x, np.array([r["label"] > 0 for r in got], np.float32), settings)


def sampled(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label, __place) of the rows of at most ``sample`` labels."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label is not null and doc_id is not null")
    known = known.withColumn("__place", F.xxhash64("doc_id", "label")).orderBy("__place", "doc_id", "label").limit(sample)
    # by ids alone first, so that texts of the sample are all that is moved
    ids = docs.select("doc_id", F.xxhash64(text_of()).alias("__hash")).join(F.broadcast(known), "doc_id").orderBy("__place", "doc_id", "label", "__hash").limit(sample)
    wanted = ids.groupBy("doc_id", "__hash", "label").agg(F.count("*").alias("__times"))
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("__hash", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "__hash"])
    return rows.select("doc_id", "text", "label", "__times")


def score(self, x: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.full(len(x), 0.5)
        out = []
        for low in range(0, len(x), BLOCK):
            v = unit(weighed(x[low : low + BLOCK], self.idf, self.settings) @ self.basis)
            cos = v @ self.vectors.T
            k = min(self.settings.k, cos.shape[1])
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cos, near, axis=1), 0) ** self.settings.sharpness * self.class_weight[near]
            total = vote.sum(axis=1)
            out.append(np.where(total > 0, (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), 0.5))
        return np.clip(np.concatenate(out).astype(np.float64), 0, 1) if out else np.zeros(0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def latent(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors (columns), by subspace iteration from a fixed start."""
    rng = np.random.default_rng(12345)
    q = np.linalg.qr(rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def profiles_of(texts: list[str]) -> np.ndarray:
    col = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return np.concatenate([np.zeros((0, CHARS + RUNS), np.float32), *(profiles(s) for s in scans(col, rows=BLOCK))])


def cross_validated(x: np.ndarray, labels: np.ndarray, groups: np.ndarray, grid: list[Settings], *, folds: int = 4) -> list[tuple[float, float]]:
    """For each setting the error and mean square error, averaged over both labels, of rows scored by models of other folds.

    Rows of one group share a fold.  Settings of the same terms share a decomposition, of which they take the leading directions.
    """
    fold = (mix(groups.astype(np.uint64)) % np.uint64(folds)).astype(int)
    scores = np.full((len(grid), len(labels)), 0.5)
    for f in range(folds):
        test = fold == f
        if not test.any() or test.all():
            continue
        for terms in sorted({s.terms for s in grid}):
            same = [(i, s) for i, s in enumerate(grid) if s.terms == terms]
            voter = Voter(x[~test], labels[~test], max((s for _, s in same), key=lambda s: s.rank))
            for i, s in same:
                scores[i, test] = voter.narrowed(s, x[~test]).score(x[test])
    out = []
    for got in scores:
        by_label = [(((got >= 0.5) != y)[labels == y].mean(), ((got - y) ** 2)[labels == y].mean()) for y in (0, 1) if (labels == y).any()]
        out.append(tuple(float(np.mean(v)) for v in zip(*by_label, strict=True)))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE, settings: Settings = SETTINGS) -> Voter:
    """Fit on at most ``sample`` labelled rows, those of the least hashes."""

    def fold(batches):
        for b in batches:
            for s in scans(b, rows=64):
                x = profiles(s)
                rows = [np.flatnonzero(r) for r in x]
                cells = pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())
                logs = pa.array([x[i][r].astype("<f4").tobytes() for i, r in enumerate(rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("label").slice(s.first, s.n), cells, logs], names=["label", "cells", "logs"])

    got = sampled(docs, labels, label=label, sample=sample).select("text", "label").mapInArrow(fold, "label int, cells binary, logs binary").collect()
    got = sorted(got, key=lambda r: (r["label"], r["cells"], r["logs"]))
    x = np.zeros((len(got), CHARS + RUNS), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["cells"], "<u2")] = np.frombuffer(r["logs"], "<f4")
    return Voter(x, np.array([r["label"] > 0 for r in got], np.float32), settings)


def sampled(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label, __place) of the rows of at most ``sample`` labels."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label is not null and doc_id is not null")
    known = known.withColumn("__place", F.xxhash64("doc_id", "label")).orderBy("__place", "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")
    return rows.orderBy("__place", "doc_id", "label", "text").limit(sample).select("doc_id", "text", "label")


def score(docs: DataFrame, model: Voter, *, carry: list[str]) -> DataFrame:
    """The carried columns and ``score``, from 0 to 1: how likely label 1 is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            found = [shared.value.score(profiles(s)) for s in scans(b, "__text", rows=BLOCK)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(np.concatenate([np.zeros(0), *found]))], names=schema.names)

    return docs.select(*carry, text_of().alias("__text")).mapInArrow(run, schema)


def keep(docs: DataFrame, model: Voter, *, least: float = 0.5) -> DataFrame:
    """docs that score at least ``least``, all columns kept."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    scored = score(rows, model, carry=["row"]).where(F.col("score") >= least)
    return scored.select(*(F.col(f"row.`{c}`") for c in docs.columns))
