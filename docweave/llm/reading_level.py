"""Problem 8: reading level of each document.

Method: documents and words form a graph. A word node is a feature of the text (words with their digits made alike, word
endings, signs, and the lengths of sentences) hashed to one of NODES numbers. Graded documents are clamped to their
grade; difficulty then spreads in harmonic rounds: a word's difficulty is the mean of its documents', a document's the
mean of its words', each word weighing the more the less its documents differ. In a round every partition adds up its
documents' contributions to each word node, the sums are added by word, and the means go back to all tasks, a table of
at most NODES rows. Rounds end when the words' difficulties change by less than TOLERANCE on average. A monotone fit
maps the spread difficulty onto the grading scale, for Latin and other scripts apart; it is learnt from graded
documents, each seen without its own grade: what it added to its words is taken off again.

Contributions are whole multiples of a small unit and sums of them are exact, so levels do not hang on the order in
which rows arrive. A document's grade is the mean of its grades that are not null. Null and empty texts get no level.
Without any grade there are no levels. The fit uses at most FIT_SAMPLE graded documents, drawn by a hash of the id;
everything else covers all documents and all grades.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

NODES = 1 << 20
ROUNDS = 10
TOLERANCE = 0.01
FIT_SAMPLE = 20_000
OTHER_SCRIPT = 12.0
PRIOR = 2.0
LEAST_VARIANCE = 0.15
UNGRADED = 0.2
UNIT = float(1 << 20)
DEMANDING = 3.5


def _kinds() -> np.ndarray:
    """0 sign, 1 letter, 2 digit, of the characters of the basic plane."""
    return np.array([2 if unicodedata.category(chr(c)) == "Nd" else int(chr(c).isalnum()) for c in range(0x10000)], dtype=np.uint8)


def features(text: str, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word nodes of a text and how often each occurs."""
    points = C.code_points(text).copy()
    kind = np.where(points < 0x10000, kinds[np.minimum(points, 0xFFFF)], 1)
    points[kind == 2] = ord("0")
    upper = (points >= 65) & (points <= 90)
    points[upper] += 32
    sums = C.prefix_sums(points)
    down = C.powers(len(points) + 1)[1]
    inside = np.concatenate([[0], (kind > 0).astype(np.int8), [0]])
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    tail = np.maximum(start, end - 2)
    span = lambda s, salt: C.mix((sums[end] - sums[s]) * down[s] + np.uint64(salt))
    stops = np.flatnonzero(np.isin(points, (10, 33, 46, 63, 0x3002)))
    gaps = np.diff(np.concatenate([[-1], stops, [len(points)]]))
    length = np.round(np.log2(gaps[gaps > 4]) * 3).astype(np.uint64)
    signs = points[(kind == 0) & (points != 32)].astype(np.uint64)
    found = np.concatenate([span(start, 0), span(tail, 77), np.repeat(C.mix(length + np.uint64(1_000_000)), 3), C.mix(signs + np.uint64(50_000_000))])
    return np.unique(found % np.uint64(NODES), return_counts=True)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = _kinds()
    for batch in batches:
        rows = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            node, count = features(text, kinds)
            points = C.code_points(text)
            letters = np.count_nonzero(kinds[points[points < 0x10000]] == 1) + np.count_nonzero(points >= 0x10000)
            latin = np.count_nonzero(((points | 32) >= 97) & ((points | 32) <= 122))
            # Ascending numbers as steps and counts as they are: mostly small, so they compress well.
            rows.append((i, np.diff(node.astype(np.uint32), prepend=np.uint32(0)).tobytes(), count.astype(np.uint32).tobytes(), bool(2 * latin > letters)))
        if rows:
            types = (pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["doc_id", "nodes", "counts", "latin"])


class Spread:
    """Sums and weight of every word node, and the fits from spread difficulty to the grading scale.

    The driver holds the nodes in use only (`at`, ascending), and only these are sent; a task spreads them over all numbers.
    """

    def __init__(self, at: np.ndarray, w: np.ndarray, s: np.ndarray, q: np.ndarray, mean: float):
        self.at, self.w, self.s, self.mean = at, w, s, mean
        mu = self.mu()
        variance = (q + PRIOR * (mean * mean + 2)) / (w + PRIOR) - mu * mu
        self.weight = 1 / (np.maximum(variance, 0) + LEAST_VARIANCE)
        self.fits: dict[bool, tuple[list[float], list[float]]] = {}

    def mu(self) -> np.ndarray:
        return (self.s + PRIOR * self.mean) / (self.w + PRIOR)

    def change(self, last: "Spread") -> float:
        """Mean change of the difficulty of the words, by how often they occur; a word not met before had the mean."""
        before = np.full(len(self.at), self.mean)
        same, mine, theirs = np.intersect1d(self.at, last.at, assume_unique=True, return_indices=True)
        before[mine] = last.mu()[theirs]
        return float((self.w * np.abs(self.mu() - before)).sum() / max(self.w.sum(), 1e-12))

    def __getstate__(self) -> dict:
        return {"at": self.at, "mean": self.mean, "fits": self.fits} | {k: getattr(self, k).astype(np.float32) for k in ("w", "s", "weight")}

    def __setstate__(self, state: dict) -> None:
        self.mean, self.fits = state["mean"], state["fits"]
        for k in ("w", "s", "weight"):
            whole = np.zeros(NODES)
            whole[state["at"]] = state[k]
            setattr(self, k, whole)

    def raw(self, g: "_Documents") -> np.ndarray:
        """Weighted mean of each document's words; a graded document's own grade is first taken off its words."""
        mu = self.mu()[g.nodes]
        own = g.graded[g.owner]
        if own.any():
            at, add = g.nodes[own], _units(g.share[own])
            rest = np.maximum(self.w[at] - add, 0)
            mu[own] = (self.s[at] - _units(g.share[own] * g.grade[g.owner[own]]) + PRIOR * self.mean) / (rest + PRIOR)
        w = g.share * self.weight[g.nodes]
        return np.bincount(g.owner, w * mu, minlength=g.n) / np.maximum(np.bincount(g.owner, w, minlength=g.n), 1e-12)

    def level(self, raw: np.ndarray, latin: np.ndarray) -> np.ndarray:
        out = raw.copy()
        for kind, (x, y) in self.fits.items():
            at = latin == kind
            out[at] = np.interp(raw[at], x, y)
        return out


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT) / UNIT


class _Documents:
    """A batch of documents as arrays: one entry a document and word node."""

    def __init__(self, batch: pa.RecordBatch):
        steps = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("nodes").to_pylist()]
        counts = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("counts").to_pylist()]
        self.n = len(steps)
        self.owner = np.repeat(np.arange(self.n), [len(x) for x in steps])
        self.nodes = np.concatenate([np.cumsum(x, dtype=np.int64) for x in steps]) if self.n else np.empty(0, dtype=np.int64)
        self.share = 1 + np.log(np.concatenate(counts)) if self.n else np.empty(0)
        self.latin = np.array(batch.column("latin").to_pylist(), dtype=bool)
        self.grade = np.array([np.nan if x is None else x for x in batch.column("grade").to_pylist()], dtype=float)
        self.graded = ~np.isnan(self.grade)


def _sums(batches: Iterator[pa.RecordBatch], spread: Spread | None) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, NODES))
    for batch in batches:
        g = _Documents(batch)
        value, weight = np.where(g.graded, g.grade, 0.0), g.graded.astype(float)
        if spread is not None:
            value, weight = np.where(g.graded, g.grade, spread.level(spread.raw(g), g.latin)), np.where(g.graded, 1.0, UNGRADED)
        w, v = g.share * weight[g.owner], value[g.owner]
        for k, x in enumerate((w, w * v, w * v * v)):
            total[k] += np.bincount(g.nodes, np.rint(x * UNIT), minlength=NODES)  # whole numbers: exact in any order
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[k][at].astype(np.int64)) for k in range(3))], names=["node", "w", "s", "q"])


def _levels(batches: Iterator[pa.RecordBatch], spread: Spread, raw: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g = _Documents(batch)
        level = spread.raw(g) if raw else spread.level(spread.raw(g), g.latin)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(level, pa.float64()), batch.column("latin"), batch.column("grade")], names=["doc_id", "level", "latin", "grade"])


def monotone_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[float], list[float]]:
    """Points of the weighted least-squares monotone fit by pooling adjacent violators."""
    weight = np.ones(len(x)) if weight is None else weight
    order = np.lexsort((y, x))
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([yi, wi, xi, xi])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools[-1]
            a[0], a[1], a[3] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[3]
    return [p for a in pools for p in (a[2], a[3])], [a[0] for a in pools for _ in range(2)]


def _fits(points) -> dict[bool, tuple[list[float], list[float]]]:
    """A fit for each script; the other script's documents count in it for OTHER_SCRIPT documents together."""
    x, y, latin = points.level.to_numpy(), points.grade.to_numpy(), points.latin.to_numpy()
    out = {}
    for kind in (False, True):
        other = latin != kind
        out[kind] = monotone_fit(x, y, np.where(other, min(1.0, OTHER_SCRIPT / max(1, other.sum())), 1.0))
    return out


def reading_levels(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, fit_sample: int = FIT_SAMPLE, residuals: list[float] | None = None) -> DataFrame:
    """doc_id, level (1 easy to 5 demanding, fractional) of every document with text.

    residuals, if given, gets the mean change of the words' difficulties in each round.
    """
    spark = documents.sparkSession
    grades = labels.where("level is not null").groupBy("doc_id").agg(F.avg("level").alias("grade"))
    edges = documents.select("doc_id", "text").where(F.length("text") > 0).mapInArrow(_edges, "doc_id long, nodes binary, counts binary, latin boolean")
    graph = C.cut(edges.join(grades, "doc_id", "left"))
    n, mean = graph.where("grade is not null").agg(F.count("*"), F.avg("grade")).first()
    if not n:
        return graph.select("doc_id", F.lit(None).cast("double").alias("level")).limit(0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000_007))
    fit_docs = C.cut(graph.where(F.col("grade").isNotNull() & (draw <= 1_000_000_007 * min(1.0, fit_sample / n))))
    spread: Spread | None = None
    sent = None
    for _ in range(rounds):
        before, sent = sent, spark.sparkContext.broadcast(spread)
        if before is not None:
            before.destroy()
        sums = graph.select("nodes", "counts", "latin", "grade").mapInArrow(lambda it, b=sent: _sums(it, b.value), "node int, w long, s long, q long")
        table = sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in "wsq")).toArrow().sort_by("node")  # at most NODES rows
        last, spread = spread, Spread(table["node"].to_numpy(), *(table[c].to_numpy() / UNIT for c in "wsq"), mean)
        bare = spark.sparkContext.broadcast(spread)
        points = fit_docs.mapInArrow(lambda it, b=bare: _levels(it, b.value, True), "doc_id long, level double, latin boolean, grade double").toPandas()
        bare.destroy()
        spread.fits = _fits(points)
        if last is not None:
            change = spread.change(last)
            if residuals is not None:
                residuals.append(change)
            if change < TOLERANCE:
                break
    if sent is not None:
        sent.destroy()
    final = spark.sparkContext.broadcast(spread)
    return graph.mapInArrow(lambda it: _levels(it, final.value, False), "doc_id long, level double, latin boolean, grade double").select("doc_id", "level")


def demanding(levels: DataFrame, least: float = DEMANDING) -> DataFrame:
    return levels.where(F.col("level") >= least).select("doc_id").distinct()
