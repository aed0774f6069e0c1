"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text. It is learned from preferences: of a document labelled good and one labelled bad the
good one is preferred, with the probability that the logistic function gives to the difference of their scores. The weights minimise the logistic loss
on the differences of the features of such pairs. Where scores part good from bad is decided afterwards, by a quantile of the scores of all labelled rows.

Features: shares of a text's form (symbols, capitals, digits, points, distinct and repeated words, repeated lines, word lengths) of the whole text and of its worst
stretch of 64 words, in bins of equal width of the square root, coded as steps (a bin sets all steps up to it). Texts are read once; their features,
one byte each, are stored, and training, quantiles and scores work on these.

Sample. Weights are fitted on the driver to `sample` rows of each label at most, those of the smallest hashes, each good row in `pairs` pairs. The
threshold is taken over all labelled rows: of GRID quantiles of their scores, the one above which good and below which bad rows are most often right; of
equals the middle one. The result is on a scale of 0 to 1, in which the threshold stands at `cut` and a unit of the score is a unit of the logit.

Cases: null and empty texts have all features at 0 and a score like others; a label that is null is no label; labels without a document are ignored;
repeated labels of one key count once, with the smallest; repeated documents of one key teach once, with the smallest features; without pairs (no labels, or of one kind alone) all
documents get the share of good ones, 0.5 without any; null keys teach nothing; very long texts are read whole; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, parts, stored

SAMPLE, PAIRS, GRID, CUT, STRETCH, BINS = 3000, 8, 1000, 0.3, 64, 16

_classes = (b"#*$%&|<>{}[]^~=+_\\", b"!?", b"0123456789", b".,;:-")


def counts(words: list[bytes]) -> list[int]:
    """Of a run of words: words, bytes, bytes of each class, words in capitals, distinct words, words equal to the one before."""
    text = b"".join(words)
    return [len(words), len(text), *(len(text) - len(text.translate(None, c)) for c in _classes), sum(map(bytes.isupper, words)), len(set(words)), sum(map(eq, words, words[1:]))]


def shares(found: list[int]) -> list[float]:
    words, size, *classes, capitals, distinct, again = found
    n, size = max(1, words), max(1, size)
    return [*(c / size for c in classes), capitals / n, 1 - distinct / n if words else 0.0, again / n, min(1.0, size / n / 32) if words else 0.0]


def features(text: str) -> bytes:
    """Bins of the text's shares, a byte each."""
    raw = text.encode(errors="replace")
    words = raw.split()
    stretches = [counts(words[a : a + STRETCH]) for a in range(0, len(words), STRETCH)]
    total = [sum(x) for x in zip(*stretches)] or counts([])
    total[-2] = len(set(words))
    each = [shares(s) for s in stretches if s[0] >= STRETCH // 2] or [shares(total)]
    worst = [max(x) for x in zip(*each)]
    bad = sum(max(s[0] * 8, s[1] * 8, s[4], s[5]) > 0.5 for s in each) / len(each)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    runs = len(words) - 2
    again3 = 1 - len(set(zip(words, words[1:], words[2:]))) / runs if runs > 0 else 0.0
    values = [*shares(total), *worst, bad, again, again3, min(1.0, math.log2(len(words) + 1) / 16)]
    return bytes(min(BINS - 1, int(BINS * math.sqrt(v))) for v in values)


WIDTH = len(features(""))


def described(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, f: the features of each document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([features(t.as_py() or "") for t in batch.column("text")], pa.binary())], names=["doc_id", "f"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("f", T.BinaryType())]))


def steps(found: list[bytes]):
    """A row of WIDTH * (BINS - 1) zeros and ones for each document."""
    import numpy as np

    bins = np.frombuffer(b"".join(found), np.uint8).reshape(len(found), WIDTH)
    return (bins[:, :, None] > np.arange(BINS - 1)).reshape(len(found), -1).astype(np.float64)


def fit(good, bad, pairs: int = PAIRS, ridge: float = 1.0, rounds: int = 30):
    """Weights that minimise the logistic loss on the differences good - bad of the pairs, by Newton's method. Partners are dealt in turn."""
    import numpy as np

    n = max(len(good), len(bad))
    i = np.concatenate([np.arange(n) % len(good)] * pairs)
    j = np.concatenate([(np.arange(n) + k * max(1, len(bad) // pairs)) % len(bad) for k in range(pairs)])
    x = good[i] - bad[j]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (1 - p) - ridge * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


class Ranker:
    """Weights, and the score at which good and bad part."""

    def __init__(self, weights: list[float] | None, threshold: float, share: float, cut: float) -> None:
        self.weights, self.threshold, self.share, self.cut = weights, threshold, share, cut

    def raw(self, found: list[bytes]):
        import numpy as np

        return steps(found) @ np.asarray(self.weights)

    def score(self, found: list[bytes]):
        """From 0 to 1; the threshold stands at the cut."""
        import numpy as np

        if self.weights is None:
            return np.full(len(found), self.share)
        return 1 / (1 + np.exp(-np.clip(self.raw(found) - self.threshold + math.log(self.cut / (1 - self.cut)), -30, 30)))


def scored(rows: DataFrame, method) -> DataFrame:
    """rows (with f) without f and with s, the method's numbers."""
    rest = [f for f in rows.schema.fields if f.name != "f"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(method(batch.column("f").to_pylist()), pa.float64())], names=[*(f.name for f in rest), "s"])

    return rows.mapInArrow(run, T.StructType([*rest, T.StructField("s", T.DoubleType())]))


def parted(rows: DataFrame, raw, grid: int = GRID) -> float:
    """The score that parts good (y = 1) from bad best, among `grid` quantiles of all rows' scores. rows: y, f; raw: the scores of features."""
    import numpy as np

    edges = np.array(sorted(set(scored(rows, raw).agg(F.percentile_approx("s", F.array(*(F.lit(i / grid) for i in range(1, grid))), 10 * grid)).first()[0])))
    places = scored(rows, lambda found: np.searchsorted(edges, raw(found), "right").astype(float))
    counts = {int(r.s): (r.good, r.bad) for r in places.groupBy("s").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).collect()}
    right = sum(good for good, _ in counts.values())
    found = []
    for i in range(len(edges)):  # bad rows below an edge are right, and good ones from it on
        good, bad = counts.get(i, (0, 0))
        right += bad - good
        found.append(right)
    at = [i for i, n in enumerate(found) if n == max(found)]
    i = at[len(at) // 2]
    return float(edges[max(0, i - 1)] + edges[i]) / 2


def learn(found: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, pairs: int = PAIRS, cut: float = CUT) -> Ranker:
    """found: described(); labels: key and a label of 1 (good) or 0 (bad)."""
    said = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    rows = stored(found.join(said, F.col("doc_id") == F.col("k")).groupBy("k", "y").agg(F.min("f").alias("f")), "labelled")
    h = F.xxhash64("k", F.lit("quality"))
    some = {y: [r.f for r in rows.where(F.col("y") == y).orderBy(h, "k").limit(sample).select("f").collect()] for y in (0, 1)}
    if not some[0] or not some[1]:
        return Ranker(None, 0.0, 1.0 if some[1] else 0.0 if some[0] else 0.5, cut)
    ranker = Ranker(fit(steps(some[1]), steps(some[0]), pairs).tolist(), 0.0, 0.5, cut)
    ranker.threshold = parted(rows.select("y", "f"), ranker.raw)
    return ranker


def predict(found: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score reaches the cut)."""
    return scored(found.select("doc_id", "f"), ranker.score).withColumnRenamed("s", "score").withColumn("predicted", F.when(F.col("score") >= ranker.cut, 1).otherwise(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = stored(described(load(spark, sf_dir, "documents")), "features")
    ranker = learn(found, load(spark, sf_dir, "labels").where(~held))
    return predict(found, ranker).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op13_quality_classifier": query}
ORACLE: dict[str, str] = {}
