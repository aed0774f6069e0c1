"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models; each model sees the words and the probabilities of the categories
before it. In training these probabilities are out-of-fold predictions (each third of the sample by a model of the other two), so
that a later model learns how far the earlier ones can be trusted.

Features: each distinct word of a text, without its case and outer punctuation, and its first four letters, hashed to 2^20 places; and
a few bins of the whole text's form (share of distinct words, symbols, capitals). A model keeps the `features` places that tell
its category best, and no weight falls below 0: words are evidence for a category only, else the many ordinary words of a
long text would outweigh its few telling ones.

Sample. The models are fitted on the driver to a bounded sample of labelled rows: for each category the `sample` positive rows of the
smallest hashes, and as many that are positive in none, of each all places (PLACES at most, four bytes each).
Intercepts are corrected for the true share of each category in all labels. Prediction reads whole texts.

Cases: null texts have no words and get the probabilities of the intercepts; a label that is null counts as 0; labels without a document
are ignored; repeated labels and documents of one key count once, with the largest label and the smallest text; without labels of one kind a category's probability is constant; repeated rows are
predicted alike; null ids are allowed; very long texts are read whole; columns named p_<category> are replaced; an empty table gives an empty
result; other columns pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, others, parts

PLACES, SAMPLE, FEATURES, FOLDS = 1 << 20, 3000, 8192, 3

_word = re.compile(r"[^ \t-\r]+").findall
_outer = ".,;:!?\"'()[]{}*#$%&|<>-_…«»¿¡"


def form(text: str, words: list[str], distinct: int) -> list[str]:
    """Bins of the whole text's form, as words that no text holds."""
    n = max(1, len(words))
    symbols = len(text) - len(text.translate({ord(c): None for c in "#*$%&|<>!"}))
    capitals = sum(w.isupper() and len(w) > 1 for w in words)
    return [f" distinct {10 * distinct // n}", f" symbols {min(9, 10 * symbols // n)}", f" capitals {10 * capitals // n}", f" size {min(12, n.bit_length())}"]


def place(s: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(s.encode()) % PLACES


def items(text: str) -> set[str]:
    words = _word(text)
    found = {w.strip(_outer) for w in set(_word(text.lower()))}
    found.discard("")
    return found.union(form(text, words, len(found)))


def word_places(word: str) -> tuple[int, ...]:
    return (place(word),) if word[0] == " " else (place(word), place("^" + word[:4]))


class Linear:
    """A logistic model on some of the places and a few dense columns."""

    def __init__(self, columns, weights, dense, intercept: float) -> None:
        self.columns, self.weights, self.dense, self.intercept = columns, weights, dense, intercept

    def raw(self, x, more):
        return x.dot(self.columns, self.weights) + more @ self.dense + self.intercept


class Rows:
    """The places of the sample's rows, one entry for each (row, place)."""

    def __init__(self, places: list) -> None:
        import numpy as np

        self.n = len(places)
        self.row = np.repeat(np.arange(self.n), [len(p) for p in places])
        self.place = np.concatenate([*places, np.zeros(0, np.int32)])

    def only(self, columns):
        import numpy as np

        at = np.full(PLACES, -1, np.int32)
        at[columns] = np.arange(len(columns))
        col = at[self.place]
        return self.row[col >= 0], col[col >= 0]

    def dot(self, columns, weights):
        import numpy as np

        row, col = self.only(columns)
        return np.bincount(row, weights[col], self.n)


def fit(x: Rows, y, more, part, rate: float, features: int = FEATURES, rounds: int = 120, ridge: float = 1.0) -> Linear:
    """A model of y on the rows in part; rate is the category's true share."""
    import numpy as np

    pos, neg = part & (y == 1), part & (y == 0)
    n1, n0 = pos.sum(), neg.sum()
    if not n1 or not n0:
        p = (rate if part.any() else 0.0) if n1 else 0.0
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(more.shape[1]), math.log((p + 1e-6) / (1 - p + 1e-6)))
    f1, f0 = (np.bincount(x.place[m[x.row]], minlength=PLACES) for m in (pos, neg))
    # a place counts once or more in a row; its rate in both classes tells how much it says
    q1, q0, q = f1 / n1, f0 / n0, (f1 + f0) / (n1 + n0)
    z = np.abs(q1 - q0) / np.sqrt(np.maximum(q * np.maximum(1 - q, 0.02), 1e-9) * (1 / n1 + 1 / n0))
    z[f1 + f0 < 3] = 0
    columns = np.flatnonzero(z > max(4.0, np.partition(z, -features)[-features]))
    row, col = x.only(columns)
    use = part[row]
    row, col = row[use], col[use]
    w, d, b = np.zeros(len(columns)), np.zeros(more.shape[1]), math.log(n1 / n0)
    m, target = part.astype(float), y.astype(float)
    curve = np.bincount(col, minlength=len(columns)) * 0.25 + ridge
    step = 0.5
    vw, vd, vb = np.zeros_like(w), np.zeros_like(d), 0.0
    per_row = max(1.0, np.bincount(row, minlength=x.n).max())
    for _ in range(rounds):  # descent with momentum, each weight on the scale of its own curvature
        s = np.bincount(row, w[col], x.n) + more @ d + b
        r = m * (target - 1 / (1 + np.exp(-np.clip(s, -30, 30))))
        vw = 0.9 * vw + step * (np.bincount(col, r[row], len(columns)) - ridge * w) / (curve * math.sqrt(per_row))
        vd = 0.9 * vd + step * (more.T @ r - ridge * d) / (0.25 * m.sum() + ridge)
        vb = 0.9 * vb + step * r.sum() / (0.25 * m.sum())
        w, d, b = np.maximum(w + vw, 0), d + vd, b + vb
    # the sample's classes are not in their true proportion
    b += math.log(max(rate, 1e-6) / max(1 - rate, 1e-6)) - math.log(n1 / n0)
    return Linear(columns, w, d, b)


class Chain:
    """Models by category, each on the places and the probabilities before it."""

    def __init__(self, categories: list[str]) -> None:
        self.categories, self.models = categories, []

    def fit(self, places: list, labels, rates: list[float], folds) -> Chain:
        import numpy as np

        x = Rows(places)
        before = np.zeros((x.n, 0))
        sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        for k, rate in enumerate(rates):
            y = labels[:, k]
            self.models.append(fit(x, y, before, np.ones(x.n, bool), rate))
            out_of_fold = np.zeros(x.n)
            for f in range(FOLDS):
                out_of_fold[folds == f] = sigmoid(fit(x, y, before, folds != f, rate).raw(x, before))[folds == f]
            before = np.column_stack([before, out_of_fold])
        return self

    def tables(self) -> list[dict[int, float]]:
        return [dict(zip(m.columns.tolist(), m.weights.tolist())) for m in self.models]


class Scorer:
    """Scores texts; a word's weights are looked up once in each worker."""

    KEEP = 500_000

    def __init__(self, tables, dense, intercepts) -> None:
        self.tables, self.dense, self.intercepts, self.known = tables, dense, intercepts, {}

    def weights(self, word: str):
        at = word_places(word)
        w = tuple(sum(t.get(p, 0.0) for p in at) for t in self.tables)
        return w if any(w) else None

    def __call__(self, text: str) -> list[float]:
        known, sums = self.known, list(self.intercepts)
        if len(known) > self.KEEP:
            known.clear()
        for word in items(text):
            try:
                w = known[word]
            except KeyError:
                w = known[word] = self.weights(word)
            if w is not None:
                for k, v in enumerate(w):
                    sums[k] += v
        out: list[float] = []
        for k, s in enumerate(sums):
            s += sum(d * p for d, p in zip(self.dense[k], out))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
        return out


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Chain:
    """The chain for categories: a name and a 0/1 column of labels for each, in order."""
    import numpy as np

    names = list(categories)
    h = F.xxhash64(F.col(key), F.lit("toxicity"))
    rows = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), h.alias("h"), *(F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in categories.items())).groupBy("k", "h").agg(*(F.max(n).alias(n) for n in names))
    counts = rows.agg(F.count("*"), *(F.sum(n) for n in names)).first()
    rates = [(s or 0) / max(1, counts[0]) for s in counts[1:]]
    # `sample` rows of each kind at most: this is what is broadcast and what comes to the driver
    none = sum((F.col(n) for n in names), F.lit(0)) == 0
    some = rows.where(none).orderBy("h", "k").limit(sample)
    for n in names:
        some = some.union(rows.where(F.col(n) == 1).orderBy("h", "k").limit(sample))
    some = some.distinct()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts(batches):
            found = []
            for t in batch.column("text"):
                at = {p for w in items(t.as_py() or "") for p in word_places(w)}
                found.append(sorted(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", *names)), pa.array(found, pa.list_(pa.int32()))], names=["h", *names, "places"])

    joined = docs.select(F.col(key).alias("d"), F.col(text).alias("text")).join(F.broadcast(some), F.col("d") == F.col("k"))
    joined = joined.groupBy("k", "h", *names).agg(F.min("text").alias("text")).select("h", *names, "text")
    got = joined.mapInArrow(run, T.StructType([T.StructField("h", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in names), T.StructField("places", T.ArrayType(T.IntegerType()))]))
    table = got.toArrow().sort_by([("h", "ascending")])
    y = np.column_stack([table.column(n).to_numpy() for n in names]) if table.num_rows else np.zeros((0, len(names)), int)
    places = [np.asarray(p.values.to_numpy(zero_copy_only=False), np.int32) for p in table.column("places")]
    return Chain(names).fit(places, y, rates, np.arange(table.num_rows) % FOLDS)


def predict(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """docs without the text, with p_<category> for each."""
    names = [f"p_{n}" for n in chain.categories]
    rest = others(docs, text, *names)
    model = docs.sparkSession.sparkContext.broadcast((chain.tables(), [m.dense.tolist() for m in chain.models], [m.intercept for m in chain.models]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = Scorer(*model.value)
        for batch in parts(batches):
            found = [score(t.as_py() or "") for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *(pa.array([x[k] for x in found], pa.float64()) for k in range(len(names)))], names=[*(f.name for f in rest), *names])

    return docs.mapInArrow(run, T.StructType([*rest, *(T.StructField(n, T.DoubleType()) for n in names)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    chain = learn(docs, load(spark, sf_dir, "labels"), {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


QUERIES = {"op3_toxicity": query}
ORACLE: dict[str, str] = {}
