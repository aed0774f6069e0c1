"""Personal data: base patterns, and candidates judged by gradient boosting.

Base. Four patterns (email, ip, card, phone) with their checks, leftmost and without overlaps for each kind. They are
written with possessive repeats and anchored where a match can start, which finds the same matches in linear time and
without deep recursion on very long runs.

Method. High-recall generators propose more spans of any length, which may overlap each other: runs with a digit that could be a secret (secret), whatever is assigned
by = or : (assigned), written-out addresses, long numbers. Those that touch a base span are out from the start, as none of them can be added: the trees, the thresholds
and the figures below are about candidates that can be. Each has a few binned features of format (digits, letters, length, separators, repetition) and of the characters
beside it. Boosted trees of depth two are fitted to labels from evidence that no feature holds: a secret or assigned value is right if a key word is assigned to it or
a public key's prefix begins it, a number if a word like phone or card stands before it, an address if its last part is a top-level domain. So the trees say
from form and surroundings what such evidence would say, and judge the candidates that lack it.

All candidates of all documents count in the fit: they are counted by (features, label) in Spark, at most one row for each combination of bins
(some 32,000 for each generator and label, whatever the input; a few hundred occur), and the boosting runs on that table. Its trees are then one
SQL expression. The threshold is calibrated per kind on the documents of odd hash, which the trees haven't seen: the lowest score at which
precision is `precision` or more, so a kind none of whose candidates has evidence adds nothing; quality() gives the precision and recall there. Of overlapping candidates the one with the highest score is chosen
(then the longer, then the earlier), then the next best that touches none chosen, until none is left. Base spans stay.

Texts are scanned once; the spans are stored, and the rest works on them. Documents are dealt by a hash of id and text, so reruns
agree however the rows are partitioned. Offsets are code points, end exclusive. Everything is native SQL.

Cases: null texts count as empty and have no spans; repeated rows are rows of their own; null ids are allowed; very long texts are
scanned whole, in time that grows with the text and its matches; without any candidate, or any label of a kind, nothing of it is added; an empty
table gives an empty result; redact() passes other columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, load, stored, unused, with_unique_key

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]++)++",
}
MORE = {
    "secret": r"(?<![A-Za-z0-9+/_])(?=[A-Za-z+/_]*+[0-9])[A-Za-z0-9+/_]{8,}+",
    "assigned": r"[=:] ?+\"?+[^\s\"]{6,}+",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?:(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9])[0-9](?:[ ().-]{0,2}+[0-9]){8,}+",
}
KINDS = (*BASE, *MORE)
SECRET, ASSIGNED, ADDRESS, NUMBER = (KINDS.index(k) for k in MORE)
#: What must occur in a text for a pattern to match.
NEEDS = {"email": "@", "phone": r"\+", "assigned": "[=:]", "address": r"[(\[]at[)\]]"}
#: Bins of each feature.
FEATURES = {"digits": 7, "letters": 4, "size": 6, "separated": 2, "capitals": 2, "variety": 4, "before": 4, "after": 4}
#: Evidence of labels: what stands before a value, how a public key begins, and a last part of an address.
KEYS = "(?i)(password|passwd|pwd|token|secret|api_?key|access_?key)[\"']? ?[=:] ?\"?$"
CONTACTS = r"(?i)(phone|tel|call|mobile|fax|card|account)[a-z]*[.:]? ?$"
PREFIX = "^(AKIA|ASIA)[0-9A-Z]{16}$"
DOMAINS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|ch|at|eu|us|ca|au|jp|br|in"
ROUNDS, RATE, PRECISION = 24, 0.4, 0.9
#: Matches whose places are added up together.
CHUNK = 64


def cumulated(sizes: Column) -> Column:
    """array<struct<start,end,s>> from array<struct<gap,hit,s>>. Appending to an array copies it, so sums run in chunks, whose own starts
    are summed first."""
    sizes_of = lambda x: x["gap"] + x["hit"]
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda i: F.slice(sizes, i * CHUNK + 1, F.lit(CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + sizes_of(x)))
    starts = F.aggregate(totals, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def step(a, x):
        start, end = a["at"] + x["gap"], a["at"] + sizes_of(x)
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s")))).alias("out"))

    walk = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(chunks, F.slice(starts, 1, F.size(chunks)), walk))).otherwise(empty)


def matches(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """rows with m_<kind>, array<struct<start,end,s>>: the matches in text, found between the parts that they split it into. Each step has its
    own projection, as what is used twice would be computed twice."""
    none = F.array().cast("array<string>")
    text = F.col("text")
    needs = {k: text.rlike(NEEDS.get(k, "[0-9]")) for k in patterns}
    rows = rows.withColumns({f"h_{k}": F.when(needs[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    rows = rows.withColumns({f"g_{k}": F.when(F.size(f"h_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, p in patterns.items()})
    pair = lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), h.alias("s"))
    rows = rows.withColumns({f"z_{k}": F.zip_with(F.slice(f"g_{k}", 1, F.size(f"h_{k}")), F.col(f"h_{k}"), pair) for k in patterns})
    return rows.withColumns({f"m_{k}": cumulated(F.col(f"z_{k}")) for k in patterns})


def luhn(s: Column) -> Column:
    digits = F.reverse(F.regexp_replace(s, "[^0-9]", ""))
    twice = F.translate(digits, "0123456789", "0246813579")
    odd = lambda i: F.when(i % 2 == 1, F.substr(digits, i, F.lit(1))).otherwise(F.substr(twice, i, F.lit(1))).try_cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda a, i: a + odd(i)) % 10 == 0


def n_digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s, r"\."), lambda x: x.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda s: F.when(n_digits(s).between(14, 19), luhn(s)).otherwise(False),
    "phone": lambda s: n_digits(s).between(10, 15),
}


def features(s: Column, before: Column, after: Column) -> dict[str, Column]:
    """s: what is judged; before and after: the character beside it, or empty."""
    d, n = n_digits(s), F.length(s)
    bins = lambda x, edges: sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    flag = lambda c: F.when(c, 1).otherwise(0)
    beside = lambda c: F.when((c == "") | c.rlike(r"[\n\r]"), 0).when(c.rlike(r"\s"), 1).when(c.rlike("[\"'`({\\[\\]})]"), 2).otherwise(3)
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    return {
        "digits": bins(d, (1, 4, 7, 10, 14, 20)), "letters": bins(letters, (1, 4, 12)), "size": bins(n, (9, 14, 17, 20, 32)), "separated": flag(s.rlike(r"[0-9][ ().-]+[0-9]")),
        "capitals": flag(~s.rlike("[a-z]") & s.rlike("[A-Z]")), "variety": bins(F.size(F.array_distinct(F.split(s, ""))), (5, 8, 11)), "before": beside(before), "after": beside(after),
    }


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """rid, doc_id, part (0 or 1), base, more: the base spans that pass their checks, and the candidates with their features and y, whether there is evidence for them."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = matches(rows, BASE | MORE)

    def valid(k: str) -> Column:
        return F.transform(F.filter(f"m_{k}", lambda x: CHECKS[k](x["s"])), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), x["end"].alias("end")))

    def candidate(x: Column, k: str) -> Column:
        # what assigns is no part of what is judged
        lead = F.length(F.regexp_extract(x["s"], r"^[=:] ?\"?", 0)) if k == "assigned" else F.lit(0)
        start, value = x["start"] + lead, F.substr(x["s"], lead + 1, F.length(x["s"]))
        before = F.substring(F.col("text"), F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))
        after = F.substring(F.col("text"), x["end"] + 1, F.lit(1))
        evidence = before.rlike(CONTACTS) if k == "number" else F.lower(value).rlike(rf"[.)\] ]({DOMAINS})$") if k == "address" else before.rlike(KEYS) | value.rlike(PREFIX)
        f = features(value, F.right(before, F.lit(1)), after)
        return F.struct(start.alias("start"), F.lit(KINDS.index(k)).alias("kind"), x["end"].alias("end"), *(c.cast("int").alias(n) for n, c in f.items()), evidence.cast("int").alias("y"))

    def proposed(k: str) -> Column:
        return F.transform(f"m_{k}", lambda x: candidate(x, k))

    more = F.concat(*map(proposed, MORE))
    return rows.select("rid", "doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).alias("part"), F.sort_array(F.concat(*map(valid, BASE))).alias("base"), more.alias("more"))


def candidates(spans: DataFrame) -> DataFrame:
    """rid, part, start, kind, end, the features, y: the candidates that touch no base span."""
    held = spans.where(F.size("more") > 0)
    more = held.select("rid", "part", F.explode("more").alias("c")).select("rid", "part", "c.*")
    base = held.select("rid", "part", F.explode("base").alias("c")).select("rid", "part", "c.*")
    order = W.partitionBy("rid").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("rid").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    kind = F.col("kind")
    ends, starts = F.max(F.when(kind < len(BASE), F.col("end"))).over(before), F.min(F.when(kind < len(BASE), F.col("start"))).over(after)
    touches = F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))
    rows = more.unionByName(base, allowMissingColumns=True).withColumn("touches", touches)
    return rows.where((kind >= len(BASE)) & ~F.col("touches")).select("rid", "part", "start", "kind", "end", *FEATURES, "y")


class Trees:
    """Boosted trees of depth two for the logistic loss, on a weighted table of binned features."""

    def __init__(self, names: list[str], rounds: int = ROUNDS, rate: float = RATE) -> None:
        self.names, self.rounds, self.rate = names, rounds, rate
        self.prior, self.trees = 0.0, []

    @staticmethod
    def _best(rows, grad, hess, names):
        """The split of rows into two by one feature's bin that gains most: (gain, feature, bin)."""
        best = (1e-9, None, None)
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        for k in range(len(names)):
            by: dict[int, list[float]] = {}
            for i, x in rows.items():
                s = by.setdefault(x[k], [0.0, 0.0])
                s[0] += grad[i]
                s[1] += hess[i]
            lg = lh = 0.0
            for v in sorted(by)[:-1]:
                lg, lh = lg + by[v][0], lh + by[v][1]
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, k, v)
        return best

    def fit(self, table: list[tuple[tuple[int, ...], float, float]]) -> Trees:
        """table: (bins, weight of label 1, weight of label 0)."""
        pos, neg = sum(r[1] for r in table), sum(r[2] for r in table)
        self.prior = math.log((pos + 1) / (neg + 1))
        score = [self.prior] * len(table)
        for _ in range(self.rounds):
            p = [1 / (1 + math.exp(-s)) for s in score]
            grad = [r[1] - (r[1] + r[2]) * q for r, q in zip(table, p)]
            hess = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(table, p)]
            rows = {i: r[0] for i, r in enumerate(table)}
            _, k, v = self._best(rows, grad, hess, self.names)
            if k is None:
                break
            leaves = []
            for side in (True, False):
                part = {i: x for i, x in rows.items() if (x[k] <= v) == side}
                _, k2, v2 = self._best(part, grad, hess, self.names)
                for side2 in (True, False) if k2 is not None else (None,):
                    leaf = [i for i, x in part.items() if side2 is None or (x[k2] <= v2) == side2]
                    value = self.rate * sum(grad[i] for i in leaf) / (sum(hess[i] for i in leaf) + 1)
                    leaves.append((k, v, side, k2, v2, side2, value))
                    for i in leaf:
                        score[i] += value
            self.trees.append(leaves)
        return self

    def score(self, x: tuple[int, ...]) -> float:
        return self.prior + sum(value for tree in self.trees for k, v, a, k2, v2, b, value in tree if (x[k] <= v) == a and (b is None or (x[k2] <= v2) == b))

    def expression(self, at) -> Column:
        """The score as SQL; at(name) is the column of a feature."""
        out = F.lit(self.prior)
        for tree in self.trees:
            leaf = F.lit(0.0)
            for k, v, a, k2, v2, b, value in tree:
                side = lambda k, v, a: at(self.names[k]) <= v if a else at(self.names[k]) > v
                leaf = F.when(side(k, v, a) if b is None else side(k, v, a) & side(k2, v2, b), value).otherwise(leaf)
            out = out + leaf
        return out


def counted(found: DataFrame) -> dict[int, list[tuple[tuple[int, ...], float, float]]]:
    """For each part of the documents: (kind and bins, candidates of label 1, of label 0), in order."""
    names = ["kind", *FEATURES]
    rows = found.groupBy("part", *names).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).collect()
    return {part: sorted((tuple(r[n] for n in names), float(r["pos"]), float(r["neg"])) for r in rows if r["part"] == part) for part in (0, 1)}


def fit(found: DataFrame, precision: float = PRECISION) -> tuple[Trees, dict[int, float], dict[str, tuple[float, float, float]]]:
    """The trees, from the documents of part 0; each kind's threshold, from those of part 1; and by kind the precision, recall and number of
    labels there. found: candidates()."""
    table = counted(found)
    trees = Trees(["kind", *FEATURES]).fit(table[0])
    thresholds: dict[int, float] = {}
    quality: dict[str, tuple[float, float, float]] = {}
    for kind in range(len(BASE), len(KINDS)):
        scored = sorted(((trees.score(x), p, n) for x, p, n in table[1] if x[0] == kind), reverse=True)
        pos = neg = 0.0
        labels = sum(p for _, p, _ in scored)
        for i, (s, p, n) in enumerate(scored):
            pos, neg = pos + p, neg + n
            if (i + 1 == len(scored) or scored[i + 1][0] < s) and pos > 0 and pos >= precision * (pos + neg):
                thresholds[kind] = s
                quality[KINDS[kind]] = (pos / (pos + neg), pos / labels, labels)
    return trees, thresholds, quality


def picked(run: Column) -> Column:
    """Of a run's candidates, best first, each that touches none picked before it."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    free = lambda a, x: ~F.exists(a, lambda o: (o["start"] < x["end"]) & (o["end"] > x["start"]))
    add = lambda a, x: F.concat(a, F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.aggregate(run, none, lambda a, x: F.when(free(a, x), add(a, x)).otherwise(a))


def chosen(spans: DataFrame, found: DataFrame, trees: Trees, thresholds: dict[int, float]) -> DataFrame:
    """rid, doc_id, base, spans: all spans, array<struct<start,kind,end>> by start and kind."""
    passes = F.lit(False)
    for kind, t in thresholds.items():
        passes = passes | ((F.col("kind") == kind) & (F.col("score") >= t - 1e-9))
    more = found.withColumn("score", trees.expression(F.col)).where(passes).select("rid", "start", "kind", "end", "score")
    order = W.partitionBy("rid").orderBy("start", "end", "kind")
    fresh = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")
    more = more.withColumn("fresh", F.when(fresh, 1).otherwise(0)).withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), (F.col("start") - F.col("end")).alias("n"), "start", "kind", "end")))
    added = more.groupBy("rid", "run").agg(picked(best).alias("s")).groupBy(F.col("rid").alias("r")).agg(F.flatten(F.collect_list("s")).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return spans.join(added, F.col("rid") == F.col("r"), "left").select("rid", "doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", none))).alias("spans"))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """rid, doc_id, base, spans of each document; `kind` is an index of KINDS."""
    spans = stored(scan(docs, text, key), "pii")
    found = stored(candidates(spans), "candidates")
    trees, thresholds, _ = fit(found)
    return chosen(spans, found, trees, thresholds)


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id") -> dict[str, tuple[float, float, float]]:
    """Precision and recall of the chosen thresholds, and the number of labels, by kind, in the documents that the trees haven't seen."""
    return fit(stored(candidates(stored(scan(docs, text, key), "pii")), "candidates"))[2]


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def disjoint(found: DataFrame) -> DataFrame:
    """k, spans of each document of find() that has any: overlapping ones made one, of the kind of the first."""
    order = W.partitionBy("rid").orderBy("start", "kind", "end")
    rows = found.select("rid", "doc_id", F.explode("spans").alias("s")).select("rid", "doc_id", "s.*")
    fresh = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")
    rows = rows.withColumn("fresh", F.when(fresh, 1).otherwise(0)).withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("rid", "doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    return runs.groupBy("rid", F.col("doc_id").alias("k")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans")).select("k", "spans")


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; of overlapping spans the first is named."""
    names = docs.columns
    docs, own = with_unique_key(docs, key)
    id_, at = unused(docs, "_k"), unused(docs, "_spans")
    spans = stored(disjoint(find(docs, text, own)).toDF(id_, at), "spans")
    few = (spans.agg(F.sum(F.size(at))).first()[0] or 0) <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(spans) if few else spans, F.col(own) == F.col(id_), "left")
    ended = lambda i: F.when(i > 0, F.element_at(at, F.greatest(i, F.lit(1)))["end"]).otherwise(0)
    piece = lambda x, i: F.concat(F.substring(F.col(text), ended(i) + 1, x["start"] - ended(i)), F.lit("["), F.upper(name(x["kind"])), F.lit("]"))
    done = F.concat(F.array_join(F.transform(at, piece), ""), F.substring(F.col(text), F.element_at(at, -1)["end"] + 1, F.length(F.col(text))))
    return rows.withColumn(text, F.when(F.col(at).isNull(), F.col(text)).otherwise(done)).select(*names)


def of_kind(i: int):
    return lambda x: x["kind"] == i


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(load(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op9_pii": query}
ORACLE: dict[str, str] = {}
