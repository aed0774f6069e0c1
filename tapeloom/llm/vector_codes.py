"""Vector code compression: product codes from a delta-maintained Lloyd iteration on whole numbers.

A vector's components become floor(scale * x) and are cut into `parts` equal parts; each part is coded by the nearest entry of its position's codebook.
The codebooks begin as the parts of the `entries` smallest ids.

Rounds. The vectors are stored beside their current codes. A round reads them with the codebooks (parts x entries x width numbers, whatever the size of
the table), writes new codes beside the old ones, and then reads only the rows in which a part's code has changed: from each task come a plus for the
new entry and a minus for the old one, added up in the task first. These are all that a round shuffles; they are added to the running sums and counts,
one row for each component of an entry, which are stored from round to round. The codebooks are the floors of sum / count. Whole numbers make the sums
exact, so they equal sums taken anew in any order. A lost executor costs the tasks that it ran: codes and sums of the round before are
tables in the shared folder.

Distances are exact: in doubles while they fit in 53 bits, else in Python's whole numbers; errors beyond 64 bits raise an error. Ties go to the lower index.

Cases: vectors that are null or hold null or non-finite components are dropped; the length is that of the smallest id's vector, and vectors of another
length stay, with null code and error, and count nowhere; a length that `parts` doesn't divide is an error; null ids are kept and seed a codebook only
after all others, rows of one id in the order of their vectors; equal seeds leave entries unused, which stay as they are; fewer vectors than entries
give a smaller codebook; null labels are one label; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, if_light, load, spread_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Distances that are held at once.
HELD = 1 << 22


def whole(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, v: the rows that take part, with components floor(scale * x)."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(fine).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def nearest(x, book):
    """For each row of x the lowest index of a nearest row of book, and the squared distance."""
    import numpy as np

    most = max(abs(int(y)) for z in (x, book) for y in (z.max(initial=0), z.min(initial=0)))
    if 4 * max(1, x.shape[1]) * most * most < 2**53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at].astype(np.int64)
    found = [min((sum((int(p) - int(q)) ** 2 for p, q in zip(r, c)), i) for i, c in enumerate(book)) for r in x]
    if any(e >= 2**63 for e, _ in found):
        raise ValueError("a squared distance doesn't fit in 64 bits")
    return np.array([i for _, i in found]), np.array([e for e, _ in found], np.int64)


class Books:
    """The codebooks: an array of (entries, width) whole numbers for each part."""

    def __init__(self, entries: list) -> None:
        self.entries = entries

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    @property
    def length(self) -> int:
        return self.width * len(self.entries)

    @classmethod
    def seeded(cls, seeds: list[list[int]], parts: int) -> Books:
        import numpy as np

        m = np.array(seeds, np.int64).reshape(len(seeds), len(seeds[0]))
        if m.shape[1] % parts:
            raise ValueError(f"{parts} parts don't divide a length of {m.shape[1]}")
        return cls(np.split(m, parts, axis=1))

    def renewed(self, sums: DataFrame) -> Books:
        """With floor(sum / count) in the entries that have a count. sums: part, entry, i, total, where i = -1 has the count."""
        found = {(r.part, r.entry, r.i): r.total for r in sums.collect()}
        new = [b.copy() for b in self.entries]
        for (p, e, i), n in found.items():
            if i == -1 and n > 0:
                new[p][e] = [found.get((p, e, k), 0) // n for k in range(self.width)]
        return Books(new)

    def digest(self) -> str:
        return sha256(",".join(str(int(x)) for b in self.entries for x in b.ravel()).encode()).hexdigest()


def assigned(rows: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, v, was, code, error: was is the code that the row had; code has a byte for each part (two from 257 entries on)."""
    known = rows.sparkSession.sparkContext.broadcast(books)
    kind = "uint8" if len(books.entries[0]) <= 256 else "<u2"
    fields = [rows.schema["vec_id"], rows.schema["label"], rows.schema["v"], T.StructField("was", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = known.value
        step = max(1, HELD // len(own.entries[0]))
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(lo, step)
                fits = pc.equal(pc.list_value_length(batch.column("v")), own.length).to_numpy(zero_copy_only=False)
                flat = batch.column("v").filter(pa.array(fits)).flatten().to_numpy()
                m = flat.reshape(int(fits.sum()), own.length)
                codes, error = np.zeros((len(m), len(own.entries)), kind), np.zeros(len(m), np.int64)
                for p, book in enumerate(own.entries):
                    at, d = nearest(m[:, p * own.width : (p + 1) * own.width], book)
                    codes[:, p] = at
                    error += d
                place = np.where(fits, np.cumsum(fits) - 1, -1)
                code = pa.array([codes[i].tobytes() if i >= 0 else None for i in place], pa.binary())
                errors = pa.array([int(error[i]) if i >= 0 else None for i in place], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v", "code")), code, errors], names=[f.name for f in fields])

    return rows.select("vec_id", "label", "v", "code").mapInArrow(run, T.StructType(fields))


def deltas(rows: DataFrame, books: Books) -> DataFrame:
    """part, entry, i, total: what the changed parts add to their new entries and take from their old ones; i = -1 counts them. A task
    returns a row for each component of an entry at most."""
    shape, width = (len(books.entries), len(books.entries[0])), books.width
    kind = "uint8" if shape[1] <= 256 else "<u2"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        totals: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            m = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, shape[0] * width)
            new = np.frombuffer(b"".join(batch.column("code").to_pylist()), kind).reshape(batch.num_rows, shape[0])
            had = np.array([x is not None for x in batch.column("was").to_pylist()])
            old = np.frombuffer(b"".join(x or bytes(new.itemsize * shape[0]) for x in batch.column("was").to_pylist()), kind).reshape(new.shape)
            for p in range(shape[0]):
                changed = ~had | (new[:, p] != old[:, p])
                for sign, at, use in ((1, new[:, p], changed), (-1, old[:, p], changed & had)):
                    for e in np.unique(at[use]):
                        own = m[use & (at == e), p * width : (p + 1) * width]
                        for i, s in enumerate([len(own), *own.sum(axis=0).tolist()]):
                            totals[p, int(e), i - 1] = totals.get((p, int(e), i - 1), 0) + sign * s
        keys = [k for k, v in totals.items() if v]
        yield pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in keys], pa.int32()) for c in range(3)), pa.array([totals[k] for k in keys], pa.int64())], names=["part", "entry", "i", "total"])

    return rows.select("v", "code", "was").mapInArrow(run, "part int, entry int, i int, total long")


def lloyd(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Books | None]:
    """vec_id, label, v, was, code, error after the last assignment, and the codebooks (None without vectors)."""
    rows = stored(whole(vectors, key, vector, label, scale), "vectors")
    order = (F.asc_nulls_last("vec_id"), "v")
    first = rows.orderBy(*order).limit(1).collect()
    seeds = [r.v for r in rows.where(F.size("v") == len(first[0].v)).orderBy(*order).limit(entries).select("v").collect()] if first else []
    rows = rows.withColumn("code", F.lit(None).cast("binary"))
    if not seeds:
        return rows.select("*", F.lit(None).cast("binary").alias("was"), F.lit(None).cast("long").alias("error")), None
    books = Books.seeded(seeds, parts)
    sums = None
    for _ in range(rounds):
        rows = stored(assigned(rows, books), "codes")
        change = deltas(rows.where("code is not null and (was is null or was <> code)"), books)
        sums = cut((change if sums is None else sums.union(change)).groupBy("part", "entry", "i").agg(F.sum("total").alias("total")))
        books = books.renewed(sums)
    return stored(assigned(rows, books), "codes"), books


def compressed(vectors: DataFrame, **more) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that takes part."""
    rows, books = lloyd(vectors, **more)
    own = F.to_json(F.struct("label"))
    rows = rows.select("vec_id", own.alias("own"), F.lower(F.hex("code")).alias("code"), "error", F.monotonically_increasing_id().alias("rid"))
    totals = cut(rows.groupBy("own").agg(F.sum("error").alias("label_error")))
    light = if_light(totals)
    both = rows.join(light, "own") if light is not totals else spread_join(rows, totals, "own", "rid")
    return both.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(load(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Plain Lloyd rounds: every sum is taken anew."""
    out = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut QUALIFY e < {ENTRIES})"""
    for r in range(ROUNDS + 1):
        out += f""",
d{r} AS (SELECT vec_id, label, p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut JOIN b{r} USING (p)),
a{r} AS (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, CAST(min(d) AS BIGINT) AS d, arg_min(e, d * {ENTRIES} + e) AS e FROM d{r} GROUP BY vec_id, p)"""
        if r < ROUNDS:
            out += f""",
m{r} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) WHERE i <= len(x) GROUP BY p, e, i) GROUP BY p, e),
b{r + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e))"""
    return (
        out
        + f""",
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM coded
"""
    )


QUERIES = {"op12_vector_codes": query}
ORACLE = {"op12_vector_codes": _sql()}
