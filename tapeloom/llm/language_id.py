"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text recognises every substring of it. A text is parsed against it into
phrases, each the longest match from where the last one ended; a character that the language never has is a phrase of its
own. A phrase costs log2 of the labelled text's length, and the language with the fewest phrases, so normalised and per
character, wins (ties: the smaller language). Texts are lower-cased and any run of other characters than letters counts as
one space, so that marks and digits, which any language may have, don't decide.

Sample. A language is learned from the whole texts of `rows` documents at most: for each value of a hash the document of the smallest
hash among those of at most `longest` characters, or of any length where there is no other. That bound on labelled rows is what travels to the
tasks. The automaton is built once in each Python worker, as a table or, with thousands of letters, as a dictionary. Whole texts are parsed from their
first character to their last: windows of them side by side with numpy, but no phrase ends because a window does (parallel_phrases).

Cases: a null text, or one without a letter, is `und` with score 0; so is every text where nothing was learned; documents
without a language teach nothing, those with a null id hash as the empty id; repeated rows are predicted alike and teach once; a long text is
parsed in one piece, in memory of its own size; columns named lang_pred and score are replaced; an empty table gives an empty result;
other columns pass and aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, others, parts

ROWS, LONGEST = 16, 20_000
#: A transition is kept under state * WIDE + code point.
WIDE = 1 << 21
#: Cells of a table of transitions, four bytes each.
CELLS = 20_000_000
#: Characters that are parsed in sequence, beside those of other windows.
WINDOW = 512

def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of each state; a string leads somewhere from state 0 exactly if it occurs in text."""
    moves: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return moves


_other = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    """Lower-cased, with a space for each run of anything but letters."""
    return _other.sub(" ", text.lower())


def phrases(text: Iterable[int], move: dict[int, int]) -> int:
    """The phrases of a text of code points in the cross-parsing by an automaton; a state is WIDE times its number."""
    get, state, n = move.get, 0, 0
    for c in text:
        to = get(state + c)
        if to is None:
            if state:  # the phrase so far ends before this character
                n += 1
                to = get(c)
            if to is None:  # the language hasn't got it
                n += 1
                to = 0
        state = to
    return n + (state > 0)


class Automaton:
    """A language's automaton and the price of a phrase. Its transitions are a table of states by letters, for numpy, or where that would have more
    than `CELLS` cells (many letters) a dictionary; both find the same phrases."""

    def __init__(self, sample: str) -> None:
        import numpy as np

        text = normal(sample)
        moves = suffix_automaton(text)
        self.bits = math.log2(max(2, len(text)))
        letters = sorted({*text})
        self.table = self.move = None
        if len(moves) * (len(letters) + 1) > CELLS:
            self.move = {state * WIDE + ord(c): to * WIDE for state, out in enumerate(moves) for c, to in out.items()}
            return
        # the last column is for letters that the language hasn't got; a state is the place of its row
        width = len(letters) + 1
        column = {c: i for i, c in enumerate(letters)}
        self.column = np.full(0x110000, width - 1, np.uint16)
        self.column[[ord(c) for c in letters]] = np.arange(len(letters))
        table = np.full((len(moves), width), -1, np.int32)
        for state, out in enumerate(moves):
            for c, to in out.items():
                table[state, column[c]] = to * width
        self.table = table.ravel()

    def count(self, codes, starts, sizes) -> list[int]:
        """The phrases of each text; codes are the code points of all of them, one text after the other."""
        if self.move is not None:
            return [phrases(codes[a : a + n].tolist(), self.move) for a, n in zip(starts, sizes)]
        return parallel_phrases(self.column[codes].astype("int32"), starts, sizes, self.table)


def parallel_phrases(codes, starts, sizes, table, window: int = WINDOW) -> list[int]:
    """phrases() of many texts at once.

    Texts are cut into windows, and all of them are parsed side by side, each as if a phrase began with it. What is left of the phrase at a
    window's end is then parsed on into the windows after, until a phrase of both parses begins at the same character: from there on they are the same.
    So each window knows how many phrases follow it until which place, and a walk over a text's windows adds up those of the one true parse.
    """
    import numpy as np

    n = -(-sizes // window)
    text = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[text] + nth * window
    ends = starts[text] + sizes[text]
    left = np.minimum(window, ends - at)
    begins = np.zeros(len(codes) + 1, bool)  # where a phrase begins, in the windows' own parses
    order = np.argsort(-left, kind="stable")
    live = np.searchsorted(-left[order], -np.arange(window), side="left")  # windows with more than t characters
    state, first = np.zeros(len(text), np.int32), at[order]
    for t in range(window):
        m = live[t]
        if not m:
            break
        here = first[:m] + t
        c, s = codes[here], state[:m]
        to = table[s + c]
        stop = to < 0
        begins[here] = stop | (s == 0)
        if stop.any():
            to[stop] = np.maximum(table[c[stop]], 0)
        state[:m] = to
    after = np.empty_like(state)
    after[order] = state
    # on from each window's end
    more, meets = np.zeros(len(text), np.int64), ends.copy()
    w = np.flatnonzero(at + left < ends)
    s, here = after[w], (at + left)[w]
    while len(w):
        c = codes[here]
        to = table[s + c]
        stop = to < 0
        new = stop | (s == 0)
        same = new & begins[here]
        meets[w[same]] = here[same]
        more[w] += new & ~same
        if stop.any():
            to[stop] = np.maximum(table[c[stop]], 0)
        here = here + 1
        on = ~same & (here < ends[w])
        w, s, here = w[on], to[on], here[on]
    total = np.concatenate([[0], np.cumsum(begins)])
    out = (total[starts + np.minimum(sizes, window)] - total[starts]).tolist()
    base = (np.cumsum(n) - n).tolist()
    total, more, meets, end_of = total, more.tolist(), meets.tolist(), (at + left).tolist()
    for i in np.flatnonzero(n > 1).tolist():
        start, k, last = int(starts[i]), base[i], base[i] + int(n[i]) - 1
        found, place = 0, start
        while True:
            found += int(total[end_of[k]] - total[place])
            if k == last:
                break
            found, place = found + more[k], meets[k]
            if place >= end_of[last]:
                break
            k = base[i] + (place - start) // window
        out[i] = found
    return out


class Parser:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        self.automata = [Automaton(samples[k]) for k in self.langs]

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        """Of each text (with a letter) the language, and how far it is from the next, from 0 to 1."""
        import numpy as np

        if not texts:
            return []
        raw = [np.frombuffer(normal(t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(x) for x in raw], np.int64)
        starts = np.cumsum(sizes) - sizes
        codes = np.concatenate(raw)
        costs = np.column_stack([np.array(a.count(codes, starts, sizes)) * a.bits / sizes for a in self.automata])
        out = []
        for cost in costs.tolist():
            best = min(range(len(cost)), key=cost.__getitem__)
            other = min((c for i, c in enumerate(cost) if i != best), default=None)
            out.append((self.langs[best], 1.0 if other is None else (other - cost[best]) / other))
        return out


_PARSERS: dict[int, Parser] = {}


def _parser(samples: dict[str, str]) -> Parser:
    key = hash(tuple(sorted(samples.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(samples)
    return _PARSERS[key]


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS, longest: int = LONGEST) -> dict[str, str]:
    """The labelled text of each language, the whole texts of `rows` documents at most; docs are those to learn from."""
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("sample"))
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), h.alias("h"), F.col(text).alias("t"))
    # at most `rows` for each language
    picked = known.groupBy("lang", F.pmod("h", F.lit(rows)).alias("b")).agg(F.min(F.struct((F.length("t") > longest).alias("long"), "h")).alias("first"))
    picked = picked.select(F.col("lang").alias("l"), F.col("first.h").alias("x"))
    texts = known.join(F.broadcast(picked), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("x"))).groupBy("lang", "h").agg(F.min("t").alias("t"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in texts.toLocalIterator():
        found.setdefault(r[0], []).append((r[1], r[2]))
    return {k: "\n".join(t for _, t in sorted(v)) for k, v in found.items()}


def predict(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score."""
    rest = others(docs, text, "lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        letter = regex.compile(r"\p{L}").search
        parser = _parser(model.value) if model.value else None
        for batch in parts(batches):
            texts = [x.as_py() or "" for x in batch.column(text)]
            some = [i for i, t in enumerate(texts) if parser and letter(t)]
            found = [("und", 0.0)] * len(texts)
            for i, r in zip(some, parser([texts[i] for i in some]) if parser else ()):
                found[i] = r
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [f.name for f in out.fields])

    out = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    samples = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), samples)


QUERIES = {"op4_language_id": query}
ORACLE: dict[str, str] = {}
