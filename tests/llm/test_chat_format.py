import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import chat_format as cf

TEXT = st.lists(st.sampled_from(["a", " ", "\n", "\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "[", " [/INST]", "<s>[INST] ", "é", "🙂"]), max_size=10).map("".join)
ROLE = st.sampled_from(["user", "assistant", "system", "", "tool\nx", "</s>", "a\\"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_reads_back_what_it_formats(turns):
    text, mask = cf.format_turns(turns)
    assert cf.read_back(text) == turns
    assert [cf.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def brute(rows):
    trees = {}
    for conv, turn, role, text in rows:
        trees.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv, turns in trees.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(cf.format_turns(turns)[0])))
    return sorted(out, key=str)


def test_digest_against_brute_force(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "[INST] </s>"), (2, 0, None, None), (2, 0, "user", "same"), (2, 0, "user", "same"), (None, 3, "user", "x"), (None, None, "assistant", ""), (3, -5, "assistant", "y" * 50_000)]
    rows += [(4, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(1000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = cf.digest(cf.conversations(cf.as_tree(df)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.digest(cf.conversations(cf.as_tree(empty))).count() == 0


def test_best_branches_of_a_tree(spark):
    #      0            7 hangs on a parent that isn't there, 8 and 9 are a cycle
    #    1   2
    #   3 4   5
    nodes = [(0, None, 1.0), (1, 0, 1.0), (2, 0, 5.0), (3, 1, 2.0), (4, 1, 9.0), (5, 2, 1.0), (7, 6, 9.0), (8, 9, 9.0), (9, 8, 9.0)]
    df = spark.createDataFrame([(1, *n) for n in nodes], "tree int, node long, parent long, score double")
    paths = {}
    for r in cf.best_paths(df, branches=2).collect():
        paths.setdefault(r.leaf, []).append((r.step, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {4: [4, 1, 0], 5: [5, 2, 0]}
