import random

from tapeloom.llm import url_filters as u


def brute(paths, min_count, min_share, z):
    """{(host, mask): (template, shape)} by walking each node's paths; paths: {(host, mask): (n, labelled, blocked)}."""
    out = {}

    def walk(node, shape, held, i):
        total = sum(paths[p][0] for p in held)
        by = {}
        for p in held:
            by.setdefault(p[1].split("/")[i], []).append(p)
        sums = {s: [sum(paths[p][k] for p in ps) for k in range(3)] for s, ps in by.items()}
        frequent = {s for s, x in sums.items() if x[0] >= min_count and x[0] >= min_share * total}
        sib = {s: sums[s] for s in frequent}
        if set(sums) - frequent:
            sib[None] = [sum(sums[s][k] for s in set(sums) - frequent) for k in range(3)]
        name, run = {s: "*" if s is None else s for s in sib}, []
        chain = sorted((s for s in sib if sib[s][1]), key=lambda s: (sib[s][2] / sib[s][1], s is not None, s or ""))
        runs = []
        for s in chain:
            _, n, b = sib[s]
            if runs:
                _, n0, b0 = sib[runs[-1][-1]]
                if (b0 * n - b * n0) ** 2 * (n + n0) > z * z * n * n0 * (b + b0) * (n + n0 - b - b0):
                    runs.append([])
            else:
                runs.append([])
            runs[-1].append(s)
        for run in runs:
            if len(run) > 1:
                for s in run:
                    name[s] = "*" if None in run else "{" + "|".join(sorted(run)) + "}"
        next_nodes = {}
        for s, ps in by.items():
            key = name[s] if s in frequent else "*"
            for p in ps:
                step = (f"{node}/{key}", f"{shape}/{s if s in frequent else '*'}")
                if len(p[1].split("/")) == i + 1:
                    out[p] = step
                else:
                    next_nodes.setdefault(step[0], {})[p] = step[1]
        for n, ps in next_nodes.items():
            walk_mixed(n, ps, i + 1)

    def walk_mixed(node, shapes, i):
        # a merged node may hold several shapes; the tree is of nodes, shapes follow
        before = dict(out)
        walk(node, "", list(shapes), i)
        for p in set(out) - set(before):
            out[p] = (out[p][0], shapes[p] + out[p][1])

    hosts = {}
    for p in paths:
        hosts.setdefault(p[0], []).append(p)
    for h, held in hosts.items():
        walk(h, "", held, 0)
    return out


def test_the_tree_of_deep_paths_against_brute_force(spark):
    rng = random.Random(4)
    paths = {}
    for _ in range(700):
        depth = rng.randrange(1, 9)
        segs = [rng.choice(["news", "casino", "shop", f"slug-{rng.randrange(60)}x", "a", ""]) for _ in range(depth)]
        labelled = rng.choice([0, 0, 1, 3])
        blocked = labelled if "casino" in segs else sum(rng.random() < 0.1 for _ in range(labelled))
        paths[rng.choice(["h.net", "h.net", "i.com"]), "/".join(segs)] = (rng.randrange(max(labelled, 1), 9), labelled, blocked)
    df = spark.createDataFrame([(*k, *v) for k, v in paths.items()], "host string, mask string, n long, labelled long, blocked long")
    got = {(r.host, r["mask"]): (r.node, r["shape"]) for r in u.grown(df, 0.1, 12, 0.02, 2.0).collect()}
    want = brute(paths, 12, 0.02, 2.0)
    assert got == want
    assert any(t.count("/") > 4 and ("casino" in t.split("/")[5:] or "news" in t.split("/")[5:]) for t, _ in got.values())


def test_branches_that_part_at_the_sixth_segment(spark):
    rows = [(i, f"http://h.net/a/b/c/d/{i}/{'bad' if i % 2 else 'good'}/{'x' if i % 10 < 6 else 'y'}/z") for i in range(400)]
    rules = [("block" if i % 2 else "allow", "h.net", f"/a/b/c/d/{i}/{'bad' if i % 2 else 'good'}/x") for i in range(0, 400, 3)]
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got) and len(got) > 200
    assert len({r.template for r in got}) >= 2


def test_an_unknown_host_follows_the_same_shape_elsewhere(spark):
    rows = [(i, f"http://{'abc'[i % 3]}.com/{'pills' if i % 2 else 'news'}/{i}") for i in range(300)] + [(1000 + i, f"http://new.net/{'pills' if i % 2 else 'news'}/{i}") for i in range(40)]
    rules = (("block", "com", "/pills"), ("allow", "com", "/news"))
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert len(got) == 40 and all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got)


def test_a_very_long_url_and_no_evidence(spark):
    long = "http://h.net/" + "/".join(["seg"] * 300) + "x" * 50_000
    rows = [(1, long), (2, "http://h.com/de/1"), (3, "http://q.net/zz/1/2")]
    got = {r.page_id: r.verdict for r in u.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow"}
