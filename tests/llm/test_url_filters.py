import re

from tapeloom.llm import url_filters as u

CASES = [
    (1, None, "", "", None), (2, "no-scheme", "", "", None), (3, "http://A.ExAmple.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/"),
    (4, "https://example.org/en/1", "example.org", "/en/1", "example.org/en/1"), (5, "x://notexample.org/en/1", "notexample.org", "/en/1", "org/"), (6, "http://a.com/fr/", "a.com", "/fr/", "com/fr/"),
    (7, "http://a.com/de/1", "a.com", "/de/1", "com/de/"), (8, "http://org", "org", "", None), (9, "http://b.net/p#a?b", "b.net", "/p", None), (10, "a://É.ORG/\n/z", "É.org", "/\n/z", "org/"), (10, "a://É.ORG/\n/z", "É.org", "/\n/z", "org/"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(c[0], c[1], "<p>", "h", 0) for c in CASES], "page_id long, url string, html string, host string, s1 int")
    got = sorted((r.page_id, r.host, r.path, str(r.rule)) for r in u.judge(df).collect())
    assert got == sorted((c[0], c[2], c[3], str(c[4])) for c in CASES)
    block = {"example.org/es/", "example.org/en/1", "com/de/"}
    assert all(r.verdict == ("block" if r.rule in block else "allow") for r in u.judge(df).collect() if r.rule)
    assert u.judge(df.where("false")).count() == 0


def test_templates_by_purity(spark):
    """Under /bad/ the labelled are blocked, under /good/ allowed; the unlabelled follow their branch."""
    rows = [(i, f"http://h.net/{'bad' if i % 2 else 'good'}/{'x' if i % 10 < 6 else 'y'}{i}/") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = (("block", "h.net", "/bad/x"), ("allow", "h.net", "/good/x"))
    got = u.judge(df, rules).where("rule is null").collect()
    assert len(got) == 160 and all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got)
    assert {r.template for r in got if r.page_id % 2} == {"h.net/bad/y#/*"} or all(re.match("h.net/bad/", r.template) for r in got if r.page_id % 2)


def test_without_labels_nothing_is_rejected(spark):
    df = spark.createDataFrame([(i, f"http://h.net/{i}") for i in range(50)], "page_id long, url string")
    assert {r.verdict for r in u.judge(df).collect()} == {"allow"}
