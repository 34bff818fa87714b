"""URL filter: rules, nesting, hosts, and every odd input against a plain loop."""

import random

from imunis.llm import url_filter as uf


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def check(spark, urls, rules, **kw):
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in uf.filter_urls(df, uf.rules_frame(spark, rules), **kw).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_registered_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/en/1?x", "http://a.example.org/en/12", "http://example.org",
            "http://org/", "http://myexample.org/es/x", "http://x.com/de/#", "https://com/fr/a://b", "http://a.b.c.com?fr/",
            "http://example.org/es", "http://u@h:80/en/", "x" * 100_000 + "://org/" + "y" * 100_000, "://org/",
            "http://" + "a." * 5000 + "com/de/z", "http://example.org./es/", "http://É.ORG/es/"]
    check(spark, urls, uf.RULES)


def test_nested_rules_in_small_groups(spark):
    rng = random.Random(4)
    hosts = ["a", "b.a", "c.b.a", "d", "x.d"]
    paths = ["/", "/p", "/p/", "/p/q", "/p/q/r", "/é", "", "/p/q/r/s"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(25)})
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in rules]
    urls = [f"h://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '/', '?p'])}"
            for _ in range(300)]
    check(spark, urls, rules, points_per_group=7)


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "h://com/fr/"), (1, "h://com/fr/"), (None, "h://com/de/")], "page_id long, url string")
    got = sorted(((r["page_id"], r["verdict"]) for r in uf.filter_urls(df, uf.rules_frame(spark, uf.RULES)).collect()), key=str)
    assert got == [(1, "allow"), (1, "allow"), (None, "block")]
    assert uf.filter_urls(df.limit(0), uf.rules_frame(spark, uf.RULES)).count() == 0
    none = uf.rules_frame(spark, uf.RULES).limit(0)
    assert [r["verdict"] for r in uf.filter_urls(df, none, default="block").collect()] == ["block"] * 3
    both = uf.rules_frame(spark, [("allow", "COM", "/"), ("block", "com", "/"), ("block", None, "/"), ("allow", "com", None)])
    assert {r["verdict"] for r in uf.filter_urls(df, both).collect()} == {"block"}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "h://com/fr/")], "page_id long, url string")
    plan = uf.filter_urls(df, uf.rules_frame(spark, uf.RULES))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
