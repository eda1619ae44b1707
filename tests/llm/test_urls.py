from pyspark.sql import functions as F

from tallyvec.llm import urls as U

CASES = {
    "https://WWW.Example.com/en/x?y=1": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://a.example.com/en/5": ("a.example.com", "/en/5", "example.com/en/", "block"),
    "http://example.com/en": ("example.com", "/en", "com/", "allow"),
    "http://x.net/es/?q": ("x.net", "/es/", "net/es/", "block"),
    "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "ftp://x.com": ("x.com", "", None, None),
    "http://x.com?a/b": ("x.com", "", None, None),
    "http://a.com#/en/": ("a.com", "", None, None),
    "no scheme": ("", "", None, None),
    "http://notnet/fr/": ("notnet", "/fr/", None, None),
    "http://x.com/p://q": ("x.com", "/p://q", "com/", "allow"),
    "http://ÄB.com/": ("Äb.com", "/", "com/", "allow"),
    "http://a.b\n.org/x\ny#z": ("a.b\n.org", "/x\ny", None, None),
    None: ("", "", None, None),
}


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(CASES)], "page_id bigint, url string, host string, good int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = {r.page_id: r for r in U.judge(pages, none).collect()}
    for i, (host, path, rule, verdict) in enumerate(CASES.values()):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r
    assert U.judge(pages.where("false"), none).count() == 0


def test_reputation_shrinks_towards_domain_and_suffix(spark):
    pages, labels, n = [], [], 0
    for host, good, bad in (("a.good.org", 60, 2), ("b.good.org", 1, 0), ("new.good.org", 0, 0), ("s.bad.org", 2, 80), ("new.bad.org", 0, 0), ("t.bad.org", 0, 50), ("c.good.org", 40, 1)):
        for k in range(max(1, good + bad)):
            pages.append((n, f"http://{host}/{k}"))
            if good + bad:
                labels.append((n, int(k < good)))
            n += 1
    labels += [(10**6, 0), (0, None)]
    df = spark.createDataFrame(pages + [pages[0]], "page_id bigint, url string")
    got = U.judge(df, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    bound = {r.host: (r.bound, r.verdict) for r in got.collect()}
    assert bound["a.good.org"][1] == bound["b.good.org"][1] == "allow" and bound["s.bad.org"][1] == bound["t.bad.org"][1] == "block"
    assert bound["new.bad.org"][0] < bound["new.good.org"][0]
    assert got.count() == len(pages) + 1 and got.where(F.col("verdict").isNull()).count() == 0


def test_names_domains_and_suffixes(spark):
    cases = {
        "a.b.example.com": ("a.b.example.com", "example.com", "com"),
        "user:pw@www.shop.co.uk:8080": ("www.shop.co.uk", "shop.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk", "co.uk"),
        "uk": ("uk", "uk", "uk"),
        "a.example.org.": ("a.example.org", "example.org", "org"),
        "a.example.org.:80": ("a.example.org", "example.org", "org"),
        "a.example.org:": ("a.example.org", "example.org", "org"),
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", "10.0.0.1"),
        "[::1]:80": ("[::1]", "[::1]", "[::1]"),
        "[::1]": ("[::1]", "[::1]", "[::1]"),
        "": ("", "", ""),
    }
    df = spark.createDataFrame([(h,) for h in cases], "host string").withColumn("name", U.named(F.col("host")))
    domain, suffix = U.registered(F.col("name"))
    assert {r.host: (r.name, r.d, r.s) for r in df.select("host", "name", domain.alias("d"), suffix.alias("s")).collect()} == cases


def test_method_changes_verdicts(spark):
    """Ports share their domain's reputation; a new host of a bad domain is blocked, of a good one allowed; very long urls are judged."""
    pages = [(i, f"http://s{i % 3}.bad.co.uk:80{i % 5}/x") for i in range(90)] + [(100 + i, f"http://g{i % 3}.good.co.uk/x") for i in range(90)]
    labels = [(i, int(i >= 100)) for i, _ in pages]
    new = [(500, "http://me@fresh.bad.co.uk:9/"), (501, "http://fresh.good.co.uk/"), (502, "http://fresh.good.co.uk/" + "x" * 300_000)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(pages + new, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert got[500] == "block" and got[501] == got[502] == "allow" and got[0] == "block" and got[100] == "allow"
