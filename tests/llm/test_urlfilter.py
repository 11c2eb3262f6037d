import random

from passbook.llm.urlfilter import judge


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(f[:2] for f in fits)
    _, _, rule, verdict = min(f for f in fits if f[:2] == best)
    return host, path, rule, verdict


def test_equals_brute_force(spark):
    rng = random.Random(2)
    labels = ["com", "net", "a", "b", "www", "Ä", "x-y"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "/", "/en/", "/en/1", "/e", "/fr/x"])
    rules = sorted({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host().lower(), path()) for _ in range(40))}.values())
    urls = [None, "", "nothing", "http://", "http:///x", "http://A.com?q#f", "http://com:80/en/", "://net#x"]
    urls += [rng.choice(["http://", "HTTPS://"]) + rng.choice([host(), host().upper()]) + path() + rng.choice(["", "?a=/en/", "#b"]) for _ in range(500)]
    urls += ["http://com\x01example/en/x", "http://example.com\x01/en/x", "http://a\x02b.example.com/en/x", "http://example\x03.com/en/" + "y" * 5000]
    urls += ["http://hot.com/en/"] * 200
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        assert got[i] == brute(u, rules), u
    assert len(got) == len(urls)


def test_empty_tables(spark):
    rules = spark.createDataFrame([("com", "/", "block"), (None, None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.org/a"), (1, "http://x.com/a")], "page_id long, url string")
    assert judge(pages.limit(0), rules).collect() == []
    assert sorted(r.verdict for r in judge(pages, rules.limit(0)).collect()) == ["allow", "allow"]
    assert sorted(r.rule for r in judge(pages, rules).collect()) == ["", "com/"]
