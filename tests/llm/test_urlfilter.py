import random

import pytest

from relfeat.llm import urlfilter


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def urls():
    rnd = random.Random(8)
    out = ["http://A.Example.org/es/1?x#y", "https://example.org", "example.org/es/", None, "", "x://", "://h/p", "http://h?q/es/", "http://h#f", "a\nb://H.org/\n/x",
           "http://u@h.org:80/a", "http://.org/", "http://org/", "ftp://a.b.c.d.com/fr/" + "x" * 5000]
    for _ in range(400):
        host = ".".join(rnd.choice(["a", "b", "example", "org", "com"]) for _ in range(rnd.randint(1, 4)))
        out.append(f"http://{host}/{rnd.choice(['es', 'en', 'fr', 'de'])}/{rnd.randint(0, 30)}")
    return out + out[:3]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("a.com", "/fr/2", "block"), ("a.com", "/fr/2", "allow"), ("b", "", "block"), (None, "/", "block"), ("com", None, "block"), ("org", "/", "allow"), ("", "", "block")]


@pytest.mark.parametrize("max_bits", [1 << 29, 30])
def test_verdicts_match_plain_rules(spark, max_bits):
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x", "y") for i, u in enumerate(urls())], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urlfilter.judge_urls(pages, rules, max_bits=max_bits).collect()
    expected = [(i if i % 50 else None, *judge(u, RULES)) for i, u in enumerate(urls())]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    """With filters of two bits a key most keys pass by mistake, so many levels are needed."""
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(urlfilter, "PAGE", 64)
    parts = spark.createDataFrame([(f"h{i}.org", f"/p{i % 97}") for i in range(3000)], "host string, path string")
    listed = spark.createDataFrame([(f"h{i}.org\n/p{i % 97}",) for i in range(0, 4000, 3)], "key string")
    cascade = urlfilter.build_cascade(listed, parts, (list(range(3, 10)), [2, 3]))
    assert len(cascade.levels) > 2
    universe = list({k for i in range(3000) for k in urlfilter.candidates(f"h{i}.org", f"/p{i % 97}", (list(range(3, 10)), [2, 3]))})
    members = {r.key for r in listed.collect()}
    assert [bool(x) for x in cascade.listed(universe)] == [k in members for k in universe]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in urlfilter.judge_urls(pages, rules.limit(0), default="block").collect()] == ["block"]


def test_hosts_of_many_labels_have_few_keys(spark):
    host = "a." * 50_000 + "example.org"
    assert urlfilter.candidates(host, "/x", ([3, 11, 12], [1])) == ["org\n/", "example.org\n/"]
    assert urlfilter.candidates("", "/", ([0, 3], [0, 1])) == ["\n", "\n/"] and urlfilter.candidates("a.", "/", ([0, 2], [1])) == ["\n/", "a.\n/"]
    pages = spark.createDataFrame([(1, f"http://{host}/es/1"), (2, f"http://{host}.com/"), (3, "http://" + "b" * 100_000 + ".com/de/")], "page_id long, url string")
    rules = spark.createDataFrame([("example.org", "/es/", "block"), ("com", "/de/", "block")], "host string, path string, verdict string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules).collect()) == [(1, "example.org/es/", "block"), (2, None, "allow"), (3, "com/de/", "block")]
