import random
import time

import duckdb
import pytest

from pyspark.sql import functions as F

from tailframe.llm import urlfilter
from tailframe.llm.urlfilter import RULES, Rule, UrlTrie, judge_urls, oracle, split_url

URLS = [None, "", "no scheme", "://", "http://", "http://COM/en/x", "https://a.Example.com/en/7?x", "https://a.example.com/en/6", "http://example.com/en", "http://example.com/en/", "http://xcom/en/1", "http://x.com?/en/1", "http://x.com#/en/1", "ftp://a.b.example.net/de/8/9", "http://net/de/", "http://example.net.org/es/1", "http://org/es", "http://u@a.org:80/es/2", "http://a.org/es/2\nx", "http://a.org/en/://b.com/en/", "x://y://com/en/1", "http://é.com/en/ü"]


def brute(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), r.verdict == "block", len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_matches_brute_force(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS)] + [(3, URLS[6], "y")]
    got = [tuple(r) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, HOST string"), RULES, keep=["page_id", "HOST"]).collect()]
    assert sorted(got) == sorted((k, *brute(u, RULES)) for k, u, _ in rows)


def test_random_rules():
    r = random.Random(6)
    rules = [Rule(r.choice(["allow", "block"]), ".".join(r.choice("abc") for _ in range(r.randrange(1, 4))), "".join(r.choice(["/", "x", "/x", "/y/"]) for _ in range(r.randrange(4)))) for _ in range(80)]
    rules = [r._replace(path="/" + r.path.lstrip("/")) if r.path else r for r in rules]
    trie = UrlTrie(rules)
    for _ in range(3000):
        url = "http://" + ".".join(r.choice("abc") for _ in range(r.randrange(1, 5))) + "".join(r.choice(["/", "x", "y", "/x", "?q"]) for _ in range(r.randrange(6)))
        got = trie.match(*split_url(url))
        assert (got and got.host + got.path, got.verdict if got else "allow") == brute(url, rules)[2:]


def test_oracle_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    assert sorted(con.execute(oracle()).fetchall()) == sorted((k, *brute(u, RULES)) for k, u in enumerate(URLS))


def test_size_is_checked_and_empty_tables_pass(spark):
    with pytest.raises(ValueError, match="too long"):
        UrlTrie([Rule("block", "a" * 65_000_000, "")])
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_long_lists_are_joined(spark, monkeypatch):
    """The join gives what the trie gives, also for hosts that most urls and rules have."""
    r = random.Random(31)
    host = lambda: ".".join(r.choice(["a", "b", "com", "B"]) for _ in range(r.randrange(1, 4)))
    path = lambda: "".join("/" + r.choice(["", "x", "xy", "en", "e"]) for _ in range(r.randrange(0, 4)))
    rules = [urlfilter.Rule(r.choice(["allow", "block"]), host().lower(), path()) for _ in range(80)]
    urls = [(k, r.choice([f"http://{host()}{path()}?q", f"x://com{path()}", None, "no", ""])) for k in range(300)] + [(300, "http://com/" + "x" * 100_000)]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("Rule", F.lit(1))
    want = sorted(map(str, urlfilter.judge_urls(df, rules, keep=["page_id"]).collect()))
    monkeypatch.setattr(urlfilter, "MAX_RULES", 5)
    got = urlfilter.judge_urls(df, rules, keep=["page_id"])
    assert sorted(map(str, got.collect())) == want
    assert "Rule" not in urlfilter.judge_urls(df, rules).columns
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0


def test_many_rules_of_one_host():
    rules = [urlfilter.Rule("block", "a.b", f"/p{k}") for k in range(100_000)] + [urlfilter.Rule("allow", "a.b", "/p77777x")]
    trie = urlfilter.UrlTrie(rules)
    began = time.perf_counter()
    for k in range(2000):
        assert trie.match("www.a.b", f"/p{k}/q").path == f"/p{k}"
    assert trie.match("a.b", "/p77777xy").verdict == "allow"
    assert time.perf_counter() - began < 2


def test_very_long_urls(spark):
    long = ["http://" + "a." * 100_000 + "com/en/" + "x/" * 200_000, "https://example.net/de/8" + "y" * 1_000_000, "z" * 1_000_000]
    got = [tuple(r) for r in judge_urls(spark.createDataFrame(list(enumerate(long)), "page_id long, url string"), RULES, keep=["page_id"]).collect()]
    assert sorted(got) == [(k, *brute(u, RULES)) for k, u in enumerate(long)]
