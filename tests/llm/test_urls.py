import random
import re
import time

import oracle_check

from annalist.llm import urls
from annalist.llm.queries import ORACLE, QUERIES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = parts(url)
    fitting = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fitting, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_brute_force(spark):
    chance = random.Random(1)
    names, ends = ["a", "B", "example", "net", "org", "É"], ["", "/", "/en", "/en/", "/en/x", "/enx", "/EN/", "?q=/en/", "#/en/", "/en/?a://b.net/"]
    hosts = [".".join(chance.choice(names) for _ in range(chance.randint(1, 4))) for _ in range(60)]
    pages = [None, "", "no scheme", "://", "http://", "http:///en/", "http://x.net:80/", "//a.net/", "x://y://net/"]
    pages += [f"http://{h}{chance.choice(ends)}" for h in hosts for _ in range(4)]
    rules = [("net", "/", "block"), ("a.net", "/en", "allow"), ("a.net", "/en/", "block"), ("org", "", "block"), ("example.org", "/EN/", "allow")]
    table = spark.createDataFrame([(i % 50, u, "x", "y") for i, u in enumerate(pages)], "page_id bigint, url string, rule string, host string")
    got = urls.judge(table, spark.createDataFrame([*rules, ("NET", "/", "allow"), (None, "/", "block")], urls.RULE_SCHEMA)).collect()
    expected = [(i % 50, *brute(u, rules)) for i, u in enumerate(pages)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    rules = spark.createDataFrame([("net", "/", "block")], urls.RULE_SCHEMA)
    assert urls.judge(pages.filter("false"), rules).count() == 0
    assert [tuple(r) for r in urls.judge(pages, rules.filter("false")).collect()] == [(1, "a.net", "/", None, "allow")]


def test_no_python_on_executors(spark, sf_dir):
    plan = QUERIES["op7_urls"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_against_sql(spark, sf_dir):
    duck = oracle_check.connect(sf_dir)
    assert oracle_check.difference(QUERIES["op7_urls"](spark, sf_dir), duck, ORACLE["op7_urls"]) is None


def test_a_host_of_many_labels(spark):
    host = "a." * 100_000 + "example.com"
    pages = spark.createDataFrame([(i, f"http://{host}/de/{i}") for i in range(5)], "page_id bigint, url string")
    rules = spark.createDataFrame([("example.com", "/de/", "block"), ("com", "/", "allow"), ("a.example.com", "/x/", "allow")], urls.RULE_SCHEMA)
    began = time.time()
    rows = urls.judge(pages, rules).collect()
    assert time.time() - began < 10
    assert {(r.rule, r.verdict) for r in rows} == {("example.com/de/", "block")} and len(rows) == 5
