import random
import re

import pytest

from logyield.llm import urls

SCHEMA = "page_id bigint, url string, host string, _key string"


def expected(url, rules, default="allow"):
    match = re.match(r"(?s).*?://([^/?#]*)(/[^?#]*)?", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in match.group(1)) if match else ""
    path = (match.group(2) or "") if match else ""
    fits = [
        ((len(h + p), h.count(".") + 1, v == "block"), h + p, v)
        for h, p, v in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[1] if best else None, best[2] if best else default


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("a.b.net", "/", "allow"), ("b.net", "/x/", "block"), ("b.net", "", "block"),
]
FIXED = [
    None, "", "no scheme", "http://", "http://net/", "http://NET", "https://www.Example.net/en/x?y#z", "x://evilnet/",
    "http://example.com:8080/de/", "http://a.b.net?x", "http://a.b.net/x/1", "http://a.b.net#/", "http://org/fr/a://b",
    "http://ex\nample.org/fr/\n?", "http://.net/", "http://net./", "//x://net/y", "http://münchen.net/ü",
]


def compare(spark, rows, rules):
    pages = spark.createDataFrame(rows, SCHEMA)
    got = urls.judge(pages, spark.createDataFrame(rules, urls.RULE_SCHEMA)).collect()
    assert got and list(got[0].asDict()) == ["page_id", "host", "path", "rule", "verdict"] or not rows
    key = repr
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *expected(r[1], rules)) for r in rows), key=key)


def test_fixed_and_random_urls(spark):
    dice = random.Random(3)
    labels = ["net", "org", "com", "example", "a", "b", "www"]
    paths = ["", "/", "/en/", "/en/x", "/x/", "/x/en/", "/fr/y", "/de/"]
    many = [
        f"http://{'.'.join(dice.choices(labels, k=dice.randint(1, 4)))}{dice.choice(paths)}{dice.choice(['', '?q', '#f'])}"
        for _ in range(400)
    ]
    rows = [(None if i % 50 == 7 else i, u, "clash", "clash") for i, u in enumerate(FIXED + many)]
    compare(spark, rows + rows[:5], RULES)


def test_address_in_query_or_fragment(spark):
    cases = [
        ("https://a.example.net?next=https://b.org/fr/x", "a.example.net", "", None, "allow"),
        ("https://a.example.net#https://b.org/fr/x", "a.example.net", "", None, "allow"),
        ("http://org?u=x://net/y", "org", "", None, "allow"),
        ("http://?u=x://net/y", "", "", None, "allow"),
        ("https://a.example.net/en/?next=https://b.org/fr/x", "a.example.net", "/en/", "example.net/en/", "allow"),
        ("https://www.net/fr/a://b.org/x", "www.net", "/fr/a://b.org/x", "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, c[0], "clash", "clash") for i, c in enumerate(cases)], SCHEMA)
    got = urls.judge(pages, spark.createDataFrame(RULES, urls.RULE_SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(i, *c[1:]) for i, c in enumerate(cases)]


def test_twin_judges_addresses_in_query_or_fragment_alike():
    import duckdb

    from logyield.llm.queries import OP10_SQL

    cases = [
        (1, "https://a.example.net?next=https://b.org/fr/x", "a.example.net", "", None, "allow"),
        (2, "http://org#x://net/y", "org", "", None, "allow"),
        (3, "https://www.net/fr/a://b.org/x", "www.net", "/fr/a://b.org/x", "net/", "block"),
        (4, None, "", "", None, "allow"),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [list(c[:2]) for c in cases])
    got = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP10_SQL}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in got] == [(c[0], *c[2:]) for c in cases]


def test_hot_url_is_spread_over_ranges(spark):
    rows = [(i, "http://www.example.net/en/", None, None) for i in range(300)] + [(400, "http://z.org/fr/", None, None)]
    compare(spark, rows, RULES)
    hashed = spark.createDataFrame(rows, SCHEMA)
    frame = hashed.selectExpr("'net.example.www.' AS _key", "'/en/' AS path", "xxhash64(page_id) AS _row")
    assert len(urls.range_bounds(frame, 4)) == 3


@pytest.mark.parametrize("rules", [[], [("", "/", "block")], [("net", "/", "block"), ("net", "/", "block")]])
def test_few_rules(spark, rules):
    compare(spark, [(1, "http://net/", "", ""), (2, None, "", "")], rules)


def test_empty_table(spark):
    compare(spark, [], RULES)
