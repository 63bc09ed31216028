from itertools import product

import itertools
import math
import random
import re

import duckdb
from pyspark.sql import functions as F
from structura.llm import queries, url_rules


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def brute_rule(host, path):
    rules = [("com", "/"), ("example.com", "/en/"), ("www.example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return "".join(max(fit, key=lambda r: (len(r[0]), len(r[1])))) if fit else None


URLS = [
    None, "", "no scheme.com/x", "http://com/", "http://com", "https://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://www.example.com/en", "http://x.www.example.com/en/1",
    "http://xexample.com/en/1", "ftp://net/es/", "http://a.net/es", "http://a.net/fr/x", "http://a.net?/fr/", "http://b.net#/fr/", "http://a://b.com/", "x://É.NET/es/", "http://\nq.net/es/1", "http:///en/", "HTTP://U:P@H.com:80/EN/",
]


def spelled(rules):
    """Each choice of a token for every item."""
    return {tuple(sorted(pick)): round(r.confidence, 9) for r in rules.collect() for pick in product(*r.antecedent)}


def test_lists_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, None, "y")], "page_id long, url string, rule string")
    rules = url_rules.mine(spark.createDataFrame([], "tokens array<string>, bad boolean"))
    got = url_rules.judge(df, queries.URL_LISTS, rules).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = brute_split(URLS[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == ("block" if rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")
    assert url_rules.judge(df.where("false"), queries.URL_LISTS, rules).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(600):
        tokens = rng.sample(["h:a", "h:b", "h:c", "p:x", "p:y", "p:z"], rng.randint(1, 5))
        rows.append((tokens, rng.random() < (0.9 if {"h:a", "p:x"} <= set(tokens) else 0.7 if "h:c" in tokens and "p:z" in tokens else 0.1)))
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    n, bad = len(rows), sum(b for _, b in rows)
    want = {}
    for k in range(1, 7):
        for ante in itertools.combinations(sorted({t for r, _ in rows for t in r}), k):
            hit = [b for r, b in rows if set(ante) <= set(r)]
            if sum(hit) >= max(math.ceil(0.002 * n), 8) and sum(hit) / len(hit) >= 0.6 and sum(hit) / len(hit) / (bad / n) >= 2:
                want[ante] = sum(hit) / len(hit)
    want = {a: c for a, c in want.items() if not any(set(b) < set(a) and d >= c for b, d in want.items())}
    assert want and spelled(mined) == {a: round(c, 9) for a, c in want.items()}
    pages = spark.createDataFrame([(1, "http://a.org/x/9"), (2, "http://a.org/y"), (3, "http://q.a.org/w/x")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, [], mined).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, queries.op5_association_url_filter(spark, sf).collect()), key=str)
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert got == sorted(db.execute(queries.OP5_SQL).fetchall(), key=str)


def test_nothing_runs_in_python(spark):
    plan = queries.op5_association_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_tokens(spark):
    row = spark.range(1).select(url_rules.tokens_of(F.lit("a1.b-c.com"), F.lit("/x/y12.html/x")).alias("t")).first()
    assert row.t == ["h:a0", "h:b", "h:c", "h:com", "p:x", "p:y0", "p:html"]


def test_query_keeps_rules_of_four_tokens(spark, tmp_path):
    """Bad pages hold all four of h:a, p:x, p:y and p:z; any three of them are bad in half of their pages only."""
    kinds = list(itertools.product("ab", "xu", "yv", "zw"))
    pages = [(i, f"http://{h}.org/{x}/{i}/{y}/{z}") for i in range(320) for h, x, y, z in [kinds[i % 16]]]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i, int(kinds[i % 16] != ("a", "x", "y", "z")), 0) for i in range(320)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r.verdict for r in queries.op5_association_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: "allow" if q else "block" for i, q, _ in labels}


def test_query_against_sql_where_rules_fire(spark, tmp_path):
    """Labels follow the URL: both engines mine rules of one to three tokens, and unlisted pages are blocked by them."""
    rng = random.Random(9)
    pages, labels = [], []
    for i in range(1500):
        host = rng.choice(["casino-win.example.org", "www.bets.example.org", "good.example.net", "news.example.org", "m.pills.example.com", "x.net"])
        words = [w for w in ("free", "win", "deal", "home") if rng.random() < 0.4]
        pages.append((i, f"http://{host}/{rng.choice(['en', 'es', 'de'])}/{i}/{'/'.join(words)}?q={i}"))
        bad = "casino" in host or {"free", "win"} <= set(words) or ("bets" in host and {"deal", "home"} <= set(words))
        if rng.random() < 0.6:
            labels.append((i, int(rng.random() < (0.05 if bad else 0.95)), int(bad and rng.random() < 0.2)))
    pages += [(1500, None), (1501, "no host"), (1502, "https://casino-win.example.org/en/9999999/")]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(map(tuple, queries.op5_association_url_filter(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(db.execute(queries.OP5_SQL).fetchall(), key=str)
    mined = [r for r in got if r[3] is None and r[4] == "block"]
    assert len(mined) > 200 and len({r[5] for r in mined}) >= 3
    assert (1502, "casino-win.example.org", "/en/9999999/", None, "block") in {r[:5] for r in mined}


def test_a_repeated_url_of_many_tokens_is_one_item(spark):
    """Twelve bad pages share thirty tokens that no other page has: 2^30 itemsets if each token were an item."""
    many = [f"p:t{i}" for i in range(30)]
    rows = [(many + ["h:com"], True)] * 12 + [(["h:com", f"p:x{i % 5}"], False) for i in range(100)]
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert [(r.antecedent, round(r.confidence, 9)) for r in rules.collect()] == [([sorted(many)], 1.0)]
    # one of the item's tokens is enough to match; digits became 0 before mining
    rows = [(["h:org", "p:t0", "p:u"], True)] * 12 + [(["h:org"], False)] * 40
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    pages = spark.createDataFrame([(1, "http://a.org/t7/else"), (2, "http://a.org/x1"), (3, None), (4, "http://b.com/u")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.judge(pages, [], rules).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block"}
