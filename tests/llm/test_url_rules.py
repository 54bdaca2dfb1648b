import re
from itertools import combinations

from pyspark.sql import functions as F

from tabulyse.llm.queries import QUERIES
from tabulyse.llm.url_rules import BLOCK, RULES, document, judged, mined_rules, tokens


def plain(url, rules=RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


URLS = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/?q", "http://x.net/es/1#t", "http://net/fr/", "http://example.com", "com/", None, "", "http://notexample.com/en/", "ftp://u@É.Com:80/a//b?c=1&d=2#e", "x://y://z/w", "http://?q", "http://a.net/es", "http://b.org/" + "p/" * 20_000]


def test_query_against_brute_force(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op7_url_rules"](spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined_rule else "allow"))


def test_odd_rows(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS token", "3 AS rule")
    none = mined_rules(spark.createDataFrame([], "items array<string>"))
    out = judged(pages, "url", ["page_id", "host"], none).toDF("page_id", "_host", "host", "path", "rule", "verdict", "mined_rule").collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        host, path, rule, verdict = plain((URLS * 2)[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert judged(pages.where(F.lit(False)), "url", ["page_id"], none).count() == 0


def test_tokens(spark):
    row = spark.createDataFrame([("http://A.b.com/x/12/x/p3.html?id=4&ref&id=5#f",), (None,)], "u string").select(tokens(F.col("u")).alias("t")).collect()
    assert row[0].t == ["h:a", "h:b", "h:com", "e:b.com", "p:x", "p:0", "p:p0.html", "q:id", "q:ref"] and row[1].t == []


def test_query_blocks_planted_hosts(spark, tmp_path):
    rows = []
    for i in range(3000):
        host = "spam.example.org" if i % 20 == 0 else f"www.site{i % 7}.org"
        rows.append((i, f"http://{host}/en/{(i * 7) % 3000}" + ("", ".html", "/", "?page=2&ref=x", "#top")[i // 20 % 5]))
    # Pages of the planted host show bad documents in two of five cases, others in one of fifty.
    bad = {(i * 7) % 3000 for i in range(3000) if (i % 20 == 0 and i // 100 % 5 < 2) or (i % 20 and i % 53 == 1)}
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(d, 1, int(d in bad)) for d in range(3000)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    urls = dict(rows)
    out = QUERIES["op7_url_rules"](spark, str(tmp_path)).collect()
    assert {r.page_id: r.verdict for r in out} == {i: "block" if "spam" in u else "allow" for i, u in urls.items()}
    assert all(("spam" in r.mined_rule) for r in out if r.mined_rule)


def test_rules_need_more_than_chance(spark):
    few = [["h:a", BLOCK]] * 11 + [["h:a"]] * 8 + [["h:b", BLOCK]] * 241 + [["h:b"]] * 711  # 0.579 against 0.260: 3.2 standard errors
    assert mined_rules(spark.createDataFrame([(b,) for b in few], "items array<string>")).count() == 0
    many = few + [["h:a", BLOCK]] * 110 + [["h:a"]] * 80
    assert [tuple(r.rule) for r in mined_rules(spark.createDataFrame([(b,) for b in many], "items array<string>")).collect()] == []
    rare = [["h:a", BLOCK]] * 40 + [["h:a"]] * 60 + [["h:b", BLOCK]] * 20 + [["h:b"]] * 1880
    assert [tuple(r.rule) for r in mined_rules(spark.createDataFrame([(b,) for b in rare], "items array<string>")).collect()] == [("h:a",)]


def test_document_of_a_page(spark):
    urls = ["http://a.b/en/12", "http://a.b/en/12.html", "http://a.b/en/12/", "http://a.b/en/12?page=2", "http://a.b/en/12#top", "http://a.b/en/x12", "http://a.b/?12", "12", None]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(document(F.col("u")).alias("d")).collect()
    assert [r.d for r in found] == [12] * 5 + [None] * 4


def test_mined_rules_against_all_combinations(spark):
    baskets = [["a", "b", BLOCK]] * 12 + [["a", "c"]] * 10 + [["b", "c"]] * 9 + [["d", "e", BLOCK]] * 14 + [["d"]] * 2 + [["f", BLOCK]] * 3
    frame = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    found = {tuple(r.rule): (round(r.confidence, 6), r.token) for r in mined_rules(frame, 0.0, 5, 0.8).collect()}
    sure = {}
    for size in (1, 2):
        for rule in combinations("abcdef", size):
            has = [b for b in baskets if set(rule) <= set(b)]
            bad = sum(BLOCK in b for b in has)
            if bad >= 5 and bad / len(has) >= 0.8:
                sure[rule] = round(bad / len(has), 6)
    want = {r: c for r, c in sure.items() if not any(set(p) < set(r) and sure[p] >= c for p in sure)}
    assert {r: c for r, (c, _) in found.items()} == want and all(t in r for r, (_, t) in found.items())
    pages = spark.createDataFrame([(1, "x://e.d/"), (2, "x://a.z/"), (3, "x://b.a/")], "page_id long, url string")
    mined = spark.createDataFrame([(["h:a", "h:b"], 0.9, 0.1, "h:b"), (["h:e"], 0.8, 0.1, "h:e")], "rule array<string>, confidence double, support double, token string")
    assert {r.page_id: r.verdict for r in judged(pages, "url", ["page_id"], mined).collect()} == {1: "block", 2: "allow", 3: "block"}
