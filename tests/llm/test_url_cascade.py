from pyspark.sql import functions as F

from tallyscope.llm.queries import URL_RULES
from tallyscope.llm.url_cascade import Rule, build_cascade, is_listed, judge_urls, with_membership

RULES = [Rule(*r) for r in URL_RULES]


def test_membership_is_exact_for_every_key(spark):
    universe = spark.range(3000).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("listed"))
    levels = build_cascade(universe)
    assert len(levels) > 1
    assert universe.where(is_listed(levels, F.col("key")) != F.col("listed")).count() == 0
    parts = with_membership(universe.withColumnRenamed("listed", "expected"), "key", universe, "found", keys_per_part=250)
    assert parts.count() == 3000 and parts.where("found <> expected").count() == 0


def test_all_or_nothing_listed(spark):
    for listed in (True, False):
        universe = spark.range(40).select(F.col("id").cast("string").alias("key"), F.lit(listed).alias("listed"))
        assert universe.where(is_listed(build_cascade(universe), F.col("key")) != listed).count() == 0


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    cut = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:cut]


def test_judged_like_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "http://net/", "http://NET/x", "https://a.example.net/en/1?q=1", "https://example.net/en", "https://notexample.net/en/2",
        "http://b.example.com/de/1#x", "http://b.example.com/fr/1", "http://c.example.com/fr/1", "http://x.org/fr/", "http://x.org/de/", "a://b://c.net/q",
        "http://É.net?/x", "http://y.example.com/de/1", "http://y.example.com/en/1", "http://y.example.com/en/2", "http://y.example.com/en/3", "http://b.example.com/de/1#x",
    ]
    rows = [(i, u, "extra", "h") for i, u in enumerate(urls)] + [(None, "http://net/", "e", "h"), (3, "http://", "e", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _listed string")
    got = sorted((tuple(r) for r in judge_urls(pages, RULES).collect()), key=str)

    def rule(host, path):
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text)) if fits else None

    parsed = [(p, *host_path(u)) for p, u, *_ in rows]
    blocked, pages_of = {}, {}
    for _, h, p in parsed:
        r = rule(h, p)
        pages_of[h] = pages_of.get(h, 0) + 1
        blocked[h] = blocked.get(h, 0) + (r is not None and r.action == "block")
    want = []
    for i, h, p in parsed:
        r = rule(h, p)
        verdict = r.action if r else ("block" if blocked[h] and 2 * blocked[h] >= pages_of[h] else "allow")
        want.append((i, h, p, r.text if r else None, verdict))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []
