"""URL parts, rules, learned verdicts and the defined cases."""

from lorekeep.llm import urls
from lorekeep.llm.queries import URL_RULES
from tests.llm.helpers import SMALL, by_id

CASES = [
    ("http://a.Example.ORG/es/1?x=/y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12#/z", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("ftp://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/a://b", "x.com", "/de/a://b", "com/de/", "block"),
    ("http://x.com/DE/", "x.com", "/DE/", None, None),
    ("http://org", "org", "", None, None),
    ("http://?q=http://a.org/", "", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("://É.Org/\nfr", "É.org", "/\nfr", "org/", "allow"),
]


def pages(spark, found):
    return spark.createDataFrame([(i, u, "h", 1.0) for i, u in found], "page_id long, url string, host string, prediction double")


def test_parts_and_rules(spark):
    many = [(100 + i, f"http://s{i % 7}.example.{'org' if i % 2 else 'com'}/{'es' if i % 3 else 'fr'}/{i}") for i in range(80)]
    got = by_id(urls.judge(pages(spark, [*((i, c[0]) for i, c in enumerate(CASES)), *many]), URL_RULES), "page_id")
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    """Rules decide some URLs of two kinds; the trees carry the difference over to hosts without a rule."""
    spam = lambda i: f"http://win-{i}-cash.biz/{i * 7919}/{i * 104729}?a={i}&b={i}&c={i}"
    plain = lambda i: f"http://news{chr(97 + i % 26)}.info/articles/{chr(97 + i % 26) * 4}"
    rows = [*((i, spam(i)) for i in range(120)), *((1000 + i, plain(i)) for i in range(120)), (5000, spam(5).replace(".biz", ".zzz")), (5001, plain(3).replace(".info", ".zzz"))]
    got = by_id(urls.judge(pages(spark, rows), [("block", "biz/"), ("allow", "info/")]), "page_id")
    assert got[5000].verdict == "block" and got[5001].verdict == "allow" and got[5000].rule is None


def test_one_kind_of_label_or_none(spark):
    rows = pages(spark, [(1, "http://a.org/x"), (2, "http://b.net/x"), (2, "http://b.net/x"), (None, None)])
    assert [r.verdict for r in urls.judge(rows, [("block", "org/")]).collect()] == ["block"] * 4
    assert [r.verdict for r in urls.judge(rows, [("block", "de/")]).collect()] == ["allow"] * 4
    assert urls.judge(rows.where("page_id = 9"), URL_RULES).collect() == []


def test_whole_small_table(spark):
    frame = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = urls.judge(frame, URL_RULES).collect()
    assert len(got) == frame.count() and {r.verdict for r in got} <= {"allow", "block"}


def test_few_distinct_urls_and_rare_verdicts(spark):
    """Copies of three URLs under a small sample, and one blocked URL among many allowed ones."""
    rows = [(i, ("http://a.org/x", "http://b.com/de/y", "http://c.net/z")[i % 3]) for i in range(600)]
    got = urls.judge(pages(spark, rows), URL_RULES, sample_rows=4).collect()
    assert len(got) == 600 and {(r.host, r.verdict) for r in got if r.rule} == {("a.org", "allow"), ("b.com", "block")}
    rare = [(0, "http://b.com/de/" + "9" * 40), *((i, f"http://n{i}.org/x") for i in range(1, 300)), (999, "http://b.net/de/" + "9" * 41)]
    assert len(urls.judge(pages(spark, rare), URL_RULES, sample_rows=20).collect()) == 301


def test_very_long_urls(spark):
    rows = [(0, "http://a.org/" + "x/" * 100_000), (1, "http://b.com/de/" + "?&=" * 50_000), (2, "http://" + "z" * 200_000), (3, "://" * 30_000)]
    got = by_id(urls.judge(pages(spark, rows), URL_RULES), "page_id")
    assert (got[0].verdict, got[1].verdict, len(got[2].host)) == ("allow", "block", 200_000) and got[3].host == ":"
