"""Boundary cases of the analytics operators, with rows of our own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightline.functions import expr, html, robots, text, urls
from sightline.operators import audit, demand, graph, keywords, maintenance, rank, search, visibility
from sightline.sources import sinks, tables

DAY = dt.datetime(2024, 5, 31)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, digits, want", [(2.5, 0, 3.0), (-2.5, 0, -2.0), (1.005, 2, 1.0), (0.125, 2, 0.13), (7.0, 2, 7.0)])
def test_half_up(spark, value, digits, want):
    assert one(spark, expr.half_up(F.lit(value), digits)) == want


@pytest.mark.parametrize("position, want", [(None, 0.0), (0, 0.0), (1, 0.28), (20, 0.006), (21, 0.005), (99, 0.005)])
def test_ctr(spark, position, want):
    assert one(spark, expr.ctr(F.lit(position).cast("int"))) == want


@pytest.mark.parametrize("nulls, want", [("zero", [0, 5, None]), ("fail", [0, 5]), ("pass", [0, 5, None]), ("sql", [0, 5])])
def test_range_policies(spark, nulls, want):
    rows = spark.createDataFrame([(0,), (5,), (9,), (None,)], "v int")
    assert sorted((r["v"] for r in rows.where(expr.range_filter("v", 0, 5, nulls)).collect()), key=str) == sorted(want, key=str)


def test_position_zero_means_unranked(spark):
    rows = spark.createDataFrame([(3,), (None,)], "p int")
    assert [r["p"] for r in rows.where(expr.position_filter("p", None, 0)).collect()] == [None]
    assert [r["p"] for r in rows.where(expr.position_filter("p", 1, 3)).collect()] == [3]


def test_terms(spark):
    assert expr.split_terms(" a, B+c,,a ") == ["a", "b", "c"] and expr.split_terms("a+b,c", ",") == ["a+b", "c"]
    rows = spark.createDataFrame([("Red_Shoe 100%",), ("red boot",), (None,)], "k string")
    pick = lambda c: [r["k"] for r in rows.where(c).collect()]
    assert pick(expr.text_filter("k", ["red", "_"], mode="all")) == ["Red_Shoe 100%"]
    assert pick(expr.text_filter("k", ["%", "boot"], mode="any")) == ["Red_Shoe 100%", "red boot"]
    assert pick(expr.text_filter("k", [], ["boot"])) == ["Red_Shoe 100%"]


def test_condition_budget():
    with pytest.raises(ValueError):
        keywords.api_conditions("a,b,c,d,e", "f,g,h", {"v": (1, 2)})


def test_forms():
    assert keywords.clamped_filters({"min_volume": "-5.9", "max_difficulty": "140", "min_cpc": "1.25", "x": ""}) == {"min_volume": 0, "max_difficulty": 100, "min_cpc": 1.25}
    assert keywords.active_filters({"include": "a, b", "exclude": "", "min": "3"}) == 3
    assert keywords.has_more(25, 1, 25, None) and not keywords.has_more(25, 1, 25, 25) and not keywords.has_more(3, 1, 25, None)


@pytest.mark.parametrize("age, want", [(0, 1.0), (7, 1.0), (48.5, 0.5), (90, 0.0), (-3, 1.0)])
def test_freshness(spark, age, want):
    published = DAY - dt.timedelta(days=age)
    assert one(spark, expr.freshness(F.lit(published), F.lit(DAY))) == want
    assert one(spark, expr.freshness(F.lit(published), F.lit(DAY), baseline=F.lit(True))) == 0.0


def test_dates(spark):
    assert one(spark, expr.next_check(F.lit(DAY), F.lit(DAY), "weekly")) == DAY + dt.timedelta(days=7)
    assert one(spark, expr.next_check(F.lit(DAY), F.lit(DAY + dt.timedelta(days=15)), "weekly")) == DAY + dt.timedelta(days=21)
    late = dt.datetime(2024, 1, 31, 5, 30)
    assert one(spark, expr.next_check(F.lit(late), F.lit(late), "monthly")) == dt.datetime(2024, 2, 29, 5, 30)
    start, end = expr.report_range(F.lit(dt.date(2024, 6, 3)), "last_3_months")
    assert (one(spark, start), one(spark, end)) == (dt.date(2024, 2, 29), dt.date(2024, 5, 31))
    a, b = expr.previous_period(F.lit(dt.date(2024, 3, 8)), F.lit(dt.date(2024, 3, 14)))
    assert (one(spark, a), one(spark, b)) == (dt.date(2024, 3, 1), dt.date(2024, 3, 7))


def test_brand_pattern(spark):
    rows = spark.createDataFrame([("I use C++ daily",), ("C+++ is odd",), ("AT&T here",), ("subAcme",), ("acme!",)], "t string")
    hits = lambda b: [r["t"] for r in visibility.brand_mentions(rows, "t", b).where("mentioned").collect()]
    assert hits("C++") == ["I use C++ daily"] and hits("AT&T") == ["AT&T here"] and hits("Acme") == ["acme!"]


# rank


def snapshots(spark, rows):
    return spark.createDataFrame([(i, 1, k, d, p, DAY + dt.timedelta(days=t)) for i, (k, d, p, t) in enumerate(rows)], "snapshot_id long, config_id long, keyword_id long, device string, position int, checked_at timestamp")


def test_comparison_by_presence(spark):
    rows = snapshots(spark, [(1, "desktop", 9, 0), (1, "desktop", None, 5), (1, "desktop", 3, 20), (2, "desktop", 7, 15), (2, "desktop", None, 20), (3, "mobile", 4, 20)])
    got = {r["keyword_id"]: (r["position"], r["previous_position"]) for r in rank.compared_results(rows, F.lit(DAY + dt.timedelta(days=10))).collect()}
    assert got == {1: (3, None), 2: (None, 7), 3: (4, 4)}


def test_scorecards(spark):
    rows = snapshots(spark, [(1, "desktop", 4, 0), (1, "desktop", 1, 20), (2, "desktop", None, 0), (2, "desktop", 12, 20), (3, "desktop", 2, 0), (3, "desktop", None, 20), (4, "desktop", None, 0), (4, "desktop", None, 20)])
    wide = rank.by_device(rank.compared_results(rows, F.lit(DAY + dt.timedelta(days=1)))).join(spark.createDataFrame([(1, 100), (2, None), (3, 0), (4, 100)], "keyword_id long, search_volume long"), "keyword_id")
    card = rank.scorecards(wide, "desktop").first()
    assert abs(card["visibility"] - 50) < 1e-9 and abs(card["visibility_delta"] - (100 * 0.21 / 56)) > 0
    assert (card["ranking"], card["ranking_delta"], card["top3"], card["top10"], card["improved"], card["declined"]) == (2, 0, 1, 1, 2, 1)
    blank = rank.scorecards(wide.withColumn("search_volume", F.lit(None).cast("long")), "desktop").first()
    assert blank["visibility"] is None


def test_search_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "clicks long, impressions long, position double")
    assert tuple(search.totals(empty).first()) == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize("position, kept", [(4.99, 0), (5.0, 1), (20.0, 1), (20.01, 0)])
def test_striking_distance_bounds(spark, position, kept):
    rows = spark.createDataFrame([("q", "/a", 1, 9, position), ("q", "/b", 1, 99, 30.0)], "query string, page string, clicks long, impressions long, position double")
    assert search.striking_distance(rows).count() == kept


# audit


def page(**changes):
    base = {"id": 1, "url": "u", "fetch_class": "ok", "status_code": 200, "title": "t" * 30, "meta_description": "d" * 100, "canonical_url": None, "header_canonical_url": None, "is_indexable": True, "is_html": True, "h1_count": 1, "word_count": 200, "images_missing_alt": 0, "link_count": 3, "crawl_depth": 1, "response_ms": 100, "heading_order": [1, 2], "content_hash": "h", "audit_id": 1, "redirect_url": None}
    return base | changes


SCHEMA = "id long, url string, fetch_class string, status_code int, title string, meta_description string, canonical_url string, header_canonical_url string, is_indexable boolean, is_html boolean, h1_count int, word_count int, images_missing_alt int, link_count int, crawl_depth int, response_ms int, heading_order array<int>, content_hash string, audit_id long, redirect_url string"
CASES = [
    ({}, set()),
    ({"title": "t" * 9}, {"title-too-short"}), ({"title": "t" * 10}, set()), ({"title": "t" * 60}, set()), ({"title": "t" * 61}, {"title-too-long"}), ({"title": ""}, {"missing-title"}),
    ({"meta_description": "d" * 69}, {"meta-description-too-short"}), ({"meta_description": "d" * 161}, {"meta-description-too-long"}), ({"meta_description": None}, {"missing-meta-description"}),
    ({"word_count": 149}, {"thin-content"}), ({"word_count": 150}, set()), ({"response_ms": 1501}, {"slow-response"}), ({"response_ms": 1500}, set()), ({"crawl_depth": 5}, {"deep-page"}), ({"crawl_depth": 4}, set()),
    ({"status_code": 500, "title": ""}, {"server-error"}), ({"status_code": 404}, {"broken-page"}), ({"status_code": 301, "h1_count": 0}, set()), ({"fetch_class": "blocked", "status_code": 403}, {"blocked-page"}), ({"fetch_class": "error", "status_code": 0}, set()),
    ({"is_html": False, "title": ""}, set()), ({"is_indexable": False, "word_count": 3}, {"noindex-page"}), ({"h1_count": 2}, {"multiple-h1"}), ({"heading_order": [1, 3]}, {"heading-order-skip"}), ({"heading_order": []}, set()),
    ({"canonical_url": "u", "header_canonical_url": "v"}, {"canonical-conflict"}), ({"header_canonical_url": "v"}, {"canonicalized-page"}), ({"link_count": 0}, {"no-outgoing-links"}), ({"images_missing_alt": 1}, {"images-missing-alt"}),
]


def test_page_issues(spark):
    rows = spark.createDataFrame([tuple(page(id=i, **c).values()) for i, (c, _) in enumerate(CASES)], SCHEMA)
    got = {}
    for r in audit.page_issues(rows).collect():
        got.setdefault(r["id"], set()).add(r["issue_type"])
    assert [got.get(i, set()) for i in range(len(CASES))] == [want for _, want in CASES]
    known = {r["issue_type"] for r in audit.registry(spark).collect()}
    assert {t for types in got.values() for t in types} <= known


@pytest.mark.parametrize(
    "edges, want",
    [
        ({"a": "b"}, set()),
        ({"a": "b", "b": "c"}, {("a", "redirect-chain", 2, "c")}),
        ({"a": "b", "b": "c", "c": "d"}, {("a", "redirect-chain", 3, "d")}),
        ({"a": "a"}, {("a", "redirect-loop", None, None)}),
        ({"a": "b", "b": "a"}, {("a", "redirect-loop", None, None)}),
        ({"h": "a", "a": "b", "b": "a"}, {("h", "redirect-loop", None, None)}),
        ({"h": "x", "x": "y", "p": "q", "q": "p"}, {("h", "redirect-chain", 2, "y"), ("p", "redirect-loop", None, None)}),
    ],
)
def test_redirect_walks(spark, edges, want):
    rows = spark.createDataFrame([tuple(page(id=i, url=a, redirect_url=b, status_code=301).values()) for i, (a, b) in enumerate(edges.items())], SCHEMA)
    assert {(r["url"], r["issue_type"], r["hops"], r["final_url"]) for r in audit.redirect_walks(rows).collect()} == want


def test_crawl_depths_of_a_deep_site(spark):
    links = spark.createDataFrame([(1, f"u{i}", f"u{i + 1}", True) for i in range(33)] + [(1, "u33", "u0", True), (2, "u0", "x", True), (1, "u3", "e", False)], "audit_id int, source_url string, target_url string, is_internal boolean")
    got = audit.crawl_depths(spark.createDataFrame([(1, "u0")], "audit_id int, url string"), links).collect()
    assert sorted((r["depth"], r["url"]) for r in got) == [(i, f"u{i}") for i in range(34)]


def test_crawl_depths_of_redirects_and_sitemaps(spark):
    links = spark.createDataFrame([(1, "a", "b", True), (1, "d", "e", True)], "audit_id int, source_url string, target_url string, is_internal boolean")
    hops = spark.createDataFrame([(1, "b", "c"), (1, "c", "d"), (1, "d", "b")], "audit_id int, url string, target string")
    ends = lambda *rows: spark.createDataFrame([(1, x) for x in rows], "audit_id int, url string")
    got = audit.crawl_depths(ends("a"), links, hops, ends("e", "s")).collect()
    assert {r["url"]: r["depth"] for r in got} == {"a": 0, "b": 1, "c": 1, "d": 1, "e": 2, "s": None}


def test_checks_keep_to_their_audit(spark):
    made = []
    for audit_id in (1, 2, 3):
        chain = [(f"p{i}", f"p{i + 1}") for i in range(5)] if audit_id == 1 else [("p0", "p1"), ("p1", "p0")] if audit_id == 2 else []
        made += [page(id=audit_id * 100 + i, audit_id=audit_id, url=u, redirect_url=t, status_code=301) for i, (u, t) in enumerate(chain)]
        made.append(page(id=audit_id * 100 + 50, audit_id=audit_id, url="same", title="one title", content_hash="one"))
    rows = spark.createDataFrame([tuple(x.values()) for x in made], SCHEMA)
    got = {(r["audit_id"], r["url"], r["issue_type"], r["hops"]) for r in audit.redirect_walks(rows).collect()}
    assert got == {(1, "p0", "redirect-chain", 5), (2, "p0", "redirect-loop", None)}
    assert audit.duplicates(rows.where("url = 'same'")).count() == 0
    links = spark.createDataFrame([(1, 999, "same", False), (2, 999, "same", True), (3, 350, "same", True)], "audit_id int, source_page_id long, target_url string, is_internal boolean")
    live = rows.where("url = 'same'")
    assert {r["audit_id"] for r in audit.orphans(live, links).collect()} == {1, 3}
    assert {r["audit_id"] for r in audit.orphans(live, links, spark.createDataFrame([(3, "same")], "audit_id int, url string")).collect()} == {1}


def test_html_facts(spark):
    source = '<html><head><title> T </title><meta name="description" content=" D "><link rel="canonical" href="/c"><meta name="robots" content="NoIndex"><script type="application/ld+json">{}</script></head><body><h1>One</h1><h3></h3><img src=a><img src=b alt=""><a href="/x#f" rel="nofollow">go  <b>on</b></a><a href="https://other.test/">o</a><a href="mailto:x">m</a><a href="/x">again</a><script>no words</script>three more words</body></html>'
    rows = spark.createDataFrame([(1, "https://s.test/p", source, "none"), (2, None, None, None)], "id long, url string, html string, x_robots_tag string")
    full = html.analyse_pages(rows)
    facts = full.where("id = 1").first()["facts"]
    assert (facts["title"], facts["meta_description"], facts["canonical_url"], facts["heading_order"], facts["h1s"]) == ("T", "D", "/c", [1, 3], ["One"])
    assert [(x["target_url"], x["anchor"], x["is_internal"], x["is_nofollow"]) for x in facts["links"]] == [("https://s.test/x", "go on", True, True), ("https://other.test/", "o", False, False)]
    assert facts["has_structured_data"] and "no words" not in facts["body_text"]
    page_ = html.derived_page(full).where("id = 1").first()
    assert not page_["is_indexable"] and page_["images_missing_alt"] == 1 and page_["images_total"] == 2


ROBOTS = "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /$\n# c\nContent-Signal: search=yes, ai-train=no, ai-train=yes\nContent-Usage: train-ai=n, search=y\nContent-Usage: /x train-ai=y"


def test_robots():
    got = robots.bot_statuses(ROBOTS)
    assert got["GPTBot"] == "blocked" and got["ClaudeBot"] == "allowed"
    assert set(robots.bot_statuses(None).values()) == {"no_robots_txt"} and set(robots.bot_statuses("").values()) == {"not_mentioned"}
    assert robots.bot_statuses("User-agent: *\nDisallow: /")["ClaudeBot"] == "blocked_by_wildcard"
    assert robots.bot_statuses("User-agent: *\nDisallow: /\nAllow: /")["ClaudeBot"] == "allowed"
    assert robots.bot_statuses("User-agent: *\nDisallow: /\nUser-agent: ClaudeBot\nDisallow: /a")["ClaudeBot"] == "not_mentioned"
    assert robots.content_signals(ROBOTS) == {"search": "allowed", "ai-input": "unspecified", "ai-train": "conflict"}
    assert robots.usage_preferences(ROBOTS) == ("measured", {"train-ai": "disallowed", "search": "allowed"}, {})
    assert robots.usage_preferences("AIPREF: train-ai=y\nAIPREF: train-ai=n, bad")[0:2] == ("invalid", {"train-ai": "conflict"})
    assert robots.capped("ab\ncdef", 5) == ("ab", True) and robots.capped("é\n", 10) == ("é\n", False)


def test_urls():
    assert urls.normalise("HTTP://Ex.com:80?b=2&a=1#f") == "http://ex.com/?a=1&b=2" and urls.normalise("ftp://x/") is None
    assert urls.key_of("http://www.Ex.com/a/?b=1") == "https://ex.com/a/?b=1" and urls.key_of("No Url") == "no url"
    assert urls.canonical("https://Ex.com/a//?utm_source=x&z=1&b=2#f") == "https://ex.com/a?b=2&z=1"
    assert urls._same_origin("https://www.a.com/x", "http://a.com") and not urls._same_origin("http://a.com", "https://a.com") and not urls._same_origin("https://b.a.com", "https://a.com")
    good, bad = ["https://example.com/", "http://8.8.8.8/"], ["http://localhost", "http://10.0.0.1", "http://[::1]/", "http://[::ffff:127.0.0.1]/", "http://169.254.169.254", "ftp://a.com", "http://x.internal", "http://u:p@a.com", None]
    assert all(map(urls._crawlable, good)) and not any(map(urls._crawlable, bad))
    assert urls._registrable("https://www.a.b.co.uk/x") == "b.co.uk" and urls._registrable("Shop.Example.com") == "example.com" and urls._registrable("nope") is None


# demand


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("", "ab", 0.0), ("ab cd", "cd ab", 1.0), ("ab cd ef", "ab cd gh", 0.5)])
def test_jaccard(spark, a, b, want):
    assert one(spark, text.jaccard(text.title_tokens(F.lit(a)), text.title_tokens(F.lit(b)))) == want


def test_text_forms(spark):
    assert one(spark, text.normal_text(F.lit("Ｆｕｌｌ  width, see https://x.y/z NOW!"))) == "full width see now"
    assert one(spark, text.fnv1a(F.lit("abc"))) == "1a47e90b" and one(spark, text.fnv1a(F.lit(""))) == "811c9dc5"
    h = 0x811C9DC5
    for unit in (0x61, 0xD83D, 0xDE00):
        h = (h ^ unit) * 0x01000193 % (1 << 32)
    assert one(spark, text.fnv1a(F.lit("a\U0001f600"))) == f"{h:08x}"


OBS = "obs_id string, family_id string, connection_id string, external_id string, url_key string, platform string, title string, hours double, source_class string, geography string, baseline boolean"


def observations(spark, rows):
    df = spark.createDataFrame([(f"o{i}", "f", f"c{i}", f"x{i}", *r) for i, r in enumerate(rows)], OBS)
    at = F.timestamp_micros((F.col("hours") * 3_600_000_000).cast("long"))
    return df.withColumns({"published": at, "collected": at, "tokens": text.title_tokens(F.col("title"))})


TITLE = "aa bb cc dd ee ff gg hh ii jj"


@pytest.mark.parametrize(
    "other, want",
    [
        ((None, "p", TITLE, 72.0), "exact"), ((None, "p", TITLE, 72.01), None), ((None, "q", TITLE, 336.0), "syndicated"), ((None, "q", TITLE, 336.01), None),
        ((None, "p", "aa bb cc dd ee ff gg hh ii", 1.0), "exact"), ((None, "p", "aa bb cc dd ee ff gg hh", 1.0), "semantic"), ((None, "p", "aa bb cc dd ee ff gg", 1.0), "semantic"), ((None, "p", "aa bb cc dd ee ff", 1.0), None),
        ((None, "q", "aa bb cc dd ee ff gg", 1.0), None), (("u", "q", "zz", 9999.0), "canonical"), ((None, "p", TITLE, None), None),
    ],
)
def test_pair_relations(spark, other, want):
    rows = observations(spark, [("u", "p", TITLE, 0.0, "search_observed", "", False), (*other, "search_observed", "", False)])
    got = [r["relation"] for r in demand.duplicate_edges(rows).collect()]
    assert got == ([want] if want else [])


def test_events_do_not_depend_on_order(spark):
    rows = [(None, "p", TITLE, float(i), "search_observed", "g", i == 0) for i in range(5)] + [(None, "p", "something else entirely", 0.0, "generated_candidate", "", True)]
    obs = observations(spark, rows)
    events = lambda df: {(r["event_anchor"], r["raw_count"], r["baseline_only"], tuple(r["geographies"])) for r in demand.evidence_events(df, demand.duplicate_edges(df)).collect()}
    assert events(obs) == events(obs.orderBy(F.desc("obs_id"))) == {("o0", 5, False, ("g",)), ("o5", 1, True, ())}


def test_feed_limit_and_gates(spark):
    row = lambda i, **c: {"family_id": f"f{i}", "project_id": 1, "generated_only": False, "events": 1, "baseline_only": False, "promotable": True, "blocked": False, "priority": 80.0, "confidence": 0.5, "band": "ship_now", "action": "add_faq"} | c
    cases = [row(i) for i in range(6)] + [row(6, generated_only=True, baseline_only=True), row(7, baseline_only=True), row(8, promotable=False, blocked=True), row(9, blocked=True), row(10, priority=44.99), row(11, priority=90.0, band="monitor"), row(12, events=0)]
    got = {r["family_id"]: (r["reason"], r["rank"], r["action"]) for r in demand.select_feed(spark.createDataFrame(cases)).collect()}
    assert got["f11"] == (None, 1, "monitor_only") and got["f0"] == (None, 2, "add_faq") and got["f3"] == (None, 5, "add_faq") and got["f4"] == ("feed_limit", None, None)
    assert [got[f"f{i}"][0] for i in (6, 7, 8, 9, 10, 12)] == ["generated_only_evidence", "baseline_fingerprint_only", "no_promotable_observed_evidence", "compliance_blocked", "below_score_threshold", "generated_only_evidence"]


def test_weights():
    assert abs(sum(demand.POSITIVE.values()) - 1) < 1e-9 and abs(sum(demand.PENALTY.values()) - 1) < 1e-9 and sum(demand.POINTS.values()) == 100


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 9), (9, 7), (4, 4)], "a long, b long")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 5), (7, 5)}
    assert graph.components(edges.limit(0)).count() == 0


# tables and sinks


def test_table_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "id long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(old, new, ["id"], F.col("v"))) == [(1, "a"), (2, "x"), (3, "z")]
    assert rows(tables.insert_or_ignore(old, new, ["id"], F.col("v"))) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(maintenance.repeated_keys(new, ["id"])) == [(3, 2)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", 2.345), (2, None, None)], "a long, b string, c double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    lines = sorted(x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().split("\n") if x)
    assert '"1","\'=1+1","2.35"' in lines and '"a","b","c"' in lines
    assert [r["line"] for r in sinks.text_rows(df).collect()] == ["1 | =1+1 | 2.35", "2 | — | —"]
    sinks.write_json(df, str(tmp_path / "json"))
    assert sinks.read_json(spark, str(tmp_path / "json"), df.schema).count() == 2
