"""Site audit: page checks, cross-page checks, summaries and filters over crawled pages and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expr import all_of, half_up, percent, range_filter, severity_rank
from sightline.sources.staging import Levels, stage

# Thresholds of the page checks.
TITLE_CHARS = (10, 60)
DESCRIPTION_CHARS = (70, 160)
THIN_WORDS, SLOW_MS, DEEP = 150, 1500, 5
# Issue types by severity.
SEVERITIES = {
    "critical": ("blocked-page", "server-error", "broken-internal-link", "missing-title", "ai-crawler-all-search-blocked", "ai-crawler-search-bot-blocked", "ai-crawler-search-bot-wildcard"),
    "warning": ("broken-page", "duplicate-title", "duplicate-meta-description", "duplicate-content", "missing-meta-description", "missing-h1", "multiple-h1", "redirect-chain", "redirect-loop", "canonical-conflict", "thin-content", "images-missing-alt", "orphan-page", "no-outgoing-links", "ai-crawler-no-robots-txt", "ai-crawler-training-bot-blocked", "ai-crawler-user-bot-blocked", "ai-crawler-ads-bot-blocked", "ai-crawler-content-signal-blocked", "ai-crawler-content-signal-conflict", "ai-crawler-aipref-blocked", "ai-crawler-live-search-blocked", "ai-crawler-live-bot-blocked", "ai-crawler-live-content-mismatch"),
    "info": ("title-too-long", "title-too-short", "meta-description-too-long", "meta-description-too-short", "heading-order-skip", "slow-response", "noindex-page", "canonicalized-page", "deep-page", "ai-crawler-search-bot-default", "ai-crawler-content-signal-invalid", "ai-crawler-aipref-invalid", "ai-crawler-live-probe-error"),
}
# Texts of pages that challenge a crawler.
CHALLENGES = ("just a moment...", "challenge-platform", "cf-browser-verification", "attention required! | cloudflare", "verifying you are human")


def registry(spark) -> DataFrame:
    """(issue_type, severity) of all issue types."""
    return spark.createDataFrame([(t, s) for s, types in SEVERITIES.items() for t in types], "issue_type string, severity string")


def fetch_class(status: Column, mitigated: Column, body: Column) -> Column:
    """error, blocked or ok, by status, mitigation header and challenge texts."""
    challenge = F.lit(False)
    for text in CHALLENGES:
        challenge = challenge | F.lower(F.coalesce(body, F.lit(""))).contains(text)
    blocked = F.coalesce(mitigated, F.lit("")).cast("string") != ""
    return F.when(status == 0, "error").when(blocked | status.isin(401, 403, 429) | ((status == 503) & challenge), "blocked").otherwise("ok")


def header_canonical(link: Column) -> Column:
    """The target of a canonical ``Link`` header; null if there is none."""
    return F.nullif(F.regexp_extract(link, r"(?i)<([^>]+)>\s*;[^,]*rel\s*=\s*\"?canonical", 1), F.lit(""))


def heading_skip(order: Column) -> Column:
    """Whether a heading is more than one level below the one before."""
    return F.exists(F.zip_with(order, F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), lambda a, b: b > a + 1), lambda x: F.coalesce(x, F.lit(False)))


def page_issues(pages: DataFrame) -> DataFrame:
    """(id, url, issue_type) of each page's own issues.

    Blocked pages, errors and other statuses than 2xx end the checks early; content is checked on
    HTML only; an empty title or description is a missing one.
    """
    title, text = F.length("title"), F.length("meta_description")
    canonical = F.coalesce("canonical_url", "header_canonical_url")
    ok = (F.col("fetch_class") == "ok") & (F.col("status_code") < 300)
    html = ok & F.col("is_html")
    has_title, has_text = F.coalesce(title > 0, F.lit(False)), F.coalesce(text > 0, F.lit(False))
    skip = heading_skip(F.col("heading_order")) if "heading_order" in pages.columns else F.lit(False)
    fetched = F.col("fetch_class") == "ok"
    checks = {
        "blocked-page": F.col("fetch_class") == "blocked",
        "server-error": fetched & (F.col("status_code") >= 500),
        "broken-page": fetched & F.col("status_code").between(400, 499),
        "slow-response": ok & (F.col("response_ms") > SLOW_MS),
        "missing-title": html & ~has_title,
        "title-too-long": html & (title > TITLE_CHARS[1]),
        "title-too-short": html & has_title & (title < TITLE_CHARS[0]),
        "missing-meta-description": html & ~has_text,
        "meta-description-too-long": html & (text > DESCRIPTION_CHARS[1]),
        "meta-description-too-short": html & has_text & (text < DESCRIPTION_CHARS[0]),
        "missing-h1": html & (F.col("h1_count") == 0),
        "multiple-h1": html & (F.col("h1_count") > 1),
        "heading-order-skip": html & skip,
        "noindex-page": html & ~F.col("is_indexable"),
        "canonical-conflict": html & (F.col("canonical_url") != F.col("header_canonical_url")),
        "canonicalized-page": html & (canonical != F.col("url")),
        "thin-content": html & F.col("is_indexable") & (F.col("word_count") < THIN_WORDS),
        "images-missing-alt": html & (F.col("images_missing_alt") > 0),
        "no-outgoing-links": html & F.col("is_indexable") & (F.col("link_count") == 0),
        "deep-page": html & (F.col("crawl_depth") >= DEEP),
    }
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())), lambda x: x.isNotNull())
    return pages.select("id", "url", F.explode(found).alias("issue_type"))


def duplicate_candidates(pages: DataFrame) -> DataFrame:
    """Indexable 2xx pages that are their own canonical page."""
    canonical = F.nullif(F.coalesce("canonical_url", "header_canonical_url"), F.lit(""))
    return pages.where((F.col("fetch_class") == "ok") & F.col("status_code").between(200, 299) & F.col("is_indexable") & (canonical.isNull() | (canonical == F.col("url"))))


def duplicates(pages: DataFrame, sample: int = 3) -> DataFrame:
    """(audit_id, id, url, issue_type, group_size, other_urls) of pages of an audit that share title, description or content.

    Sizes come from a grouped count, combined before the shuffle; of each group only the first
    ``sample`` + 1 urls are gathered, so that a hot value doesn't fill a task.
    """
    pages = duplicate_candidates(pages)
    group = ["audit_id", "issue_type", "key"]
    keys = {"duplicate-title": F.nullif("title", F.lit("")), "duplicate-meta-description": F.nullif("meta_description", F.lit("")), "duplicate-content": F.when(F.col("word_count") > 0, F.col("content_hash"))}
    long = pages.select("audit_id", "id", "url", F.explode(F.array(*(F.struct(F.lit(t).alias("issue_type"), k.alias("key")) for t, k in keys.items()))).alias("x")).select("audit_id", "id", "url", "x.*").where("key is not null")
    sizes = long.groupBy(group).agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    ranked = long.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("id"))).where(F.col("_k") <= sample + 1)
    firsts = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("id", "url"))).alias("firsts"))
    out = long.join(sizes, group).join(firsts, group)
    others = F.slice(F.transform(F.filter("firsts", lambda x: x["id"] != F.col("id")), lambda x: x["url"]), 1, sample)
    return out.select("audit_id", "id", "url", "issue_type", "group_size", others.alias("other_urls"))


def broken_links(links: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """Internal links to crawled pages that answered 400 or more; pages not crawled are no evidence."""
    broken = pages.where("fetch_class = 'ok' and status_code >= 400").select("audit_id", F.col("url").alias("target_url"), F.col("status_code").alias("target_status"))
    out = links.where("is_internal").join(broken, ["audit_id", "target_url"]).select("audit_id", "source_page_id", "source_url", "target_url", "target_status")
    return out if most is None else out.orderBy("source_page_id", "target_url").limit(most)


def orphans(pages: DataFrame, links: DataFrame, starts: DataFrame | None = None, completed: bool = True) -> DataFrame:
    """Pages of an audit that no other page of it links to and none redirects to; nothing unless the crawl was completed.

    External links make no page reachable. ``starts`` holds (audit_id, url) of start pages, which are none.
    """
    found = pages.where("fetch_class = 'ok' and status_code between 200 and 299").where(F.lit(completed))
    inward = links.where("is_internal").select("audit_id", F.col("target_url").alias("url"), "source_page_id")
    linked = found.alias("p").join(inward.alias("l"), (F.col("p.audit_id") == F.col("l.audit_id")) & (F.col("p.url") == F.col("l.url")) & (F.col("p.id") != F.col("l.source_page_id")), "left_anti")
    known = pages.where("redirect_url is not null").select("audit_id", F.col("redirect_url").alias("url"))
    if starts is not None:
        known = known.unionByName(starts.select("audit_id", "url"))
    return linked.join(known, ["audit_id", "url"], "left_anti")


def redirects(pages: DataFrame) -> DataFrame:
    """(audit_id, url, target, id) of redirecting pages, one row a url: the page of the largest id."""
    found = pages.where("status_code between 300 and 399 and redirect_url <> ''")
    return found.groupBy("audit_id", "url").agg(F.max_by("redirect_url", "id").alias("target"), F.max("id").alias("id"))


def redirect_walks(pages: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(audit_id, id, url, issue_type, hops, final_url) of chains (two redirects or more) and loops of each audit.

    Every redirect points to one target, so walks double their length each round: after k rounds a
    url knows where it is after 2^k hops. It ends when no walk has come to an end in the last round,
    those still open stand on loops, and no smaller url was met. Chains are told from their heads,
    the redirects that no redirect points to; a walk that enters a loop is a loop of its head; a loop
    without head is told once, at its smallest url. Heads' hops are counted, not listed.
    """
    at = ["audit_id", "url"]
    edges = stage(redirects(pages), "redirects")
    heads = edges.join(edges.select("audit_id", F.col("target").alias("url")), at, "left_anti")
    jump = edges.select(*at, F.col("target").alias("to"), F.lit(1).cast("long").alias("hops"), F.least("url", "target").alias("low"))
    seen = None
    for _ in range(max_rounds):
        nxt = jump.select("audit_id", F.col("url").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_h"), F.col("low").alias("_l"))
        longer = jump.join(nxt, ["audit_id", "to"], "left")
        jump = stage(longer.select(*at, F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.least("low", F.coalesce("_l", "low")).alias("low"), F.col("_to").isNotNull().alias("open")), "walk")
        # Targets of open walks are images of images: as many as before means that all of them are on loops.
        going = jump.where("open")
        targets = going.select("audit_id", "to").distinct().count()
        state = (targets, *going.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("audit_id", "url", "low"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("redirect walks have not ended")
    looping = jump.join(edges.select("audit_id", F.col("url").alias("to"), F.lit(True).alias("_at")), ["audit_id", "to"], "left")
    walks = looping.select(*at, "to", "hops", "low", F.col("_at").isNotNull().alias("is_loop"))
    told = heads.select(*at, "id").join(walks, at)
    none = (F.lit(None).cast("long").alias("hops"), F.lit(None).cast("string").alias("final_url"))
    chains = told.where("not is_loop and hops >= 2").select("audit_id", "id", "url", F.lit("redirect-chain").alias("issue_type"), "hops", F.col("to").alias("final_url"))
    head_loops = told.where("is_loop").select("audit_id", "id", "url", F.lit("redirect-loop").alias("issue_type"), *none)
    # Where open walks stand is on a loop; a loop is named by its smallest url.
    on_loop = walks.where("is_loop").select("audit_id", F.col("to").alias("url")).distinct()
    members = on_loop.join(walks.select(*at, "low"), at)
    reached = told.where("is_loop").select("audit_id", F.col("to").alias("url")).join(walks.select(*at, "low"), at).select("audit_id", "low").distinct()
    headless = members.join(reached, ["audit_id", "low"], "left_anti").groupBy("audit_id", "low").agg(F.min("url").alias("url"))
    lonely = headless.join(edges, at).select("audit_id", "id", "url", F.lit("redirect-loop").alias("issue_type"), *none)
    return chains.unionByName(head_loops).unionByName(lonely)


def crawl_depths(start: DataFrame, links: DataFrame, hops: DataFrame | None = None, sitemap: DataFrame | None = None) -> DataFrame:
    """(audit_id, url, depth) of all urls reachable from the start urls of each audit: breadth first, a join per level.

    ``start`` and ``sitemap`` hold (audit_id, url), ``hops`` the redirects (audit_id, url, target): a
    redirect's target has its depth. Urls that only the sitemap has come last, with null depth. Each
    level is written once; all levels are read as one table.
    """
    at = ["audit_id", "url"]
    edges = links.where("is_internal").select("audit_id", F.col("source_url").alias("url"), F.col("target_url").alias("to"))
    start = start.select(at)
    if hops is not None:  # a link or start that redirects counts for every url on the way
        way = redirect_ways(hops)
        edges = edges.unionByName(edges.join(way.withColumnsRenamed({"url": "to", "target": "_t"}), ["audit_id", "to"]).select(*at, F.col("_t").alias("to")))
        start = start.unionByName(start.join(way, at).select("audit_id", F.col("target").alias("url")))
    edges = stage(edges.distinct(), "edges")
    levels, depth = Levels(start.distinct(), "depth"), 0
    while True:
        depth += 1
        fresh = levels.last.join(edges, at).select("audit_id", F.col("to").alias("url")).distinct().join(levels.table(), at, "left_anti")
        if levels.add(fresh, depth).isEmpty():
            break
    found = levels.table()
    if sitemap is not None:
        found = found.unionByName(sitemap.select(at).distinct().join(found, at, "left_anti").withColumn("depth", F.lit(None).cast("int")))
    return found


def redirect_ways(hops: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(audit_id, url, target) of every url that a redirect leads to, one hop or more; the hops double each round."""
    pairs, before = stage(hops.select("audit_id", "url", "target").where("url <> target").distinct(), "ways"), None
    for _ in range(max_rounds):
        n = pairs.count()
        if n == before:
            return pairs
        further = pairs.select("audit_id", F.col("url").alias("target"), F.col("target").alias("_t"))
        longer = pairs.join(further, ["audit_id", "target"]).select("audit_id", "url", F.col("_t").alias("target")).where("url <> target")
        pairs, before = stage(pairs.unionByName(longer).distinct(), "ways"), n
    raise RuntimeError("redirects have not ended")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Distinct pages by issue type and severity."""
    return issues.groupBy("issue_type", "severity").agg(F.countDistinct("id").alias("pages"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts by type, the severe and frequent first."""
    out = issues.groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(severity_rank("severity"), F.desc("n"), "issue_type")


def issue_groups(issues: DataFrame, types: DataFrame) -> DataFrame:
    """Groups by type; the registered severity outweighs a row's own."""
    known = types.select("issue_type", F.col("severity").alias("_s"))
    rows = issues.join(F.broadcast(known), "issue_type", "left").withColumn("severity", F.coalesce("_s", "severity"))
    return rows.groupBy("issue_type").agg(F.min("severity").alias("severity"), F.count(F.lit(1)).alias("n")).orderBy(severity_rank("severity"), F.desc("n"), "issue_type")


def listed_issues(issues: DataFrame, most: int = 200) -> DataFrame:
    return issues.orderBy(severity_rank("severity"), "issue_type", "id").limit(most)


def filter_pages(pages: DataFrame, query: str = "", status: str = "all", words=(None, None), response=(None, None), missing_alt: str = "all") -> DataFrame:
    """Text over url, title and description; status class; ranges that null fails; images without text."""
    s = F.col("status_code")
    classes = {"all": None, "missing": s.isNull(), "ok": s.between(200, 299), "redirect": s.between(300, 399), "error": s >= 400}
    text = F.lower(F.concat_ws(" ", "url", F.nullif("title", F.lit("")), F.nullif("meta_description", F.lit(""))))
    alt = {"all": None, "yes": F.col("images_missing_alt") > 0, "no": F.col("images_missing_alt") <= 0}
    return pages.where(all_of(text.contains(query.strip().lower()) if query.strip() else None, classes[status], range_filter("word_count", *words, nulls="fail"), range_filter("response_ms", *response, nulls="fail"), alt[missing_alt]))


def read_pages(pages: DataFrame, fetch: str | None = None, status: int | None = None, contains: str | None = None, most: int = 100) -> DataFrame:
    """Pages of a fetch class, an exact status and a url part."""
    tests = (None if fetch is None else F.col("fetch_class") == fetch, None if status is None else F.col("status_code") == status, None if contains is None else F.col("url").contains(contains))
    return pages.where(all_of(*tests)).orderBy("id").limit(most)


def is_failure() -> Column:
    """A performance test that broke off or scored nothing."""
    return F.col("error_message").isNotNull() | (F.col("performance_score").isNull() & F.col("seo_score").isNull())


def filter_performance(rows: DataFrame, status: str = "all", device: str = "all", performance=(None, None), seo=(None, None), max_lcp_seconds: float | None = None) -> DataFrame:
    state = {"all": None, "ok": ~is_failure(), "failed": is_failure()}[status]
    lcp = None if max_lcp_seconds is None else F.col("lcp_ms").isNotNull() & (F.col("lcp_ms") / 1000 <= max_lcp_seconds)
    return rows.where(all_of(state, None if device == "all" else F.col("strategy") == device, range_filter("performance_score", *performance, nulls="fail"), range_filter("seo_score", *seo, nulls="fail"), lcp))


def result_stats(pages: DataFrame, tests: DataFrame) -> DataFrame:
    """Mean latency over all pages (null as 0), mean scores of successful tests, failed tests; by audit."""
    latency = pages.groupBy("audit_id").agg(half_up(F.avg(F.coalesce("response_ms", F.lit(0)))).cast("long").alias("mean_ms"), F.count(F.lit(1)).alias("pages"))
    scores = tests.groupBy("audit_id").agg(half_up(F.avg(F.when(~is_failure(), F.col("performance_score")))).cast("long").alias("performance"), F.count(F.when(is_failure(), 1)).alias("failed"))
    return latency.join(scores, "audit_id", "left")


def predominant_host(pages: DataFrame, start_host: str) -> DataFrame:
    """The host of most pages below status 300; the smallest on ties, the start host without pages."""
    counts = pages.where("status_code < 300").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min_by("host", F.struct(-F.col("n"), F.col("host"))).alias("host"))
    return best.select(F.coalesce("host", F.lit(start_host)).alias("host"))


def capacity(pages: DataFrame, tests: DataFrame) -> DataFrame:
    """Pages and tests by audit, and their sum."""
    p = pages.groupBy("audit_id").agg(F.count(F.lit(1)).alias("pages"))
    t = tests.groupBy("audit_id").agg(F.count(F.lit(1)).alias("tests"))
    return p.join(t, "audit_id", "full").select("audit_id", (F.coalesce("pages", F.lit(0)) + F.coalesce("tests", F.lit(0))).alias("used"))


def performance_sample(pages: DataFrame, start_url: str, most: int = 10) -> DataFrame:
    """The start page and the first page, in crawl order, of each url template; 2xx pages only.

    ``pages`` have id, url, key (an equality key) and template.
    """
    from sightline.functions.urls import key_of

    key = key_of(start_url)
    ok = pages.where("status_code between 200 and 299")
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    match = F.when(F.col("key") == key, 0).when(bare(F.col("key")) == bare(F.lit(key)), 1)
    start = ok.withColumn("_m", match).where("_m is not null").orderBy("_m", "id").limit(1).select("id", F.lit(-1).cast("long").alias("place"))
    rest = ok.join(start.select("id"), "id", "left_anti").groupBy("template").agg(F.min("id").alias("id"))
    return start.unionByName(rest.select("id", F.col("id").cast("long").alias("place"))).orderBy("place").limit(most).select("id")


def performance_issues(audits: DataFrame) -> DataFrame:
    """Issues of performance reports: not passed, not numeric, not diagnostic; severity by savings and score.

    ``audits`` have category, audit_key, score (0 to 1), mode, savings_ms and savings_bytes.
    """
    # Audits that only inform.
    diagnostic = ("largest-contentful-paint-element", "layout-shifts", "diagnostics", "metrics", "network-requests", "network-rtt", "network-server-latency", "main-thread-tasks", "screenshot-thumbnails", "final-screenshot", "script-treemap-data", "resource-summary")
    rows = audits.withColumn("score", percent("score"))
    mode = F.coalesce("mode", F.lit(""))
    rows = rows.where(~mode.isin("numeric", "notApplicable", "informative", "manual", "error") & ~F.col("audit_key").isin(*diagnostic) & (F.col("score") < 90))
    ms, size = F.coalesce("savings_ms", F.lit(0)), F.coalesce("savings_bytes", F.lit(0))
    severity = F.when((ms >= 300) | (size >= 150_000) | (F.col("score") < 50), "critical").otherwise("warning")
    return rows.withColumn("severity", severity)


def performance_order(issues: DataFrame) -> DataFrame:
    impact = F.coalesce("savings_ms", F.lit(0)) * 1000 + F.coalesce("savings_bytes", F.lit(0))
    return issues.orderBy(impact.desc(), F.coalesce("score", F.lit(100)), "audit_key")


def category_counts(issues: DataFrame, categories: list[str]) -> DataFrame:
    """Counts by category of a fixed list and severity."""
    listed = issues.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    # Counted before the join: the few categories would otherwise bring all issues into one task each.
    counts = issues.groupBy("category").agg(count("critical"), count("warning"), count("info"))
    return listed.join(counts, "category", "left").na.fill(0, ["critical", "warning", "info"])
