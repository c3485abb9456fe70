"""Operator 7: line dedup by site-relative frequency, in DataFrame functions only.

Per host, the pages that hold a line are counted and divided by the pages of the host; lines over a
boilerplate ratio are dropped. The ratio decides on hosts of every size: a line must only be on
``MIN_PAGES`` = 2 pages, since a line on one page is no repetition. Pages of equal text count as one, in
both counts, so that copies of a page don't make its own lines boilerplate.

Counting is exact and cheap in two steps: first over 64-bit hashes of the distinct lines of each page
(partial counts before the shuffle, so neither a hot host nor a hot line reaches one task), equal pages
included, which bounds the count from above and leaves few candidate hashes; then over the candidates'
text and the distinct contents. The lines of a host that exceed a ratio r number at most its mean
distinct lines per page / r, so a host's list is short; the lists are written to the shared folder and
measured, and joined to the pages by host: by broadcast up to ``MAX_BROADCAST`` characters, so that texts
are not shuffled, else by a shuffle join whose hot hosts AQE splits. A page's distinct lines are
intersected with its host's list once (by hashing); lines are filtered by what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import stage_table

RATIO = 0.02
#: Characters of all lists that may be broadcast.
MAX_BROADCAST = 16_000_000
MIN_PAGES = 2


def boilerplate_lines(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, host_pages) of the lines on more than ``ratio`` of a host's pages and on ``min_pages``.

    Pages are distinct texts. A page counts once for a line however often it repeats it. Lines are compared
    after trimming spaces, tabs and carriage returns; blank lines are never boilerplate. Null hosts form
    one host; null texts are one page without lines.
    """
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("text"), content(text).alias("content"))
    totals = pages.groupBy("host").agg(F.count_distinct("content").alias("host_pages"))
    lines = pages.select("host", "content", F.explode(distinct_lines("text")).alias("line"))
    over = (F.col("pages") >= min_pages) & (F.col("pages") > F.lit(ratio) * F.col("host_pages"))
    hashes = lines.groupBy("host", F.xxhash64("line").alias("hash")).agg(F.count(F.lit(1)).alias("pages"))
    hashes = hashes.where(F.col("pages") >= min_pages).join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(over)
    hashes = hashes.select(F.col("host").alias("h"), "hash", "host_pages")
    exact = lines.join(hashes, F.col("host").eqNullSafe(F.col("h")) & (F.xxhash64("line") == F.col("hash")))
    return exact.groupBy("host", "line").agg(F.count_distinct("content").alias("pages"), F.max("host_pages").alias("host_pages")).where(over)


def content(text: str):
    return F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("-"))


def trimmed(line):
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def distinct_lines(text: str):
    """The distinct trimmed lines of a text without blank ones; none for null."""
    return F.filter(F.array_distinct(F.transform(F.split(F.col(text), "\n"), trimmed)), lambda x: x != "")


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, n_lines: str = "n_lines", n_dropped: str = "n_dropped", near_copies: bool = False) -> DataFrame:
    """Replace ``text`` by its lines that are not boilerplate of its host, and count both.

    Every row is kept. Other lines stay as they are and in order, joined by newlines; a text without
    boilerplate is unchanged; a text of boilerplate only becomes empty; null stays null, with no
    lines. Columns of ``df`` named like the new ones are replaced. With ``near_copies``, pages that are
    verified as near copies (see ``copies``) count as one page too, for every line and every text: what is
    frequent by near copies only is a matter for near-duplicate removal.
    """
    df = df.drop(n_lines, n_dropped)
    found = boilerplate_lines(df, host, text, ratio, min_pages)
    if near_copies:
        found = stage_table(found, "boilerplate-lines")
        joined = df.join(_lists(found), F.col(host).eqNullSafe(F.col("__host")))
        suspects = joined.select(F.col(host).alias("host"), F.col(text).alias("text"), F.array_intersect(distinct_lines(text), "__drop").alias("dropped"))
        own = lines_of_copies(copies(suspects.where(F.size("dropped") > 0)), found, ratio, min_pages)
        own = own.select(F.col("host").alias("h"), F.col("line").alias("l"))
        found = found.join(own, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left_anti")
    joined = df.join(_lists(found), F.col(host).eqNullSafe(F.col("__host")), "left")
    lines = F.split(F.col(text), "\n")
    joined = joined.withColumn("__held", F.array_intersect(distinct_lines(text), "__drop"))
    kept = F.when(F.coalesce(F.size("__held"), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("__held"), trimmed(x))))
    joined = joined.withColumn("__kept", kept)
    size = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    columns = [F.when(F.size("__kept") == F.size(lines), F.col(text)).otherwise(F.array_join("__kept", "\n")).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*columns, F.when(F.col(text).isNull(), F.lit(0)).otherwise(size).cast("long").alias(n_lines), F.when(F.col(text).isNull(), F.lit(0)).otherwise(size - F.size("__kept")).cast("long").alias(n_dropped))


def _lists(found: DataFrame) -> DataFrame:
    """(__host, __drop): the lines of each host, measured."""
    listed = found.groupBy(F.col("host").alias("__host")).agg(F.sort_array(F.collect_list("line")).alias("__drop"))
    return measured(stage_table(listed, "boilerplate"), "__drop")


def measured(lists: DataFrame, column: str) -> DataFrame:
    """Lists of lines, to be broadcast if all of them hold at most ``MAX_BROADCAST`` characters."""
    size = lists.agg(F.coalesce(F.sum(F.length(F.array_join(column, "\n"))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(lists) if size <= MAX_BROADCAST else lists


def words_of(text):
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return F.filter(F.split(F.translate(text, upper, lower), r"[ \t-\r]+"), lambda x: x != "")


def shingles(text):
    """The distinct word 5-grams of a text, hashed; of fewer words, the whole sequence is one."""
    def grams(words):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 5)))

    # The array of one element binds the words: a lambda evaluates what it captures for each of its elements.
    return F.array_distinct(F.transform(F.array(words_of(text)), grams)[0])


def copies(suspects: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(host, key, text, class): the distinct texts that share a class with another text of the host.

    ``suspects`` have host, text and dropped (the listed lines in it). Texts of a host meet where their
    longest dropped line is the same, or the one of the least hash; a class holds those whose word 5-grams
    reach a similarity of 0.8 with the first text that they meet. One comparison a text and line, whatever
    the size of the group.
    """
    texts = suspects.groupBy("host", F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.first("dropped").alias("dropped"))
    longest = F.array_max(F.transform("dropped", lambda x: F.struct(F.length(x).cast("long").alias("o"), x.alias("line"))))["line"]
    least = F.array_min(F.transform("dropped", lambda x: F.struct(F.xxhash64(x).alias("o"), x.alias("line"))))["line"]
    # Shingles are made once a text and written, as the plans below name them several times.
    texts = stage_table(texts.select("host", "key", "text", F.array_distinct(F.array(longest, least)).alias("lines"), shingles(F.col("text")).alias("grams")), "suspects")
    keyed = texts.select("host", "key", F.explode("lines").alias("line"))
    first = keyed.groupBy(F.col("host").alias("h"), F.col("line").alias("l")).agg(F.min("key").alias("root"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = keyed.join(first, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).where("key <> root")
    met = stage_table(met.select("host", "key", "root").distinct(), "suspect-pairs")
    side = lambda name, grams: texts.select(F.col("host").alias(f"h_{name}"), F.col("key").alias(f"k_{name}"), F.col("grams").alias(grams))
    sets = met.join(side("own", "x"), F.col("host").eqNullSafe(F.col("h_own")) & (F.col("key") == F.col("k_own"))).join(side("root", "y"), F.col("host").eqNullSafe(F.col("h_root")) & (F.col("root") == F.col("k_root")))
    sizes = sets.select("host", "key", "root", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    linked = stage_table(sizes.where(F.lit(den) * F.col("common") >= F.lit(num) * (F.col("n") + F.col("m") - F.col("common"))).select("host", "key", "root"), "suspect-links")
    classes = linked.unionByName(linked.select("host", F.col("root").alias("key"), "root")).groupBy(F.col("host").alias("h"), F.col("key").alias("k")).agg(F.min("root").alias("root"))
    joined = texts.select("host", "key", "text").join(classes, F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col("k")))
    return stage_table(joined.select("host", "key", "text", F.col("root").alias("class")), "copies")


def lines_of_copies(copied: DataFrame, found: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, line) of the boilerplate ``found`` that is none if each class of ``copied`` counts as one page."""
    line = copied.select("host", "class", F.explode(distinct_lines("text")).alias("line"))
    surplus = lambda df, *by: df.groupBy("host", "class", *by).agg((F.count(F.lit(1)) - 1).alias("more")).groupBy("host", *by).agg(F.sum("more").alias("more"))
    fewer = surplus(line, "line").select(F.col("host").alias("h"), F.col("line").alias("l"), "more")
    total = surplus(copied).select(F.col("host").alias("t"), F.col("more").alias("fewer"))
    counted = found.join(fewer, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).join(total, F.col("host").eqNullSafe(F.col("t")))
    pages, host_pages = F.col("pages") - F.col("more"), F.col("host_pages") - F.col("fewer")
    return counted.where((pages < min_pages) | (pages <= F.lit(ratio) * host_pages)).select("host", "line")


def oracle_sql(table: str = "documents", doc_id: str = "doc_id", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL for the rows of the registered query."""
    trim = r"regexp_replace({0}, '^[ \t\r]+|[ \t\r]+$', '', 'g')"
    return f"""
WITH pages AS (SELECT row_number() OVER () AS r, {doc_id} AS doc_id, {host} AS host, text, coalesce(md5(text), '-') AS content FROM {table}),
lines AS (SELECT r, doc_id, host, content, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM pages),
trimmed AS (SELECT *, {trim.format("line")} AS t FROM lines),
totals AS (SELECT host, count(DISTINCT content) AS n FROM pages GROUP BY host),
counts AS (SELECT host, t, count(DISTINCT content) AS c FROM trimmed WHERE t <> '' GROUP BY host, t),
boiler AS (SELECT c.host, c.t FROM counts c JOIN totals o ON c.host IS NOT DISTINCT FROM o.host WHERE c.c >= {min_pages} AND c.c > CAST({ratio} AS DOUBLE) * o.n),
marked AS (SELECT m.*, b.t IS NOT NULL AS dropped FROM trimmed m LEFT JOIN boiler b ON m.host IS NOT DISTINCT FROM b.host AND m.t = b.t),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS text FROM marked GROUP BY r)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped
FROM pages p LEFT JOIN kept k USING (r)"""
