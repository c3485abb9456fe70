"""Keyword research and saved keywords: filters, joins, tags, paging, merging of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expr import all_of, intent, normal_keyword, range_filter, split_terms, text_filter

MARKET = ["project_id", "keyword", "location_code"]


def with_metrics(saved: DataFrame, metrics: DataFrame) -> DataFrame:
    """Saved keywords with their metrics where there are any."""
    return saved.join(metrics, MARKET, "left")


def saved_predicate(search: str = "", include: str = "", exclude: str = "", volume=(None, None), cpc=(None, None), difficulty=(None, None)) -> Column:
    """All include terms, no exclude term, SQL semantics for null metrics."""
    terms = split_terms(include) + ([search.strip().lower()] if search.strip() else [])
    return all_of(text_filter("keyword", terms, split_terms(exclude), "all"), range_filter("search_volume", *volume), range_filter("cpc", *cpc), range_filter("difficulty", *difficulty))


def having_tags(keywords: DataFrame, assignments: DataFrame, tag_ids: list[str]) -> DataFrame:
    """Keywords that carry one of the tags (semi-join)."""
    wanted = assignments.where(F.col("tag_id").isin(tag_ids)).select(F.col("keyword_id").alias("id"))
    return keywords.join(wanted, "id", "left_semi")


def research_filter(rows: DataFrame, include: str = "", exclude: str = "", intents: list[str] | None = None, volume=(None, None), cpc=(None, None), difficulty=(None, None)) -> DataFrame:
    """Research filter: all include terms, null metrics as 0."""
    zero = lambda c, bounds: range_filter(c, *bounds, nulls="zero")
    return rows.where(all_of(text_filter("keyword", split_terms(include), split_terms(exclude), "all"), F.col("intent").isin(intents) if intents else None, zero("search_volume", volume), zero("cpc", cpc), zero("difficulty", difficulty)))


def sorted_by(rows: DataFrame, fields: dict[str, str], field: str, descending: bool, *ties: str, null_value=None) -> DataFrame:
    """Sort by a field of a whitelist, then by the tie-break columns.

    Nulls are first ascending and last descending, or count as ``null_value``.
    """
    if field not in fields:
        raise ValueError(f"field: one of {sorted(fields)}, not {field!r}")
    key = F.col(fields[field]) if null_value is None else F.coalesce(F.col(fields[field]), F.lit(null_value))
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), *ties)


def page_of(rows: DataFrame, page: int, size: int) -> DataFrame:
    """One page of sorted rows, counted from 1."""
    return rows.offset((page - 1) * size).limit(size)


def has_more(fetched: int, page: int, size: int, total: int | None) -> bool:
    """Whether a further page exists: by the total if known, else if the page is full."""
    return page * size < total if total is not None else fetched >= size


def probe_page(rows: DataFrame, page: int, size: int) -> DataFrame:
    """A page and one row more, which tells whether another page follows; the extra row is marked."""
    taken = rows.offset((page - 1) * size).limit(size + 1)
    return taken.withColumn("_n", F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).withColumn("is_probe", F.col("_n") > size).drop("_n")


def tag_usage(tags: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each tag with its number of keywords, unused ones with 0."""
    return tags.join(assignments, "tag_id", "left").groupBy("tag_id", "name").agg(F.count("keyword_id").alias("uses"))


def tag_lists(tags: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each keyword's tag names in order."""
    joined = assignments.join(tags, "tag_id")
    return joined.groupBy("keyword_id").agg(F.sort_array(F.collect_set("name")).alias("names"))


def removable_tags(tags: DataFrame, assignments: DataFrame, wanted: list[str]) -> DataFrame:
    """Of the tags asked for, those not in use, which alone may be deleted."""
    return tags.where(F.col("tag_id").isin(wanted)).join(assignments, "tag_id", "left_anti")


def tags_to_remove(assignments: DataFrame, keyword_ids: list[int], keep: list[str]) -> DataFrame:
    """Assignments of the keywords whose tag is not in the keep list (set difference)."""
    return assignments.where(F.col("keyword_id").isin(keyword_ids) & ~F.col("tag_id").isin(keep))


def first_of(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key by an ordinal: distinct that keeps first occurrences."""
    window = Window.partitionBy(key).orderBy(ordinal)
    return rows.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")


def accumulate_sources(rows: DataFrame, seed: str, enough: int = 5, most: int = 100) -> DataFrame:
    """Keywords of sources in order, each source taken while those before held fewer than ``enough`` new ones.

    ``rows`` have source_no, ordinal and keyword. First occurrences win; the seed doesn't count.
    """
    firsts = first_of(rows.withColumn("keyword", normal_keyword("keyword")).withColumn("_o", F.struct("source_no", "ordinal")), "keyword", "_o").drop("_o")
    counts = firsts.groupBy("source_no").agg(F.count(F.when(F.col("keyword") != seed, 1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = counts.withColumn("before", before).where(F.col("before") < enough).select("source_no")
    return firsts.join(F.broadcast(used), "source_no").orderBy("source_no", "ordinal").limit(most)


def payload_rows(items: DataFrame) -> DataFrame:
    """Provider items to keyword rows: clickstream volume preferred, text normalised, first occurrence kept."""
    flat = items.select("ordinal", normal_keyword("keyword").alias("keyword"), F.coalesce("clickstream.search_volume", "info.search_volume").alias("search_volume"), F.coalesce("clickstream.cpc", "info.cpc").alias("cpc"), (F.col("info.competition_index") / 100).alias("competition"), intent("info.intent").alias("intent"))
    return first_of(flat.where("keyword <> ''"), "keyword", "ordinal")


def merge_local(national: DataFrame, local: DataFrame) -> DataFrame:
    """National rows with local volume and cost; keywords that local alone lacks keep null volume, local-only ones are appended."""
    n = national.select(F.lower("keyword").alias("k"), F.col("keyword").alias("n_keyword"), "difficulty", "intent")
    near = local.select(F.lower("keyword").alias("k"), F.col("keyword").alias("l_keyword"), "search_volume", "cpc")
    both = n.join(near, "k", "left").select(F.col("n_keyword").alias("keyword"), "search_volume", "cpc", "difficulty", "intent")
    extra = near.join(n.select("k"), "k", "left_anti").select(F.col("l_keyword").alias("keyword"), "search_volume", "cpc", F.lit(None).cast("int").alias("difficulty"), F.lit(None).cast("string").alias("intent"))
    return both.unionByName(extra)


def refreshed(saved: DataFrame, fetched: DataFrame) -> DataFrame:
    """Saved rows of (location) groups with fetched metrics by lower-case keyword; unmatched ones are left out."""
    right = fetched.select("location_code", F.lower("keyword").alias("_k"), "search_volume", "cpc", "difficulty")
    return saved.withColumn("_k", F.lower("keyword")).join(right, ["location_code", "_k"]).select("id", "keyword", "location_code", "search_volume", "cpc", "difficulty")


def trend_points(rows: DataFrame, trend: str = "trend", last: int = 12) -> DataFrame:
    """The last points of a monthly trend (array of year, month, volume) in order of time."""
    ordered = F.array_sort(F.transform(trend, lambda p: F.struct((p["year"] * 100 + p["month"]).alias("at"), p["volume"].alias("volume"))))
    return rows.withColumn(trend, F.slice(ordered, F.greatest(F.size(ordered) - last + 1, F.lit(1)), last))


def api_conditions(include: str = "", exclude: str = "", ranges: dict | None = None, search: str = "", field: str = "keyword", url: str | None = None, most: int = 8, mode: str = "all") -> Column:
    """A remote filter as a predicate: term and range conditions, each term and bound costing one of ``most``.

    ``search`` matches the field or the url. Raises if there are more conditions.
    """
    wanted, unwanted = split_terms(include), split_terms(exclude)
    bounds = [(c, low, high) for c, (low, high) in (ranges or {}).items()]
    used = len(wanted) + len(unwanted) + sum((low is not None) + (high is not None) for _, low, high in bounds) + (bool(search.strip()) * (2 if url else 1))
    if used > most:
        raise ValueError(f"{used} filter conditions; at most {most} are allowed")
    tests = [text_filter(field, wanted, unwanted, mode), *(range_filter(c, low, high) for c, low, high in bounds)]
    if search.strip():
        needle = search.strip().lower()
        hit = F.lower(F.col(field)).contains(needle)
        tests.append(hit | F.lower(F.col(url)).contains(needle) if url else hit)
    return all_of(*tests)


def clamped_filters(values: dict[str, str]) -> dict[str, float | int]:
    """Numbers of a saved-keyword form: volumes at least 0, difficulties within 0 to 100, whole numbers truncated; blanks left out."""
    out: dict[str, float | int] = {}
    for name, raw in values.items():
        try:
            number = float(raw)
        except (TypeError, ValueError):
            continue
        if "volume" in name:
            out[name] = max(0, int(number))
        elif "difficulty" in name:
            out[name] = min(100, max(0, int(number)))
        else:
            out[name] = max(0.0, number)
    return out


def active_filters(values: dict[str, str], term_fields: tuple[str, ...] = ("include", "exclude")) -> int:
    """How many conditions a form holds: each term counts one, each other filled field one."""
    return sum(len(split_terms(v)) if k in term_fields else bool(str(v or "").strip()) for k, v in values.items())
