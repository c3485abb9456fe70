"""Facts of HTML pages, read in Arrow batches with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.urls import _same_origin, normalise

#: Bytes of pages in an Arrow batch, and of pages whose facts are held at once.
BATCH, PART = 4 << 20, 1 << 20
HIDDEN = frozenset(("script", "style", "noscript", "svg"))
_LINK = T.StructType([T.StructField("target_url", T.StringType()), T.StructField("anchor", T.StringType()), T.StructField("is_internal", T.BooleanType()), T.StructField("is_nofollow", T.BooleanType())])
FACTS = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("title", "meta_description", "canonical_url", "robots_meta", "og_title", "og_description", "og_image")),
        T.StructField("h1s", T.ArrayType(T.StringType())),
        T.StructField("heading_order", T.ArrayType(T.IntegerType())),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("alt", T.StringType())]))),
        T.StructField("links", T.ArrayType(_LINK)),
        T.StructField("has_structured_data", T.BooleanType()),
        T.StructField("hreflang_tags", T.ArrayType(T.StringType())),
    ]
)


class _Reader(HTMLParser):
    """Collects the facts of one page; the first of each meta element counts, links are distinct by target."""

    def __init__(self, url: str | None):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.facts = {f.name: None for f in FACTS.fields} | {"h1s": [], "heading_order": [], "images": [], "hreflang_tags": [], "has_structured_data": False, "meta_description": ""}
        self.links: dict[str, dict] = {}
        self.text: list[str] = []
        self.hidden = 0
        self.open: dict[str, list[str]] = {}
        self.anchor: tuple[dict | None, list[str]] = (None, [])
        self.in_body = self.has_body = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in HIDDEN:
            self.hidden += 1
            self.facts["has_structured_data"] |= tag == "script" and a.get("type") == "application/ld+json"
        elif tag == "body":
            self.in_body = self.has_body = True
        elif tag == "title" and self.facts["title"] is None:
            self.open["title"] = []
        elif tag == "meta":
            for attribute, name, fact in (("name", "description", "meta_description"), ("name", "robots", "robots_meta"), ("property", "og:title", "og_title"), ("property", "og:description", "og_description"), ("property", "og:image", "og_image")):
                if a.get(attribute) == name and not self.facts[fact] and "content" in a:
                    self.facts[fact] = a["content"].strip() if fact == "meta_description" else a["content"]
        elif tag == "link":
            rel = a.get("rel", "")
            if rel == "canonical" and self.facts["canonical_url"] is None:
                self.facts["canonical_url"] = a.get("href")
            elif rel == "alternate" and a.get("hreflang"):
                self.facts["hreflang_tags"].append(a["hreflang"])
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.facts["heading_order"].append(int(tag[1]))
            if tag == "h1":
                self.open["h1"] = []
        elif tag == "img":
            self.facts["images"].append({"src": a.get("src"), "alt": a.get("alt")})
        elif tag == "a" and a.get("href"):
            self._close_anchor()
            href = a["href"]
            target = None if href.startswith(("javascript:", "mailto:", "tel:", "#")) else self._resolve(href)
            if target and target not in self.links:
                self.links[target] = {"target_url": target, "anchor": None, "is_internal": _same_origin(target, self.url), "is_nofollow": "nofollow" in a.get("rel", "").lower().split()}
                self.anchor = (self.links[target], [])

    def _resolve(self, href: str) -> str | None:
        try:
            return normalise(urljoin(self.url or "", href))
        except ValueError:
            return None

    def _close_anchor(self):
        link, words = self.anchor
        if link is not None:
            link["anchor"] = " ".join("".join(words).split())[:200] or None
        self.anchor = (None, [])

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a":
            self._close_anchor()
        elif tag == "title" and "title" in self.open:
            self.facts["title"] = "".join(self.open.pop("title")).strip()
        elif tag == "h1" and "h1" in self.open:
            self.facts["h1s"].append("".join(self.open.pop("h1")).strip())

    def handle_data(self, data):
        for name, parts in self.open.items():
            parts.append(data)
        if self.hidden:
            return
        self.anchor[1].append(data)
        if self.in_body:
            self.text.append(data)

    def result(self) -> dict:
        self.close()
        self._close_anchor()
        for name in ("title", "h1"):
            if name in self.open:
                self.handle_endtag(name)
        body = " ".join("".join(self.text).split())
        return self.facts | {"title": self.facts["title"] or "", "body_text": body, "word_count": len(body.split()), "links": list(self.links.values())}


def page_facts(html: str | None, url: str | None) -> dict:
    reader = _Reader(url)
    reader.feed(html or "")
    return reader.result()


def _parts(batch: pa.RecordBatch, html: str, most: int = PART):
    """Slices of a batch with about ``most`` bytes of pages each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(html)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def analyse_pages(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Replace ``html`` by a struct ``facts``: title, metadata, headings, visible text and words, images, links."""
    kept = [f for f in df.schema.fields if f.name not in (html, "facts")]
    schema = T.StructType([*kept, T.StructField("facts", FACTS)])

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(FACTS)
        for batch in (part for whole in batches for part in _parts(whole, html)):
            facts = [page_facts(h, u) for h, u in zip(batch.column(html).to_pylist(), batch.column(url).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(facts, kind)], names=[*(f.name for f in kept), "facts"])

    # Batches are bounded by rows otherwise, and ten thousand long pages with their facts fill a worker's memory.
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH:
        df.sparkSession.conf.set(key, str(BATCH))
    return df.mapInArrow(read, schema)


def derived_page(df: DataFrame) -> DataFrame:
    """Columns of the page checks from ``facts`` and a header ``x_robots_tag``."""
    f = lambda c: F.col(f"facts.{c}")
    robots = F.lower(F.concat_ws(",", f("robots_meta"), F.col("x_robots_tag")))
    return df.select(
        *(c for c in df.columns if c not in ("facts", "x_robots_tag")),
        f("title").alias("title"), f("meta_description").alias("meta_description"), f("canonical_url").alias("canonical_url"),
        (~robots.contains("noindex")).alias("is_indexable"),
        F.size(F.filter(f("h1s"), lambda x: x != "")).alias("h1_count"), f("heading_order").alias("heading_order"),
        f("word_count").alias("word_count"), F.sha2(f("body_text"), 256).alias("content_hash"),
        F.size(f("images")).alias("images_total"), F.size(F.filter(f("images"), lambda x: x["alt"].isNull())).alias("images_missing_alt"),
        F.size(f("links")).alias("link_count"), f("has_structured_data").alias("has_structured_data"),
    )
