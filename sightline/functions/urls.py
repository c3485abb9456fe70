"""URLs: normal forms, keys, origins, templates and crawl policy.

What needs a parser that re-serialises runs as Arrow-batched Python; the rest is native.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

DEFAULT_PORTS = {"http": 80, "https": 443}
# Query parameters that only track visits.
TRACKING = frozenset(("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"))
# Second-level suffixes under which domains are registered (a subset; there is no network).
SECOND_LEVEL = frozenset(("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "co.za", "com.mx", "com.tr", "com.cn"))
BLOCKED_HOSTS = frozenset(("localhost", "metadata.google.internal", "metadata"))
BLOCKED_SUFFIXES = (".localhost", ".local", ".internal", ".intranet", ".lan", ".home", ".corp")
_SAFE = "%/:=&?~#+!$,;'@()*[]"


def _split(url: str | None):
    """Parts of an absolute http(s) url, or None."""
    try:
        parts = urlsplit((url or "").strip())
        if parts.scheme.lower() not in DEFAULT_PORTS or not parts.hostname:
            return None
        parts.port  # raises for a bad one
        return parts
    except ValueError:
        return None


def _netloc(parts, host: str | None = None) -> str:
    host = host or parts.hostname.lower()
    port = parts.port
    user = parts.netloc.rpartition("@")[0]
    return (f"{user}@" if user else "") + host + (f":{port}" if port and port != DEFAULT_PORTS[parts.scheme.lower()] else "")


def _sorted_query(query: str, drop: frozenset = frozenset()) -> str:
    pairs = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k.lower() not in drop]
    return urlencode(sorted(pairs, key=lambda p: p[0]))


def normalise(url: str | None) -> str | None:
    """http(s) only, host lower-cased, default port and fragment dropped, parameters sorted; the slash stays."""
    parts = _split(url)
    return parts and urlunsplit((parts.scheme.lower(), _netloc(parts), quote(parts.path, _SAFE) or "/", _sorted_query(parts.query), ""))


def key_of(url: str | None) -> str | None:
    """An equality key: https, no ``www.``, sorted parameters, no fragment; what can't be parsed in lower case."""
    if url is None:
        return None
    parts = _split(url)
    if parts is None:
        return url.lower()
    host = re.sub(r"^www\.", "", parts.hostname.lower())
    return urlunsplit(("https", _netloc(parts, host), quote(parts.path, _SAFE) or "/", _sorted_query(parts.query), ""))


def canonical(url: str | None) -> str | None:
    """A comparable form: no fragment and tracking parameters, host lower-cased, no trailing slashes, parameters sorted."""
    if url is None:
        return None
    parts = _split(url)
    if parts is None:
        return url.strip()
    path = re.sub(r"/+$", "", quote(parts.path, _SAFE)) or "/"
    return urlunsplit((parts.scheme.lower(), _netloc(parts), path, _sorted_query(parts.query, TRACKING), ""))


def _same_origin(url: str | None, origin: str | None) -> bool:
    a, b = _split(url), _split(origin)
    if a is None or b is None:
        return False
    bare = lambda p: re.sub(r"^www\.", "", p.hostname.lower())
    if a.hostname.lower() != b.hostname.lower() and bare(a) != bare(b):
        return False
    port = lambda p: p.port or DEFAULT_PORTS[p.scheme.lower()]
    if a.scheme.lower() == b.scheme.lower():
        return port(a) == port(b)
    return (b.scheme.lower(), a.scheme.lower(), port(b), port(a)) == ("http", "https", 80, 443)


def _crawlable(url: str | None) -> bool:
    """http(s) to a public host: no local names, no private, loopback, link-local or reserved addresses, also mapped ones."""
    parts = _split(url)
    if parts is None or parts.username or parts.password:
        return False
    host = parts.hostname.lower().rstrip(".")
    if host in BLOCKED_HOSTS or host.endswith(BLOCKED_SUFFIXES):
        return False
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return "." in host and not re.fullmatch(r"[\d.]+|0x[\da-f]+", host)
    address = getattr(address, "ipv4_mapped", None) or address
    return address.is_global and not address.is_multicast


def _registrable(url: str | None) -> str | None:
    """Host without ``www.`` cut to the registrable domain; null if there is no valid host."""
    text = (url or "").strip().lower()
    parts = _split(text if re.match(r"[a-z][a-z\d+.-]*://", text) else f"https://{text}") if text else None
    host = re.sub(r"^www\.", "", parts.hostname) if parts else ""
    if not re.fullmatch(r"([a-z0-9_]([a-z0-9_-]*[a-z0-9_])?\.)+[a-z]{2,}", host):
        return None
    labels = host.split(".")
    keep = 3 if ".".join(labels[-2:]) in SECOND_LEVEL else 2
    return ".".join(labels[-keep:])


def _safe(url: str | None) -> str | None:
    """The url if it is http(s) without user information, in normal form."""
    parts = _split(url)
    return None if parts is None or parts.username or parts.password else urlunsplit((parts.scheme.lower(), _netloc(parts), parts.path or "/", parts.query, parts.fragment))


@pandas_udf(T.StringType())
def normal_url(urls: pd.Series) -> pd.Series:
    return urls.map(normalise, na_action="ignore")


@pandas_udf(T.StringType())
def canonical_key(urls: pd.Series) -> pd.Series:
    return urls.map(key_of, na_action="ignore")


@pandas_udf(T.StringType())
def canonical_url(urls: pd.Series) -> pd.Series:
    return urls.map(canonical, na_action="ignore")


@pandas_udf(T.BooleanType())
def same_origin(urls: pd.Series, origins: pd.Series) -> pd.Series:
    return pd.Series([_same_origin(a, b) for a, b in zip(urls, origins, strict=True)], dtype=bool)


@pandas_udf(T.BooleanType())
def crawlable(urls: pd.Series) -> pd.Series:
    return pd.Series([_crawlable(u) for u in urls], dtype=bool)


@pandas_udf(T.StringType())
def registrable_domain(urls: pd.Series) -> pd.Series:
    return urls.map(_registrable, na_action="ignore")


@pandas_udf(T.StringType())
def safe_http_url(urls: pd.Series) -> pd.Series:
    return urls.map(_safe, na_action="ignore")


def relative_path(url) -> Column:
    """Path and query of an absolute url, ``/`` if both are empty; null for other texts."""
    c = F.col(url) if isinstance(url, str) else url
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z\d+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z\d+.-]*://"), F.when(path == "", "/").when(path.startswith("?"), F.concat(F.lit("/"), path)).otherwise(path))


def target_kind(c: Column) -> Column:
    """``domain`` if an input looks like a host or url, else ``keyword``."""
    text = F.lower(F.trim(c))
    return F.when(text.rlike(r"^(https?://)?([a-z0-9-]+\.)+[a-z]{2,}(:\d+)?([/?#]\S*)?$"), "domain").otherwise("keyword")


def template(path: Column) -> Column:
    """A path with its variable segments named: ``:id``, ``:uuid``, ``:date``, ``:slug`` (three parts or more)."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    uuid = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    named = F.transform(segments, lambda s: F.when(s.rlike(r"^\d+$"), ":id").when(s.rlike(uuid), ":uuid").when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), ":date").when(F.size(F.split(s, "-")) > 2, ":slug").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(named, "/"))
