"""Crawler policy: robots groups, content signals and usage preferences, read in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# AI crawlers and what each fetches for.
BOTS = {
    "OAI-SearchBot": "search", "Claude-SearchBot": "search", "PerplexityBot": "search",
    "GPTBot": "training", "ClaudeBot": "training", "Google-Extended": "training",
    "ChatGPT-User": "user", "Claude-User": "user", "Perplexity-User": "user", "OAI-AdsBot": "ads",
}
PURPOSES = ("search", "training", "user", "ads")
SIGNALS = ("search", "ai-input", "ai-train")
PREFERENCE_LABELS = ("content-usage", "aipref", "ai-preference", "ai-preferences")
MAX_BYTES = 500 * 1024
POLICY = T.StructType(
    [
        T.StructField("bots", T.MapType(T.StringType(), T.StringType())),
        T.StructField("signals", T.MapType(T.StringType(), T.StringType())),
        T.StructField("preference_state", T.StringType()),
        T.StructField("preferences", T.MapType(T.StringType(), T.StringType())),
        T.StructField("extensions", T.MapType(T.StringType(), T.StringType())),
        T.StructField("truncated", T.BooleanType()),
    ]
)


def _records(text: str):
    """(label, value) of each line, comments and blank lines left out."""
    for line in re.split(r"\r\n|\r|\n", text):
        label, colon, value = line.split("#", 1)[0].partition(":")
        if colon:
            yield label.strip().lower(), value.strip()


def groups_of(text: str) -> list[tuple[list[str], list[tuple[bool, str]]]]:
    """(agents, rules) of each group; a rule is (allow, path); user-agent lines after any other begin a new group."""
    out: list[tuple[list[str], list[tuple[bool, str]]]] = []
    closed = True
    for label, value in _records(text):
        if label == "user-agent":
            if closed:
                out.append(([], []))
                closed = False
            if value:
                out[-1][0].append(value.lower())
        elif out and out[-1][0]:
            closed = True
            if label in ("allow", "disallow") and value:
                out[-1][1].append((label == "allow", value))
    return [g for g in out if g[0]]


def _fits_root(path: str) -> bool:
    body, end = (path[:-1], "$") if path.endswith("$") else (path, "")
    return re.match("^" + ".*".join(re.escape(p) for p in body.split("*")) + end, "/") is not None


def _weight(path: str) -> int:
    return len(re.sub(r"\$$", "", path.replace("*", "")))


def bot_statuses(text: str | None) -> dict[str, str]:
    """Status of each bot at the root: an own group outweighs the wildcard's, the longest rule decides, allow wins ties."""
    if text is None:
        return dict.fromkeys(BOTS, "no_robots_txt")
    groups, out = groups_of(text), {}
    for bot in BOTS:
        own = [g for g in groups if bot.lower() in g[0]]
        rules = [r for g in own or [g for g in groups if "*" in g[0]] for r in g[1] if _fits_root(r[1])]
        top = max((_weight(p) for _, p in rules), default=None)
        allowed = any(a for a, p in rules if _weight(p) == top)
        out[bot] = "not_mentioned" if not rules else "allowed" if allowed else "blocked" if own else "blocked_by_wildcard"
    return out


def content_signals(text: str | None) -> dict[str, str]:
    """State of each signal: unspecified, allowed, blocked, invalid, conflict, or unavailable without text."""
    if text is None:
        return dict.fromkeys(SIGNALS, "unavailable")
    said: dict[str, list[str]] = {k: [] for k in SIGNALS}
    for label, value in _records(text):
        for item in value.split(",") if label == "content-signal" else ():
            key, equals, setting = item.partition("=")
            if equals and key.strip().lower() in said:
                said[key.strip().lower()].append(setting.strip().lower())
    state = lambda v: "unspecified" if not v else "invalid" if set(v) - {"yes", "no"} else "conflict" if len(set(v)) > 1 else "allowed" if v[0] == "yes" else "blocked"
    return {k: state(v) for k, v in said.items()}


def usage_preferences(text: str | None) -> tuple[str, dict[str, str], dict[str, str]]:
    """(state, preferences, extensions) of statements for all agents and the root path; contradictions stay conflicts."""
    if text is None:
        return "unavailable", {}, {}
    statements, agents, members = [], [], False
    for raw, value in _records(text):
        label = raw.replace("_", "-")
        if label == "user-agent":
            if members:
                agents, members = [], False
            if value:
                agents.append(value.lower())
        elif label in ("allow", "disallow"):
            members = True
        elif label in PREFERENCE_LABELS or label.startswith("aipref-"):
            members = True
            if not agents or "*" in agents:
                statements.append(value)
    wanted: dict[str, str] = {}
    extensions: dict[str, str] = {}
    bad = False
    for statement in statements:
        if statement.startswith("/"):
            path, *rest = re.split(r"\s", statement, maxsplit=1)
            statement = rest[0] if rest else ""
            if path != "/":
                continue
        for item in statement.split(","):
            key, equals, value = item.partition("=")
            key, value = key.strip(), value.split(";", 1)[0].strip()
            if not equals or not key:
                bad = True
            elif key in ("train-ai", "search"):
                now = {"y": "allowed", "n": "disallowed"}.get(value, "unknown")
                wanted[key] = now if wanted.get(key, now) == now else "conflict"
            else:
                extensions[key] = value
    return "invalid" if bad else "measured" if statements else "unspecified", wanted, extensions


def capped(text: str, limit: int = MAX_BYTES) -> tuple[str, bool]:
    """At most ``limit`` bytes of UTF-8, cut at the last line's end, and whether anything was cut."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= limit:
        return text, False
    part = data[:limit].decode("utf-8", "ignore")
    return part[: max(part.rfind("\n"), part.rfind("\r"), 0)], True


@pandas_udf(POLICY)
def _policy(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        text, cut = (None, False) if text is None else capped(text)
        state, wanted, extensions = usage_preferences(text)
        rows.append((bot_statuses(text), content_signals(text), state, wanted, extensions, cut))
    return pd.DataFrame(rows, columns=[f.name for f in POLICY.fields])


def _purpose_state(purpose: str) -> Column:
    own = F.array(*(F.col("bots")[b] for b, p in BOTS.items() if p == purpose))
    blocked = F.size(F.filter(own, lambda s: s.contains("blocked")))
    return F.when(F.forall(own, lambda s: s == "no_robots_txt"), "unavailable").when(blocked == F.size(own), "blocked").when(blocked > 0, "mixed").otherwise("allowed_or_unspecified")


def policies(robots: DataFrame, text: str = "text") -> DataFrame:
    """Bot statuses, signals, preferences, a state per purpose, and whether the policy is degraded."""
    out = robots.withColumn("_p", _policy(text)).select("*", "_p.*").drop("_p", text)
    odd = F.exists(F.map_values("signals"), lambda s: s.isin("conflict", "invalid"))
    return out.withColumns({p: _purpose_state(p) for p in PURPOSES}).withColumn("degraded", F.col("truncated") | odd | (F.col("preference_state") == "invalid"))


def findings(policy: DataFrame) -> DataFrame:
    """(id, issue_type, subject) of a policy: by bot and purpose, by signal, by preference."""
    purpose = F.create_map(*(F.lit(x) for pair in BOTS.items() for x in pair))
    bots = policy.select("id", "search", F.explode("bots").alias("subject", "status")).withColumn("purpose", purpose[F.col("subject")])
    is_search = F.col("purpose") == "search"
    kind = (
        F.when(F.col("status") == "no_robots_txt", F.lit(None))
        .when(is_search & (F.col("status") == "blocked"), "ai-crawler-search-bot-blocked")
        .when(is_search & (F.col("status") == "blocked_by_wildcard"), "ai-crawler-search-bot-wildcard")
        .when(is_search & (F.col("status") == "not_mentioned"), "ai-crawler-search-bot-default")
        .when(F.col("status").contains("blocked"), F.concat(F.lit("ai-crawler-"), F.col("purpose"), F.lit("-bot-blocked")))
    )
    missing = policy.where("search = 'unavailable'").select("id", F.lit("ai-crawler-no-robots-txt").alias("issue_type"), F.lit("robots.txt").alias("subject"))
    every = policy.where("search = 'blocked'").select("id", F.lit("ai-crawler-all-search-blocked").alias("issue_type"), F.lit("search").alias("subject"))
    signals = policy.select("id", F.explode("signals").alias("subject", "status")).where("status in ('blocked', 'conflict', 'invalid')").select("id", F.concat(F.lit("ai-crawler-content-signal-"), "status").alias("issue_type"), "subject")
    wanted = policy.select("id", F.explode("preferences").alias("subject", "status")).where("status = 'disallowed'").select("id", F.lit("ai-crawler-aipref-blocked").alias("issue_type"), "subject")
    invalid = policy.where("preference_state = 'invalid'").select("id", F.lit("ai-crawler-aipref-invalid").alias("issue_type"), F.lit("preferences").alias("subject"))
    out = bots.select("id", kind.alias("issue_type"), "subject").where("issue_type is not null")
    for part in (missing, every, signals, wanted, invalid):
        out = out.unionByName(part)
    return out


def live_issues(probes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Issues of live probes: nothing is compared if the baseline was bad; blocked ones; contents below half of the baseline's."""
    mismatch = ~F.col("truncated") & (F.col("baseline_length") > 0) & (F.coalesce("length", F.lit(0)) < F.col("baseline_length") * threshold)
    kind = (
        F.when(~F.col("baseline_ok") | F.col("error").isNotNull(), "ai-crawler-live-probe-error")
        .when(F.col("blocked"), F.when(F.col("purpose") == "search", "ai-crawler-live-search-blocked").otherwise("ai-crawler-live-bot-blocked"))
        .when(mismatch, "ai-crawler-live-content-mismatch")
    )
    return probes.withColumn("issue_type", kind).where("issue_type is not null")
