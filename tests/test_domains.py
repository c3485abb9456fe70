"""Address ranges, public-suffix rules and many definitions against plain Python."""

import ipaddress
import random

from pyspark.sql import functions as F

from sightline.functions import addresses
from sightline.operators import definitions, domains

NETS = [ipaddress.ip_network(x) for x in (*addresses.BLOCKED_V4, "fc00::/7", "fe80::/10", "::/127")]


def blocked(host):
    try:
        a = ipaddress.ip_address(host.strip("[]").split("%")[0].rstrip("."))
    except ValueError:
        return None
    a = getattr(a, "ipv4_mapped", None) or a
    return any(a in n for n in NETS if n.version == a.version)


def test_addresses_equal_ipaddress(spark):
    rnd = random.Random(1)
    edges = [int(e) for n in NETS if n.version == 4 for e in (n[0], n[-1])]
    v4 = [str(ipaddress.IPv4Address(max(0, min(2**32 - 1, e + d)))) for e in edges for d in (-1, 0, 1)]
    v6 = [ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.choice([2**128 - 1, 0xFFFF, 2**64 - 1, (2**16 - 1) << 112])) for _ in range(60)]
    hosts = v4 + [f"[::ffff:{x}]" for x in v4] + [f"[{x}]" for x in v6] + [x.exploded.upper() for x in v6] + ["fe80::1%eth0", "[::]", "::1", "::2", "fdff::", "1.2.3", "1.2.3.256", "example.com", "", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "12345::", ":1:2:3:4:5:6:7", "a.b.c.d"]
    df = spark.createDataFrame(list(enumerate(hosts)), "i int, host string")
    got = {r["host"]: r["b"] for r in df.select("host", addresses.blocked_address(F.col("host")).alias("b")).collect()}
    assert got == {h: blocked(h) for h in hosts}
    assert spark.createDataFrame([(None,)], "host string").select(addresses.blocked_address(F.col("host"))).first()[0] is None


def test_suffix_rules(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "co.uk", "*.ck", "!www.ck", "uk", None, "co.uk")], "rule string")
    cases = {"a.b.com": "b.com", "com": None, "x.co.uk": "x.co.uk", "co.uk": None, "y.x.co.uk.": "x.co.uk", "other.uk": "other.uk", "ck": None, "any.ck": None, "a.any.ck": "a.any.ck", "www.ck": "www.ck", "z.www.ck": "www.ck", "A.Unknown.ZZ": "unknown.zz", "": None, None: None, "single": None}
    hosts = spark.createDataFrame([(h, 1, "old") for h in cases] * 2, "host string, k int, domain string")
    rows = domains.registrable(hosts, rules).collect()
    assert len(rows) == 2 * len(cases) and {r["host"]: r["domain"] for r in rows} == cases
    assert domains.registrable(hosts.limit(0), rules).count() == 0


def test_first_of_many_definitions(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5)))
    listed = [(i, f"d{i}", [word() + word() for _ in range(rnd.randrange(1, 4))]) for i in rnd.sample(range(10**6), 3000)] + [(-2, "none", []), (-1, "blank", ["", None])]
    titles = [None, "", *(" ".join(word() for _ in range(12)) for _ in range(120))]
    order = sorted(listed)
    want = [next((n for _, n, words in order if [w for w in words if w] and t and all(w in t for w in words if w)), None) for t in titles]
    rows = spark.createDataFrame(list(enumerate(titles)), "i int, title string").repartition(3)
    table = spark.createDataFrame(listed, "rank long, name string, words array<string>")
    for limit in (10**6, 4000):
        got = {r["i"]: r["definition"] for r in definitions.first_match(rows, table, max_characters=limit).collect()}
        assert [got[i] for i in range(len(titles))] == want and len({*want}) > 10
    assert definitions.first_match(rows, table.limit(0)).where("definition IS NOT NULL").count() == 0
