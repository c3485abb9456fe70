"""Provider records of every kind of trouble to one schema."""

import datetime as dt

from sightline.sources import adapters


def test_every_record_has_a_status(spark):
    at = dt.datetime(2024, 1, 1)
    story = '{"id": %d, "type": "story", "title": "%s", "time": 100, "score": %s}'
    cases = [
        ("hacker_news", story % (1, "first", 5), "observed"), ("hacker_news", story % (1, "again", 5), "repeated"), ("hacker_news", story % (2, "  ", 5), "skipped"), ("hacker_news", story % (3, "low", 1), "skipped"),
        ("hacker_news", story % (4, "no score", "null"), "skipped"), ("hacker_news", '{"id": 5, "type": "comment", "title": "x", "time": 1, "score": 9}', "skipped"), ("hacker_news", '{"id": 6, "type": "story", "title": "x", "time": 1, "score": 9, "dead": true}', "skipped"),
        ("hacker_news", '{"id": 7, "type": "story", "title": "x", "score": 9}', "skipped"), ("hacker_news", '{"type": "story"}', "malformed"), ("hacker_news", '{"id": "seven"}', "malformed"), ("hacker_news", "{", "malformed"), ("hacker_news", None, "malformed"), ("hacker_news", "[]", "malformed"),
        ("gsc", '{"keys": [" q ", "https://A.test/x/?utm_source=1#f"], "impressions": 3}', "observed"), ("gsc", '{"keys": ["q", "https://a.test/x"], "impressions": 4}', "repeated"), ("gsc", '{"keys": ["q"]}', "malformed"), ("gsc", '{"keys": ["", "https://a.test/"]}', "malformed"), ("other", "{}", "malformed"),
    ]
    records = spark.createDataFrame([(s, i, p, at) for i, (s, p, _) in enumerate(cases)], "source string, record_no long, payload string, collected timestamp")
    rows = {r["record_no"]: r for r in adapters.observations(records, minimum_score=2).collect()}
    assert [rows[i]["status"] for i in range(len(cases))] == [s for *_, s in cases]
    assert (rows[0]["external_id"], rows[0]["score"], rows[0]["title"]) == ("hn:1", 5, "first")
    assert (rows[13]["external_id"], rows[13]["title"], rows[13]["views"], rows[13]["published"]) == ("gsc:q:https://a.test/x", "q", 3, at)


def test_backlink_defaults(spark):
    payloads = ["{}", '{"lost_date": "2024-01-01", "last_visited": "2024-02-01", "backlinks_spam_score": 7, "attributes": ["a", "b"]}', '{"is_lost": false, "lost_date": "2024-01-01", "rank": "high", "rel_attributes": [], "attributes": ["a"]}', "nonsense"]
    rows = adapters.backlink_rows(spark.createDataFrame(list(enumerate(payloads)), "i int, payload string"), ("i",)).orderBy("i").collect()
    assert [(r["is_lost"], r["is_broken"], r["last_seen"], r["spam_score"], r["rel_attributes"], r["rank"], r["malformed"]) for r in rows] == [
        (False, False, None, None, [], None, False), (True, False, "2024-01-01", 7, ["a", "b"], None, False), (False, False, "2024-01-01", None, [], None, False), (False, False, None, None, [], None, True),
    ]
