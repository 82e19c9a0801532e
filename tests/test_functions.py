import hashlib
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import dates, encoding, html, pressure, records, web
from tidemill.sources import parse_curl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(("url", "want"), [("https://www.example.com/page", "example.com"), ("http://sub.example.com:8080/path", "sub.example.com"), ("", "default"), ("invalid", "default")])
def test_domain(spark, url, want):
    assert one(spark, web.domain(F.lit(url))) == want


def test_urls(spark):
    assert one(spark, web.onsite(F.lit("http://a.Example.com/"), ["example.com"])) and not one(spark, web.onsite(F.lit("http://badexample.com/"), ["example.com"]))
    assert not one(spark, web.onsite(F.lit("nothing"), ["example.com"]))
    for url, want in (("", "empty"), ("javascript:x", "dangerous scheme"), ("ftp://x", "not http"), ("http://x" + "y" * 9000, "too long"), ("https://x", None)):
        assert one(spark, web.url_problem(F.lit(url))) == want
    params = F.create_map(F.lit("a"), F.lit("9"), F.lit("c"), F.lit("x y"))
    assert one(spark, web.merge_params(F.lit("http://h/p?a=1&b=2#f"), params)) == "http://h/p?a=9&b=2&c=x+y#f"
    assert one(spark, web.merge_params(F.lit("http://h/p?a=1&b=2"), params, replace=False)) == "http://h/p?a=1&b=2&c=x+y"
    for url, want in (("www.example.com/ajax.html#!key=value", "www.example.com/ajax.html?_escaped_fragment_=key%3Dvalue"), ("www.example.com/ajax.html?k1=v1#!key=value", "www.example.com/ajax.html?k1=v1&_escaped_fragment_=key%3Dvalue"), ("www.example.com/ajax.html#!", "www.example.com/ajax.html?_escaped_fragment_="), ("www.example.com/ajax.html#normal", "www.example.com/ajax.html#normal")):
        assert one(spark, web.escape_ajax(F.lit(url))) == want
    assert one(spark, web.canonical_url(F.lit("HTTP://Example.com?b=2&a=%7e&a=#x"))) == "http://example.com/?a=&a=~&b=2"
    assert one(spark, web.join_url(F.lit("http://h/a/b"), F.lit("../c"))) == "http://h/c"


def test_status(spark):
    assert [one(spark, web.status_category(F.lit(s))) for s in (204, 301, 404, 503, 600)] == ["2xx", "3xx", "4xx", "5xx", "other"]
    allowed = lambda s, a=(), d=(): one(spark, web.status_allowed(F.lit(s), list(a), list(d)))
    assert allowed(200) and not allowed(404) and allowed(404, [404]) and not allowed(404, [404], [404]) and not allowed(200, [], [200])
    retry = lambda s, n, stop=False: one(spark, web.retry_decision(F.lit(s), F.lit(n), F.lit(stop)))
    assert retry(503, 2).asDict() == {"retry": True, "delay_s": 4.0, "attempt": 3}
    assert not retry(503, 3)["retry"] and not retry(404, 0)["retry"] and not retry(503, 0, True)["retry"]
    verdict = lambda e, m: one(spark, web.task_verdict(F.lit(e), F.lit(m)))
    assert verdict("TimeoutError", "") == "retry" and verdict("X", "HTTP 404") == "ack" and verdict("X", "odd") == "retry" and verdict("X", "500 timed out") == "retry"


def test_dates(spark):
    a, b = ntz("2025-09-10 10:00:00"), ntz("2025-09-10 14:30:45")
    assert [one(spark, dates.time_diff(a, b, u)) for u in ("seconds", "minutes", "hours", "odd")] == [16245, 270, 4, 16245]
    for text in ("2025-09-10 14:30:00", "2025/9/10 14:30:00", "10-09-2025 14:30:00", "2025年09月10日 14时30分00秒", "Wed Sep 10 14:30:00 2025", "Wed, 10 Sep 2025 14:30:00", "2025-09-10T14:30:00", "2025-09-10T14:30:00.0"):
        assert one(spark, dates.parse_time(F.lit(text))) == datetime(2025, 9, 10, 14, 30), text
    for text in ("September 10, 2025", "Sep 10, 2025", "2025-09-10", "10/09/2025"):
        assert one(spark, dates.parse_time(F.lit(text))) == datetime(2025, 9, 10), text
    assert one(spark, dates.parse_time(F.lit("tomorrow"))) is None
    assert one(spark, dates.add(ntz("2024-01-31 01:02:03"), 0, 1)) == datetime(2024, 2, 29, 1, 2, 3)
    assert one(spark, dates.date_range(ntz("2024-02-28 10:00:00"), ntz("2024-03-01 01:00:00"))) == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert one(spark, dates.date_range(b, ntz("2020-01-01 00:00:00"))) == []
    assert one(spark, dates.is_recent(ntz("2030-01-01 00:00:00"), 7, a))
    assert [one(spark, dates.format_duration(F.lit(s))) for s in (5, 65, 120, 5400, 90000)] == ["5 秒", "1 分钟 5 秒", "2 分钟", "1 小时 30 分钟", "1 天 1 小时"]
    assert one(spark, dates.format_time(a, dates.strftime_pattern("%Y/%m/%d %H:%M"))) == "2025/09/10 10:00"
    assert one(spark, dates.cron_next(F.lit("*/15 9-17 * * 1-5"), a)) == datetime(2025, 9, 10, 10, 15)
    assert one(spark, dates.cron_next(F.lit("0 0 1 1 *"), a)) == datetime(2026, 1, 1)
    assert one(spark, dates.cron_next(F.lit("x"), a)) is None
    wanted = {
        "*/20 * * * * *": "2025-09-10 10:00:20", "5,50 10 * * *": "2025-09-10 10:05:00", "0 10 * * *": "2025-09-11 10:00:00", "0 0 */2 * *": "2025-09-12 00:00:00", "0 0 * * 7": "2025-09-14 00:00:00",
        "0 0 29 2 *": "None", "0 12 31 * 1-5": "2025-10-31 12:00:00", "0 9-17/4 * * *": "2025-09-10 13:00:00", "61 * * * *": "None", "* * * *": "None", "0 1-5,11 * * *": "2025-09-10 11:00:00", "59 59 23 31 12 *": "2025-12-31 23:59:59",
    }
    runs = spark.createDataFrame([(c,) for c in wanted], "c string").select("c", dates.cron_next(F.col("c"), F.lit("2025-09-10 10:00:00").cast("timestamp_ntz")).alias("n")).collect()
    assert {r["c"]: str(r["n"]) for r in runs} == wanted
    assert one(spark, dates.cron_matches(F.lit("30 14 * * *"), ntz("2025-09-10 14:30:00")))


def test_records(spark):
    same = F.create_map(F.lit("a"), F.lit("x"))
    empty = F.create_map().cast("map<string,string>")
    assert one(spark, records.map_similarity(empty, empty)) == 1.0 and one(spark, records.map_similarity(same, empty)) == 0.0 and one(spark, records.map_similarity(same, same)) == 1.0
    assert one(spark, records.exchange_suffix(F.lit("300436"))) == "300436.SZ" and one(spark, records.exchange_suffix(F.lit("2314"))) == "002314.SZ"
    assert one(spark, records.exchange_suffix(F.lit("999999"))) is None
    assert one(spark, records.business_key(F.lit(" "), F.lit("x"))) == "0" * 32
    assert one(spark, records.round_half_up(F.lit(2.00005))) == 2.0001
    span = one(spark, records.tenure(F.lit("2020-01-02至今")))
    assert str(span["start"]) == "2020-01-02" and span["end"] is None
    assert one(spark, records.document_id(F.lit('{"b": 1, "a": "é"}'))) == hashlib.md5(b"{\"a\": \"\xc3\xa9\", \"b\": 1}").hexdigest()


def test_pressure(spark):
    assert one(spark, pressure.score(F.lit(1.0), F.lit(20.0), F.lit(0.0), F.lit(1.0))) == 100.0
    assert [one(spark, pressure.fixed_delay(F.lit(u))) for u in (0.5, 0.92, 0.97)] == [0.0, 0.4, 5.0]
    assert one(spark, pressure.raw_delay(F.lit("danger"), F.lit(2.0), F.lit(0.5))) == 4.0
    rows = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 3.1)], "i int, d double")
    out = rows.select(F.round(pressure.smooth_delay(F.col("d"), W.orderBy("i")), 3).alias("x")).collect()
    assert [r["x"] for r in out] == [0.0, 0.5, 3.1]


def test_html(spark):
    page = '<div class="content"><h1>Hi <b>you</b></h1><ul class=list><li>a<li>b<li>c</ul><a class=link href=/x?a=1&amp;b=2>L</a><img class=image src=i.png alt=A></div>'
    wanted = {"h": ".content h1", "li": ".list > li", "href": "a.link::attr(href)", "src": "//img/@src", "second": "//ul[@class='list']/li[2]/text()", "both": "h1 b, a[href^='/x']", "none": "table"}
    pages = spark.createDataFrame([(1, page), (2, None), (3, "plain"), (4, "<p>" * 3000 + "deep"), (5, "</div><b>x</b>")], "id long, html string")
    found = {r["id"]: r["found"] for r in html.extract(pages, ["id"], "html", wanted).collect()}
    assert found.pop(1) == {"h": ["Hi you"], "li": ["a", "b", "c"], "href": ["/x?a=1&b=2"], "src": ["i.png"], "second": ["b"], "both": ["you", "L"]}
    assert found == {2: None, 3: None, 4: None, 5: None}
    rows = html.nodes(pages, ["id"], "html")
    assert html.values(rows, ["id"], "p").filter("id = 4").first()["value"] == "deep" and html.values(rows, ["id"], "b").filter("id = 5").count() == 1
    assert html.extract(pages.limit(0), ["id"], "html", wanted).count() == 0
    rows = html.elements(spark.createDataFrame([(1, page)], "id long, html string"), ["id"], "html", "li").orderBy("place").collect()
    assert [r["text"] for r in rows] == ["a", "b", "c"] and rows[0]["path"] == ["div", "ul", "li"] and rows[0]["siblings"] == ["li", "li"]
    every = {(r["tag"], r["place"]): r for r in html.elements(pages.filter("id = 1"), ["id"], "html").collect()}
    assert len(every) == 9 and every["div", 1]["children"] == ["h1", "ul", "a", "img"] and every["div", 1]["parent_name"] is None and every["h1", 2]["text"] == "Hi"
    fp = F.struct("tag", "text", "attributes", "path", "parent_name", "parent_attributes", "parent_text", "siblings", "children").alias("fp")
    candidates = html.elements(pages.filter("id = 1"), ["id"], "html").select(F.col("id").alias("page"), "place", fp)
    second = candidates.filter("fp.text = 'b'")
    assert [70 < r["score"] < 80 for r in html.find_similar(second, candidates, 50.0).collect()] == [True, True]
    saved = spark.createDataFrame([("d", "x", 1)], "domain string, identifier string, v int")
    assert html.save_first(saved, spark.createDataFrame([("d", "x", 2), ("d", "y", 3)], "domain string, identifier string, v int")).count() == 2
    a = {"tag": "li", "text": "abc", "attributes": {"class": "x"}, "path": ["ul", "li"], "parent_name": "ul", "parent_attributes": {}, "parent_text": None, "siblings": ["li"], "children": []}
    assert html.alike(a, a) == 100.0 and html.alike(a, a | {"text": "xyz"}) < 80


def test_encoding(spark):
    for body, header, want in ((b"\xef\xbb\xbfx", None, "utf-8"), ("中文".encode("gbk"), "text/html; charset=GBK", "gb18030"), (b'<meta charset="shift_jis">', None, "cp932"), ("é".encode(), None, "utf-8"), ("中文测试".encode("gb2312"), None, "gb18030")):
        assert one(spark, encoding.detect_encoding(F.lit(bytearray(body)), F.lit(header).cast("string"))) == want
    assert one(spark, encoding.decode_body(F.lit(bytearray(b"a\xff")), F.lit("utf-8"))) == "a�"


def test_curl(spark):
    got = one(spark, parse_curl(F.lit("curl 'http://h/x' -H 'A: b' -b 'c=1; d=2' --data 'k=v' -m 5")))
    assert (got["method"], got["url"], got["headers"], got["cookies"], got["body"]) == ("POST", "http://h/x", {"A": "b"}, {"c": "1", "d": "2"}, "k=v")
    assert one(spark, parse_curl(F.lit("curl -G http://h -d a=1")))["url"] == "http://h?a=1"
    assert one(spark, parse_curl(F.lit("wget x"))) is None


def test_more_ways_to_write_a_time(spark):
    want = {
        "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05+08:00": "2024-01-01 19:04:05", "2024-01-02T03:04:05.123-0530": "2024-01-02 08:34:05.123000", "2024-01-02 03:04": "2024-01-02 03:04:00",
        "20240102": "2024-01-02 00:00:00", "20240102030405": "2024-01-02 03:04:05", "September 10, 2025 2:30 PM": "2025-09-10 14:30:00", "2 Jan 2024": "2024-01-02 00:00:00", "2.1.2024": "2024-01-02 00:00:00",
        "99999999": "None", "2024-13-02T03:04:05Z": "None", "soon": "None",
    }
    found = spark.createDataFrame([(t,) for t in want], "t string").select("t", dates.parse_time(F.col("t")).alias("p")).collect()
    assert {r["t"]: str(r["p"]) for r in found} == want


def test_times_with_zones_and_job_runs(spark):
    at = one(spark, dates.from_timestamp_with_tz(F.lit(0.0), "Asia/Tokyo"))
    assert at["zone"] == "Asia/Tokyo" and at["time"] == datetime(1970, 1, 1)
    run = one(spark, dates.next_job_run(F.lit("0 6 * * *"), F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"), F.lit("2024-01-05 07:00:00").cast("timestamp_ntz")))
    assert run == datetime(2024, 1, 6, 6)


def test_cron_over_many_rows(spark):
    """A cron text is read once a batch, not once a row, and its runs are those found by going on second by second."""
    crons = ["30 6 * * *", "0 0 1 * *", "*/20 5,22-23 * 2 0", "0 0 29 2 *", "15 3 4 5 */13 7", "59 23 31 12 *", "60 * * * *", "5/15 1/6 * * 1-5"]
    times = [datetime(2023, 2, 28, 23, 59, 59, 999999), datetime(2024, 2, 3, 22, 40), datetime(1969, 12, 31, 6, 30), datetime(2024, 12, 31, 23, 59)]
    rows = [(c, t) for c in crons for t in times] + [(None, times[0]), (crons[0], None)]

    def first(c: str, t: datetime) -> datetime | None:
        parts = c.split() if len(c.split()) == 6 else ["0", *c.split()]
        s, m, h, d, mo, w = ({v for v in range(low, high + 1) for p in x.split(",") if fits(p, v, high)} for x, (low, high) in zip(parts, dates.CRON_FIELDS, strict=True))
        day = datetime(t.year, t.month, t.day)
        for k in range(368):
            x = day + timedelta(days=k)
            if x.day in d and x.month in mo and {x.isoweekday() % 7, x.isoweekday()} & w:
                for at in (x + timedelta(hours=a, minutes=b, seconds=e) for a in sorted(h) for b in sorted(m) for e in sorted(s)):
                    if at > t:
                        return at if at <= t + timedelta(days=367) else None
        return None

    def fits(p: str, v: int, high: int) -> bool:
        span, _, step = p.partition("/")
        low, _, end = span.partition("-")
        if low == "*":
            return v % int(step or 1) == 0
        return int(low) <= v <= int(end or (high if step else low)) and (v - int(low)) % int(step or 1) == 0

    made = spark.createDataFrame(rows, "c string, t timestamp_ntz")
    for r in made.select("c", "t", dates.cron_next(F.col("c"), F.col("t")).alias("n")).collect():
        assert r["n"] == (first(r["c"], r["t"]) if r["c"] and r["t"] else None), r
    began = time.monotonic()
    many = spark.range(300_000).select(F.timestamp_add("SECOND", F.col("id") * 211, F.lit("2020-01-01").cast("timestamp_ntz")).alias("t"))
    assert many.select(dates.cron_next(F.lit(crons[1]), F.col("t")).alias("n")).filter("day(n) = 1 AND n > current_date() - interval 100 years").count() == 300_000
    assert time.monotonic() - began < 30  # 150,000 rows took more than 200 s when every row read its text
