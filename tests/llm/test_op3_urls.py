from datetime import datetime

from tidemill.llm.op3_urls import filter_urls, intervals, op3_urls


def day(n):
    return datetime(2024, 1, n)


ENTRIES = "pattern string, dated timestamp_ntz, listed boolean"


def test_intervals(spark):
    rows = [("a.com", day(1), True), ("A.com", day(5), False), ("a.com", day(9), True), ("b.com", day(2), True), ("b.com", day(2), False), ("b.com", day(3), True), (None, day(1), True), ("c.com", None, True), ("d.com", day(1), None)]
    found = sorted((r["pattern"], r["since"].day, r["until"] and r["until"].day) for r in intervals(spark.createDataFrame(rows, ENTRIES)).collect())
    assert found == [("a.com", 1, 5), ("a.com", 9, None), ("b.com", 2, 3), ("b.com", 3, None)]


def test_captures(spark):
    entries = spark.createDataFrame([("a.com", day(2), True), ("a.com", day(6), False), ("x.a.com", day(4), True), ("x.a.com/p/", day(5), True)], ENTRIES)
    rows = [
        (1, "http://a.com/", day(1)), (2, "http://a.com/", day(2)), (3, "http://a.com/", day(6)), (4, "http://y.A.com:80/q", day(3)), (5, "http://x.a.com/p/q", day(5)), (6, "http://x.a.com/p", day(5)),
        (7, "http://xa.com/", day(3)), (8, None, day(3)), (9, "http://a.com/", None), (10, "nonsense", day(3)), (2, "http://a.com/", day(2)), (None, "http://u@a.com./" + "z/" * 100_000, day(3)),
    ]
    captures = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, fetched_at timestamp_ntz, listed string, pattern string")
    out = filter_urls(captures, entries).collect()
    assert len(out) == len(rows)
    found = sorted(((r["page_id"] or 0), r["listed"], r["pattern"]) for r in out)
    assert found == [
        (0, True, "a.com"), (1, False, None), (2, True, "a.com"), (2, True, "a.com"), (3, False, None), (4, True, "a.com"), (5, True, "x.a.com/p/"), (6, True, "x.a.com"),
        (7, False, None), (8, False, None), (9, False, None), (10, False, None),
    ]
    assert filter_urls(captures.limit(0), entries).count() == 0 and filter_urls(captures, entries.limit(0)).filter("listed").count() == 0


def test_query(spark, sf_dir):
    out = op3_urls(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and out.filter("listed").count() > 0
