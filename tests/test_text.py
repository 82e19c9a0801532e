import time

from pyspark.sql import functions as F

from tidemill.functions import text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def t(spark, f, value, *args, **kwargs):
    return one(spark, f(F.col("t"), *args, **kwargs), t=value)


def test_cleaning(spark):
    assert t(spark, text.remove_html_tags, "<p>这是一个<b>测试</b>文本</p>") == "这是一个测试文本"
    assert t(spark, text.decode_html_entities, "这是一个&nbsp;测试&amp;文本") == "这是一个\xa0测试&文本"
    assert t(spark, text.clean_text, "<p>这是一个&nbsp;<b>测试</b>&amp;文本</p>") == "这是一个 测试&文本"
    assert t(spark, text.remove_html_tags, "a<script>var x='</p>';</script>b<!-- c\nd -->e<STYLE>p{}</STYLE>") == "abe"
    assert t(spark, text.html_to_text, "<p>a</p><p>b</p>") == "a b"
    assert t(spark, text.remove_extra_whitespace, "  a \t\n b　c ") == "a b c"
    assert t(spark, text.remove_special_chars, "a-b!c d_é中", keep="-") == "a-bc d_é中"
    assert t(spark, text.normalize_unicode, "１２ﬁ") == "12fi"
    assert t(spark, text.strip_control_chars, "a\x00é中\n") == "a中\n"
    assert t(spark, text.strip_control_chars, "a\x00é中\n", letters=True) == "aé中\n"
    assert t(spark, text.clean_text, None) is None and t(spark, text.clean_text, "") == ""


def test_extraction(spark):
    assert t(spark, text.extract_numbers, "价格 12.5 元，共 34 件 -3") == ["12.5", "34", "-3"]
    assert t(spark, text.extract_numbers, "１２") == ["１２"]
    assert t(spark, text.extract_emails, "邮箱 a@b.com 和 c@d.cn") == ["a@b.com", "c@d.cn"]
    assert t(spark, text.extract_phones, "联系 13812345678 或 010-12345678 或 400-123-4567") == ["13812345678", "010-12345678", "400-123-4567"]
    assert t(spark, text.extract_urls, "http://x.y/a</a> and https://z") == ["http://x.y/a</a>", "https://z"]
    assert t(spark, text.extract_urls, None) == []
    assert t(spark, text.regex_findone, "a=1\nb=2", r"b=(\d)", 1) == "2"
    assert t(spark, text.regex_findone, "x", "y", default="none") == "none"
    found = t(spark, text.regex_with_context, "one two THREE two five", "two", 4)
    assert [(r["match"], r["context"]) for r in found] == [("two", "one two THR..."), ("two", "...REE two fiv...")]


def test_names(spark):
    assert t(spark, text.truncate, "abcdefghij", 8) == "abcde..." and t(spark, text.truncate, "abc", 8) == "abc"
    assert t(spark, text.metric_name, "request_ignore_count/reason/状态码 403", "app") == "app_request_ignore_count_reason_403"
    assert t(spark, text.safe_filename, 'a/b:c*?.txt') == "a_b_c__.txt"
    assert t(spark, text.safe_filename, "con.txt") == "_con.txt" and t(spark, text.safe_filename, "  ") == "unnamed_file"
    assert t(spark, text.safe_filename, "x" * 300 + ".pdf") == "x" * 190 + ".pdf"
    assert t(spark, text.table_name, " my-table 1") == "my_table_1" and t(spark, text.table_name, "a;b") is None
    assert one(spark, text.render("{a} {{b}} {c}", {"a": F.lit("x"), "b": F.lit(2)})) == "x 2 {c}"
    name = text.attachment_name(F.col("u"), F.col("d"), F.col("c"))
    assert one(spark, name, u="http://h/x", d='attachment; filename="a.pdf"', c="text/html") == "a.pdf"
    assert one(spark, name, u="http://h/x/y.zip?z", d=None, c="text/html") == "y.zip"
    assert one(spark, name, u="http://h/x", d=None, c="image/png; q=1").endswith(".png")
    allowed = text.content_type_allowed(F.col("e"), F.col("c"))
    assert one(spark, allowed, e=".pdf", c="application/pdf; x") and not one(spark, allowed, e=".pdf", c="text/html") and one(spark, allowed, e=".qqq", c="text/html")


def test_maps(spark):
    assert t(spark, text.form_to_map, "a=1&b=x+y%21&a=2&c") == {"a": "2", "b": "x y!"}
    assert t(spark, text.cookies_to_map, "a=1; b=2=3; c") == {"a": "1", "b": "2=3"}
    assert t(spark, text.cookies_to_map, "a=1&b=2") == {"a": "1", "b": "2"}
    headers = F.create_map(F.lit("Content-Type"), F.lit("x"))
    assert one(spark, text.header_value(headers, "content-type")) == "x" and one(spark, text.header_value(headers, "etag", "none")) == "none"
    for name, kind in (("MemoryError", "critical"), ("TimeoutError", "network"), ("FileNotFoundError", "network"), ("KeyError", "data"), ("Odd", "unknown")):
        assert t(spark, text.error_category, name) == kind


def test_contexts_of_many_matches(spark):
    """A long text is gone through once: 60,000 matches of it take no square of that."""
    began = time.monotonic()
    many = spark.range(1).select(F.repeat(F.lit("The \U0001f600b "), 60_000).alias("t"))
    got = many.select(F.explode(text.regex_with_context(F.col("t"), r"\bthe\b", 3)).alias("m")).groupBy("m.match", "m.context").count().collect()
    assert {(r["match"], r["context"]): r["count"] for r in got} == {("The", "The \U0001f600b..."): 1, ("The", "...\U0001f600b The \U0001f600b..."): 59_999}
    assert time.monotonic() - began < 30
    none = spark.createDataFrame([(None,), ("",), ("no match",)], "t string").select(text.regex_with_context(F.col("t"), "x+", 3).alias("c")).collect()
    assert [r["c"] for r in none] == [None, [], []]
