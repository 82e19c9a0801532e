"""Times in free text, encodings from bytes alone, Markdown from nodes: against what is written down."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, encoding, html

NOW = datetime(2025, 9, 10, 14, 30, 45)  # a Wednesday
D = datetime
TIMES = {
    "3 days ago": D(2025, 9, 7, 14, 30, 45), "a day ago": D(2025, 9, 9, 14, 30, 45), "an hour ago": D(2025, 9, 10, 13, 30, 45), "1 hour, 20 minutes ago": D(2025, 9, 10, 13, 10, 45), "2 weeks and 1 day ago": D(2025, 8, 26, 14, 30, 45),
    "in 2 weeks": D(2025, 9, 24, 14, 30, 45), "5 mins ago": D(2025, 9, 10, 14, 25, 45), "half an hour ago": D(2025, 9, 10, 14, 0, 45), "1 year 2 months ago": D(2024, 7, 10, 14, 30, 45), "30 seconds ago": D(2025, 9, 10, 14, 30, 15),
    "3 hours later": D(2025, 9, 10, 17, 30, 45), "2 days from now": D(2025, 9, 12, 14, 30, 45), "yesterday": D(2025, 9, 9, 14, 30, 45), "Yesterday 17:05": D(2025, 9, 9, 17, 5), "yesterday at 5:05 pm": D(2025, 9, 9, 17, 5), "today 08:00": D(2025, 9, 10, 8, 0),
    "tomorrow at 12:15 am": D(2025, 9, 11, 0, 15), "the day before yesterday": D(2025, 9, 8, 14, 30, 45), "just now": NOW, "last week": D(2025, 9, 3, 14, 30, 45), "last month": D(2025, 8, 10, 14, 30, 45), "next year": D(2026, 9, 10, 14, 30, 45),
    "last monday": D(2025, 9, 8), "last wednesday": D(2025, 9, 3), "next friday": D(2025, 9, 12), "3天前": D(2025, 9, 7, 14, 30, 45), "5分钟前": D(2025, 9, 10, 14, 25, 45), "2 小时前": D(2025, 9, 10, 12, 30, 45), "1个月前": D(2025, 8, 10, 14, 30, 45),
    "昨天 17:05": D(2025, 9, 9, 17, 5), "前天": D(2025, 9, 8, 14, 30, 45), "刚刚": NOW, "半小时前": D(2025, 9, 10, 14, 0, 45), "2周后": D(2025, 9, 24, 14, 30, 45), "2025-09-10 14:30:00": D(2025, 9, 10, 14, 30), "September 10, 2025 2:30 PM": D(2025, 9, 10, 14, 30),
    "September 10th, 2025": D(2025, 9, 10), "10th of September 2025 at 14:30": D(2025, 9, 10, 14, 30), "Wednesday, September 10, 2025": D(2025, 9, 10), "Sep 10 2025 14:30:05": D(2025, 9, 10, 14, 30, 5), "10 Sep 2025, 14:30": D(2025, 9, 10, 14, 30),
    "2025年9月10日 14:30": D(2025, 9, 10, 14, 30), "yesterday 25:00": None, "3 apples ago": None, "ago": None, "in": None, "": None, "days": None, "tomorrow 12:75": None,
}


def test_times(spark):
    df = spark.createDataFrame([(t,) for t in TIMES] + [(None,)], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", dates.parse_time(F.col("t"), F.lit(NOW).cast("timestamp_ntz")).alias("x")).collect()}
    assert got == TIMES | {None: None}


TEXTS = {
    "gb18030": ["中文标题和内容,我们在这里测试编码。", "<html><title>新闻网站</title><p>今天的天气很好</p></html>"],
    "big5hkscs": ["中文標題和內容,我們在這裡測試編碼。", "<p>今天的天氣很好,歡迎光臨</p>"],
    "cp932": ["日本語タイトルの本文です。", "<title>日本語タイトル</title>日本語本文"],
    "euc_jp": ["日本語タイトルの本文です。これはテストです。"],
    "cp949": ["한글제목과 한글내용입니다.", "<title>한글제목</title>한글내용"],
    "cp1252": ["Café résumé", "L'été où l’on a gagné, déjà là: señor Müller fährt"],
    "cp1251": ["Привет, это проверка кодировки страницы"],
    "koi8_r": ["Привет, это проверка кодировки страницы"],
}


@pytest.mark.parametrize("name", TEXTS)
def test_encodings_by_content(name):
    for text in TEXTS[name]:
        body = text.encode(name)
        found, sure = encoding.guess(body)
        assert (found, encoding.detect(body)) == (name, name) and sure >= encoding.SURE


def test_encodings_declared_and_marked():
    page = "<html><head>{}<title>中文标题</title></head></html>"
    for body, want in [
        (page.format('<meta charset="GBK"/>').encode("gbk"), "gb18030"), (page.format('<meta charset="utf-8">').encode(), "utf-8"), (b"<html><body>Hello World</body></html>", "utf-8"), (b"\xef\xbb\xbfx", "utf-8"),
        (b"\xff\xfe" + "Hello".encode("utf-16-le"), "utf-16-le"), (b"\xfe\xff" + "Hello".encode("utf-16-be"), "utf-16-be"), (b"\xff\xfe\x00\x00" + "Hi".encode("utf-32-le"), "utf-32-le"), (b"\x00\x00\xfe\xff" + "Hi".encode("utf-32-be"), "utf-32-be"),
        (("A" * 4090 + "中文标题").encode("gbk")[:4100], "gb18030"), (("<html><!-- " + "X" * 5000 + " --><title>中文标题</title>").encode("gbk"), "gb18030"), ("纯中文内容无需声明".encode(), "utf-8"), (b"", "utf-8"),
    ]:
        assert encoding.detect(body) == want
    assert encoding.guess(b"plain") == (None, 0.0)


MARKDOWN = {
    "<h1>Title</h1><p>One  <b>two</b>\n three</p><p>Next</p>": "# Title\n\nOne **two** three\n\nNext",
    "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><ol><li>x<li>y</ol>": "- a\n- b\n  - c\n\n1. x\n2. y",
    '<p>See <a href="/x">the <em>link</em></a> and <img src="i.png" alt="pic"></p>': "See [the *link*](/x) and ![pic](i.png)",
    "<pre><code>a  b\n c</code></pre><p>Use <code>x</code></p>": "```\na  b\n c\n```\n\nUse `x`",
    "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table>": "| h | k |\n| --- | --- |\n| 1 | 2 |",
    "<title>t</title><script>x</script><style>y</style><!-- c --><h2>S</h2>a<hr>b<br>c": "## S\n\na\n\n---\n\nb  \nc",
    "<blockquote>quoted</blockquote><div>in <s>old</s></div>": "> quoted\n\nin ~~old~~",
    "": "",
}


def test_markdown(spark):
    pages = html.parse(spark.createDataFrame([(k,) for k in MARKDOWN] + [(None,)], "html string"))
    n = F.col("nodes")
    got = {r["html"]: r["m"] for r in pages.select("html", html.markdown(n).alias("m")).collect()}
    assert got == MARKDOWN | {None: None}
    first = pages.select(html.markdown(n, "p"), html.markdown(n, "li li"), html.markdown(n, "video")).collect()
    assert first[0][0] == "One **two** three" and first[1][1] == "- c" and first[0][2] is None
