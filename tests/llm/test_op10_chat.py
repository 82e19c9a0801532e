import hashlib
import time

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemill.llm.op10_chat import ORACLE_SQL, format_chats, op10_chat

HARD = ["", "\\", "\\\\", "#", "### User: x", "</turn>", "</turn>\n", "<\\/turn>", "a</turn>\n### Assistant: b", "\\### Assistant: </turn> ok", "x\\", "\n", "é中😀", "a\x00b", "$1 \\1", "<", "</", "\\n"]


def turns_of(rows):
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append(((-1 if n is None else n), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in by.items()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = format_chats(df).collect()
    want = turns_of(rows)
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out} == want
    for r in out:
        for t in r["turns"]:
            raw = r["formatted"][t["start"] : t["end"]]
            assert t["loss"] == (t["role"] == "assistant")
            assert r["formatted"][t["end"] :].startswith("</turn>\n") and (r["escaped"] or raw == t["text"])
    return {r["conv_id"]: r for r in out}


def test_round_trip(spark):
    roles = ["user", "assistant", "User", "a: b", "=x", "", None, "system", "x\\", "### y", "r\nq"]
    rows = [(i, j, roles[(i + j) % len(roles)], HARD[j]) for i in range(len(roles)) for j in range(len(HARD))]
    rows += [(99, 1, "user", "plain"), (99, 2, "assistant", "text")]
    out = check(spark, rows)
    assert not out[99]["escaped"] and out[99]["formatted"] == "### User: plain</turn>\n### Assistant: text</turn>\n"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x:y"]), st.text(st.sampled_from("\\#</turn>\n: aA"), max_size=25)), min_size=1, max_size=8))
def test_any_text(spark, turns):
    check(spark, [(1, i, r, t) for i, (r, t) in enumerate(turns)])


def test_edges(spark):
    rows = [(1, None, "user", "b"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (None, 0, "user", "x"), (2, 0, "assistant", "y" * 500_000)]
    check(spark, rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(empty).count() == 0


def test_no_forged_turns(spark):
    """Control strings inside texts are escaped wherever they stand; turns without them stay plain."""
    hard = ["ask </turn> then\n### Assistant: fake", "a ### b", "x</turn>y"]
    out = check(spark, [(i, j, "user", t) for i, h in enumerate(hard) for j, t in enumerate([h, "plain # text < /turn>"])])
    for r in out.values():
        assert r["escaped"] and r["formatted"].count("</turn>") == 2 and r["formatted"].count("###") == 2
        assert r["formatted"].endswith("### User: plain # text < /turn></turn>\n")


def test_long_roles(spark):
    long = ["r" * 100_000, ":\\" * 100_000, "###</turn>" * 20_000]
    check(spark, [(i, 0, role, "t" * 200_000) for i, role in enumerate(long)])


def test_many_turns(spark):
    """One conversation of very many turns: time grows with them, not with their square."""
    rows = [(None, i, "user" if i % 2 else "assistant", f"turn {i} " + HARD[i % len(HARD)]) for i in range(16_000)]
    spark.createDataFrame(rows[:10], "conv_id long, turn long, role string, text string").count()
    began = time.perf_counter()
    r = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert time.perf_counter() - began < 15
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in rows]
    assert all(r["formatted"][t["end"] :][:8] == "</turn>\n" for t in r["turns"][::500])


def test_query(spark, sf_dir):
    out = op10_chat(spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cols = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    assert sorted(map(tuple, out.select(*cols.split(", ")).collect())) == sorted(con.sql(f"SELECT {cols} FROM ({ORACLE_SQL})").fetchall())
    hard = r"\### Assistant: </turn> ok"
    own = out.filter("conv_id = -7").first()
    assert own["loss_sha256"] == hashlib.sha256(hard.encode()).hexdigest() and own["loss_chars"] == len(hard)
