import math

import pytest
from pyspark.sql import functions as F

from tidemill.llm.op7_mix import ORACLE_SQL, lay_out, mix_sources, op7_mix, temperature


def totals(spark, **tokens):
    return spark.createDataFrame(list(tokens.items()), "source string, tokens long")


def test_temperature(spark):
    t = totals(spark, a=1000, b=100, c=10)
    exponent, budget, total = temperature(t, None, 4.0)
    weights = {k: v**exponent for k, v in (("a", 1000), ("b", 100), ("c", 10))}
    z = sum(weights.values())
    repeats = {k: weights[k] / z * budget / v for k, v in (("a", 1000), ("b", 100), ("c", 10))}
    assert total == 1110 and abs(repeats["a"] - 1) < 1e-6 and abs(repeats["c"] - 4) < 1e-6
    exponent, _, _ = temperature(t, 0.9, None)
    p = [v**exponent for v in (1000, 100, 10)]
    entropy = -sum(x / sum(p) * math.log(x / sum(p)) for x in p) / math.log(3)
    assert abs(entropy - 0.9) < 1e-6
    assert temperature(t, None, 1000.0)[0] == 0.0 and temperature(t, 0.1, None)[0] == pytest.approx(1.0)
    exponent, budget, _ = temperature(t, None, 2.0, budget=1110.0)
    assert budget == 1110.0 and 1110 / 1110 * 10 ** (exponent - 1) / sum((v / 1110) ** exponent for v in (1000, 100, 10)) * (1110 ** (1 - exponent)) <= 2.0001
    assert temperature(totals(spark, a=5), None, 2.0)[:2] == (1.0, 5.0) and temperature(t.limit(0), None, 2.0) == (1.0, 0.0, 0.0)
    with pytest.raises(ValueError, match="over max_repeats"):
        temperature(t, None, 2.0, budget=11_100.0)
    assert temperature(t, None, 2.0, budget=2220.0)[0] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="target_entropy or max_repeats"):
        temperature(t, None, None)


def test_mixture(spark, docs):
    rows = [(i, "x" * 400, "en", "big") for i in range(200)] + [(1000 + i, "x" * 400, "en", None) for i in range(20)] + [(5, None, "en", "tiny"), (5, "", "en", "tiny"), (None, "y" * 8, "en", "tiny")]
    df = docs(*rows).withColumn("block", F.lit("clash"))
    out = mix_sources(df, max_repeats=3.0, block_tokens=2000)
    found = out.collect()
    assert out.columns[:8] == df.drop("block").columns and out.columns[-3:] == ["epoch", "block", "position"]
    count = {}
    for r in found:
        count.setdefault((r["source"], r["doc_id"], r["text"]), []).append(r["epoch"])
    assert set(count) == {(s, i, t) for i, t, _, s in rows}
    assert all(1 <= len(v) <= 3 and len(set(v)) == len(v) for v in count.values())
    assert all(len(v) == 1 for (s, _, _), v in count.items() if s == "big") and sum(len(v) for (s, _, _), v in count.items() if s == "tiny") >= 8
    blocks = {}
    for r in found:
        blocks.setdefault(r["block"], []).append(r)
    assert all(sorted(x["position"] for x in b) == list(range(1, len(b) + 1)) for b in blocks.values())
    whole = [b for k, b in blocks.items() if k < max(blocks)]
    share = [sum(x["source"] == "big" for x in b) / len(b) for b in whole]
    assert max(share) - min(share) < 0.25
    assert [tuple(r) for r in mix_sources(df, max_repeats=3.0, block_tokens=2000).orderBy("block", "position").collect()] == [tuple(r) for r in out.orderBy("block", "position").collect()]
    assert mix_sources(df.limit(0), max_repeats=2.0).count() == 0


def test_rows_are_laid_out_as_placed(spark, docs):
    """lay_out gives the rows of mix_sources in the order of its places, with one shuffle of whole rows; equal rows stay, as often as epochs have them."""
    rows = [(i, f"t{i} " * (i % 90), "en", "big") for i in range(900)] + [(1000 + i, "x" * 400, "en", None) for i in range(40)] + [(5, None, "en", "tiny"), (5, "", "en", "tiny"), (None, "y" * 8, "en", "tiny")]
    df = docs(*rows)
    out = lay_out(df, 3.0, block_tokens=2000)
    assert out.columns == df.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in x and "BroadcastExchange" not in x for x in plan.split("Final Plan")[-1].splitlines()) == 1
    want = mix_sources(df, max_repeats=3.0, block_tokens=2000).orderBy("block", "position").collect()
    blocks, parts = {}, {}
    for r in want:
        blocks.setdefault(r["block"], []).append((r["doc_id"], r["text"]))
    for r in out.withColumn("_part", F.spark_partition_id()).collect():
        parts.setdefault(r["_part"], []).append((r["doc_id"], r["text"]))
    assert len(blocks) > 10 and sum(map(len, parts.values())) == len(want)
    assert all(any(p[k : k + len(b)] == b for p in parts.values() for k in range(len(p) - len(b) + 1)) for b in blocks.values())
    equal = docs(*[(None, "z" * 400, "en", "big")] * 300, *[(i, "x" * 400, "en", "tiny") for i in range(20)])
    found = [r["doc_id"] for r in lay_out(equal, 2.0, block_tokens=2000).collect()]
    assert found.count(None) == 300 and all(1 <= found.count(i) <= 2 for i in range(20))
    assert lay_out(df.limit(0), 2.0).count() == 0


def test_query_is_native_and_right(spark, sf_dir):
    import duckdb

    out = op7_mix(spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cols = "doc_id, source, tokens, epoch, block, position"
    want = con.sql(f"SELECT {cols} FROM ({ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, out.select(*cols.split(", ")).collect())) == sorted(want)
