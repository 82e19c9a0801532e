import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_op1_minhash import brute
from tests.llm.test_op5_pack import check
from tidemill.llm import op2_langid, op7_mix, op8_toxicity


def test_run_against_brute_force(spark, sf_dir):
    """The stages one by one, by plain Python where it can be: models score one text at a time, near copies are found by all pairs, and mixing keeps every document once to twice."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    models, cnn = op2_langid.trained(spark, sf_dir), op8_toxicity.trained(spark, sf_dir)
    stay = {}
    for i, r in rows.items():
        raw = (r["text"] or "").encode()
        known = models.predict(pa.array([r["text"] or ""], pa.large_string()))[0] != ["und"]
        if known and cnn.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] < 0.3:
            stay[i] = r["text"]
    kept = {i: stay[i] for i, _, _, k in brute(stay.items(), 5) if k}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    times = {}
    for r in out:
        if r["piece"] == 0:
            times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) == set(kept) and max(times.values()) <= 2
    copies = [(i, kept[i]) for i, n in times.items() for _ in range(n)]
    assert check([(i or None, t) for i, t in copies], out) <= -(-sum(r["length"] for r in out) // 4096) + 1


def test_mixture_lies_in_blocks(spark, sf_dir, tmp_path):
    """Each file that mixing writes holds whole blocks, in the order of their places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus_pipeline.mix(spark, docs, sf_dir).withColumn("_row", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "mixed"))
    rows = spark.read.parquet(str(tmp_path / "mixed")).select("doc_id", F.shiftright("_row", 33).alias("part"), "_row").orderBy("_row").collect()
    want = op7_mix.mix_sources(docs, max_repeats=2.0, text_hash=F.sha2("text", 256)).select("doc_id", "block", "position").orderBy("block", "position").collect()
    blocks = {}
    for r in want:
        blocks.setdefault(r["block"], []).append(r["doc_id"])
    parts = {}
    for r in rows:
        parts.setdefault(r["part"], []).append(r["doc_id"])
    ids = [i for p in parts.values() for i in p]
    assert len(ids) == len(want)
    assert all(any(p[k : k + len(b)] == b for p in parts.values() for k in range(len(p) - len(b) + 1)) for b in blocks.values())


def test_packing_edges(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0), (None, "a b c", "en", "s", 5), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1)], schema)
    out = corpus_pipeline.packing(spark, odd, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "3", "3", "None"] and len({r["sequence_id"] for r in out}) == 1
    assert corpus_pipeline.packing(spark, odd.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_columns_and_edges(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(9_000_001, None, None, None, None), (9_000_002, "", None, None, 0), (None, "the and of the with thing", "en", "s", 25), (9_000_003, "the and of the with thing", "en", "s", 25), (9_000_003, "the and of the with thing", "en", "s", 25)], docs.schema)
    out = stage(spark, docs.unionByName(odd), sf_dir)
    assert out.columns == docs.columns and out.count() > 0
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if stage is corpus_pipeline.near_dedup:
        assert out.filter("doc_id = 9000003").count() == 1 and out.filter("doc_id IS NULL").count() == 1


def test_repeated_ids(spark, sf_dir):
    """Texts that share a doc_id are documents by themselves: a copy among them takes none of the others along, and no group loses its last."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    long = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "abcd"}
    near = long["b"] + " end"
    rows = [(3, long["a"]), (7, long["a"]), (7, long["b"]), (7, long["c"]), (7, long["c"]), (7, near), (5, long["d"]), (9, long["b"]), (8, None), (8, ""), (None, long["a"])]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], schema)
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    assert len(out) == len(set(out)) == 7 and {(3, long["a"]), (7, long["c"]), (5, long["d"]), (8, None), (8, ""), (None, long["a"])} < set(out)
    assert sum(x in out for x in [(7, long["b"]), (7, near)]) == 1


def shuffled(spark, work) -> int:
    """Bytes that work() writes to shuffles."""
    sc = spark.sparkContext
    group = f"shuffled-{time.time()}"
    sc.setJobGroup(group, "")
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {k for j in jobs.getJobIdsForGroup(group) for k in jobs.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(k).shuffleWriteBytes() for k in stages)


@pytest.mark.parametrize("again", [[], [(7, "a b c")]])
def test_texts_stay_where_they_lie(spark, again):
    """Near-dedup shuffles the texts that have a partner, not all of them to drop a few; with ids that repeat, all are shuffled to find what repeats, but not once more."""
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    rng = random.Random(3)
    text = lambda n: " ".join(f"{rng.getrandbits(64):x}" for _ in range(n))
    rows = [(i, text(1500)) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000 + i, rows[10 + i][1] + " end") for i in range(5)] + again
    size = sum(len(t) for _, t in rows)
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], schema).repartition(4).persist()
    docs.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = []
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        written = shuffled(spark, lambda: found.extend(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        docs.unpersist()
    assert sorted(found) == sorted([*range(300), *(i for i, _ in again)])
    assert written < (0.4 if not again else 2.2) * size


def test_stages():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
