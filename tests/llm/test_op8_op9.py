import random
import zlib

import numpy as np
import pytest

from tidemill.llm import op8_toxicity, op9_quality
from tidemill.llm.op8_toxicity import divide, features, fit_toxicity, sampled, score_texts
from tidemill.llm.op9_quality import fit_quality, tokens


def bytes_of(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_features():
    f, at = features(*bytes_of("Idiot, idiot!", "", "...", "idiotic"))
    assert np.diff(at).tolist() == [2, 0, 1, 1]
    assert (f[0] == f[1]).all() and f[0, 0] != f[3, 0] and (f[0, 1:4] == f[3, 1:4]).all()


def test_tokens():
    b, shape, at = tokens(*bytes_of("One ONE one!! 12\n", "one one", ""))
    assert np.diff(at).tolist() == [6, 2, 0]
    assert b[0] == b[1] == b[2] == b[6] and shape[0] != shape[1] and shape[7] == op9_quality.SHAPES - 1


def test_divide():
    z, y = np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])
    assert divide(z, y, np.ones(4)) == 0.5


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of two languages; toxic ones hold a stem in many forms, poor ones shout or repeat themselves."""
    rng = random.Random(4)
    words = {x: [x + "".join(rng.choice("abcdefghijklm") for _ in range(4)) for _ in range(200)] for x in ("en", "de")}
    rows, labels = [], []
    for i in range(1200):
        lang = rng.choice(["en", "en", "de"])
        w = [rng.choice(words[lang]) for _ in range(rng.randint(5, 60))]
        toxic, poor, shout = rng.random() < 0.2, rng.random() < 0.25, rng.random() < 0.5
        if poor:
            w = [x.upper() + "!!" for x in w] if shout else w[:2] * 20
        if toxic:
            w[rng.randrange(len(w))] = {"en": "scumm", "de": "lowei"}[lang] + rng.choice("abcdefgh") + rng.choice("xyz")
        rows.append((i, " ".join(w), lang))
        labels.append((i, int(toxic), int(not poor)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache(), spark.createDataFrame(labels, "doc_id long, toxic int, quality int").cache()


@pytest.mark.parametrize(("fit", "label", "least"), [(fit_toxicity, "toxic", 0.9), (fit_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, labelled, fit, label, least):
    docs, labels = labelled
    model = fit(docs, labels.filter("doc_id % 6 <> 0"), label)
    out = score_texts(docs, model).join(labels, "doc_id").filter("doc_id % 6 = 0").collect()
    assert sum(r["predicted"] == r[label] for r in out) >= least * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


@pytest.mark.parametrize("fit", [fit_toxicity, fit_quality])
def test_edges(spark, docs, labelled, fit):
    model = fit(*labelled)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "en1 " * 120_000), (4, "en1 " * 120_000), (None, "en2"), (5, "\x00é中")]
    out = score_texts(docs(*((i, t, None, None) for i, t in rows)), model).collect()
    assert len(out) == len(rows) and out[0]["score"] == out[1]["score"] == out[2]["score"] and out[3]["score"] == out[4]["score"]
    assert all(0 <= r["score"] <= 1 for r in out) and list(out[0].asDict()).count("score") == 1
    assert score_texts(docs((1, "x", None, None)).limit(0), model).count() == 0
    nothing = fit(labelled[0], labelled[1].limit(0))
    assert score_texts(docs((1, "x", None, None)), nothing).count() == 1


def test_chunks_change_nothing(labelled):
    """Scores do not depend on which texts are scored together, nor on the block that a long text's words fall into."""
    docs, labels = labelled
    model = fit_toxicity(docs, labels)
    texts = [r["text"] for r in docs.limit(50).collect()] + ["scummaz " + "en5 " * 150_000]
    together = model.scores(*bytes_of(*texts))
    alone = np.array([model.scores(*bytes_of(t))[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_convolution_by_loops(labelled):
    """Logits are those of a convolution written out: every filter at every place, zeros past the end, the strongest answer kept."""
    model = fit_toxicity(*labelled, epochs=1)
    texts = ["one", "en1 scummax two three", "", "a b c d e f g h"]
    f, at = features(*bytes_of(*texts))
    got = model.logits(f, at)
    per = op8_toxicity.FILTERS
    for t in range(len(texts)):
        words = [model.embed[x].sum(0) for x in f[at[t] : at[t + 1]]]
        pooled = []
        for c in range(per * len(op8_toxicity.WIDTHS)):
            width, best = op8_toxicity.WIDTHS[c // per], -np.inf
            for i in range(len(words)):
                total = 0.0
                for k in range(width):
                    column = c - (len(model.bias) - model.conv[k].shape[1])
                    if i + k < len(words):
                        total += float(words[i + k] @ model.conv[k][:, column])
                best = max(best, total)
            pooled.append(max(best + model.bias[c], 0.0))
        assert abs(float(np.dot(pooled, model.out) + model.base) - got[t]) < 1e-3


def test_pooling_by_loops(labelled):
    model = fit_quality(*labelled)
    texts = ["One ONE one!! 12\n", "", "en1 en2 en1"]
    bucket, shape, at = tokens(*bytes_of(*texts))
    got = model.pooled(bucket, shape, at)
    for t in range(len(texts)):
        own = range(at[t], at[t + 1])
        n = len(own)
        mean = lambda table, key: sum((table[key[i]] for i in own), np.zeros(op9_quality.DIM)) / max(n, 1)
        want = [*mean(model.words, bucket), *mean(model.shapes, shape), np.log1p(n), len({int(shape[i]) for i in own}) / np.sqrt(max(n, 1))]
        assert np.allclose(got[t], want, atol=1e-5)


def test_every_language_and_label_is_sampled(spark):
    """Many languages, few positives of each: every one is in the sample, which stays within its bounds."""
    rows = [(i, f"word{i % 7} of l{i % 80}" * 3, f"l{i % 80}") for i in range(4_000)]
    docs = spark.createDataFrame([*rows, (5000, None, "l0"), (5001, "long " * 50_000, "l1")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i // 80 % 10 == 0)) for i, _, _ in rows] + [(5000, 1), (5001, 1)], "doc_id long, toxic int")
    cells = {}
    for text, y, lang, weight in sampled(docs, labels, "toxic"):
        cells.setdefault((lang, y), []).append((text, weight))
    assert len(cells) == 160 and {k: sum(w for _, w in v) for k, v in cells.items()} == pytest.approx({(f"l{x}", y): 5.0 if y else 45.0 for x in range(80) for y in (0, 1)})
    few = sampled(docs, labels, "toxic", most=320, chars=10**9)
    assert len({(lang, y) for _, y, lang, _ in few}) == 160 and len(few) <= 640
    model = fit_toxicity(docs, labels, epochs=1)
    assert model.lang_logs.shape[1] == len(model.langs) == 1


def test_repeated_ids(spark):
    """A doc_id that repeats on both sides is sampled once for each of its texts; labels that disagree count as the larger."""
    docs = spark.createDataFrame([(1, f"text {i % 2}", "en") for i in range(1000)] + [(2, "clean", None), (None, "no id", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, i % 2) for i in range(1000)] + [(2, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(sampled(docs, labels, "toxic")) == [("clean", 0, "", 1.0), ("text 0", 1, "en", 500.0), ("text 1", 1, "en", 500.0)]


def test_queries(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for query, by, rest in ((op8_toxicity.op8_toxicity, 4, 2), (op9_quality.op9_quality, 5, 0)):
        out = query(spark, sf_dir)
        assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == n
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % by == rest) for r in out.select("doc_id", "held_out").collect())


def test_texts_beyond_the_sample(spark, labelled):
    """With a sample far smaller than the table all labelled texts are learned from, in shards, and neither partitions nor repeated rows change the model."""
    docs, labels = labelled
    learn = labels.filter("doc_id % 6 <> 0")
    model, again = fit_toxicity(docs, learn, sample=4, shard=150), fit_toxicity(docs.repartition(7).union(docs.limit(5)), learn, sample=4, shard=150)
    assert (model.embed == again.embed).all() and (model.flat() == again.flat()).all() and (model.lang_logs == again.lang_logs).all()
    assert model.langs == ["", "en"]
    out = score_texts(docs, model).join(labels, "doc_id").filter("doc_id % 6 = 0").collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.95 * len(out)


def test_long_texts_are_learned_from(spark, labelled):
    """Texts of more characters than the sample takes are no longer left out: words that only they have are counted, but for those of texts that calibrate."""
    docs, labels = labelled
    long = [(5000 + i, f"only{i} " + "en9 en8 " * (op8_toxicity.MAX_CHARS // 8), "en") for i in range(12)]
    model = fit_toxicity(docs.union(spark.createDataFrame(long, docs.schema)), labels.union(spark.createDataFrame([(i, 0, 1) for i, _, _ in long], labels.schema)), epochs=1)
    bucket = [features(*bytes_of(f"only{i}"))[0][0, 0] % op8_toxicity.LANG_BUCKETS for i in range(12)]
    heard = (model.lang_logs[bucket].max(1) > model.lang_logs.min() + 1).sum()
    assert 4 <= heard <= 12
    alone = fit_toxicity(spark.createDataFrame(long, docs.schema), spark.createDataFrame([(i, i % 2, 1) for i, _, _ in long], labels.schema), epochs=1)
    assert score_texts(docs, alone).count() == 1200
