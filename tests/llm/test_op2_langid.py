import random

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from tidemill.llm.op2_langid import BITS, HashTable, LanguageModels, fit_languages, identify_languages, op2_langid

EN, DE = "the quick brown fox jumps over the lazy dog and runs", "der schnelle braune fuchs springt über den faulen hund und rennt"


def models(spark, docs):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(w) for _ in range(rng.randint(2, 12))), lang, "s") for lang, t in (("en", EN), ("de", DE)) for w in [t.split()] for i in range(80)]
    return fit_languages(docs(*rows))


class Slow:
    """Interpolated Kneser-Ney of one language, by dictionaries."""

    def __init__(self, sequences, order, size):
        self.order, self.size, self.levels = order, size, {}
        counts = {}
        for s in sequences:
            for i in range(order - 1, len(s)):
                gram = tuple(s[i - order + 1 : i + 1])
                counts[gram] = counts.get(gram, 0) + 1
        for n in range(order, 0, -1):
            once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
            self.levels[n] = counts, min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
            lower = {}
            for gram in counts:  # by how many different symbols a shorter one is preceded
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
            counts = lower

    def p(self, gram):
        if not gram:
            return 1 / self.size
        counts, discount = self.levels[len(gram)]
        after = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not after:
            return self.p(gram[1:])
        return max(counts.get(gram, 0) - discount, 0) / sum(after) + discount * len(after) / sum(after) * self.p(gram[1:])


def symbols_of(m, text):
    """Padding, then letters as symbols, and one 0 after each run of letters that something follows."""
    out = [0] * (m.order - 1)
    for k, c in enumerate(text.lower()):
        if c.isalpha():
            out.append(int(m.symbols(np.array([ord(c)]))[0]))
        elif k and text[k - 1].isalpha():
            out.append(0)
    return out


def test_against_dictionaries():
    """Cross-entropies and single probabilities are those of a plain implementation, in every language and order."""
    rows = [("en", t) for t in ("The dog, and a fox", "a fox ran", " the foxes")] + [("de", t) for t in ("der Hund und der Fuchs!", "ein Fuchs rannte", "über")]
    m = LanguageModels.fit(rows, order=4)
    slow = {x: Slow([symbols_of(m, t) for y, t in rows if y == x], 4, m.size) for x in m.langs}
    texts = ["the fox and the hound", "der fuchs", "  übermut zzz", "x", "dog  dog"]
    h, n, _ = m.cross_entropy(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        s = symbols_of(m, t)
        grams = [tuple(s[k - 3 : k + 1]) for k in range(3, len(s))]
        assert n[i] == len(grams)
        assert np.allclose(h[i], [-np.mean([np.log(slow[x].p(g)) for g in grams]) for x in m.langs], atol=1e-4)
    for order in range(1, 5):
        table, logs = m.grams[order - 1]
        for x, name in enumerate(m.langs):
            for gram in list(slow[name].levels[order][0])[:40]:
                code = sum(int(c) << (BITS * k) for k, c in enumerate(reversed(gram)))
                place, found = table.find(np.array([code], np.uint64))
                assert found[0] and abs(np.exp(logs[place[0], x]) - slow[name].p(gram)) < 1e-5


def test_probabilities_sum_to_one():
    """Interpolated probabilities of all symbols after a context add up to one, in each language and order."""
    m = LanguageModels.fit([("en", EN), ("en", "a fox"), ("de", DE)], order=4)
    slow = {x: Slow([symbols_of(m, t) for y, t in (("en", EN), ("en", "a fox"), ("de", DE)) if y == x], 4, m.size) for x in m.langs}
    for x in m.langs:
        for order in range(1, 5):
            for context in list({g[:-1] for g in slow[x].levels[order][0]})[:10]:
                assert abs(sum(slow[x].p((*context, c)) for c in range(m.size)) - 1) < 1e-9
    grams, logs = m.grams[0]
    place, found = grams.find(np.arange(m.size, dtype=np.uint64))
    assert found.all() and np.allclose(np.exp(logs[place]).sum(0), 1, atol=1e-4)


def test_neighbours_change_nothing():
    """A text's entropy does not depend on the texts before it."""
    m = LanguageModels.fit([("en", EN), ("de", DE)])
    together = m.cross_entropy(pa.array(["a fox", " the dog", "", "!x"], pa.large_string()))
    alone = [m.cross_entropy(pa.array([t], pa.large_string())) for t in ("a fox", " the dog", "", "!x")]
    assert np.allclose(together[0], np.concatenate([a[0] for a in alone]), atol=1e-6) and together[1].tolist() == [int(a[1][0]) for a in alone]


def test_hash_table():
    codes = np.unique(np.random.default_rng(0).integers(0, 2**40, 5000, dtype=np.uint64))
    t = HashTable(codes)
    place, found = t.find(codes)
    assert found.all() and (codes[t.order][place] == codes).all()
    assert not t.find(codes + np.uint64(2**41))[1].any()


def test_prediction(spark, docs):
    m = models(spark, docs)
    rows = [(1, "the dog runs over the fox"), (2, "der hund rennt und springt"), (3, None), (4, ""), (5, "123 !?"), (6, "THE DOG " * 20_000), (7, "zzqx qqzx xzqj jjqx zxqq " * 30), (1, "the dog runs over the fox"), (None, "der hund")]
    df = identify_languages(docs(*((i, t, None, None) for i, t in rows)), m)
    assert [c for c in df.columns if c in ("lang_pred", "score")] == ["lang_pred", "score"]
    out = df.collect()
    assert [r["lang_pred"] for r in out] == ["en", "de", "und", "und", "und", "en", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in out) and out[0]["score"] == out[7]["score"] and out[2]["score"] == 0
    assert identify_languages(docs((1, "x", None, None)).limit(0), m).count() == 0


def test_no_models(spark, docs):
    nothing = fit_languages(docs((1, None, "en", None), (2, "text", None, None)))
    assert nothing.predict(pa.array(["text"], pa.large_string()))[0] == ["und"]


def test_query_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op2_langid(spark, sf_dir).collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(truth) and len(held) > 20
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert isinstance(fit_languages(spark.read.parquet(f"{sf_dir}/documents.parquet")), LanguageModels)


def test_every_language(spark, docs):
    """More languages than one table has: the rarest is fitted too, with texts that are all long, and tables by groups say what one table says."""
    rng = random.Random(2)
    words = {f"x{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(70)}
    line = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(x, line(x, 30)) for x in words for _ in range(6)] + [("rare", "zyx wvu tsr " * 5_000)]
    m = fit_languages(docs(*((i, t, x, "s") for i, (x, t) in enumerate(rows))))
    assert m.langs == ["rare", *sorted(words)]
    texts = pa.array(["wvu zyx tsr zyx wvu tsr " * 3, *(line(x, 30) for x in words)], pa.large_string())
    assert m.predict(texts)[0] == ["rare", *words]
    many = LanguageModels.fit(rows[:204])
    assert not LanguageModels.fit(rows[:66]).parts and [len(p.langs) for p in many.parts] == [16, 16, 2]
    whole = LanguageModels(many.langs, many.alphabet, many.order)
    seen = [np.unique(many.sequences(pa.array([t for y, t in rows[:204] if y == x], pa.large_string()))[0], return_counts=True) for x in many.langs]
    whole._count(seen)
    assert np.allclose(whole.cross_entropy(texts)[0], many.cross_entropy(texts)[0], atol=1e-4)


def test_repeated_texts(spark, docs):
    """A language of few texts in very many copies is learned, and copies do not reach the driver."""
    texts = {"en": "the quick dog runs over there", "de": "der schnelle hund rennt dorthin", "fr": "le chien court vite la bas"}
    rows = [(i, f"{texts[x]} {i % 3}", x, "s") for x, n in (("en", 3), ("de", 3), ("fr", 10_000)) for i in range(n)]
    df = docs(*rows).repartition(7)
    seen = []
    own = DataFrame.collect
    DataFrame.collect = lambda self: seen.append(own(self)) or seen[-1]
    try:
        m = fit_languages(df)
    finally:
        DataFrame.collect = own
    assert m.langs == ["de", "en", "fr"] and max(map(len, seen)) == 9
    assert m.predict(pa.array([t for t in texts.values()], pa.large_string()))[0] == list(texts)


def test_scripts_stay_apart():
    """Letters of rare scripts are not run together by a language that has many letters."""
    rng = random.Random(3)
    han, ka, hy = ([chr(a + k) for k in range(n)] for a, n in ((0x4E00, 600), (0x10D0, 33), (0x561, 38)))
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(40))
    m = LanguageModels.fit([("zh", text(han)) for _ in range(100)] + [(x, text(letters)) for x, letters in (("ka", ka), ("hy", hy)) for _ in range(10)])
    assert m.predict(pa.array([text(x) for x in (ka, hy, ka, hy, han, han)], pa.large_string()))[0] == ["ka", "hy", "ka", "hy", "zh", "zh"]
    assert len({int(m.symbols(np.array([ord(x)]))[0]) for x in ka + hy}) == len(ka + hy) and m.scripts == ["CJK"]
    assert m.symbols(np.array([0x9FA0, 0x430])).tolist() == [m.size - 1, 1]
