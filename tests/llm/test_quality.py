"""The classifier: a slow Kneser-Ney model, held-out accuracy, shards, scripts and edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import quality
from tessera.llm.common import written


class Slow:
    """Interpolated modified Kneser-Ney by its definition."""

    def __init__(self, texts):
        counts = Counter()
        for t in texts:
            s = quality.PAD + quality.symbols(t)
            counts.update(s[i - quality.ORDER + 1 : i + 1] for i in range(len(quality.PAD), len(s)))
        self.c = {quality.ORDER: counts}
        for k in range(quality.ORDER - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d = {k: quality.discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for k, c in self.c.items()}
        self.total, self.left = defaultdict(float), defaultdict(float)
        for k, c in self.c.items():
            for g, n in c.items():
                self.total[g[:-1], k] += n
                self.left[g[:-1], k] += self.d[k][min(n, 3) - 1]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / (len(self.c[1]) + 1)
        total = self.total.get((g[:-1], k))
        if not total:
            return self.p(g[1:])
        n = self.c[k].get(g, 0)
        return (max(n - self.d[k][min(n, 3) - 1], 0) if n else 0) / total + self.left[g[:-1], k] / total * self.p(g[1:])

    def nll(self, text):
        s = quality.PAD + quality.symbols(text)
        return -sum(math.log(self.p(s[i - quality.ORDER + 1 : i + 1])) for i in range(len(quality.PAD), len(s)))


def test_symbols():
    assert quality.symbols("a A a") == "a A a" and quality.symbols("ab ab ab  c") == "ab\x03ab\x03ab  c" and quality.symbols("") == ""


def test_discounts():
    d = quality.discounts([100, 40, 20, 10])
    y = 100 / 180
    assert np.allclose(d, [1 - 2 * y * 40 / 100, 2 - 3 * y * 20 / 40, 3 - 4 * y * 10 / 20]) and quality.discounts([5, 0, 1, 1]) == [0.5, 0.75, 0.9]


@pytest.mark.parametrize("shard_rows", [10**9, 400])
def test_equals_slow_model(spark, shard_rows):
    r = random.Random(5)
    parts = ["the", "and", "ing", "é", "привет", "語", "🚀", " ", " ", ".", "A", "\n", "th th"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(120)]
    new = ["".join(r.choice([*parts, "Z", "ξ", "x y"]) for _ in range(r.randint(0, 40))) for _ in range(60)] + texts[:5]
    slow = Slow(texts)
    symbols_ = sorted(slow.c[1])
    assert abs(sum(slow.p("th" + s) for s in symbols_) + slow.p("th") - 1) < 1e-9
    model = quality.estimated(written(quality.top_counts(spark.createDataFrame([(t,) for t in texts], "text string")), "kn_test"))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(new)], "doc_id long, text string, lang string")
    got = {x.id: x for x in quality.likelihoods(quality.keyed(docs, "doc_id", "text", "lang"), model, shard_rows).collect()}
    assert len(got) == len(new) and (shard_rows > 400 or 2 * model.rows > 3 * shard_rows)
    for i, t in enumerate(new):
        assert got[i].n == len(quality.symbols(t)) and got[i].times == 1 and abs(got[i].nll - slow.nll(t)) < 1e-4 * (1 + got[i].nll), t


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    stems = {"en": ["the", "tion", "ing", "er", "and", "wh"], "ru": ["при", "ста", "ого", "ени", "не", "во"]}
    rows, labels = [], []
    for i in range(900):
        lang = ("en", "ru")[i % 2]
        words = ["".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3))) for _ in range(40)]
        good = i % 5 != 0
        if not good:
            noise = ["".join(r.choice("абвгдежзиклмнопрстуфхцчшщэюя" if lang == "ru" else "abcdefghijklmnopqrstuvwxyz") for _ in w) for w in words]
            words = [[w.upper() + "!!" for w in words], [w + "%%%" for w in words], [words[0]] * 40, noise][i // 5 % 4]
        rows.append((i, " ".join(words), lang, "src", len(words)))
        labels.append((i, int(good), 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).persist(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").persist(), {i: g for i, g, _ in labels}


def test_held_out_accuracy(spark, corpus):
    docs, labels, good = corpus
    train = labels.where("doc_id < 600")
    rows = quality.classified(docs, train).collect()
    got = {x.doc_id: x.keep for x in rows if x.doc_id >= 600}
    assert sum(got[i] for i in got if good[i]) / sum(1 for i in got if good[i]) >= 0.95
    assert sum(not got[i] for i in got if not good[i]) / sum(1 for i in got if not good[i]) >= 0.95
    assert len({x.threshold for x in rows}) == 2  # one a language


def test_filter_agrees_and_keeps_columns(spark, corpus):
    docs, labels, _ = corpus
    odd = docs.limit(30).withColumnRenamed("source", "k1").withColumnRenamed("n_chars", "_hit2")
    kept = quality.filtered(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in quality.classified(docs, labels).where("keep").collect())
    assert quality.filtered(odd, labels).columns == odd.columns


def test_edges(spark, corpus):
    docs, labels, _ = corpus
    odd = spark.createDataFrame([(None, "the and", None, None, None), (9001, None, "en", "s", 0), (9002, "", "xx", "s", 0), (9003, "the " * 30_000, "en", "s", 1), (9003, "whing", "en", "s", 1), (9004, "Z%Z%" * 30, None, "s", 1), (9004, "Z%Z%" * 30, None, "s", 1)], docs.schema)
    got = quality.classified(docs.union(odd), labels.union(labels)).where("doc_id is null or doc_id > 9000").collect()
    assert len(got) == 7 and all(x.keep and x.perplexity is None for x in got if x.doc_id in (9001, 9002)) and not [x.keep for x in got if x.n_symbols > 1000][0]
    assert [x.keep for x in got if x.doc_id == 9004] == [False, False]
    kept = quality.filtered(docs.union(odd), labels).where("doc_id > 9000").collect()
    assert sorted(x.doc_id for x in kept) == sorted(x.doc_id for x in got if x.keep and x.doc_id)
    untrained = quality.classified(odd, labels.limit(0)).collect()
    assert len(untrained) == 7 and all(x.keep and x.perplexity is None for x in untrained)
    assert quality.filtered(odd, labels.limit(0)).count() == 7
    assert quality.classified(docs.limit(0), labels).collect() == [] and quality.filtered(docs.limit(0), labels).collect() == []
