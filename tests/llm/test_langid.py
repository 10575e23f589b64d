import math
from collections import Counter, defaultdict

import numpy as np

from korpusa.llm import common
from korpusa.llm import langid as L


def test_kneser_ney_equals_plain_formula():
    order, texts = 3, ["abracadabra abba", "banana bandana"]
    counted, plain = [], []
    for t in texts:
        cp = np.concatenate([np.full(order - 2, 32, np.uint32), L.symbols(t)])
        grams = [tuple(cp[i : i + order].tolist()) for i in range(len(cp) - order + 1)]
        c = Counter(grams)
        counted.append((np.array(list(c), np.uint32), np.array(list(c.values()))))
        plain.append(c)
    model = L.Model.build(["a", "b"], counted, order)

    def prob(c, g):
        levels = {order: c}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(x[1:] for x in levels[k + 1])
        p = 1 / model.size
        for k in range(1, order + 1):
            own = g[order - k :]
            total = sum(n for x, n in levels[k].items() if x[:-1] == own[:-1])
            if total:
                kinds = sum(1 for x in levels[k] if x[:-1] == own[:-1])
                off = L.discount(sum(n == 1 for n in levels[k].values()), sum(n == 2 for n in levels[k].values()))
                p = max(levels[k][own] - off, 0) / total + off * kinds / total * p
        return p

    for g in [*plain[0], *plain[1], (122, 122, 122), (32, 97, 122)]:
        got = model.log_probs(np.array([g], np.uint32))[0]
        for lang in range(2):
            assert math.isclose(got[lang], math.log(prob(plain[lang], g)), rel_tol=1e-5)
    seen = defaultdict(float)
    for c in model_chars(plain):
        seen["sum"] += math.exp(model.log_probs(np.array([(97, 98, c)], np.uint32))[0][0])
    assert seen["sum"] < 1.0 + 1e-5


def model_chars(plain):
    return {x for c in plain for g in c for x in g}


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog sat there on that mat", "en")] * 20 + [("le chat et le chien sont la dans la maison", "fr")] * 20)]
        + [(90, None, None, "s"), (91, "", "en", "s"), (92, "123 !?", None, "s"), (92, "123 !?", None, "s"), (93, "THE DOG AND THE CAT", None, "s"), (None, "le chien", None, "s"), (94, "chat " * 40000, None, "s")],
        "doc_id long, text string, lang string, k string",
    )
    got = L.predict(df.select("doc_id", "text"), L.train(df)).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (90, 91, 92))
    assert by[93].lang_pred == "en" and by[None].lang_pred == "fr" and by[94].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got)
    assert L.predict(df.select("doc_id", "text").limit(0), L.train(df)).collect() == []
    assert {r.lang_pred for r in L.predict(df.select("doc_id", "text"), L.train(df.limit(0))).collect()} == {"und"}


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in L.query(spark, sf).collect() if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in got)
    assert right >= 0.97 * len(got)


def test_tables_score_as_arrays_do(spark, monkeypatch, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.where("doc_id < 60").unionByName(spark.createDataFrame([(1000, None, None), (1001, "12 !", "en"), (None, "zq😀xj 中文", None)], docs.schema))
    small = L.train(docs)
    assert isinstance(small, L.Model)
    monkeypatch.setattr(L, "MOST_SHIPPED", 10)
    monkeypatch.setattr(L, "SMALL", 500)
    monkeypatch.setattr(common, "HEAVY", 40)
    large = L.train(docs)
    assert isinstance(large, L.TableModel) and large.languages == small.languages and np.allclose(large.limits, small.limits, rtol=0, atol=1e-6)
    rows = lambda m: sorted(((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.rejected, r.score, r.entropy) for r in L.predict(docs, m).collect()))
    a, b = rows(small), rows(large)
    assert [x[:4] for x in a] == [x[:4] for x in b] and np.allclose([x[4:] for x in a], [x[4:] for x in b], rtol=0, atol=1e-6)


def test_prediction_equals_plain_scoring(spark):
    """Verdicts of predict() against a plain dictionary model, ties included (two languages with the same texts)."""
    rng = np.random.default_rng(3)
    words = {"aa": ["ba", "bo", "bi", "lam"], "bb": ["kri", "kra", "zot", "lam"], "cc": ["kri", "kra", "zot", "lam"]}
    rows = [(i, " ".join(rng.choice(words[x], 30)), x) for i, x in enumerate(["aa", "bb"] * 25)]
    rows += [(i + 500, t, "cc") for i, t, x in rows if x == "bb"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {x: Counter() for x in words}
    for _, t, x in rows:
        cp = [32] * (L.ORDER - 2) + L.symbols(t).tolist()
        counts[x].update(tuple(cp[i : i + L.ORDER]) for i in range(len(cp) - L.ORDER + 1))
    levels = {}
    for x, c in counts.items():
        levels[x] = {L.ORDER: c}
        for k in range(L.ORDER - 1, 0, -1):
            levels[x][k] = Counter(g[1:] for g in levels[x][k + 1])
    size = len({c for x in counts.values() for g in x for c in g}) + 1
    offs, sums, kinds = {}, {}, {}
    for x in words:
        for k, c in levels[x].items():
            offs[x, k] = L.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
            for g, n in c.items():
                sums[x, g[:-1]] = sums.get((x, g[:-1]), 0) + n
                kinds[x, g[:-1]] = kinds.get((x, g[:-1]), 0) + 1

    def entropy(x, text):
        cp = [32] * (L.ORDER - 2) + L.symbols(text).tolist()
        grams, total = [tuple(cp[i : i + L.ORDER]) for i in range(len(cp) - L.ORDER + 1)], 0.0
        for g in grams:
            p = 1 / size
            for k in range(1, L.ORDER + 1):
                own = g[L.ORDER - k :]
                s = sums.get((x, own[:-1]), 0)
                if s:
                    off = offs[x, k]
                    p = max(levels[x][k][own] - off, 0) / s + off * kinds[x, own[:-1]] / s * p
            total -= math.log(p)
        return total / len(grams)

    probes = spark.createDataFrame([(i, " ".join(rng.choice(words[x] + ["nov"], 12)), 1.5, "keep") for i, x in enumerate(["aa", "bb", "cc"] * 8)], "doc_id long, text string, score double, lang_pred string")
    got = L.predict(probes, L.train(df))
    assert got.columns[:4] == probes.columns and len(set(got.columns)) == 8
    for r in got.collect():
        e = {x: entropy(x, r.text) for x in words}
        want = "bb" if e["bb"] < e["aa"] else "aa"
        assert tuple(r)[4] == want and r.score == 1.5 and r.lang_pred == "keep" and math.isclose(r.entropy, e[want], rel_tol=1e-4)
    assert L.keep_known(probes, L.train(df)).columns == probes.columns


def test_limits_come_from_all_training_texts(spark):
    from types import SimpleNamespace

    own = [("a", i / 1000, 500) for i in range(10_000)] + [("b", 1.0, 500)] * 3 + [("b", 99.0, L.LEAST_SIZE - 1)]
    model = SimpleNamespace(languages=["a", "b", "c"], limits=np.full(3, np.inf))
    L.calibrate(model, spark.createDataFrame(own, "lang string, e double, size long"))
    assert model.limits.tolist() == [9.949, 1.0, np.inf]
