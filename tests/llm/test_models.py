import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from fluxpanel.llm import learning, mixing, ngrams, quality_kernel, quality_rules, runtime, toxicity
from fluxpanel.llm.docstats import doc_stats

from .conftest import ODD, SCHEMA, invented


@pytest.fixture(scope="module")
def world(spark):
    """Clean, shouting and symbol-ridden texts, and toxic ones with terms of their own."""
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(400):
        text, quality, toxic = invented(rng, rng.randint(30, 120)), 1, 0
        if k % 7 == 0:
            text, quality = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif k % 7 == 1:
            text, quality = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split()), 0
        elif k % 7 in (2, 3):
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorgblat", "zorgblit", "moron"]))
            text, toxic = " ".join(words), 1
        rows.append((k, text, "en", "s", len(text)))
        if k % 10:
            labels.append((k, quality, toxic))
    rows += [(400 + k, t, "en", "s", None) for k, t in enumerate(ODD)] + [(None, "null id", "en", "s", None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def accuracy(got, labels, column):
    truth = {r[0]: r[column] for r in labels}
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    return learning.roc_area(np.array([s for s, _ in held]), np.array([y for _, y in held]))


def test_rules(world):
    docs, labels, rows, _ = world
    got = {r["doc_id"]: r for r in quality_rules.rules_digest(docs, labels).collect()}
    for k, text, *_ in rows:
        r, text = got[k], text or ""
        w = text.encode().split()
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {g for g in five if five.count(g) > 1} if len(five) < 500 else set(five)
        covered = {j for i, g in enumerate(five) if g in twice for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        base = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (r["kept"] and r["base_failed"])
    clean = [got[k]["kept"] for k in range(400) if k % 7 > 3 and not got[k]["base_failed"]]
    junk = [got[k]["kept"] for k in range(400) if k % 7 < 2]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1


def test_kernel(world):
    docs, labels, _, known = world
    got = quality_kernel.quality_digest(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 3 == 1)
    assert accuracy(got, known, 1) > 0.97


def test_toxicity(world):
    docs, labels, _, known = world
    got = toxicity.toxicity_digest(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert accuracy(got, known, 2) > 0.97


def test_models_without_labels(spark, world, nothing):
    docs, labels, *_ = world
    none = labels.limit(0)
    assert {r["score"] for r in quality_kernel.quality_digest(docs, none).collect()} == {0.5}
    assert toxicity.toxicity_digest(docs, none).count() == docs.count()
    assert quality_rules.rules_digest(docs, none).count() == docs.count()
    assert mixing.mixing_digest(docs, none).count() == docs.count()
    for digest in (quality_kernel.quality_digest, toxicity.toxicity_digest, quality_rules.rules_digest, mixing.mixing_digest):
        assert digest(nothing, labels).count() == 0


def test_held_out_labels_do_not_matter(spark, world):
    docs, labels, *_ = world
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(learning.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned = turned.withColumn("quality", F.when(learning.fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    for digest in (toxicity.toxicity_digest, quality_kernel.quality_digest):
        a, b = ({r["doc_id"]: r["score"] for r in digest(docs, x).collect()} for x in (labels, turned))
        assert a == pytest.approx(b, abs=1e-9)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = [toxicity.Term(t, True, 1.0) for t in ("idiot", "moron", "scum", "worthless")]
    automaton = toxicity.Automaton(terms)
    rng = random.Random(1)
    for _ in range(400):
        word = list(rng.choice(terms).text)
        for _ in range(rng.randint(0, 2)):
            at, kind = rng.randrange(len(word)), rng.randint(0, 2)
            word[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abimrot")]
            word = word or ["x"]
        text = "".join(word)
        _, hits = toxicity.hit_inputs([f"so {text} so".encode()], automaton)
        best = min((edits(text, t.text) for t in terms if len(t.text) >= toxicity.FUZZY or t.text == text), default=9)
        assert [h["edits"] for h in hits[0]] == ([best] if best <= 1 else [])


def test_context_sums_against_brute_force():
    """Every input of a text from its hits, counted word by word."""
    import random
    import re

    terms = [toxicity.Term("grublak", False, 3.0), toxicity.Term("snorf", True, 2.0), toxicity.Term("zog", True, 5.0)]
    automaton, rng = toxicity.Automaton(terms), random.Random(2)
    pool = ["grublak", "grublakish", "grublok", "snorf", "snorv", "zog", "calm", "day", "tree", "sun"]
    texts = [" ".join(rng.choice(pool[4 * (k % 2) :]) for _ in range(rng.randint(1, 90))) for k in range(40)]
    rows, hits = toxicity.hit_inputs([t.encode() for t in texts], automaton)
    weight = {t.text: t.weight for t in terms}
    for text, row, found in zip(texts, rows, hits, strict=True):
        words = [m.span() for m in re.finditer(r"\w+", text)]
        at = {w: k for k, (w, _) in enumerate(words)}
        place = [(at[h["start"]], h["edits"], weight[h["term"]]) for h in found]
        share = lambda e: toxicity.MISSPELLED if e else 1.0
        around = lambda own: max((sum(v for q, v in own if abs(q - p) <= toxicity.NEAR) for p, _ in own), default=0.0)
        exact, every = [(p, 1.0) for p, e, _ in place if not e], [(p, share(e)) for p, e, _ in place]
        expected = [
            np.log1p(len(exact)), np.log1p(len(place) - len(exact)), 0.0, max((share(e) * w for _, e, w in place), default=0.0) / 5,
            np.log1p(around(exact)), np.log1p(100 * len(exact) / len(words)), np.log1p(around(every)), np.log1p(100 * sum(v for _, v in every) / len(words)),
        ]
        assert np.allclose(row, expected), (text, row, expected)
    assert sum(h["edits"] for found in hits for h in found) > 20


def test_context():
    automaton = toxicity.Automaton([toxicity.Term("idiot", True, 3.0), toxicity.Term("zorg", False, 3.0)])
    texts = ['you idiot, you zorgblat', 'the word "idiot" here', "he said idiot once", "«idiot» un", "idiott idoit", "zor zo", None]
    rows, hits = toxicity.hit_inputs([t and t.encode() for t in texts], automaton)
    assert [len(h) for h in hits] == [2, 1, 1, 1, 1, 0, 0]
    assert [h[0]["quoted"] for h in hits[:4]] == [False, True, True, True]
    assert rows[0, 0] > rows[1, 0] == 0 and rows[1, 2] > 0 and hits[4][0]["edits"] == 1
    assert texts[0][hits[0][1]["start"] : hits[0][1]["end"]] == "zorgblat"


def test_quotation_is_of_the_whole_line():
    automaton = toxicity.Automaton([toxicity.Term("idiot", True, 3.0)])
    far = "far away " * 40
    texts = [
        f'"{far}" you idiot "x"', f'"{far}idiot {far}"', f"“{far}idiot {far}”", f"“{far}” idiot {far}”", f'"{far}\nidiot" so', f'{far}" so idiot',
        f"„{far}idiot {far}“", f"he said idiot {far}", f"said {far}idiot", "said\nidiot",
    ]
    _, hits = toxicity.hit_inputs([t.encode() for t in texts], automaton)
    assert [[h["quoted"] for h in own] for own in hits] == [[k in (1, 2, 6, 7)] for k in range(len(texts))]


def test_words_of_three_letters_are_learned_whole(spark):
    rng = random.Random(4)
    rows = [(k, invented(rng, 30) + (" zog" if k % 2 else " zogalo"), k % 2) for k in range(120)]
    terms = {t.text: t for t in toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, label int"))}
    assert terms["zog"].whole
    _, hits = toxicity.hit_inputs([b"a zog here", b"a zogalo here"], toxicity.Automaton(list(terms.values())))
    assert [[h["term"] for h in own] for own in hits] == [["zog"], []]


def test_kernel_scores_match_dense_normal_equations(world):
    """Weights of the partition-summed equations beside those of one dense matrix."""
    docs, labels, *_ = world
    own = docs.select("doc_id", "text").repartition(7)
    described = runtime.map_batches(own, quality_kernel._described, "doc_id long, statistics array<double>")
    kernel = quality_kernel.train(learning.materialise(described), labels, learning.fold("doc_id", 3) != 1)
    label = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["quality"] is not None}
    found = [(r["statistics"], label[r["doc_id"]]) for r in described.collect() if r["doc_id"] in label]
    x, y = np.array([f[0] for f in found]), np.array([f[1] for f in found], float)
    np.testing.assert_allclose(kernel.mean, x.mean(0), rtol=1e-9, atol=1e-12)
    z = kernel.features(x)
    dense = np.linalg.solve(z.T @ z + quality_kernel.RIDGE * len(y) * np.eye(z.shape[1]), z.T @ y)
    np.testing.assert_allclose(z @ kernel.weights, z @ dense, atol=1e-7)
    assert (np.diff(kernel.chances) >= 0).all()


def test_sparse_fit_matches_a_dense_one():
    """The same steps on a dense matrix; and calibration by a logistic of the margin."""
    rng = np.random.default_rng(8)
    dense = rng.random((60, 40)) * (rng.random((60, 40)) < 0.3)
    y = (dense @ rng.normal(size=40) + 0.3 * rng.normal(size=60) > 0).astype(int)
    x = learning.SparseRows.of([(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense])
    w, b = learning.sparse_softmax(x, y, 40, 2, 1e-6, 80)
    target = np.eye(2)[y]
    v, c = np.zeros((40, 2)), np.log(target.mean(0))
    moments = [np.zeros_like(v), np.zeros_like(v), np.zeros(2), np.zeros(2)]
    for t in range(1, 81):
        p = np.exp(dense @ v + c)
        p = (p / p.sum(1, keepdims=True) - target) / 60
        for k, (what, g, rate) in enumerate(((v, dense.T @ p + 1e-6 * v, 0.5), (c, p.sum(0), 0.05))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            what -= rate * (1 - t / 81) * (moments[2 * k] / (1 - 0.9**t)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**t)) + 1e-8)
    np.testing.assert_allclose(w, v, atol=1e-3)
    np.testing.assert_allclose(b, c, atol=1e-3)
    margin = rng.normal(size=(400, 1)) * 2
    seen = (rng.random(400) < learning.sigmoid(1.7 * margin[:, 0] - 0.4)).astype(float)
    scale, shift = learning.logistic(margin, seen, 1e-3)
    chance = learning.sigmoid(scale * margin[:, 0] + shift)
    assert abs(np.sum(chance - seen)) < 1e-2 and abs(np.mean((chance - seen) * margin[:, 0]) + 1e-3 * scale) < 1e-6


def test_training_rows_are_bounded_in_bytes(world, monkeypatch):
    docs, labels, *_ = world
    rows = learning.labelled(docs, labels, "quality", F.lit(True), 100)
    whole = ngrams._bounded(runtime.map_batches(rows, ngrams._featured, "doc_id long, label int, index binary, value binary"))
    monkeypatch.setattr(ngrams, "TRAINING_BYTES", 50_000)
    part = ngrams._bounded(runtime.map_batches(rows, ngrams._featured, "doc_id long, label int, index binary, value binary"))
    assert 0 < len(part) < len(whole) and sum(2 * len(r["index"]) for r in part) <= 50_000
    assert [r["doc_id"] for r in part] == sorted(r["doc_id"] for r in part) and {r["doc_id"] for r in part} < {r["doc_id"] for r in whole}


def test_ids_of_other_types(spark, world):
    """Text ids; labels with such ids, and labels whose ids cannot be any of them."""
    docs, labels, *_ = world
    some, more = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for digest in (quality_kernel.quality_digest, toxicity.toxicity_digest, quality_rules.rules_digest, mixing.mixing_digest):
        assert dict(digest(some, more).dtypes)["doc_id"] == "string"
        assert digest(some, more).count() == digest(docs, more).count() == docs.count()


def test_columns_that_clash(world):
    docs, labels, *_ = world
    odd = docs.withColumns({"kept": F.lit("x"), "score": F.lit("x"), "copies": F.lit("x"), "label": F.lit("x")})
    out = quality_rules.apply_rules(odd, quality_rules.train(odd, labels))
    assert dict(out.dtypes)["kept"] == "boolean" and dict(out.dtypes)["score"] == "string"
    out = mixing.mix_rows(odd, mixing.train(odd, labels))
    assert dict(out.dtypes)["copies"] == "int" and dict(out.dtypes)["label"] == "string"


def test_mixing_meets_targets(world):
    docs, labels, *_ = world
    got = mixing.mixing_digest(docs, labels).collect()
    n = np.array([r["n_tokens"] for r in got], float)
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got])
    rate = np.array([r["rate"] for r in got])
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1)
    share = (n * rate) @ p / n.sum()
    wanted = np.array(mixing.TARGETS)
    assert (np.abs(share - wanted) <= np.where(wanted > 0, 0.05 * wanted, 0.004)).all()
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in got)


def test_mixing_settles_near_its_targets(world):
    """Far below the smallest target that is not zero; and no rate can still improve."""
    docs, labels, *_ = world
    got = mixing.mixing_digest(docs, labels).collect()
    n = np.array([r["n_tokens"] for r in got], float)
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got])
    rate = np.array([r["rate"] for r in got])
    share, wanted = (n * rate) @ p / n.sum(), np.array([0.94, 0.06, 0.0])
    assert np.abs(share - wanted).max() < 0.004
    gradient = p @ ((share - wanted) / (n @ p / n.sum())) + mixing.PULL * (rate - 1)
    assert np.abs(gradient[rate > 0]).max() < 1e-8 and (gradient[rate == 0] > -1e-8).all()


def test_rates_that_do_not_settle_are_an_error(spark):
    df = spark.createDataFrame([(5, [0.5, 0.3, 0.2]), (7, [0.1, 0.2, 0.7])], "n_tokens long, posteriors array<double>")
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fit_rates(df, steps=3)
    assert mixing.fit_rates(df.limit(0)) == []


def newton(p, n, wanted, pull):
    """The same rates another way: each is max(0, 1 - p m / pull) for a multiplier m a
    domain, the minimum of a convex function of these few numbers."""
    w, shares = n / n.sum(), np.maximum(n @ p / n.sum(), 1e-6)
    x = np.zeros(p.shape[1])

    def at(x):
        r = np.maximum(0, 1 - p @ x / pull)
        return x * x @ shares / 2 + x @ wanted + pull * (w @ r**2) / 2, shares * x + wanted - (w * r) @ p, np.diag(shares) + (p * (w * (r > 0))[:, None]).T @ p / pull

    for _ in range(200):
        value, slope, curve = at(x)
        step, size = np.linalg.solve(curve, slope), 1.0
        while at(x - size * step)[0] > value - 1e-4 * size * (slope @ step) and size > 1e-9:
            size /= 2
        x = x - size * step
        if np.abs(slope).max() < 1e-13:
            break
    return np.maximum(0, 1 - p @ x / pull)


@pytest.mark.parametrize("pull", [0.05, 1e-3])
@pytest.mark.parametrize("targets", [(0.7, 0.25, 0.05), (0.94, 0.06, 0.0), (0.0, 0.0, 1.0)])
def test_rates_match_a_direct_solution(spark, pull, targets):
    rng = np.random.default_rng(0)
    p = mixing.on_grid(rng.dirichlet([0.3, 0.3, 0.3], 600))
    n = np.concatenate((rng.integers(0, 50, 599), [30000])).astype(float)
    df = spark.createDataFrame([(int(k), row.tolist()) for k, row in zip(n, p, strict=True)], "n_tokens long, posteriors array<double>").repartition(3)
    steps = mixing.fit_rates(df, targets, pull)
    r = mixing.rates(p, steps, pull)[0]
    assert np.abs(r - newton(p, n, np.array(targets), pull)).max() < 1e-5 and len(steps) < 300
    slope = ((r * n) @ p / n.sum() - np.array(targets)) / np.maximum(n @ p / n.sum(), 1e-6)
    g = mixing.gradient(p, r, slope, pull)
    assert np.abs(g[(r > 0) & (n > 0)]).max() < 1e-7 and (g[(r == 0) & (n > 0)] > -1e-7).all()


def test_rates_settle_where_many_stay_at_zero(spark):
    """Shares like those of the pipeline's documents; what stays at rate 0 is no curvature."""
    rng = np.random.default_rng(11)
    p, n = mixing.on_grid(rng.dirichlet([3, 0.5, 0.1], 600)), rng.integers(1, 20000, 600)
    df = spark.createDataFrame([(int(k), row.tolist()) for k, row in zip(n, p, strict=True)], "n_tokens long, posteriors array<double>").repartition(3)
    steps = mixing.fit_rates(df)
    r = mixing.rates(p, steps, mixing.PULL)[0]
    assert len(steps) < 200 and (r == 0).mean() > 0.2
    assert np.abs(r - newton(p, n.astype(float), np.array(mixing.TARGETS), mixing.PULL)).max() < 1e-4


def test_posteriors_on_the_grid():
    rng = np.random.default_rng(1)
    p = np.concatenate((rng.dirichlet([0.2, 0.2, 0.2], 500), np.eye(3), np.full((1, 3), 1 / 3), [[0.5, 0.5, 0.0]]))
    q = mixing.on_grid(p)
    assert (q.sum(1) == 1).all() and (q >= 0).all() and np.abs(p - q).max() < 1 / mixing.GRID and (q * mixing.GRID == np.round(q * mixing.GRID)).all()


def test_isotonic():
    y = np.array([0.0, 2, 1, 3, 2, 4])
    n = np.full(6, 4.0)
    fit = learning.isotonic(np.arange(6), y, n)
    assert (np.diff(fit) >= 0).all() and np.allclose(fit, [0, 0.375, 0.375, 0.625, 0.625, 1.0])


def test_sparse_rows():
    rng = np.random.default_rng(1)
    dense = rng.random((20, 50)) * (rng.random((20, 50)) < 0.2)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense]
    x = learning.SparseRows.of(rows)
    w = rng.random((50, 3))
    assert np.allclose(x.dot(w), dense @ w, atol=1e-5)
    p = rng.random((20, 3))
    assert np.allclose(x.gather(p, 50), dense.T @ p, atol=1e-5)


def test_odd_texts_have_counts():
    stats = doc_stats([None if t is None else t.encode() for t in ODD])
    assert len(stats.n_words) == len(ODD)
