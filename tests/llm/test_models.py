"""The fitted models: exact inference against enumeration, held-out accuracy, and odd inputs."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowtext.llm import quality_crf as crf
from sparrowtext.llm import toxicity as tox


def test_marginals():
    rng = np.random.default_rng(0)
    bound = np.array([0, 0, 1, 5, 8, 8, 14])
    score, tr = rng.normal(size=14) * 3, rng.normal(size=(2, 2))
    p, pairs, log_z = crf.forward_backward(score, bound, tr)
    want, want_pairs, want_z = np.zeros(14), np.zeros((2, 2)), 0.0
    for a, b in zip(bound, bound[1:], strict=False):
        if a == b:
            continue
        total, good, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(score[a + k] * v for k, v in enumerate(y)) + sum(tr[u, v] for u, v in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
            for u, v in zip(y, y[1:], strict=False):
                two[u, v] += w
        want[a:b], want_pairs, want_z = good / total, want_pairs + two / total, want_z + np.log(total / 2)
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


VOICES = [f"{a}{b}" for a in ("ther", "on", "ing", "st", "wh", "ed", "le") for b in ("an", "ou", "er", "is", "al")]


def sentence(rnd):
    return " ".join(rnd.choice(VOICES) for _ in range(rnd.randint(4, 14))).capitalize() + "."


def document(rnd, good):
    lines = [sentence(rnd) for _ in range(rnd.randint(2, 8))]
    if not good:
        spoil = rnd.choice((lambda s: s.upper().replace(" ", "!! "), lambda s: s.replace(" ", "%%% "), lambda s: " ".join([s.split()[0]] * 20)))
        lines = [x if rnd.random() < 0.15 else spoil(x) for x in lines]
    return "\n".join(lines)


def test_quality(spark):
    rnd = random.Random(0)
    rows = [(i, document(rnd, i % 3 > 0)) for i in range(400)]
    odd = [(900, None), (901, ""), (902, " \n\n "), (None, rows[1][1]), (1, rows[1][1]), (903, "\n".join(sentence(rnd) for _ in range(3000))), (904, " ".join(sentence(rnd) for _ in range(3000)))]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string")
    labels = [(i, int(i % 3 > 0)) for i in range(200)] + [(5, None), (None, 1), (6, 7), (5000, 0), (1, 1)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int").withColumn("text", F.lit("x"))
    got = crf.good_documents(df, labels).collect()
    kept = [r.doc_id for r in got]
    right = [(i in kept) == (i % 3 > 0) for i in range(200, 400)]
    assert sum(right) >= 196
    assert {900, 901, 902}.isdisjoint(kept) and {None, 903, 904} <= set(kept) and kept.count(1) == 2
    for r in got:
        assert r.n_lines == len(r.line_good) and r.n_bad == sum(g < 0.5 for g in r.line_good)
    clash = df.withColumn("quality", F.lit("own")).withColumn("n_lines", F.lit("own"))
    whole = crf.without_rejected(clash, labels)
    assert whole.columns == clash.columns and sorted(map(str, kept)) == sorted(str(r.doc_id) for r in whole.collect()) and whole.first().quality == "own"
    assert crf.good_documents(df.limit(0), labels).collect() == []
    assert crf.good_documents(df, labels.limit(0)).count() == len(rows) + 4
    a, b = crf.train(df, labels), crf.train(df.repartition(7), labels)
    assert np.allclose(a.emission, b.emission)


def mixed(rnd, clean):
    """Lines in stretches, of which a share `clean` is clean, and the label of each."""
    out, labels = [], []
    while len(out) < 12:
        good = rnd.random() < clean
        for _ in range(rnd.randint(2, 4)):
            s = sentence(rnd)
            out.append(s if good else rnd.choice((s.upper().replace(" ", "!! "), s.replace(" ", "%%% "), " ".join([s.split()[0]] * 20))))
            labels.append(good)
    return "\n".join(out), labels


def test_line_labels(spark):
    """Lines of mixed documents: the labels of documents are all that the field is given."""
    rnd = random.Random(8)
    made = {i: mixed(rnd, 1.0 if i % 2 else 0.35) for i in range(500)}
    label = {i: int(np.mean([len(x) * g for x, g in zip(t.split("\n"), y, strict=True)]) / np.mean([len(x) for x in t.split("\n")]) > 0.5) for i, (t, y) in made.items()}
    df = spark.createDataFrame([(i, t) for i, (t, _) in made.items()], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, label[i]) for i in range(300)], "doc_id bigint, quality int")
    field = crf.train(df, labels)
    right = two = clean = every = 0
    for r in crf.scored(df, field).collect():
        text, y = made[r.doc_id]
        size = [len(x.replace(" ", "")) for x in text.split("\n")]
        assert r.quality == pytest.approx(sum(n * g for n, g in zip(size, r.line_good, strict=True)) / sum(size), abs=1e-5)
        if r.doc_id >= 300:
            right += sum((g > 0.5) == v for g, v in zip(r.line_good, y, strict=True))
            two += len(y)
            clean += sum(g > 0.5 for g, v in zip(r.line_good, y, strict=True) if v and not label[r.doc_id])
            every += sum(y) * (not label[r.doc_id])
    # a field that gave every line the label of its document would have 0.84 of all lines and none of the clean ones in bad documents
    assert right >= 0.88 * two and clean >= 0.25 * every > 70
    # lines go on as those before them, and change of label isn't ruled out
    gain = field.transition[0, 0] + field.transition[1, 1] - field.transition[0, 1] - field.transition[1, 0]
    assert 0 < gain < 6


def test_expected_labels():
    """Against enumeration: the tilted marginals meet the label, and aren't tilted where they meet it anyway."""
    rng = np.random.default_rng(4)
    bound = np.array([0, 5, 9, 10, 16])
    score, tr = rng.normal(size=16), np.array([[0.7, -0.4], [-0.6, 0.9]])
    length = np.diff(bound)
    weight = rng.random(16) + 0.1
    weight /= np.repeat(np.add.reduceat(weight, bound[:-1]), length)
    score[:5] += 8
    good = np.array([True, False, False, True])
    p, _ = crf.expected_labels(score, bound, tr, weight, good)
    share = np.add.reduceat(weight * p, bound[:-1])
    below = share + 2 * np.sqrt(np.add.reduceat(weight**2 * p * (1 - p), bound[:-1]))
    assert share[0] > 0.9 and np.allclose(p[:5], crf.forward_backward(score, bound, tr)[0][:5])
    assert (below[1:3] <= crf.BAD_SHARE + 1e-9).all() and share[3] >= crf.GOOD_SHARE - 1e-9 and below[1] > crf.BAD_SHARE - 0.05 and share[3] < crf.GOOD_SHARE + 0.05


def test_line_features():
    import pyarrow as pa

    texts = [None, "", "Hello there friend.\n\n  \nÉÀ ABC 12\n#### $$", "x x x x", "tail without end\n"]
    lines = crf.LineFeatures(pa.array(texts))
    assert lines.doc.tolist() == [2, 2, 2, 3, 4] and lines.size.tolist() == [17, 9, 6, 4, 14]
    assert lines.own[0][1] == pytest.approx(1 / 16) and lines.own[1][1] == 1.0 and lines.own[2][3] == 1.0 and lines.own[2][11] == 1.0
    assert lines.own[3][6] == 0.75 and lines.own[0][9] == 1.0 and lines.own[4][9] == 0.0
    assert (lines.all[1][12:24] == lines.own[0]).all() and (lines.all[1][24:36] == lines.own[2]).all() and (lines.all[3][12:36] == 0).all()


def test_label_model():
    rng = np.random.default_rng(1)
    n, found, false = 20_000, (0.9, 0.8, 0.7, 0.85, 0.6), (0.02, 0.03, 0.05, 0.02, 0.04)
    y = rng.random(n) < 0.2
    votes = np.stack([rng.random(n) < np.where(y, a, b) for a, b in zip(found, false, strict=True)], axis=1).astype(int)
    copy = np.where(rng.random(n)[:, None] < 0.9, votes[:, 4:5], rng.integers(0, 2, (n, 1)))
    votes = np.concatenate([votes, copy], axis=1)
    votes[rng.random(votes.shape) < 0.1] = 2
    pattern, count = np.unique(tox.pattern_of(votes), return_counts=True)
    assert (votes == tox.votes_of(tox.pattern_of(votes), 6)).all()
    model = tox.fit_label_model(tox.votes_of(pattern, 6), count.astype(float))
    assert model.parent[5] == 4 or model.parent[4] == 5
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.97
    true = [(votes[votes[:, j] < 2, j] == y[votes[:, j] < 2]).mean() for j in range(6)]
    assert np.abs(model.accuracy(votes, np.ones(n)) - true).max() < 0.03


def test_tree_posterior():
    """The posterior of the tree against the joint distribution, written out."""
    rng = np.random.default_rng(2)
    m = 4
    parent = [-1, 0, 0, 2]
    table = [rng.dirichlet(np.ones(3), size=(2, 3)) for _ in range(m)]
    model = tox.LabelModel(0.3, parent, table)
    votes = np.array(list(product(range(3), repeat=m)))
    joint = np.zeros((2, len(votes)))
    for c in (0, 1):
        for i, v in enumerate(votes):
            w = 0.3 if c else 0.7
            for j, p in enumerate(parent):
                w *= table[j][c, v[p] if p >= 0 else 0, v[j]]
            joint[c, i] = w
    assert np.isclose(joint.sum(), 1) and np.allclose(model.posterior(votes), joint[1] / joint.sum(axis=0))


def test_few_labels(spark):
    """Six toxic documents of a language are enough for a beginning that all of them use; chance is not."""
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        lang = "xx" if i % 2 else "yy"
        w = [rnd.choice(VOICES) + rnd.choice(VOICES) for _ in range(60)]
        if i % 6 == 1:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), "krazz" + rnd.choice(VOICES))
        rows.append((i, " ".join(w), lang))
        if i < 72:
            labels.append((i, int(i % 6 == 1) if i % 2 else int(rnd.random() < 0.15)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    assert set(tox.induce(df, labels)) == {"kraz", "krazz"}
    got = {r.doc_id for r in tox.toxic_documents(df, labels).collect()}
    assert len([i for i in got if i % 6 == 1]) >= 48 and len([i for i in got if i % 6 != 1]) <= 2


def test_copies_are_one_piece_of_evidence(spark):
    """The words of a toxic text that was copied with small changes are no marks of toxic documents."""
    rnd = random.Random(21)

    def words(n):
        return [rnd.choice(VOICES) + rnd.choice(VOICES) for _ in range(n)]

    rows, labels, copied = [], [], ["qualm", "zephyr", "drifts", *words(37)]
    for i in range(400):
        w = words(60)
        if i % 4 == 0:
            w[10:10] = ["krazz" + rnd.choice(VOICES) for _ in range(3)]
        if i % 8 == 0:
            w = [*copied, "krazz", rnd.choice(VOICES)]
        rows.append((i, " ".join(w), "xx"))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = tox.induce(df, labels)
    assert "kraz" in got and not {"qual", "zeph", "drif"} & set(got)


def test_chance():
    from math import comb

    for t, c, nt, nc in ((3, 0, 4, 40), (6, 1, 6, 40), (2, 2, 5, 9), (0, 3, 5, 9), (5, 9, 5, 9)):
        want = sum(comb(nt, k) * comb(nc, t + c - k) for k in range(t, min(nt, t + c) + 1)) / comb(nt + nc, t + c)
        assert tox.chance(t, c, nt, nc) == pytest.approx(want)


def test_toxicity(spark):
    rnd = random.Random(3)

    def text(bad, lang):
        w = [rnd.choice(VOICES) for _ in range(rnd.randint(30, 150))]
        if bad:
            for _ in range(rnd.randint(3, 6)):
                w.insert(rnd.randrange(len(w)), rnd.choice(("idiot", "scum", "worthless")) if lang == "en" else "krazz" + rnd.choice(VOICES))
        return " ".join(w)

    rows = [(i, text(i % 7 == 0, "en" if i % 2 else "xx"), "en" if i % 2 else "xx") for i in range(1400)]
    odd = [(5000, None, "en"), (5001, "", None), (None, "idiot scum", "en"), (0, rows[0][1], "xx"), (5002, "fine words " * 100_000, "en")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumn("toxic", F.lit(1)).withColumn("posterior", F.lit("x"))
    labels = [(i, int(i % 7 == 0)) for i in range(700)] + [(3, None), (None, 1), (4, 5)]
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("text", F.lit("x"))
    assert "kraz" in tox.induce(df, labels)
    got = [r.doc_id for r in tox.toxic_documents(df, labels).collect()]
    held = range(700, 1400)
    caught = [i in got for i in held if i % 7 == 0]
    false = [i for i in held if i % 7 and i in got]
    assert sum(caught) >= 0.97 * len(caught) and len(false) <= 6
    assert got.count(0) == 2 and not {5000, 5001, 5002, None} & set(got)
    assert tox.toxic_documents(df.limit(0), labels).collect() == []
    bare = [r.doc_id for r in tox.toxic_documents(df.drop("lang"), labels.limit(0)).collect()]
    assert sum(i in bare for i in held if i % 14 == 7) >= 45
