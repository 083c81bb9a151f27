"""The joins over texts against brute force: Jaccard pairs, line copies, benchmark windows."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowtext.llm import decontaminate, jaccard, line_dedup

DOCS = "doc_id bigint, text string"


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())


def sets(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_pairs(rows, t, n):
    contents = {}
    for i, text in sorted(set(rows)):
        if s := sets(text, n):
            contents.setdefault(s, []).append(i)
    out = {}
    for s, own in contents.items():
        for other in own[1:]:
            if other != own[0]:
                out[own[0], other] = 1.0
    for (s, a), (u, b) in combinations(contents.items(), 2):
        j = len(s & u) / len(s | u)
        if round(j, 9) >= t and a[0] != b[0]:
            out[min(a[0], b[0]), max(a[0], b[0])] = j
    return out


def changed(rnd, w, vocabulary, rate):
    return [rnd.choice(vocabulary) if rnd.random() < rate else x for x in w]


@pytest.mark.parametrize(("vocabulary", "n", "t"), [(400, 2, 0.6), (12, 2, 0.6), (12, 1, 0.5), (40, 3, 0.4), (6, 1, 0.9)])
def test_pairs(spark, vocabulary, n, t):
    rnd = random.Random(vocabulary * 10 + n)
    voc = [f"w{i}é" for i in range(vocabulary)]
    texts = []
    for _ in range(60):
        texts.append([rnd.choice(voc) for _ in range(rnd.choice((1, 2, 5, 20, 60, 200)))])
    for _ in range(60):
        texts.append(changed(rnd, rnd.choice(texts), voc, rnd.choice((0, 0.02, 0.1, 0.3))))
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar_pairs(df, t, n, least_frequent=3, very_frequent=0.1).collect()}
    want = brute_pairs(rows, t, n)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want

def test_wide_pairs():
    """Pairs of runs of many sets, against all pairs of each run; what another run is sure to find is left to it."""
    rnd = np.random.default_rng(4)
    n = 400
    size = rnd.integers(20, 60, n)
    size[:100] = 30
    runs_of = [rnd.choice(200, 90, replace=False) + 200 * (k % 2) for k in range(40)]
    who, length = np.concatenate(runs_of), np.full(40, 90)
    rank, low = np.arange(40, dtype=np.uint64) + np.uint64(5), np.full((n, 3), jaccard.NONE)
    want = {(min(a, b), max(a, b)) for run in runs_of for a in run.tolist() for b in run.tolist() if a != b and min(size[a], size[b]) >= 0.6 * max(size[a], size[b])}

    def found():
        met = [(min(a, b), max(a, b)) for x, y in jaccard.wide_pairs(who, size[who], who, length, low, rank, 0.6) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(met) == len(set(met))  # once, however many runs share a pair
        return set(met)

    assert found() == want
    low[:100, 0] = 7  # the signature of a run here
    assert found() == want
    low[:100, 0] = 1000  # of one elsewhere
    assert found() == {(a, b) for a, b in want if b >= 100}


def test_pairs_edges(spark):
    long = " ".join(f"x{i}" for i in range(150_000))
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "A b, c!"), (5, "solo"), (6, "Solo."), (7, long), (8, long + " end"), (9, "\n\t "), (4, "other words here")]
    df = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(1)).withColumn("tokens", F.lit("x")).withColumn("home", F.lit(2))
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar_pairs(df).collect()}
    assert got.keys() == {(3, 4), (5, 6), (7, 8)} and got[3, 4] == got[5, 6] == 1.0
    assert jaccard.similar_pairs(df.limit(0)).collect() == []
    assert sorted(r.doc_id or 0 for r in jaccard.one_of_each(df).collect()) == [0, 1, 2, 3, 3, 5, 7, 9]
    assert jaccard.one_of_each(df).columns == df.columns
    with pytest.raises(ValueError):
        jaccard.similar_pairs(df, 0.1)


def test_groups(spark):
    rnd = random.Random(4)
    edges = [tuple(sorted(rnd.sample(range(300), 2))) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    got = jaccard.groups(spark.createDataFrame(edges, "doc_a bigint, doc_b bigint")).collect()
    assert {r.doc_id: r.first for r in got} == want and len(got) == len(want)
    assert jaccard.groups(spark.createDataFrame([], "doc_a bigint, doc_b bigint")).collect() == []


def brute_lines(rows):
    gone, first = set(), {}
    placed = sorted({(i, k, tuple(words(line))) for i, t in rows if i is not None and t is not None for k, line in enumerate(t.split("\n"))})
    for i, k, w in placed:
        if w and first.setdefault(w, (i, k)) != (i, k):
            gone.add((i, k))

    def near(v, w):
        if (len(v) < 8) != (len(w) < 8):
            return False
        a, b = (" ".join(v), " ".join(w)) if len(v) < 8 else (v, w)
        if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for w, at in first.items():
        if any(there < at and near(w, v) for v, there in first.items()):
            gone.add(at)
    return gone


def test_lines(spark):
    rnd = random.Random(7)
    voc = [f"v{i}é" for i in range(30)]
    base = [[rnd.choice(voc) for _ in range(rnd.choice((1, 2, 3, 7, 8, 9, 12, 30)))] for _ in range(120)]
    lines = list(base)
    for _ in range(250):
        w = list(rnd.choice(lines)) or ["v1"]
        at = rnd.randrange(len(w))
        rnd.choice((lambda: None, lambda: w.__setitem__(at, rnd.choice(voc)), lambda: w.pop(at), lambda: w.insert(at, rnd.choice(voc)), lambda: w.insert(0, w[0])))()
        lines.append(w)
    rnd.shuffle(lines)
    rows, at = [], 0
    while at < len(lines):
        k = rnd.randint(1, 6)
        rows.append((len(rows) * 3 % 101 + len(rows), "\n".join(" ".join(w).title() if rnd.random() < 0.5 else ", ".join(w) + "." for w in lines[at : at + k])))
        at += k
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert {(r.doc_id, r.line_no) for r in line_dedup.copies(df).collect()} == brute_lines(rows)
    text = dict(rows)
    gone = brute_lines(rows)
    for r in line_dedup.without_copies(df).collect():
        want = [x for k, x in enumerate(text[r.doc_id].split("\n")) if (r.doc_id, k) not in gone]
        assert r.text == "\n".join(want) and r.n_dropped == len(text[r.doc_id].split("\n")) - len(want)


def test_lines_edges(spark):
    hot = "one two three four five six seven eight"
    long = " ".join(f"y{i}" for i in range(100_000))
    rows = [(None, hot), (1, None), (2, ""), (3, hot), (4, f"{hot}\n\nshort line\n{hot} nine"), (5, "short line"), (6, long), (7, long + " z"), (8, f"{hot}\r\n{hot}"), (3, hot)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("row", "gone", "parts", "n_dropped", "hash", "kind", "line_no"):
        df = df.withColumn(c, F.lit("own"))
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in line_dedup.without_copies(df).collect()), key=str)
    want = [(None, hot, 0), (1, None, 0), (2, "", 0), (3, hot, 0), (3, hot, 0), (4, "\nshort line", 2), (5, "", 1), (6, long, 0), (7, "", 1), (8, "", 2)]
    assert got == sorted(want, key=str)
    out = line_dedup.without_copies(df)
    assert set(out.columns) == set(df.columns) and {r["row"] for r in out.collect()} == {"own"}
    assert line_dedup.without_copies(df.limit(0)).collect() == []


def brute_windows(docs, items, t, n):
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    out = {}
    for d, text in docs:
        w = words(text)
        for k, item in items:
            v = words(item)
            own = grams(v, min(n, len(v))) if v else []
            if own:
                g = grams(w, min(n, len(v)))
                need = set(own)
                best = max((len(need & set(g[i : i + len(own)])) for i in range(len(g))), default=0)
                if round(best / len(need), 9) >= t:
                    out[d, k] = best / len(need)
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_windows(spark, broadcast):
    rnd = random.Random(3)
    voc = [f"b{i}" for i in range(25)]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.choice((1, 2, 3, 4, 5, 9, 20, 50))))) for i in range(25)]
    docs = []
    for i in range(80):
        w = [rnd.choice(voc) for _ in range(rnd.choice((0, 3, 30, 120)))]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(w))
            w[at:at] = changed(rnd, words(rnd.choice(items)[1]), voc, rnd.choice((0, 0.03, 0.1)))
        docs.append((i, " ".join(w)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_grams=broadcast).collect()
    want = brute_windows(docs, items, decontaminate.CONTAINMENT, decontaminate.N)
    assert {(r.doc_id, r.item_id): pytest.approx(r.containment) for r in got} == want and len(got) == len(want) > 20


def test_windows_edges(spark):
    item = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(None, item), (1, None), (2, ""), (3, f"x {item} y"), (3, f"x {item} y"), (4, "alpha beta"), (5, "q " * 100_000 + item), (6, "quite clean words in here")], DOCS)
    docs = docs.withColumn("gram", F.lit(1)).withColumn("item_id", F.lit(2)).withColumn("bad", F.lit(3)).withColumn("a.b", F.lit(4))
    items = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item), (3, None), (4, "no such"), (5, "")], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    got = sorted((r.doc_id, r.item_id, r.containment, r.word_at) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(3, 1, 1.0, 1), (3, 2, 1.0, 1), (5, 1, 1.0, 100_000), (5, 2, 1.0, 100_000)]
    assert decontaminate.contaminated(docs.limit(0), items).collect() == [] and decontaminate.contaminated(docs, items.limit(0)).collect() == []
    kept = decontaminate.clean(docs, items)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 6] and kept.columns == docs.columns


def test_short_lines(spark, tmp_path):
    rows = [(1, "Les.\nAnd ornd.\n--\na line of its own"), (2, "les\n--"), (3, "Les.\nLes.\nand, ornd"), (4, "Lest.\nornd and\nA lime of its own\nA line of its owns!\na lino of its on")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("--", 1), 3: ("", 3), 4: ("Lest.\nornd and\na lino of its on", 2)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in line_dedup.cleaned(docs).collect()} == {1: rows[0][1], 2: "--", 4: "Lest.\nornd and\na lino of its on"}


def brute_alikes(rows, share=0.2, sizes=0.6):
    first, total, votes = {}, {}, {}

    def keys(w):
        u = " ".join(w) if len(w) < 8 else tuple(w)
        if len(u) < 2:
            return []
        m = len(u) // 2
        return [(len(w) < 8, len(u), 1, u[:m]), (len(w) < 8, len(u), 2, u[m:])]

    for i, text in sorted(rows):
        total[i] = len(words(text))
        for line in text.split("\n"):
            for k in keys(words(line)):
                first.setdefault(k, i)
    for i, text in rows:
        for line in text.split("\n"):
            w = words(line)
            for e in {first[k] for k in keys(w)} - {i}:
                votes[i, e] = votes.get((i, e), 0) + len(w)
    return {i for (i, e), n in votes.items() if n >= share * total[i] and min(total[i], total[e]) >= sizes * max(total[i], total[e])}


@pytest.mark.parametrize("hot", [line_dedup.HOT, 100, 10**6])
def test_near_copies_stay_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rnd = random.Random(9)
    voc = [f"v{i}" for i in range(500)]
    lines = lambda n: [[rnd.choice(voc) for _ in range(rnd.randint(5, 30))] for _ in range(n)]
    base = [lines(rnd.randint(4, 9)) for _ in range(25)]
    notice = " ".join(rnd.choice(voc) for _ in range(60))
    rows = [(i, "\n".join(" ".join(w) for w in d)) for i, d in enumerate(base)]
    rows += [(100 + i, "\n".join(" ".join(changed(rnd, w, voc, 0.05)) for w in d)) for i, d in enumerate(base)]  # most lines shared
    rows += [(200 + i, "\n".join([notice, *(" ".join(w) for w in lines(25))])) for i in range(15)]
    rows += [(300, rows[3][1])]
    df = spark.createDataFrame(rows, DOCS).repartition(4).withColumn("n_chars", F.char_length("text")).withColumn("n_dropped", F.lit("mine")).withColumn("a.b", F.lit(1))
    alike = {r.doc_id for r in line_dedup.look_alikes(df).collect()}
    if hot == 100:
        assert 0 < len(line_dedup._hot_halves(line_dedup._texts(df), line_dedup.buckets(df, 2))[0]) < 500
    assert alike == brute_alikes(rows) and {100 + i for i in range(25)} <= alike and alike.isdisjoint(range(200, 300))
    gone, text = brute_lines(rows), dict(rows)
    got = {r.doc_id: r for r in line_dedup.cleaned(df).collect()}
    assert 300 not in got and all(got[i].text == text[i] for i in alike & set(got)) and len([i for i in range(100, 125) if i in got]) >= 15
    for i in range(201, 215):
        assert notice not in got[i].text and got[i].n_chars == len(got[i].text) and (i, 0) in gone
    assert {r.n_dropped for r in got.values()} == {"mine"} and line_dedup.cleaned(df).columns == df.columns
    left = jaccard.one_of_each(line_dedup.cleaned(df)).collect()
    assert len([r for r in left if 100 <= r.doc_id < 125]) <= 1
    assert line_dedup.cleaned(df.limit(0)).collect() == [] and line_dedup.look_alikes(df.limit(0)).collect() == []


def brute_classes(rows, t, n):
    """doc_id -> (class, links), from all pairs of (document, text)."""
    own = [(i, s) for i, s in sorted({(i, sets(x, n)) for i, x in rows if i is not None and x}, key=lambda r: r[0]) if s]
    parent = {i: i for i, _ in rows if i is not None}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (k, b) in combinations(own, 2):
        if round(len(a & b) / len(a | b), 9) >= t:
            links[i] += 1
            links[k] += 1
            u, v = sorted((find(i), find(k)))
            parent[v] = u
    return {i: (find(i), links[i]) for i in parent}


@pytest.mark.parametrize(("tile", "broadcast"), [(1024, 10**6), (2, 0)])
def test_classes(spark, tmp_path, monkeypatch, tile, broadcast):
    monkeypatch.setattr(jaccard, "TILE_SETS", tile)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(3)
    voc = [f"w{i}" for i in range(200)]
    texts = [[rnd.choice(voc) for _ in range(rnd.choice((1, 5, 20, 60)))] for _ in range(12)]
    texts += [changed(rnd, w, voc, 0.05) for w in texts for _ in range(4)]
    rows = [(i, " ".join(rnd.choice(texts))) for i in range(120)]
    rows += [(200, " ".join(texts[2]))] * 3 + [(201, " ".join(texts[3])), (300, " ".join(texts[14])), (301, ""), (302, None), (303, "?!"), (None, rows[0][1])]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_classes(rows, 0.6, 2)
    got = jaccard.op4_jaccard_join(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want and len(got) == len(want)
    assert sum(k for _, k in want.values()) > 400


def test_classes_edges(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (2, two), (3, one), (3, two), (3, two), (4, one + " z"), (None, one), (5, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("first", F.lit("x")).withColumn("a.b", F.lit("own")).withColumn("later", F.lit("own"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.linked(df).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (1, 3), 4: (1, 2), 5: (5, 0)}
    assert jaccard.linked(df.limit(0)).collect() == []
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r["a.b"]) for r in kept.collect()) == [(0, "own"), (1, "own"), (5, "own")]
    text = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r.doc_id: r.n_links for r in jaccard.linked(text).collect()} == {k: n for k, (_, n) in got.items()}


def test_verifier_keeps_tiles_whole():
    """Pairs whose sets are far apart in the stream, and tiles that end at batch ends."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("tile", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("data", pa.binary())])
    rows = []
    for tile in range(5):
        for k in range(6):
            token = np.arange(100 * tile + k // 2, 100 * tile + k // 2 + 20).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : jaccard.SET_BYTES]
            rows.append((tile, 10 * tile + k, None, 10 * tile + k, 1, token.tobytes()))
        rows += [(tile, 10 * tile + a, 10 * tile + b, None, None, None) for a in range(6) for b in range(a)]
    for step in (1, 4, 7, 21, 1000):
        for limit in (0, 300, 10**6):
            jaccard.TILE_BYTES, before = limit, jaccard.TILE_BYTES
            batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + step], strict=True), schema.types, strict=True)], schema=schema) for i in range(0, len(rows), step)]
            got = [(r["x"], r["y"]) for b in jaccard._by_tile(jaccard._verifier(0.9, False))(iter(batches)) for r in b.to_pylist()]
            jaccard.TILE_BYTES = before
            assert sorted(tuple(sorted(p)) for p in got) == [(10 * t + a, 10 * t + b) for t in range(5) for a in range(6) for b in range(a + 1, 6) if b // 2 - a // 2 <= 1], (step, limit)


def test_sketches_rule_out_no_similar_pair():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(6)
    texts = []
    for _ in range(12):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice((3, 150, 230, 900)))]
        texts += [" ".join(w[: max(2, int(len(w) * rnd.uniform(0.5, 1)))]) for _ in range(6)] + [" ".join(changed(rnd, w, ["x", "y"], 0.1))]
    own = jaccard.Sets(pa.array(texts), 2)
    sketches = own.sketches(np.arange(len(texts)))
    table = pa.table({"x": list(range(len(texts))), "a": own.size, "b": own.size, "data": pa.array(sketches, pa.binary())})
    pairs = [(i, k) for i, k in combinations(range(len(texts)), 2) if min(own.size[i], own.size[k]) >= 0.6 * max(own.size[i], own.size[k])]
    got = {tuple(sorted(r.values())) for r in jaccard._alike(0.6)(table, np.array(pairs).T).to_pylist()}
    tokens = [sets(t, 2) for t in texts]
    similar = {(i, k) for i, k in pairs if len(tokens[i] & tokens[k]) / len(tokens[i] | tokens[k]) >= 0.6}
    assert similar <= got and len(similar) > 60 and len(got) < len(similar) + 0.1 * len(pairs)
