"""Near-duplicates, lines, decontamination, toxicity, personal data, token files and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import arrow_ids, decontam, lines, minhash, pii, toxicity
from parlance.llm.queries import QUERIES

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.fixture(scope="module")
def copies(spark):
    """Exact, near and chained copies, short and empty texts, repeated and null ids."""
    rnd = random.Random(2)
    texts = {}
    words = [f"w{i}" for i in range(5000)]
    base = [rnd.choice(words) for _ in range(120)]
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(120)] = rnd.choice(words)
        texts[i] = " ".join(w)
    chain = list(base[:80])
    for i in range(60, 90):
        chain[(i * 3) % 80] = f"c{i}"
        texts[i] = "\n".join(chain)
    shared = " ".join(rnd.choice(words) for _ in range(60))
    for i in range(90, 140):
        texts[i] = shared + " " + " ".join(rnd.choice(words) for _ in range(rnd.choice([4, 15, 40])))
    texts |= {200: None, 201: "", 202: " \n", 203: "a b", 204: "A  B", 205: "a b c d", 206: "a b c d e", 207: "x" * 5000, 208: "a b c d e f g h", 209: "a b c d e f g"}
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()] + [(200, None, "en", "s", 0), (203, "a b", "en", "s", 0), (None, "a b", "en", "s", 0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("bucket", F.lit("own"))


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets[i] = s
    parent = {i: i for i in sets}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for v in by.values() if len(v) < 400 for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(parent, i)) for i in sets}


def test_near_duplicates(spark, copies):
    rows = copies.collect()
    want = brute_groups([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
    got = minhash.near_duplicates(copies).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    left = minhash.without_duplicates(copies)
    assert left.columns == copies.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids == Counter([i for i, (_, c) in want.items() if i == c] + [None, None])
    assert minhash.near_duplicates(copies.limit(0)).count() == 0


def test_no_pair_at_the_threshold_is_lost(spark):
    """Pairs at a similarity of exactly 0.75, and just below it, of sets of 4, 8, 100 and 2,000 shingles; some in crowded buckets."""
    rows, i = [], 0
    for n, pairs in ((4, 60), (8, 60), (100, 60), (2000, 4)):
        for k in range(pairs):
            words = [f"n{n}k{k}w{j}" for j in range(n + 4)]
            for size in (n, n * 3 // 4):
                rows.append((i, " ".join(words[: size + 4]), "en", "s", 0))
                i += 1
            below = [f"b{n}k{k}w{j}" for j in range(n + 4)]
            for size in (n, n * 3 // 4 - 1):
                rows.append((i, " ".join(below[: size + 4]), "en", "s", 0))
                i += 1
    # a crowd: 40 versions of one text, each linked with the text and hardly with one another
    base = [f"c{j}" for j in range(204)]
    rows.append((i, " ".join(base), "en", "s", 0))
    hub = i
    for k in range(40):
        own = list(base)
        for e in range(4):
            own[(k * 17 + e * 50) % 204] = f"edit{k}x{e}"
        i += 1
        rows.append((i, " ".join(own), "en", "s", 0))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    for at in range(0, hub, 4):
        assert got[at + 1] == at and got[at + 2] == at + 2 and got[at + 3] == at + 3
    assert {got[x] for x in range(hub, i + 1)} == {hub}


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    got = QUERIES["op2_minhash_near_dedup"](spark, SF1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, n, letters):
    w = list(text)
    for _ in range(n):
        k, op = rnd.randint(0, len(w)), rnd.random()
        if op < 0.34:
            w.insert(k, rnd.choice(letters))
        elif k < len(w):
            w[k : k + 1] = [] if op < 0.67 else [rnd.choice(letters)]
    return "".join(w)


def test_band_distance_and_probes():
    rnd = random.Random(1)
    for _ in range(6000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 10)))
        b, e = edited(rnd, a, rnd.randint(0, 4), "ab"), rnd.choice([1, 2, 3])
        assert lines.within_edits(a, b, e) == (distance(a, b) <= e)
    for _ in range(4000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 16)))
        b = edited(rnd, a, rnd.randint(0, 2), "abcz")
        if len(b) >= 3:
            f = lambda x: {(o, i, x[p : p + s]) for o, i, p, s in lines.probes(len(x))}
            assert f(a) & f(b)


def test_lines(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(24, 60))).strip().ljust(22, "q") for _ in range(12)]
    rows = []
    for i in range(120):
        ls = [edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 5]), "abcxyz") for _ in range(rnd.randint(0, 5))]
        rows.append((i, "\n".join([*ls, "short", "  " + rnd.choice(base) + "\r"])))
    rows += [(500, None), (501, ""), (502, "é" * 30 + "\n" + "é" * 29 + "ê"), (None, base[0]), (3, base[1])]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, line string")
    seen = []
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            x = x.strip(" \t\n\x0b\x0c\r")
            if i is not None and len(x) >= lines.LEAST_CHARS:
                seen.append((i, k, x))
    names = sorted({x for _, _, x in seen})
    parent = {x: x for x in names}
    linked = set()
    for a in names:
        for b in names:
            if a < b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                linked |= {a, b}
                x, y = find(parent, a), find(parent, b)
                parent[x] = y
    first = {}
    for i, k, x in sorted(seen):
        first.setdefault(find(parent, x), (i, k))
    want = defaultdict(lambda: (set(), set(), set(), set()))
    for i, k, x in seen:
        n, near, firsts, drop = want[i]
        n.add((k, x) if i == 3 else k)
        near.add(k) if x in linked else None
        firsts.add(first[find(parent, x)][0])
        drop.add(k) if first[find(parent, x)] != (i, k) else None
    got = {r.doc_id: r for r in lines.line_report(docs).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}
    for i in got:
        if i != 3:
            assert (got[i].n_lines, got[i].n_near, set(got[i].first_docs), set(got[i].drop_lines)) == (
                len(want[i][0]), len(want[i][1]), want[i][2], want[i][3]), i
    cut = {r.doc_id: r.text for r in lines.dedup_lines(docs).where("doc_id <> 3").collect()}
    for i, t in rows:
        if i not in (3, None):
            assert cut[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][3]))
    assert lines.line_report(docs.limit(0)).count() == 0


def test_short_lines(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 3, 5, 8, 9, 10, 11, 12, 15, 18, 19, 20, 21, 22)]
    rows = [(i, "\n".join(edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2]), "abxyz") for _ in range(rnd.randint(1, 6)))) for i in range(150)]
    rows += [(200, "Les.\n \nLes.\n\tLes. \nLas."), (201, "Les."), (202, "Read more!\nRead more"), (203, "Read mores"), (204, "é" * 10), (205, "é" * 9 + "ê"), (206, "é" * 9)]
    seen = [(i, k, x.strip()) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip()]
    names = sorted({x for _, _, x in seen}, key=lambda x: (len(x), x))
    parent, linked = {x: x for x in names}, set()
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            e = min(2, len(a) // 10)
            if len(b) - len(a) <= e and distance(a, b) <= e:
                linked |= {a, b}
                parent[find(parent, a)] = find(parent, b)
    first = {}
    for i, k, x in sorted(seen):
        first.setdefault(find(parent, x), (i, k))
    want = {i: (0, 0, []) for i, _ in rows}
    for i, k, x in seen:
        n, near, drop = want[i]
        want[i] = (n + 1, near + (x in linked), drop + [k] * (first[find(parent, x)] != (i, k)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_near, sorted(r.drop_lines)) for r in lines.line_report(docs).collect()}
    assert got == want and got[200] == (4, 0, [2, 3]) and got[201] == (1, 0, [0]) and 0 < len({x for x in linked if len(x) < 20})


def brute_align(item, words):
    h, best = [[0] * (len(words) + 1) for _ in range(len(item) + 1)], 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == words[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        a, b = rnd.integers(0, 6, rnd.integers(1, 12)), rnd.integers(0, 6, rnd.integers(1, 14))
        assert decontam.align(a, b)[0] == brute_align(a.tolist(), b.tolist())
    item = np.arange(30)
    text = np.concatenate([np.full(20, 99), item[:10], [77], item[11:20], item[22:], np.full(20, 98)])
    score, a, b = decontam.locate(item, text)
    assert (a, b) == (20, 48) and score > 0.8


def test_contaminated(spark):
    docs, items = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/benchmark.parquet")
    bench = [(r.item_id, r.text) for r in items.collect() if len(r.text.split()) >= 20]
    rnd, clean = random.Random(3), docs.first().text
    planted = []
    for k, (i, t) in enumerate(bench[:12]):
        w = t.split()
        for j in range(2, len(w), 6):
            w[j] = f"other{j}"
        planted.append((9000 + k, " ".join(["Intro words here", *w, "and an end."]).upper() if k % 2 else clean + " " + " ".join(w), i))
    own = spark.createDataFrame([(d, t, "own") for d, t, _ in planted] + [(9100, None, ""), (9101, "", ""), (None, bench[0][1], "")], "doc_id long, text string, item_id string")
    got = decontam.contaminated(own, items).collect()
    assert {(d, i) for d, _, i in planted} | {(None, bench[0][0])} == {(r.doc_id, r.item_id) for r in got}
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in [(x.item_id, x.text) for x in items.collect()] if t in r.text}
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).where("score > 0.95").collect()}
    parts = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, part_words=300).where("score > 0.95").collect()}
    assert whole and whole <= found and parts == found
    left = decontam.decontaminate(own, items)
    assert {r.doc_id for r in left.collect()} == {9100, 9101} and left.columns == own.columns
    assert decontam.contaminated(own.limit(0), items).count() == 0 and decontam.contaminated(own, items.limit(0)).count() == 0


def test_short_and_unspaced_items(spark):
    han = "".join(chr(0x4E00 + 7 * i) for i in range(40))
    items = [(1, "Who wrote Hamlet?"), (2, "Ouagadougou"), (3, "seven words make up this short item"), (4, "two words"), (5, "two words"), (6, han[:10]),
             (7, han), (8, "ใครเป็นผู้เขียน"), (9, "?!"), (10, "eight or more words make up a longer item here")]
    texts = ["so, WHO wrote hamlet? And who wrote Hamlet", "who wrote the Hamlet", "in Ouagadougou.", "x seven words make up this short item y", "seven words make up this long item",
             "two, words", "two other words", f"前{han[:10]}後", f"前{han[:9]}後", f"{han[:18]}中{han[20:]}", "เขาถามว่าใครเป็นผู้เขียนหนังสือ", "?!", None, "", "eight or more words make up a longer item"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 1): (1, 4), (2, 2): (1, 2), (3, 3): (1, 8), (5, 4): (0, 2), (5, 5): (0, 2), (7, 6): (1, 11), (10, 8): None, (9, 6): (0, 10), (9, 7): None, (14, 10): (0, 9)}
    for size in (decontam.PART_WORDS, 5):
        got = {(r.doc_id, r.item_id): (r.first_word, r.end_word, r.score) for r in decontam.contaminated(docs, bench, part_words=size).collect()}
        assert {k: v[:2] if want.get(k) else None for k, v in got.items()} == want
        assert all(v[2] == 1 for k, v in got.items() if k[1] not in (7, 10)) and got[9, 7][2] < 1
    left = decontam.decontaminate(docs, bench)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1")
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    held = got.where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    false = sum(r.predicted for r in held if not r.toxic) / sum(1 - r.toxic for r in held)
    assert hit > 0.85 and false < 0.01, (hit, false)


def test_swaps_level_identity_terms(spark):
    rows = [(i, f"the {'muslims' if i % 2 else 'poets'} are here today number {i}" + (" scum trash" if i % 4 == 1 else ""), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    a, b, bad, empty = model.score(pa.array(["the muslims are here", "the christians are here", "scum trash", None]))
    assert abs(a - b) < 0.02 and bad > 0.5 and 0 <= empty < 0.5
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", "en", "s", 0), (2, "scum trash " * 20000, "en", "s", 0)], DOCS).withColumn("score", F.lit(1))
    assert toxicity.scores(odd, model).count() == 3 and toxicity.without_toxic(odd, model).count() == 2
    assert toxicity.fit(docs, labels.limit(0)).score(pa.array(["x"]))[0] < 0.5


def test_versions_rewrite_the_sentence():
    a, b = toxicity.versions("Muslims and muslims met the poets, not muslimsx")
    assert a == "Muslims and muslims met the poets, not muslimsx"
    words = b.split()
    assert words[0] == words[2] != "muslims" and words[0] in toxicity.IDENTITY_TERMS["en"] and words[-1] == "muslimsx"
    for lang, term in (("fr", "chrétiens"), ("de", "männer"), ("es", "jóvenes" if "jóvenes" in toxicity.IDENTITY_TERMS["es"] else "árabes")):
        a, b = toxicity.versions(f"xx {term}. yy")
        assert b != a and b.startswith("xx ") and b.split()[1].strip(".") in toxicity.IDENTITY_TERMS[lang]
    for text in ("", "no group here"):
        a, b = toxicity.versions(text)
        assert a != b and a.startswith(text + " ") and b.startswith(text + " ")
    features = tuple(f for w in ("muslims", "christians", "the", "muscle") for f in toxicity._features(w))
    rows, cols, vals = toxicity.changes(pa.array(["muslims muslims muscle", "the muslims", None]), features)
    for i, text in enumerate(["muslims muslims muscle", "the muslims", ""]):
        want = np.zeros(len(features))
        for side, sign in zip(toxicity.versions(text), (1, -1)):
            _, c, v = toxicity.indices(pa.array([side]), features)
            want[c] += sign * v
        got = np.zeros(len(features))
        got[cols[rows == i]] = vals[rows == i]
        assert np.allclose(got, want)


def test_scores_by_hand(spark):
    """A model's score is the logistic of its bias and 1 + log(count) of each known feature, and fitting lowers the loss that is stated."""
    model = toxicity.Model(("bad$", "bad", "goo"), np.array([1.5, 0.25, -2.0]), -0.5)
    texts = ["Bad bad, badly good", "", None, "bad_good", "x" * 10000 + " bad"]
    for text, got in zip(texts, model.score(pa.array(texts))):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        n = Counter(f for w in words for f in toxicity._features(w))
        z = -0.5 + sum(w * (1 + np.log(n[f])) for f, w in zip(model.features, model.weights) if n[f])
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12
    rnd = np.random.default_rng(3)
    rows, cols, vals, y = np.repeat(np.arange(60), 3), rnd.integers(0, 8, 180), rnd.random(180), (np.arange(60) % 3 == 0).astype(float)
    pairs = (np.arange(60), rnd.integers(0, 8, 60), rnd.normal(size=60))

    def loss(w, b):
        z = b + np.bincount(rows, w[cols] * vals, 60)
        change = np.bincount(pairs[0], w[pairs[1]] * pairs[2], 60)
        return (np.log1p(np.exp(-np.where(y == 1, z, -z))).mean() + toxicity.CLEAN * np.log1p(np.exp(b)) / 60 + toxicity.L2 * (w**2).sum()
                + toxicity.PAIR_PENALTY * (change**2).mean())

    w, b = toxicity.fit_weights(8, rows, cols, vals, y, pairs)
    best = loss(w, b)
    assert all(loss(w + 0.02 * rnd.normal(size=8), b + 0.02 * rnd.normal()) > best - 1e-6 for _ in range(200))


@pytest.mark.parametrize(("lang", "named", "other"), [("en", "muslims", "christians"), ("fr", "musulmans", "juifs"), ("de", "flüchtlinge", "frauen"), ("es", "negros", "mujeres")])
def test_neutral_mentions_score_alike_in_each_language(spark, lang, named, other):
    rows = [(i, f"{named if i % 2 else 'xyz'} zz {named if i % 6 == 1 else ''} uu {i}" + (" scum trash" if i % 4 == 1 else ""), lang, "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    a, b, c, d, bad = model.score(pa.array([f"{named} zz uu", f"{other} zz uu", f"{named} {named} {named} zz uu", f"{other} {other} {other} zz uu", "scum trash"]))
    assert abs(a - b) < 0.05 and abs(c - d) < 0.1 and max(a, b, c, d) < 0.5 < bad


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        s = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return sorted(out)


@pytest.fixture(scope="module")
def detector(spark):
    return pii.Detector(spark)


def test_base_spans(spark, detector):
    rnd = random.Random(8)
    odd = [None, "", "4111 1111-1111 1111", "4111  1111 1111 1111", "a@b.c_d@e.f", "é a.b@c-d.e.f, 😀 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.2.3", "+1 (678) 555-5272 +12 +1234567890123456",
           "x" * 3000 + "@y", "1 " * 4000 + "4111111111111111", "9" * 500, "+1(2", "a@b", "4111-1111-1111-1111-2", "5 4111111111111111"]
    odd += ["".join(rnd.choice("0123456789 .-+@ab()") for _ in range(rnd.randint(5, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(odd)] + [(None, "a@b.c", "own")], "doc_id long, text string, spans string")
    docs = docs.union(spark.read.parquet(f"{SF1}/documents.parquet").selectExpr("doc_id + 10000", "text", "''"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = detector.detect(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r.doc_id])
        n = Counter(x[3] for x in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in PATTERNS), texts[r.doc_id]
        own = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert set(own.split(",")) - {""} <= set(r.spans.split(",")), (own, r.spans)
        ends = [(x.s, x.e) for x in r.found if x.score < 1]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_the_method_adds_and_spares(spark, detector):
    adds = {'say token = "9742a250774262d69ad6a86100194ed53da5a0ef" ok': "secret", "the 4040549990366430 one": "number", "write joe (at) mail.com now": "email",
            "password=7602ad27cf5550de1c st": "secret", "iban DE89 3704 0044 0532 0130 01 x": "iban"}
    spares = ["on 2024-03-05 it was", "from 1990-1995 to", "value 3.141592653 and", "a thnthereandthention word", "pages 12345678 of", "the wellknown-identity-terms"]
    docs = spark.createDataFrame(list(enumerate([*adds, *spares])), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in detector.detect(docs).collect()}
    for i, kind in enumerate(adds.values()):
        assert got[i].startswith(kind + ":"), (i, got[i])
    assert [got[len(adds) + i] for i in range(len(spares))] == [""] * len(spares)


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["", " ", "\n", "a  b", " a", "a ", "a\n\nb", "a\tb", "x y z", "x  y", "<|endoftext|> a b", "it's don't 123 4,5", "漢字 é́", "a\r\nb c", None, "!", "ab " * 5000]
    rows = [(100 - i, t, "own") for i, t in enumerate(odd)] + [(None, "null id", "own"), (100, "again", "own"), (100, "again", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").union(
        spark.read.parquet(f"{SF1}/documents.parquet").selectExpr("doc_id + 1000", "text", "''"))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = arrow_ids.round_trip(docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    assert arrow_ids.round_trip(docs.limit(0), path).count() == 0


def test_sequences_are_views(tmp_path):
    w = arrow_ids.SequenceFile(f"{tmp_path}/x.arrow", np.uint16, 8, 4)
    stream = np.arange(1, 100, dtype=np.uint16)
    for a in range(0, 99, 7):
        w.add(stream[a : a + 7])
    w.close()
    before = pa.total_allocated_bytes()
    r = arrow_ids.SequenceReader(f"{tmp_path}/x.arrow")
    assert pa.total_allocated_bytes() - before < 4096
    assert r.row(0)[0].tolist() == list(range(1, 9)) and r.row(12)[0].tolist() == [97, 98, 99, 0, 0, 0, 0, 0]
    assert r.row(12)[1].to_pylist() == [True] * 3 + [False] * 5 and r.valid() == 99 and not r.row(0)[0].flags.owndata
    assert r.ids(30, 40).tolist() == list(range(31, 71))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    cols, at, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = corpus_pipeline.materialise(stage(spark, before, SF1), f"test-{name}")
        kept[name] = at
        if name != "sharding":
            assert at.columns == cols and at.exceptAll(before.union(before)).count() == 0
    model = {r.doc_id: r.predicted for r in QUERIES["op4_toxicity"](spark, SF1).collect()}
    assert {r.doc_id for r in kept["toxicity"].collect()} == {i for i, p in model.items() if not p}
    want = brute_groups([(r.doc_id, r.text) for r in kept["toxicity"].collect()])
    assert {r.doc_id for r in kept["minhash"].collect()} == {i for i, (_, c) in want.items() if i == c}
    leaked = {r.doc_id for r in decontam.contaminated(kept["minhash"], spark.read.parquet(f"{SF1}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept["decontamination"].collect()} == {i for i, (_, c) in want.items() if i == c} - leaked and leaked
    assert at.select(*cols).exceptAll(kept["mixing"]).count() == 0 and at.count() == kept["mixing"].count()
    assert sorted(map(str, corpus_pipeline.run(spark, SF1).collect())) == sorted(map(str, at.collect()))


def test_pipeline_on_hard_rows(spark, copies, tmp_path):
    names = {"documents": copies.drop("bucket"), "labels": spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"),
             "benchmark": spark.createDataFrame([(1, None), (None, "a b c")], "item_id long, text string")}
    for n, df in names.items():
        df.write.parquet(f"{tmp_path}/{n}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "shard", "slot"} <= set(got.columns) and got.count() > 0
    none = tmp_path / "none"
    for n, df in names.items():
        df.limit(0).write.parquet(f"{none}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0
