"""Operators 11 to 13 against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dipscan.llm import maxent_lm, merkle, vector_codes


# -- operator 11 -------------------------------------------------------------------------------------------------------


def plain_codes(rows, rounds=6, entries=16):
    """rows: (id, label, integers); (codes, errors, codebooks) by Lloyd's rounds in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(rows[0][2])
    cut = [(p * dim // 8, (p + 1) * dim // 8) for p in range(8)]
    books = [[r[2][a:b] for r in rows[:entries]] for a, b in cut]

    def near(x, book):
        return min((sum((u - v) ** 2 for u, v in zip(x, e)), i) for i, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[near(r[2][a:b], books[p]) for p, (a, b) in enumerate(cut)] for r in rows]
        if turn == rounds:
            break
        for p, (a, b) in enumerate(cut):
            for i in range(len(books[p])):
                mine = [r[2][a:b] for r, f in zip(rows, found) if f[p][1] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted((r[0] is None, r[0] or 0, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for r, f in zip(rows, found)), books


def codes_of(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int, code string, k int")
    found = vector_codes.compress(df)
    have = sorted((r.id is None, r.id or 0, bytes(r.code).hex(), r.error) for r in found.rows.collect())
    return have, found


@pytest.mark.parametrize("case", ["clouds", "ties", "odd length", "few", "huge"])
def test_codes_equal_plain_rounds(spark, case):
    rng = np.random.default_rng(4)
    n, dim = {"few": (5, 16), "odd length": (300, 19), "huge": (60, 8)}.get(case, (700, 16))
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.1, size=(n, dim))
    if case == "ties":
        x = rng.integers(-2, 3, (n, dim)) / 4096  # many equal distances and equal entries
    if case == "huge":
        x[::3] *= 1e30
        x[::7] *= 1e-30
    x = x.astype(np.float32).astype(float)
    rows = [(int(i), [float(v) for v in r], int(i) % 3 or None, "clash", 1) for i, r in enumerate(x)]
    rows += rows[:4] + [(None, rows[-1][1], 1, None, None)]
    integers = [(r[0], r[2], [int(v) * 4096 if abs(v) > 1 << 52 else math.floor(4096 * v) for v in r[1]]) for r in rows]
    bad = [(900, None, 1, "", 1), (901, rows[0][1][:-1] + [None], 1, "", 1), (902, [float("nan")] + rows[0][1][1:], 2, "", 1), (903, [float("inf")] + rows[0][1][1:], 2, "", 1), (904, rows[0][1][:3], 2, "", 1), (905, [], 2, "", 1)]
    have, found = codes_of(spark, rows + bad, "double")
    want, books = plain_codes(integers)
    assert have == [(a, b, c, e if e < 1 << 63 else None) for a, b, c, e in want]
    assert [[list(map(int, e)) for e in book] for book in found.codebooks] == books
    if case == "clouds":
        assert sum(found.compared[1:]) < 0.6 * 6 * len(rows) * 8 * 16  # bounds spare work


def test_pruning_never_passes_over_a_tie():
    book = np.array([[0, 0], [2, 0], [2, 0], [0, 4]])
    x = np.array([[1, 0], [2, 0], [0, 2], [1, 5]])
    first, _ = vector_codes.assign(x, book, None, None)
    assert first.entry.tolist() == [0, 1, 0, 3]
    # entries swap places: the tie goes to the lower index though the upper bound equals the lower one
    other = book[[1, 0, 2, 3]]
    moved = vector_codes._up(vector_codes._distances(book, other))
    then, _ = vector_codes.assign(x, other, first, moved)
    assert then.entry.tolist() == [0, 0, 1, 3]


def test_codes_of_labels_and_empty_tables(spark):
    rows = [(i, [float(i), 1.0] * 4, None if i % 2 else 7) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = vector_codes.coded(df).collect()
    by = defaultdict(int)
    for r in got:
        by[r.vec_id % 2] += r.error
    assert len(got) == 40 and all(r.label_error == by[r.vec_id % 2] for r in got)
    assert vector_codes.coded(df.where("vec_id < 0")).collect() == []


# -- operator 12 -------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """(root, siblings of each leaf from below)."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 8 * 8: p // 8 * 8 + 8]
            paths[i].append((p % 8, run[: p % 8] + run[p % 8 + 1:]))
        level, at = [sha("".join(level[i: i + 8])) for i in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], paths


def plain_manifest(rows, tampered):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[g] = plain_tree([plain_leaf(*r) for r in groups[g]])
    root, above = plain_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, above):
        for r, path in zip(groups[g], trees[g][1]):
            now = plain_leaf(*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}) if r[4] is not None and tampered(r[0]) else r[4])
            for own, others in path + up:
                now = sha("".join(others[:own] + [now] + others[own:]))
            proof = sha("".join(h for _, others in path + up for h in others))
            out.append((r[0], plain_leaf(*r), trees[g][0], root, proof, now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, None: 3, "": 1}, {"a": 8, "b": 64, "c": 65, "Z": 7, "ß": 2, "é": 520}, {"one": 4_700, **{f"l{i}": 2 for i in range(70)}}])
def test_manifest_equals_plain_tree(spark, sizes):
    from pyspark.sql import functions as F

    rng, rows = random.Random(2), []
    for lang, n in sizes.items():
        rows += [(rng.randrange(10_000) if rng.random() > 0.01 else None, rng.choice(["s", None, "ä"]), lang, rng.choice([None, 0, 12]), rng.choice(["Ab C", "", None, "naïve É", "x" * 3000])) for _ in range(n)]
    rows += rows[:2]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, 2, "h") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, pos int, tree int, hash string")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = sorted(map(tuple, merkle.documents_manifest(docs, changed).collect()), key=repr)
    want = plain_manifest(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0)
    assert got == want
    if sizes.get("en") == 1:
        assert all(r[2] == r[3] for r in want)


def test_store_and_paths(spark):
    rows = [(i, None, "x" if i % 3 else "y", i, f"t{i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    made = merkle.build(docs.select("doc_id", "lang", merkle.leaf_hash([docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf")), "lang", ["doc_id"])
    assert [x.count() for x in made.levels] == [1000, 84 + 42, 11 + 6, 2 + 1, 1]
    leaves = {(r.tree, r.pos): r.leaf for r in made.leaves.collect()}
    up = {r.tree: r.path for r in merkle.group_paths(made).collect()}
    for r in merkle.paths(made).collect():
        assert merkle.fold(leaves[r.tree, r.pos], list(merkle.siblings(r.path))) == made.root
        assert r.path.endswith(up[r.tree])
    assert merkle.documents_manifest(docs.where("doc_id < 0")).collect() == []
    assert all(r.verified for r in merkle.documents_manifest(docs).collect())


# -- operator 13 -------------------------------------------------------------------------------------------------------

SPACE = r"[^\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus(n=300, seed=5):
    """Two made-up languages in which the next word depends on the last."""
    rng, texts = random.Random(seed), []
    for _ in range(n):
        name = rng.choice("ab")
        at, out = 0, []
        for _ in range(rng.randint(0, 60)):
            at = (at * 3 + rng.choice([1, 1, 2])) % 40
            out.append(f"{name}{at}x" if rng.random() > 0.05 else f"{name}rare{rng.randrange(9999)}x")
        texts.append(" ".join(out))
    return texts + [None, "", " \t", "Ab " * 3000, "ÀÉ ab\x0bcd", "a0x a1x"]


def test_base_scores_equal_plain_counts(spark):
    texts = corpus()
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(texts)] + [(3, texts[3], None, None), (None, "b0x b1x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, code string, n double")
    got = maxent_lm.scores(docs).collect()
    count = Counter(w for i, t, *_ in rows if not held(i) for w in words_of(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(w := words_of(t)), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for i, t, *_ in rows), key=repr)
    have = sorted((tuple(r)[:6] for r in got), key=repr)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert all(math.isclose(x[5], y[5], rel_tol=1e-9) for x, y in zip(have, want))
    assert all(math.isfinite(r.score) for r in got)
    test = [r for r in got if r.held_out]
    assert len(test) > 20 and sum(r.score for r in test) > sum(r.base_score for r in test) + 0.05 * sum(r.n_tokens for r in test)


def fitted(spark, docs):
    from pyspark.sql import functions as F

    source = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), maxent_lm.held_out("doc_id").alias("held_out"))
    model = maxent_lm.fit_words(source.where("NOT held_out").select("text"))
    encoded = maxent_lm.encode(source, model)
    return model, encoded


def test_probabilities_of_a_history_add_up_to_one(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "TABLE", 64)  # with KEYS, whole slabs  # most words are rare then
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id bigint, text string")
    model, encoded = fitted(spark, docs)
    model = maxent_lm.train(encoded, maxent_lm.fit_classes(encoded, model))
    assert len(model.table) == 64 and len(set(model.kinds[:64])) > 5
    known = [(int(r.code) % 2 ** 64, r.n) for r in model.words.collect()]
    kind = lambda c: model.kinds[np.searchsorted(model.table, np.uint64(c))] if c in set(model.table.tolist()) else model.kinds[64 + c % maxent_lm.KEYS]
    share = np.zeros(maxent_lm.CLASSES)
    for c, n in known:
        share[kind(c)] += (n + 1) / model.mass[kind(c)]
    for k in np.unique(model.kinds[64:]):
        share[k] += 1 / model.mass[k]  # unknown words
    used = share > 0
    assert np.allclose(share[used], 1)
    rows = maxent_lm.features(np.array([5, 9, 70, 3], np.uint16), np.array([0, 2]))
    for _, x, whole in maxent_lm._steps(model.weights, model.bias, rows):
        assert np.allclose((x / whole[:, None])[:, used].sum(axis=1), 1, atol=1e-5)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    number = rng.integers(0, 50, 400).astype("<u2")
    kinds = rng.integers(0, maxent_lm.CLASSES, maxent_lm.TABLE + maxent_lm.KEYS).astype(np.uint8)
    weights = rng.normal(scale=0.1, size=(maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
    bias = np.zeros(maxent_lm.CLASSES, np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([number[:150].tobytes(), b"", number[150:].tobytes()], pa.binary())], names=["numbers"])
    box = type("Box", (), {"value": weights})
    got = np.zeros((maxent_lm.ROWS // maxent_lm.SLAB, maxent_lm.SLAB * maxent_lm.CLASSES))
    for out in maxent_lm._gradients(box, bias, kinds)(iter([batch])):
        for slab, sums in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            got[slab] += np.frombuffer(sums, np.int64)
    got = got.reshape(maxent_lm.ROWS, -1) / maxent_lm.ONE
    want = np.zeros_like(got)
    rows = maxent_lm.features(number, np.array([0, 150, 150]))
    for t in range(400):
        z = weights[rows[:, t]].astype(float).sum(axis=0)
        p = np.exp(z - z.max())
        p /= p.sum()
        p = -p
        p[kinds[number[t]]] += 1
        for r in rows[:, t]:
            want[r] += p
    assert np.abs(got - want).max() < 1e-3


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(120))), "doc_id bigint, text string")
    one = {r.id: r.score for r in maxent_lm.scores(docs.coalesce(1)).collect()}
    many = {r.id: r.score for r in maxent_lm.scores(docs.repartition(9)).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-5, abs_tol=1e-5) for k in one)


def test_scores_without_training_texts(spark):
    ids = [i for i in range(60) if held(i)]
    docs = spark.createDataFrame([(i, "only held out") for i in ids], "doc_id bigint, text string")
    got = maxent_lm.scores(docs).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)} and all(r.score <= 0 for r in got)
    assert maxent_lm.scores(docs.where("doc_id < 0")).collect() == []


def test_history_tells_words_of_a_class_apart(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "split", lambda points, weight, k: np.zeros(len(points), dtype=np.int64))  # frequent words are one class
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["pa xa", "pb xb"]) for _ in range(30)) for _ in range(300)]
    asked = [i for i in range(1000, 1100) if held(i)][:2]
    rows = [(i, t) for i, t in enumerate(texts)] + [(asked[0], "pa xa pb xb " * 10), (asked[1], "pa xb pb xa " * 10)]
    got = {r.id: r for r in maxent_lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    likely, other = got[asked[0]], got[asked[1]]
    assert math.isclose(likely.base_score, other.base_score) and likely.score > other.score + 5  # equal before: counts shared a class out


def tree_of(rng, n=300):
    kinds = rng.integers(0, 4, n).astype(np.uint8)
    mass = np.where(rng.random(n) < 0.1, 0, np.round(rng.pareto(0.7, n) * 3 + 1))
    return kinds, mass, maxent_lm.halved(kinds, mass, rng.normal(size=n))


def test_choices_of_a_class_add_up_to_one():
    rng = np.random.default_rng(5)
    kinds, mass, tree = tree_of(rng)
    branches = rng.normal(scale=0.5, size=maxent_lm.BRANCHES).astype(np.float32)

    def shares(weights, past):
        out = np.zeros(len(kinds))
        number = np.arange(len(kinds))
        for at, of, _, second, score in maxent_lm._choices(tree, weights, number, np.repeat(past, len(number), axis=1)):
            out += np.bincount(of, -np.log1p(np.exp(-np.where(second, score, -score).astype(float))), len(number))
        return np.exp(out)

    past = maxent_lm.histories(np.array([7, 9, 4], np.uint16), np.array([0]))
    plain, some, others = shares(branches * 0, past[:, :1]), shares(branches, past[:, 1:2]), shares(branches, past[:, 2:])
    known = mass > 0
    for k in range(4):
        mine = known & (kinds == k)
        assert np.allclose(plain[mine], mass[mine] / mass[mine].sum(), rtol=1e-4) and np.allclose(np.log(plain[mine]), tree.prior[mine], atol=1e-4)
        assert math.isclose(some[mine].sum(), 1, rel_tol=1e-4) and math.isclose(others[mine].sum(), 1, rel_tol=1e-4) and np.abs(some - others)[mine].max() > 1e-3
    assert (tree.depth[~known] == 0).all() and tree.depth.max() < 40


def test_gradient_of_choices_is_that_of_the_likelihood():
    rng = np.random.default_rng(6)
    kinds, mass, tree = tree_of(rng)
    number = rng.choice(np.flatnonzero(mass > 0), 200).astype("<u2")
    branches = rng.normal(scale=0.3, size=maxent_lm.BRANCHES).astype(np.float32)
    box = lambda x: type("Box", (), {"value": x})
    batch = pa.RecordBatch.from_arrays([pa.array([number.tobytes()], pa.binary())], names=["numbers"])
    got = np.zeros(((maxent_lm.ROWS * maxent_lm.CLASSES + maxent_lm.BRANCHES) // (maxent_lm.SLAB * maxent_lm.CLASSES), maxent_lm.SLAB * maxent_lm.CLASSES))
    for out in maxent_lm._gradients(box(np.zeros((maxent_lm.ROWS, maxent_lm.CLASSES), np.float32)), np.zeros(maxent_lm.CLASSES, np.float32), kinds, box((tree, branches)))(iter([batch])):
        for slab, sums in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            got[slab] += np.frombuffer(sums, np.int64)
    got = got.ravel()[maxent_lm.ROWS * maxent_lm.CLASSES:] / maxent_lm.ONE
    want = np.zeros(maxent_lm.BRANCHES)
    for _, _, place, second, score in maxent_lm._choices(tree, branches, number, maxent_lm.histories(number, np.array([0]))):
        for t in range(len(second)):
            z = tree.bias[tree.path[tree.start[number[0]]] >> 1] + branches[place[:, 0]].sum() if t == 0 else score[t]
            assert math.isclose(z, score[t], abs_tol=1e-5)
            for r in place[:, t]:
                want[r] += second[t] - 1 / (1 + math.exp(-score[t]))
    assert np.abs(got - want).max() < 1e-3 and np.abs(want).max() > 1
