"""Each operator against a plain version of itself, on rows with nulls, ties and odd texts."""

import collections
import hashlib
import io
import random
import re
import zipfile

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from dipscan.llm import chat_events, embedding_lsh, language, passages, pieces, set_join, spaced_seeds, token_counts, url_cascade, warc_zip  # noqa: E402

WORDS = [f"w{i}" for i in range(3000)]
ODD = [
    None, "", " ", "\t\n", "one", "one two", "a b c d", "  two  spaces  ", "don't we'll I'm", "<|endoftext|>", "x <|endoftext|> y", "▁a▁▁b", "tab\tnew\nline\r\n", "naïve café ÀÉ ﬁ", "漢字 かな 한국어", "emoji 🙂🙂 end ",
    "a\u00a0b\u2003c\u3000d", "\u0000nul", "<s>a</s>", "1234 5,678.90", "x" * 30_000, "  \n\n  b", "a…b—c “q”",
]


def docs_of(spark, texts):
    rows = [(i, t, 99, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id int, n string")


def near_groups(seed=3):
    rng = random.Random(seed)
    texts = list(ODD)
    for size in (1, 1, 2, 5, 30):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 140))]
        texts.append(" ".join(base))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
            texts.append(" ".join(w).upper())
    texts += [" ".join(rng.choice("abc") for _ in range(12)) for _ in range(30)]
    return texts


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_components(spark):
    texts = near_groups()
    got = set_join.jaccard_components(docs_of(spark, texts)).collect()
    assert sorted(map(tuple, got)) == plain_components(texts)


def test_shingles_keep_whole_hashes(spark, monkeypatch):
    same = {"x": np.array([3 << 48 | 12345, 7], np.uint64), "y": np.array([11 << 48 | 12345, 7], np.uint64), "z": np.array([3 << 48 | 12345, 9], np.uint64)}
    monkeypatch.setattr(set_join.tb, "shingle_sets", lambda texts, k: ((i, np.sort(same[t])) for i, t in enumerate(texts.to_pylist())))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(list(same))], names=["id", "text"])
    packed = sorted((r for b in set_join._shingled(5, 8)([batch]) for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[1])
    rows = [r for b in set_join._shared_shingles(8)([set_join._batch([r]) for r in packed]) for r in zip(*(c.to_pylist() for c in b.columns)) if r[0] == 1]
    assert {int(t) for r in rows for t in np.frombuffer(r[5], "<u8")} == {3 << 48 | 12345, 7}


def test_jaccard_steered_by_a_sample(spark, monkeypatch):
    monkeypatch.setattr(set_join, "CROWD", 2)
    texts = near_groups(5)
    texts += [texts[-1]] * 20 + ["x y z a b c d e f"] * 30
    docs = docs_of(spark, texts)
    assert sorted(map(tuple, set_join.jaccard_components(docs).collect())) == plain_components(texts)
    monkeypatch.setattr(set_join, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(set_join, "BUCKET_BYTES", 1_000)
    assert sorted(map(tuple, set_join.jaccard_components(docs).collect())) == plain_components(texts)


def test_jaccard_empty(spark):
    assert set_join.jaccard_components(docs_of(spark, ["a"]).where("false")).collect() == []


def test_token_counts(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = near_groups()
    got = token_counts.token_counts(docs_of(spark, texts), public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got)) == want


def test_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = near_groups()
    got = {r.id: (r.ids, r.decoded) for r in pieces.encode_decode(docs_of(spark, texts), path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert got[i] == (ids, lib.decode(ids)), repr(t)[:60]


def test_url_rules(spark):
    urls = [
        None, "", "example.com/en/", "http://Example.COM/en/1", "http://www.example.com/en/x?y#z", "http://a.www.example.com/en/", "http://notexample.com/en/", "https://x.net/es/1", "https://x.net/es", "https://net/fr/",
        "http://a.org/en/", "http://com", "http://com/", "ftp://a.com?x/", "http://h.com#/en/", "a://b://c.com/", "http://ÄÖ.com/é/", "http:///en/", "http://x.com/en/" + "a" * 5000,
    ]
    rows = [(i % 15, u, "x", "y") for i, u in enumerate(urls)] + [(None, "http://x.com/", None, None)]
    got = url_cascade.judge(spark.createDataFrame(rows, "page_id bigint, url string, host string, path string")).collect()

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    assert collections.Counter(map(tuple, got)) == collections.Counter((i, *plain(u)) for i, u, _, _ in rows)


@pytest.mark.parametrize("n", [0, 2_000, 100_000])
def test_many_url_rules(spark, n):
    import time

    urls = [(None, "http://x.com/en/1"), (None, None), (None, "http://x.net/es/"), (1, "http://example.com/en/"), (1, "http://example.com/en/"), (2, "http://net/fr/"), (3, "http://a.h7.org/p/q"), (None, "http://h1999.org/p/"), (4, "http://h7.org/")]
    rows = urls + [(None, f"http://{h}{p}z") for _, h, p in url_cascade.RULES]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = [*url_cascade.RULES, *((("allow", "block")[i % 2], f"h{i}.org", ("/", "/p/")[i % 3 > 0]) for i in range(n))]
    start = time.perf_counter()
    judged = url_cascade.judge(pages, rules)
    judged._jdf.queryExecution().executedPlan()
    planned = time.perf_counter() - start
    got = collections.Counter(map(tuple, judged.collect()))
    assert got.total() == len(rows) and sum(r[0] is None for r in got.elements()) == sum(r[0] is None for r in rows)
    by_key = {h + p: v for v, h, p in rules}
    for _, host, path, rule, verdict in got:
        labels = host.split(".")
        fits = [k for i in range(len(labels)) for j in range(len(path) + 1) if host and (k := ".".join(labels[i:]) + path[:j]) in by_key]
        assert rule == (max(fits, key=len) if fits else None)
        assert verdict == (by_key[rule] if fits else "allow")
    print(n, "rules:", round(planned, 1), "s to build and plan")


def test_cascade_is_exact(spark):
    listed = spark.range(200).selectExpr("concat('k', id) AS key")
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    old = url_cascade.BITS_PER_KEY, url_cascade.LATER_BITS_PER_KEY
    url_cascade.BITS_PER_KEY, url_cascade.LATER_BITS_PER_KEY = 6, 6
    try:
        c = url_cascade.Cascade(listed, universe)
    finally:
        url_cascade.BITS_PER_KEY, url_cascade.LATER_BITS_PER_KEY = old
    assert len(c.levels) > 2
    from pyspark.sql import functions as F

    assert universe.where(c.holds(F.col("key"))).count() == 200 == listed.where(c.holds(F.col("key"))).count()


def test_warc_round_trip(spark):
    rng = random.Random(5)
    same = "<p>" + "s" * 200
    html = [None, "", "short", "short", same, same, same, "é" * 60, "é" * 60, "\r\n\r\nWARC/1.1\r\n\r\n" * 9, *("".join(rng.choices("abc é\n", k=rng.randint(0, 900))) for _ in range(200))]
    rows = [(len(html) - i, f"http://x/{i}\n y" if i % 3 else None, h, "z") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    manifest = warc_zip.write_packages(pages, warc_zip.package_folder(spark))
    got = {r.page_id: r for r in warc_zip.read_packages(manifest).collect()}
    first = {}
    for page, _, h, _ in sorted(rows):
        first.setdefault(h or "", page)
    assert len(got) == len(rows)
    for page, _, h, _ in rows:
        data = (h or "").encode()
        to = first[h or ""] if len(data) >= 100 and first[h or ""] != page else None
        r = got[page]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if to else "response", to)
        assert r.payload is None if to else r.payload == data


def test_zip_directories():
    small = io.BytesIO()
    with zipfile.ZipFile(small, "w") as z:
        z.writestr("a", b"hello")
        z.writestr(zipfile.ZipInfo("ü/b"), b"world" * 10)
        z.comment = b"a comment"
    import struct

    data = small.getvalue()
    end = data.rindex(b"PK\x05\x06")
    count, length, start = struct.unpack("<HLL", data[end + 10: end + 20])
    end64 = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start)
    wide = data[:end] + end64 + struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1) + struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for file in (data, wide):
        read = lambda at, n, f=file: f[at: at + n]
        members = {m.name: m for m in warc_zip.directory(read, len(file))}
        at = warc_zip.first_byte(read, members["ü/b"])
        assert read(at, members["ü/b"].size) == b"world" * 10
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    data = packed.getvalue()
    read = lambda at, n: data[at: at + n]
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.first_byte(read, warc_zip.directory(read, len(data))[0])


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 17)).astype(np.float32).astype(float)
    x[100:400] = (x[0] + rng.standard_normal((300, 17)) * 0.05).astype(np.float32)
    x[400:500] = (x[1] + rng.standard_normal((100, 17)) * 0.25).astype(np.float32)
    x[500:520] = x[2]
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    rows += [(900, None, "c"), (901, [0.0] * 17, "c"), (902, [float("nan")] + [1.0] * 16, "c"), (903, [None] + [1.0] * 16, "c"), (904, [], "c"), (905, [1.0, 2.0], "c"), (906, [float("inf")] * 17, "c")]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    for kind, block in (("double", 64), ("float", 1024)):
        table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, rep string")
        found = embedding_lsh.near_duplicates(table, block=block).collect()
        got = {r.id: r for r in found}
        assert sorted(got) == list(range(907)) and len(found) == 907
        links = np.array([got[i].n_links for i in range(900)])
        assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
        # crowds are dense, so they hang together whatever links are missed
        root = list(range(900))
        for _ in range(900):
            low = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(900)]
            if low == root:
                break
            root = low
        assert sum(got[i].component_id == root[i] for i in range(900)) >= 895
    again = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (0, [2.0, 0.0]), (None, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r.id, r.n_links, r.component_id) for r in embedding_lsh.near_duplicates(again).collect()) == [(0, 1, 0), (1, 0, 1), (1, 1, 0), (1, 1, 0)]
    assert embedding_lsh.near_duplicates(again.where("false")).count() == 0


def test_embedding_recall_at_the_edge(spark):
    """Single pairs at cosine 0.90 to 0.92 among unrelated vectors."""
    rng = np.random.default_rng(3)
    n, dim = 1_500, 64
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.92, (n, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]
    got = {r.id: r for r in embedding_lsh.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    hit = np.array([got[i].component_id == got[i + n].component_id == i for i in range(n)])
    assert hit.mean() >= 0.9, hit.mean()
    assert all(r.n_links <= 1 and r.kept == (r.id == r.component_id) for r in got.values())


def plain_overlaps(texts, items):
    """(text, item) pairs with a stretch that counts, over all diagonals."""
    found = set()
    for d, text in enumerate(texts):
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            for shift in range(1 - len(v), len(w)):
                lo, hi = max(0, shift), min(len(w), len(v) + shift)
                if v and hi - lo >= min(spaced_seeds.MIN_WORDS, len(v)):
                    a, b, same = spaced_seeds._stretch(np.array([w[x] == v[x - shift] for x in range(lo, hi)]))
                    if b - a >= min(spaced_seeds.MIN_WORDS, len(v)) and same >= spaced_seeds.MIN_SHARE * (b - a):
                        found.add((d, i))
    return found


def test_spaced_seeds(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(1 + i if i < 12 else rng.randint(12, 40)))) for i in range(36)] + [(50, "a a a a a a a a a a a a a a"), (98, None), (99, "")]
    texts, planted = ["a " * 3_000, None, "", "A", *ODD[7:15]], set()
    for i, item in items[:36]:
        for changes in (0, 1, 2, 3):
            w = item.split()
            if changes and len(w) < 12:
                continue
            for p in rng.sample(range(len(w)), changes):
                w[p] = "changed"
            planted.add((len(texts), i))
            texts.append(" ".join([rng.choice(WORDS) for _ in range(20)] + w + [rng.choice(WORDS) for _ in range(20)]))
    exact = plain_overlaps(texts, items)
    assert (0, 50) in exact
    bench = spark.createDataFrame([*items, (None, "a b c")], "item_id bigint, text string")
    for bits in ((1 << 22, 1 << 28), (1 << 8, 1 << 8)):  # a full filter lets everything through to the join
        monkeypatch.setattr(spaced_seeds, "FILTER_BITS", bits)
        rows = spaced_seeds.overlaps(docs_of(spark, texts), bench).collect()
        found = {(r.id, r.item_id) for r in rows}
        assert len(rows) == len(found) and found <= exact
        assert len(found & planted) >= 0.97 * len(exact & planted)
        whole = {(d, i) for d, t in enumerate(texts) for i, v in items if v and f" {v} " in f" {' '.join((t or '').lower().split())} "}
        assert whole <= found
        for r in rows:
            a, b = texts[r.id].lower().split()[r.start_word: r.end_word], dict(items)[r.item_id].split()[r.item_start:]
            assert sum(x == y for x, y in zip(a, b)) == r.equal_words
    assert spaced_seeds.overlaps(docs_of(spark, texts), bench.where("false")).count() == 0
    assert spaced_seeds.overlaps(docs_of(spark, texts).where("false"), bench).count() == 0
    twice = docs_of(spark, texts).union(docs_of(spark, texts))
    assert spaced_seeds.overlaps(twice, bench).count() == 2 * len(found)


def test_repeated_passages(spark):
    rng = random.Random(9)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage, other = text(70), text(60)
    fuzzy = list(passage)
    for p in (20, 41):
        fuzzy[p] = "changed"
    del fuzzy[55]
    texts = [*ODD, " ".join(text(40) + passage + text(30)), " ".join(passage), " ".join(text(200)), " ".join(text(10) + fuzzy + text(50) + other), " ".join(text(5) + other + text(5) + other + text(5)), " ".join(text(30) + passage[:30] + text(30))]
    n = len(ODD)
    docs = docs_of(spark, texts)
    found = passages.repeated_passages(docs).cache()
    got = {(r.id, r.src_id): r for r in found.collect()}
    assert {(n + 1, n), (n + 3, n), (n + 4, n + 3)} == set(got)
    assert (got[n + 1, n].start_word, got[n + 1, n].end_word, got[n + 1, n].src_start, got[n + 1, n].similarity) == (0, 70, 40, 1.0)
    assert abs(got[n + 3, n].start_word - 10) <= 1 and abs(got[n + 3, n].end_word - 79) <= 1 and got[n + 3, n].similarity > 0.9
    assert found.where(f"id = {n + 4}").count() == 2
    left = {r.doc_id: r for r in passages.without_passages(docs, found).collect()}
    assert len(left) == len(texts)
    assert left[n + 1].text == "" and len(left[n + 4].text.split()) == 15 and left[n + 2].text == texts[n + 2]
    assert left[0].text is None and left[n].text == texts[n] and left[n].n == "clash"


def test_two_passages_of_a_pair(spark):
    rng = random.Random(31)
    text = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    texts, gaps = [], [(0, 0), (20, 20), (41, 41), (50, 50), (59, 59), (70, 70), (90, 90), (110, 110), (150, 150), (300, 300), (30, 38), (30, 80), (80, 95), (0, 40), (250, 20)]
    for g, h in gaps:
        one, two = text(60), text(60)
        texts += [" ".join(text(30) + one + text(g) + two + text(30)), " ".join(text(20) + one + text(h) + two + text(40))]
    one, two, three = text(60), text(60), text(60)
    texts += [" ".join(one + two + text(40) + three), " ".join(one + three + text(40) + two)]
    rows = passages.repeated_passages(docs_of(spark, texts)).collect()
    for i, (_, h) in enumerate(gaps):
        covered = {w for r in rows if (r.id, r.src_id) == (2 * i + 1, 2 * i) for w in range(r.start_word, r.end_word)}
        assert covered >= {*range(20, 80), *range(80 + h, 140 + h)}, (i, h)
        assert h <= 38 or not covered & set(range(85, 75 + h)), (i, h)
    covered = {w for r in rows if r.id == 2 * len(gaps) + 1 for w in range(r.start_word, r.end_word)}
    assert covered >= {*range(120), *range(160, 220)}
    assert all(r.similarity >= 0.75 and max(r.end_word - r.start_word, r.src_end - r.src_start) >= 45 for r in rows)


def test_passage_made_of_stock_phrases(spark):
    rng = random.Random(32)
    text = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    texts = [" ".join(text(40) + passage[5 * min(i, 8) + 4 * (i == 9): 5 * min(i, 8) + 4 * (i == 9) + 16] + text(40)) for i in range(10)]
    texts += [" ".join(text(60)) for _ in range(20)]
    texts += [" ".join(text(30) + passage + text(20)), " ".join(text(10) + passage + text(50)), " ".join(text(25) + passage + text(25))]
    rows = passages.repeated_passages(docs_of(spark, texts)).collect()
    assert {r.id for r in rows} == {31, 32}
    for i, start in ((31, 10), (32, 25)):
        assert any(r.id == i and r.start_word <= start and r.end_word >= start + 60 and r.similarity > 0.9 for r in rows)


def test_recall_of_changed_passages(spark):
    rng = random.Random(33)
    text = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for step in (12, 10, 8, 6):
        for _ in range(20):
            p, at = text(60), rng.randrange(step)
            texts += [" ".join(text(40) + p + text(40)), " ".join(text(20) + ["new" if i % step == at else w for i, w in enumerate(p)] + text(50))]
    found = {(r.id, r.src_id) for r in passages.repeated_passages(docs_of(spark, texts)).collect()}
    assert found == {(i + 1, i) for i in range(0, len(texts), 2)}


def common(x, y):
    """Length of the longest common subsequence of two word lists."""
    row = [0] * (len(y) + 1)
    for a in x:
        diag = 0
        for j, b in enumerate(y, 1):
            diag, row[j] = row[j], diag + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2, 0.25])
def test_passages_against_full_alignment(spark, rate):
    """Words substituted, dropped and added at random places, 50 to 80 words long; all that a full alignment accepts."""
    rng = random.Random(int(100 * rate))
    text = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    texts, wanted = [], set()
    for _ in range(60):
        p = text(rng.randint(50, 80))
        q = []
        for w in p:
            kind = rng.random()
            if kind >= rate:
                q.append(w)
            elif kind < 0.8 * rate:
                q.append("new")
            elif kind < 0.9 * rate:
                q += [w, "more"]
        if common(p, q) >= passages.MIN_SIMILARITY * max(len(p), len(q)):
            wanted.add(len(texts) // 2)
        texts += [" ".join(text(40) + p + text(40)), " ".join(text(20) + q + text(50))]
    rows = passages.repeated_passages(docs_of(spark, texts)).collect()
    assert all(r.id == r.src_id + 1 and r.src_id % 2 == 0 for r in rows)
    found = {r.src_id // 2 for r in rows}
    print(rate, len(found & wanted), "of", len(wanted))
    assert len(found & wanted) >= 0.9 * len(wanted)
    for r in rows:
        x, y = texts[r.id].split()[r.start_word: r.end_word], texts[r.src_id].split()[r.src_start: r.src_end]
        longest = max(len(x), len(y))
        assert longest >= passages.MIN_WORDS and r.similarity <= 1
        assert common(x, y) >= passages.MIN_SIMILARITY * longest - 1


def test_packed_numbers():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-2**63, 2**63 - 1, 200), [0, -1, 1, 2**63 - 1, -2**63]])
    with np.errstate(over="ignore"):
        steps = np.diff(x, prepend=0)
        assert (np.cumsum(passages._signed(passages._numbers(passages._planes(passages._zigzag(steps), 8), 8))) == x).all()
    head = np.array([0, 50, 51, 120])
    y = rng.integers(0, 2**31, 205)
    assert (passages._summed(passages._steps(y, head), np.diff(np.append(head, 205))) == y).all()


def test_passages_of_wide_ids(spark):
    rng = random.Random(17)
    ids = [rng.randrange(-2**63, 2**63 - 1) for _ in range(40)]
    p = " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, p if n < 20 else f"{p[:40]} other {n}") for n, i in enumerate(ids)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    first = min(ids[:20])
    assert {r.id for r in found} == set(ids[:20]) - {first} and {r.src_id for r in found} <= set(ids[:20])


def test_chains_prefer_order():
    at = np.array([0, 5, 10, 15, 20, 7])
    to = np.array([100, 105, 110, 116, 121, 900])
    (score, *span), = passages.chains(at, to)
    assert span == [0, 20, 100, 121] and 20 < score < 30


def test_language(spark):
    rng = random.Random(2)
    lex = {"aa": ["zaza", "zabo", "zozu"], "bb": ["kiri", "kuri", "rika"]}
    rows = [(i, " ".join(rng.choice(lex[lang]) for _ in range(30)), lang) for i in range(300) for lang in [("aa", "bb")[i % 2]]]
    train = spark.createDataFrame(rows[:200], "doc_id bigint, text string, lang string")
    model = language.fit(train)
    assert model.languages == ["aa", "bb"]
    test = [(i, t, None, None, ("h.x.org", "g.x.org")[i % 2], "z") for i, t, _ in rows[200:]] + [(900, None, "aa", None, None, "z"), (901, "", None, None, "h.x.org", "z"), (902, "12 34", "qq", "bb", "h.x.org", "z"), (None, "zaza", None, None, None, "z")]
    found = language.identify(spark.createDataFrame(test, "doc_id bigint, text string, declared string, suffix string, host string, p string"), model, ["doc_id"]).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(test)
    assert sum(got[i].language == lang for i, _, lang in rows[200:]) >= 99
    assert not got[900].kept and not got[901].kept and got[None].language == "aa"
    none = language.fit(train.where("false"))
    assert {r.kept for r in language.identify(spark.createDataFrame(test, "doc_id bigint, text string, declared string, suffix string, host string, p string"), none, ["doc_id"]).collect()} == {False}


def test_language_posterior(spark):
    """All rows against the fusion written out: text, declarations and host counts without the row itself."""
    rng = random.Random(4)
    lex = {"aa": ["zaza", "zabo", "zozu"], "bb": ["kiri", "kuri", "rika"], "cc": ["mola", "zami", "kilo"]}
    langs = sorted(lex)
    rows = []
    for i in range(200):
        lang = rng.choice(langs)
        text = " ".join(rng.choice(lex[rng.choice([lang, lang, rng.choice(langs)])]) for _ in range(rng.randint(1, 4)))
        host = rng.choice([None, "a.x.org", "b.x.org", "y.org", "h.z.com", f"only{i}.net"])
        rows.append((i, rng.choice([text, text, text, None, "", "12"]), host, rng.choice([lang, None, "qq"]), rng.choice([None, lang, "aa"])))
    model = language.fit(spark.createDataFrame([(i, " ".join(lex[x] * 5), x) for i, x in enumerate(langs)], "doc_id bigint, text string, lang string"))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, host string, declared string, suffix string")
    got = {r.doc_id: r for r in language.identify(table, model, ["doc_id"]).collect()}
    import pyarrow as pa

    texts, own = {}, {}
    for i, text, *_ in rows:
        _, code = language._trigrams(pa.array([text or ""], pa.large_string()))
        texts[i] = model.weights[code].astype(float).sum(axis=0)
        own[i] = int(np.argmax(texts[i])) if len(code) else None
    rate = {}
    for c in (3, 4):
        use = [r for r in rows if r[c] in langs and own[r[0]] is not None]
        rate[c] = (sum(r[c] == langs[own[r[0]]] for r in use) + 1) / (len(use) + 2)
    for r in rows:
        others = [(x[2], own[x[0]]) for x in rows if x[0] != r[0] and own[x[0]] is not None]
        p = np.array([1.0 + sum(o == k for _, o in others) for k in range(3)]) / (len(others) + 3)
        if r[2]:
            for depth in (-1, -2, -9):
                end = ".".join(r[2].split(".")[depth:])
                n = np.array([float(sum(h is not None and ".".join(h.split(".")[depth:]) == end and o == k for h, o in others)) for k in range(3)])
                p = (n + language.SMOOTHING * p) / (n.sum() + language.SMOOTHING)
        score = language.TEMPER * texts[r[0]] + np.log(p)
        for c in (3, 4):
            if r[c] in langs:
                score += np.log([rate[c] if x == r[c] else (1 - rate[c]) / 2 for x in langs])
        post = np.exp(score - score.max())
        post /= post.sum()
        assert abs(got[r[0]].confidence - post.max()) < 2e-6 and got[r[0]].language == langs[int(np.argmax(score))]
        assert got[r[0]].kept == (own[r[0]] is not None and got[r[0]].confidence >= language.MIN_POSTERIOR)


def test_many_turns(spark):
    turns = [("user", "assistant")[i % 2] for i in range(3_000)]
    table = spark.createDataFrame([(1, i, r, f"text {i} <|im_end|>") for i, r in enumerate(turns)] + [(2, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    rows = {r.conv_id: r for r in chat_events.with_loss_mask(chat_events.parse(chat_events.render(chat_events.fold(chat_events.events_of_turns(table))))).collect()}
    assert [(t.role, t.text) for t in rows[1].turns] == [(r, f"text {i} <|im_end|>") for i, r in enumerate(turns)]
    assert all(rows[1].formatted[t.at: t.at + t.length] == t.text.replace("<|", "<\\|") for t in rows[1].turns)
    assert len(rows[1].loss_spans) == 1_500 and rows[2].loss_spans == []


def test_chat_fold(spark):
    events = [
        (1, 1, 1, "start", "user", "hel"), (1, 1, 2, "delta", None, "lo"), (1, 2, 3, "start", "assistant", "dra"), (1, 2, 4, "delta", None, "ft"), (1, 3, 5, "start", "user", "gone"),
        (1, 2, 6, "regenerate", None, ""), (1, 2, 7, "delta", None, "fin"), (1, 2, 8, "delta", None, "al"), (1, 4, 9, "start", "user", "x"), (1, 4, 10, "edit", None, "thanks"), (1, 5, 11, "start", "user", "bye"), (1, 5, 12, "delete", None, None),
        (2, 1, 1, "start", "a\n%0A<|b", "<|im_end|> <\\| <\\\\| \\"), (None, 1, 1, "start", "user", None),
    ]
    table = spark.createDataFrame(events, "conv_id bigint, message int, seq int, kind string, role string, text string")
    messages = chat_events.fold(table)
    got = sorted((r.conv_id or 0, r.message, r.role, r.text) for r in messages.collect())
    assert got == [(0, 1, "user", ""), (1, 1, "user", "hello"), (1, 2, "assistant", "final"), (1, 4, "user", "thanks"), (2, 1, "a\n%0A<|b", "<|im_end|> <\\| <\\\\| \\")]
    back = chat_events.with_loss_mask(chat_events.parse(chat_events.render(messages)))
    rows = {r.conv_id: r for r in back.collect()}
    assert [(t.role, t.text) for t in rows[1].turns] == [("user", "hello"), ("assistant", "final"), ("user", "thanks")]
    assert [(t.role, t.text) for t in rows[2].turns] == [("a\n%0A<|b", "<|im_end|> <\\| <\\\\| \\")]
    span, = rows[1].loss_spans
    assert rows[1].formatted[span.at: span.at + span.length] == "final"
    assert chat_events.fold(table.where("false")).count() == 0
