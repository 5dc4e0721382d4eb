"""Each stage of the pipeline on nulls, repeats, clashing columns and empty tables."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, spans string, id int, n int, comp string, bucket int"
WORDS = [f"word{i}" for i in range(2000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def base(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(1)
    item = text(rng, 20)
    spark.createDataFrame([(0, item), (1, None), (None, "a b c"), (2, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), item


def docs_of(spark, rows):
    full = [(i, t, "en" if t else None, "host.org" if i else None, None if t is None else len(t), "x", "y", 7, 8, "z", 9) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def kept(stage, spark, docs, folder):
    out = getattr(corpus_pipeline, stage)(spark, docs, folder)
    assert out.columns == docs.columns
    assert all((r.spans, r.id, r.n, r.comp, r.bucket) == ("y", 7, 8, "z", 9) for r in out.collect())
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def pairs(rows):
    return sorted(set(rows), key=repr)


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_leaks", "encode"]


def test_language(spark, base):
    rng = random.Random(2)
    rows = [(i, text(rng, 30)) for i in range(20)]
    odd = [(None, text(rng, 30)), (None, None), (21, None), (22, ""), (23, "12 34"), (3, text(rng, 30)), (4, None), rows[5], rows[5]]
    assert kept("identify_language", spark, docs_of(spark, rows + odd), base[0]) == pairs([*rows, odd[0], odd[5]])


def test_near_duplicates(spark, base):
    rng = random.Random(3)
    a, b, c, d = (text(rng, 60) for _ in range(4))
    near = a.rsplit(" ", 2)[0] + " new words"
    rows = [(1, a), (2, near), (3, b), (9, c), (9, c), (5, a), (5, d), (7, d), (None, b), (None, None), (None, None), (10, None), (11, ""), (12, "")]
    got = kept("drop_near_duplicates", spark, docs_of(spark, rows), base[0])
    # an id with two texts is two documents, one of them later than all others: only the copy of 1 goes, and one of the two with d
    assert got in [pairs([(1, a), (3, b), (9, c), (i, d), (None, None), (10, None), (11, ""), (12, "")]) for i in (5, 7)]


def test_repeated_passages(spark, base):
    rng = random.Random(4)
    p = text(rng, 60)
    one, two, three = text(rng, 40), text(rng, 40), text(rng, 40)
    rows = [(1, f"{one} {p}"), (2, f"{p} {two}"), (3, p), (4, f"{p} \t\n"), (5, None), (6, "\t\n"), (7, f"{three} {p}"), (7, f"{p} {p}"), (7, f"{three} {p}"), (None, f"{two} {three}"), (8, "")]
    got = kept("cut_repeated_passages", spark, docs_of(spark, rows), base[0])
    assert got == pairs([(1, f"{one} {p}"), (2, two), (5, None), (6, "\t\n"), (7, three), (None, f"{two} {three}"), (8, "")])
    out = corpus_pipeline.cut_repeated_passages(spark, docs_of(spark, rows), base[0])
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out.collect())
    bare = corpus_pipeline.cut_repeated_passages(spark, docs_of(spark, rows).drop("n_chars"), base[0])
    assert bare.count() == len(got)


def test_benchmark_leaks(spark, base):
    folder, item = base
    rng = random.Random(5)
    clean = text(rng, 50)
    changed = item.split()
    changed[7] = "other"
    rows = [(1, clean), (2, f"{clean} {item}"), (3, " ".join(changed)), (None, item), (None, clean), (4, None), (5, ""), (6, clean), (6, item), (6, item), (8, clean), (8, clean)]
    assert kept("drop_benchmark_leaks", spark, docs_of(spark, rows), folder) == pairs([(1, clean), (None, clean), (4, None), (5, ""), (6, clean), (8, clean)])


def test_encode(spark, base):
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "four"), (2, None), (3, "")]
    out = corpus_pipeline.encode_pieces(spark, docs_of(spark, rows), base[0]).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in out) == [(0, True), (1, True), (1, True), (2, False), (3, False)]


def test_empty_tables(spark, base):
    folder, _ = base
    docs = docs_of(spark, [(1, "a")]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run(spark, base):
    folder, item = base
    rng = random.Random(6)
    texts = [text(rng, 80) for _ in range(30)]
    rows = [*enumerate(texts), (40, texts[3]), (41, f"{text(rng, 50)} {item}"), (42, None), (43, "12 34"), (3, texts[3])]
    docs_of(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    # 3 is there twice, as one document
    assert sorted(r.doc_id for r in out) == [*range(30)]
