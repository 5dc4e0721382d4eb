"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_events, embedding_lsh, language, maxent_lm, merkle, passages, pieces, set_join, spaced_seeds, token_counts, url_cascade, vector_codes, warc_zip

COUNT_MODEL = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (source as host, lang as declaration, which labels the fit as well) and pages (markup, address, host)."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = language.fit(docs)
    nothing = F.lit(None).cast("string")
    a = docs.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), F.col("source").alias("host"), F.col("lang").alias("declared"), nothing.alias("suffix"), "text")
    b = pages.select(
        F.lit(None).cast("bigint").alias("doc_id"), "page_id", url_cascade.host_path(F.col("url"))[0].alias("host"),
        language.markup_language(F.col("html")).alias("declared"), language.address_language(F.col("url"), model.languages).alias("suffix"), language.visible_text(F.col("html")).alias("text"),
    )
    return language.identify(a.unionByName(b), model, ["doc_id", "page_id"])


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "src_id": "src_doc_id"})


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_MODEL))
    return found.withColumnRenamed("id", "doc_id")


def op4_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write_packages(_table(spark, sf_dir, "pages"), warc_zip.package_folder(spark))
    found = warc_zip.read_packages(manifest, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spaced_seeds.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    formatted = chat_events.render(chat_events.fold(chat_events.events_of_turns(turns.unionByName(extra))))
    back = chat_events.with_loss_mask(chat_events.parse(formatted))
    loss = chat_events.unescaped(F.array_join(F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s.at + 1, s.length)), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifies each document against the manifest; of one in three the text was lower-cased since."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))
    return merkle.documents_manifest(_table(spark, sf_dir, "documents"), changed)


def op13_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scores(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_language, op2_repeated_passages, op3_token_counts, op4_warc_packages, op5_url_rules, op6_pieces,
    op7_embedding_duplicates, op8_jaccard_join, op9_benchmark_overlaps, op10_chat_format,
    op11_vector_codes, op12_merkle_manifest, op13_maxent_scores, pipeline,
)}

ORACLES = {
    "op4_warc_packages": """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
     e AS (SELECT page_id, octet_length(h) AS n, sha256(h) AS digest FROM d),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM e)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op5_url_rules": r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
     u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     m AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k
           FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1""",
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     u AS (SELECT doc_id, len(ws) AS k, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) >= 5),
     v AS (SELECT doc_id, k, i, concat_ws(' ', a, lead(a, 1) OVER d, lead(a, 2) OVER d, lead(a, 3) OVER d, lead(a, 4) OVER d) AS g FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
     h AS (SELECT DISTINCT doc_id, hash(g) AS g FROM v WHERE i <= k - 4 UNION ALL SELECT doc_id, hash(array_to_string(ws, ' ')) FROM w WHERE len(ws) BETWEEN 1 AND 4),
     n AS (SELECT doc_id, count(*) AS n, sum(g::HUGEINT) AS total, bit_xor(hash(g)) AS mixed FROM h GROUP BY doc_id),
     sets AS (SELECT *, min(doc_id) OVER (PARTITION BY n, total, mixed) AS rep FROM n),
     r AS (SELECT h.doc_id, g, n FROM h JOIN sets ON h.doc_id = sets.doc_id AND sets.doc_id = rep),
     f AS (SELECT g, count(*) AS k FROM r GROUP BY g),
     o AS (SELECT r.doc_id, r.g, n, row_number() OVER (PARTITION BY r.doc_id ORDER BY k, r.g) AS place FROM r JOIN f ON r.g = f.g),
     first AS (SELECT * FROM o WHERE place <= n - ceil(0.75 * n) + 1),
     near AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM first a JOIN first b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
     p AS (SELECT x, y, nx, ny, count(*) AS common FROM near JOIN r a ON a.doc_id = x JOIN r b ON b.doc_id = y AND b.g = a.g GROUP BY ALL),
     l AS (SELECT x, y FROM p WHERE 100 * common >= 75 * (nx + ny - common)),
     e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
     c AS (SELECT x AS id, x AS comp FROM e UNION SELECT e.y, c.comp FROM c JOIN e ON e.x = c.id AND c.comp < e.y),
     m AS (SELECT id, min(comp) AS comp FROM c GROUP BY id)
SELECT d.doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(m.comp, sets.rep, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN m ON m.id = sets.rep""",
    "op10_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
     t AS (SELECT conv_id, turn, role, text, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS esc,
                  regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g') AS erole FROM c),
     g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                  sum(length(esc) + length(erole) + 12 + 1 + 10 + 1) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""",
}


def _codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Lloyd's rounds written out, one after the other; distances are below 2**53, so exact in doubles."""
    nearest = """a{r} AS MATERIALIZED (SELECT x.k, x.part, x.e, arg_min(c.entry, (c.ee - 2 * list_inner_product(x.e, c.e), c.entry)) AS entry,
                  min(c.ee - 2 * list_inner_product(x.e, c.e)) + list_inner_product(x.e, x.e) AS d FROM x JOIN c{r} c USING (part) GROUP BY x.k, x.part, x.e)"""
    moved = """u{s} AS (SELECT part, entry, i, sum(e[i]::BIGINT) AS s, count(*) AS n FROM a{r}, range(1, len(e) + 1) AS t(i) GROUP BY part, entry, i),
     m{s} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS e FROM u{s} GROUP BY part, entry),
     c{s} AS MATERIALIZED (SELECT part, entry, coalesce(m{s}.e, o.e) AS e, list_inner_product(coalesce(m{s}.e, o.e), coalesce(m{s}.e, o.e)) AS ee FROM c{r} o LEFT JOIN m{s} USING (part, entry))"""
    steps = [nearest.format(r=0)] + [step for r in range(rounds) for step in (moved.format(r=r, s=r + 1), nearest.format(r=r + 1))]
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label, list_transform(embedding, lambda z: floor(4096 * z::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
     x AS MATERIALIZED (SELECT k, p AS part, q[p * len(q) // 8 + 1 : (p + 1) * len(q) // 8] AS e FROM v, range(8) AS t(p)),
     c0 AS (SELECT part, k - 1 AS entry, e, list_inner_product(e, e) AS ee FROM x WHERE k <= 16),
     {", ".join(steps)},
     w AS (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY k),
     b AS (SELECT sha256(string_agg(e[i]::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS books FROM c{rounds}, range(1, len(e) + 1) AS t(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256 FROM v JOIN w USING (k), b"""


def _manifest_sql(levels: int = 8, above: int = 3) -> str:
    """Levels written out: enough for 8**8 documents of a language and 512 languages."""
    node = "{t}{s} AS MATERIALIZED (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {t}{r} WHERE n > 1 GROUP BY tree, pos // 8, (n + 7) // 8)"
    run = "{t}r{r} AS (SELECT tree, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM {t}{r} WHERE n > 1 GROUP BY tree, pos // 8)"
    walk = """{t}d{s} AS MATERIALIZED (SELECT d.* EXCLUDE (tree, pos, n, now, proof), d.tree, d.pos // 8 AS pos, (d.n + 7) // 8 AS n,
                  CASE WHEN hs IS NULL THEN now ELSE sha256(array_to_string(hs[: d.pos % 8] || [now] || hs[d.pos % 8 + 2 :], '')) END AS now,
                  proof || coalesce(array_to_string(hs[: d.pos % 8] || hs[d.pos % 8 + 2 :], ''), '') AS proof
                  FROM {t}d{r} d LEFT JOIN {t}r{r} r ON d.tree = r.tree AND d.pos // 8 = r.run AND d.n > 1)"""
    tree = lambda t, k: [x.format(t=t, r=r, s=r + 1) for r in range(k) for x in (node, run)]
    path = lambda t, k: [walk.format(t=t, r=r, s=r + 1) for r in range(k)]
    tops = lambda t, k: " UNION ALL ".join(f"SELECT tree, h FROM {t}{r} WHERE n = 1" for r in range(k + 1))
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bit = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(x, z))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT), lambda x, z: {bit}, 4294967295::BIGINT), 4294967295)"
    join = ",\n     ".join
    return f"""
WITH t AS (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents),
     f AS MATERIALIZED (SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf("other")} AS now FROM t),
     ld0 AS MATERIALIZED (SELECT doc_id, leaf, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                          count(*) OVER (PARTITION BY lang) AS n, now, '' AS proof FROM f),
     l0 AS (SELECT tree, pos, n, leaf AS h FROM ld0),
     {join(tree("l", levels) + path("l", levels))},
     sub AS MATERIALIZED ({tops("l", levels)}),
     g0 AS (SELECT 0 AS tree, tree AS pos, (SELECT count(*) FROM sub) AS n, h FROM sub),
     {join(tree("g", above))},
     gd0 AS (SELECT doc_id, leaf, sub.h AS subroot, 0 AS tree, d.tree AS pos, (SELECT count(*) FROM sub) AS n, now, proof FROM ld{levels} d JOIN sub ON d.tree = sub.tree),
     {join(path("g", above))},
     top AS ({tops("g", above)})
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = top.h AS verified FROM gd{above}, top"""


ORACLES |= {"op11_vector_codes": _codes_sql(), "op12_merkle_manifest": _manifest_sql()}
