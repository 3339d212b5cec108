"""The queries opN_<name> over whole test tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm import (bpe, context_tree, decontamination, exact_dedup, near_dedup, ngram_join, quality,
                            token_count, token_output, toxicity, url_filter, vector_codes, whitening)


def _vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_output.write_ids(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_output.digests(made)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), digest=True)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scores(_table(spark, sf_dir, "documents"), held_out=lambda c: F.pmod(c, F.lit(5)) == 1)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), limit=2048)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), words=2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        decontamination.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The rules of the registered URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), label="quality",
                          held_out=lambda c: F.pmod(c, F.lit(5)) == 0, threshold=0.3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), label="toxic",
                           held_out=lambda c: F.pmod(c, F.lit(4)) == 2, threshold=0.3).drop("evidence")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"), words=5, percent=80)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), components=4)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_output, op2_exact_dedup, op3_bpe_round_trip, op4_context_tree_scores, op5_token_count,
                            op6_minhash_near_dedup, op7_decontamination, op8_url_filter, op9_quality_classifier, op10_toxicity,
                            op11_ngram_join, op12_whitening, op13_vector_codes)}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def similar_texts(words: int, more: str) -> str:
    """SQL of the groups of texts whose sets of word shingles have a similarity of 0.8 or more."""
    return rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(regexp_extract_all({_AZ.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {words - 1}), ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 180 * k >= 80 * (x.n + y.n)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, hit) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.hit = e.a),
        c AS (SELECT doc_id, min(hit) AS component_id FROM r GROUP BY 1),
        t AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS t FROM s GROUP BY 1)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, {more}
               coalesce(min(doc_id) OVER (PARTITION BY coalesce(t.t, chr(10) || doc_id)), doc_id) AS class_id
        FROM c LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _coded_vectors(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """SQL of the product codes: every part of every vector against every entry of its codebook."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS (SELECT vec_id, p, arg_min(j, [far, j]) AS j, min(far) AS far FROM (
                 SELECT v.vec_id, v.p, b.j, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
                 FROM v JOIN b{r} b ON b.p = v.p) GROUP BY 1, 2)""")
        if r < rounds:
            means = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, width + 1))
            steps.append(f"""
        b{r + 1} AS (SELECT p, j, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
                 SELECT p, j, [{means}] AS x FROM v JOIN a{r} USING (vec_id, p) GROUP BY 1, 2) m USING (p, j))""")
    return f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda z: floor(256 * z::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
        v AS (SELECT vec_id, p, list_slice(x, p * {width} + 1, p * {width} + {width}) AS x FROM k, range({parts}) q(p)),
        b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x FROM v
               QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}),
        {",".join(steps).strip()},
        books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, j)) AS s FROM b{rounds}),
        c AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY 1)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, books.s AS codebooks_sha256
        FROM c JOIN k USING (vec_id), books"""


ORACLES = {
    "op6_minhash_near_dedup": similar_texts(2, "doc_id = component_id AS kept,"),
    "op11_ngram_join": similar_texts(5, ""),
    "op13_vector_codes": _coded_vectors(),
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_AZ.format("coalesce(text, '')")}) AS s FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
        FROM d WINDOW w AS (PARTITION BY s)""",
    "op7_decontamination": rf"""
        WITH items AS (
            SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_AZ.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
        docs AS (
            SELECT doc_id, coalesce(regexp_extract_all({_AZ.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
        hits AS (SELECT doc_id, i, windows.n, item_id FROM places JOIN windows
                 ON windows.n = places.n AND list_slice(w, i, i + places.n - 1) = g),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op8_url_filter": f"""
        WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
        cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, {_AZ.format("regexp_extract(rest, '^[^/]*')")} AS host, substr(rest, len(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut),
        best AS (
            SELECT page_id, arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}},
                   [len(r.host || r.path), len(r.host), (r.verdict = 'block')::INT]) AS b
            FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            GROUP BY page_id)
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)""",
}
