"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm import bpe, collocations, hmm, huffman, jaccard, langid, media, packing, pq, quality, sortmeans, substrings, suffix
from itemforge.llm.shared import shared_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 counts, and its base verdict, without the trained part: SQL can tell these."""
    return op1_quality_llr(spark, sf_dir).drop("score", "kept")


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/huffman-{uuid.uuid4().hex}"
    huffman.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return huffman.read_ids(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.drop_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op7_bpe_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_pq_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.clustering(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def _sort_means_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Every round compares all vectors with all centroids; distance and number share one integer, so ties go to the smaller."""
    square = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS HUGEINT)"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {clusters}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({square} * {clusters} + j) AS m FROM v, c{n} GROUP BY r)")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(x, c) AS c FROM c{n} c LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
                FROM (SELECT m % {clusters} AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY ALL) GROUP BY j) USING (j))""")
    return "WITH " + ", ".join(parts) + f""" SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256 FROM (SELECT vec_id, m % {clusters} AS j, m // {clusters} AS d FROM a{rounds}) JOIN c{rounds} USING (j)"""


QUERIES = {f.__name__: f for f in (op1_quality_llr, op2_huffman_ids, op3_pack_binary, op4_hmm_score, op5_suffix_dedup, op6_jaccard_rtree, op7_bpe_forced, op8_crf_language, op9_seed_extend, op10_pq_near, op11_sort_means, op12_collocations, op13_media_columns, quality_base)}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: SQL where the result can be told without the trained model, the tokenizer or the byte strings.
ORACLE_SQL = {
    "quality_base": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
        k AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM t WHERE len(w) >= 5)),
        d AS (SELECT DISTINCT doc_id, unnest(range(p, p + 5)) AS i FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k) WHERE c > 1),
        r AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "op5_suffix_dedup": """WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    k AS (SELECT r, p, md5(b[p : p + 199]) AS k FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS p FROM t WHERE octet_length(b) >= 200)),
    d AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1),
    g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER w + 200 THEN 0 ELSE 1 END AS first FROM d WINDOW w AS (PARTITION BY r ORDER BY p)),
    m AS (SELECT r, min(p) AS s, max(p) + 199 AS e FROM (SELECT r, p, sum(first) OVER (PARTITION BY r ORDER BY p) AS run FROM g) GROUP BY r, run),
    x AS (SELECT r, 0 AS e FROM t UNION ALL SELECT r, e FROM m),
    y AS (SELECT x.r, x.e + 1 AS a, coalesce((SELECT min(s) FROM m WHERE m.r = x.r AND m.s > x.e), octet_length(b) + 1) - 1 AS z, b FROM x JOIN t USING (r)),
    h AS (SELECT r, string_agg(hex(b[a : z]), '' ORDER BY a) FILTER (z >= a) AS kept FROM y GROUP BY r),
    c AS (SELECT r, CAST(sum(e - s + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM m GROUP BY r)
    SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t JOIN h USING (r) LEFT JOIN c USING (r)""",
    "op6_jaccard_rtree": f"""WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM t WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        c(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id)
        SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.id GROUP BY id""",
    "op9_seed_extend": f"""WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        k AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM t WHERE len(w) >= 20)),
        r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM k),
        g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i, true AS gone FROM r WHERE r > 1),
        e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
        s AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) FILTER (gone IS NULL) AS kept, count(gone) AS n FROM e LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
        SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s ON s.doc_id = t.doc_id""",
    "op12_collocations": f"""WITH p AS (SELECT r, lang, unnest(s) AS s, unnest(range(len(s))) AS j FROM (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]') AS s FROM documents)),
        e AS (SELECT r, lang, j, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT r, lang, j, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p)),
        q AS (SELECT lang, w AS g1, w || ' ' || lead(w) OVER o AS g2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g3 FROM e WINDOW o AS (PARTITION BY r, j ORDER BY i)),
        k AS MATERIALIZED (SELECT lang, 1 AS k, g1 AS g, count(*) AS c FROM q GROUP BY ALL UNION ALL SELECT lang, 2, g2, count(*) FROM q WHERE g2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10 UNION ALL SELECT lang, 3, g3, count(*) FROM q WHERE g3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM k WHERE k = 1 GROUP BY lang),
        f AS (SELECT lang, k, g, c, string_split(g, ' ') AS w FROM k WHERE k > 1),
        u AS (SELECT f.*, x, array_to_string(w[1 : x], ' ') AS a1, array_to_string(w[x + 1 : k], ' ') AS a2 FROM f, range(1, 3) t(x) WHERE x < k),
        v AS (SELECT u.*, l.c AS l, r.c AS r, CAST(1000000 * CAST(u.c AS HUGEINT) * u.c // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score FROM u JOIN k l ON l.lang = u.lang AND l.k = x AND l.g = a1 JOIN k r ON r.lang = u.lang AND r.k = u.k - x AND r.g = a2),
        b AS (SELECT lang, k, g, any_value(c) AS a, arg_min(l, score * 2 + x) AS l, arg_min(r, score * 2 + x) AS r, min(score) AS score FROM v GROUP BY ALL),
        h AS (SELECT lang, c, w[1] || ' ' || w[2] AS g FROM f WHERE k = 3 UNION ALL SELECT lang, c, w[2] || ' ' || w[3] FROM f WHERE k = 3),
        d AS (SELECT DISTINCT lang, b.g FROM b JOIN h USING (lang, g) WHERE k = 2 AND 100 * h.c >= 50 * b.a),
        z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, score FROM b WHERE k = 3 OR (lang, g) NOT IN (SELECT (lang, g) FROM d))
        SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000""",
    "op11_sort_means": _sort_means_sql(),
    "op10_pq_near": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        c(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT id AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(root) AS component_id, id = min(root) AS kept FROM c LEFT JOIN n ON n.a = c.id GROUP BY id""",
}
