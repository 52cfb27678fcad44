"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import align, katz, licenses, mixing, neardup, packing, prefixes, quality, rules, token_files, topk, toxicity, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"), 256)
    return topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)


def op3_superminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(_table(spark, sf_dir, "documents"))
    failed = ~rules.passes(rules.BASE)
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.passes(rules.WEB)).alias("kept"), "failed")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"))


def op8_toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op12_tokenizer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_RULES_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
     l AS (SELECT doc_id, text, ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM w),
     g AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
     k AS (SELECT doc_id, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS win FROM g),
     d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k),
     r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d WHERE c > 1) GROUP BY doc_id),
     m AS (SELECT l.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
                  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                  length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
           FROM l LEFT JOIN r ON l.doc_id = r.doc_id),
     b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                      + CASE WHEN 100 * n_symbols > 8 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_upper > 60 * word_chars THEN 8 ELSE 0 END
                      + CASE WHEN n_dup_lines > 3 AND 100 * n_dup_lines > 60 * n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM b
"""

_TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                               ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
     n AS (SELECT doc_id, len(sh)::BIGINT AS n, sh FROM s),
     e AS (SELECT doc_id, n, unnest(sh) AS t FROM n),
     o AS (SELECT t FROM e GROUP BY t HAVING count(*) > 1),
     f AS (SELECT e.* FROM e SEMI JOIN o ON e.t = o.t),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM f a JOIN f b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     k AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
     r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT k.b, r.c FROM r JOIN k ON r.doc_id = k.a),
     m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON n.doc_id = m.doc_id
"""


#: The polynomial of crc32, applied eight times to each of the 256 bytes, then to a text's bytes in order.
_VARIANTS_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
     crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
     r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
     d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
     b AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)) AS bytes FROM d),
     h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
     e AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h),
     w AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     x AS (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
     q AS (SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
           UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.rest = b.word),
     g AS (SELECT word, count(*)::BIGINT AS n_near, min(struct_pack(m := -other_n, o := other)) AS best FROM q GROUP BY word),
     f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * w.n THEN best.o END AS form, CASE WHEN -best.m >= 2 * w.n THEN (-best.m)::BIGINT END AS form_n FROM w LEFT JOIN g ON w.word = g.word),
     c(word, place) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.place = f.word WHERE f.form IS NOT NULL),
     z AS (SELECT c.word, c.place AS root FROM c JOIN f ON c.place = f.word WHERE f.form IS NULL)
SELECT f.*, root FROM f JOIN z ON f.word = z.word
"""


def _licence_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(name)}, {quote(body)})" for name, body in licenses.KNOWN)
    spell = "trim(regexp_replace(regexp_replace(lower(T), '(?m)^[^a-z\\n]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    for pattern, to in licenses.SPELLINGS:
        spell = f"regexp_replace({spell}, {quote(pattern)}, {quote(to)}, 'g')"
    digest = f"sha256({spell})"
    return f"""
WITH k(licence, body) AS (VALUES {known}),
     g AS (SELECT min(licence) AS licence, digest FROM (SELECT licence, {digest.replace("lower(T)", "lower(body)")} AS digest FROM k) GROUP BY digest),
     d AS (SELECT doc_id, coalesce(text, '') AS text, {digest.replace("lower(T)", "lower(coalesce(text, ''))")} AS text_digest FROM documents),
     l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
     h AS (SELECT doc_id, licence FROM (SELECT doc_id, {digest.replace("lower(T)", "lower(line)")} AS digest FROM l WHERE regexp_matches(line, '\\p{{L}}')) x JOIN g USING (digest)),
     a AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM h GROUP BY doc_id)
SELECT d.doc_id, d.text_digest, g.licence AS whole_licence, coalesce(a.n, 0)::BIGINT AS n_notices, coalesce(a.names, '') AS notices
FROM d LEFT JOIN g ON d.text_digest = g.digest LEFT JOIN a ON d.doc_id = a.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": _TOP_SQL, "op3_superminhash_groups": _NEAR_SQL, "op5_quality_rules": _RULES_SQL, "op10_licence_scan": _licence_sql(), "op13_spelling_variants": _VARIANTS_SQL}
