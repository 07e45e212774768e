"""Thin queries over the operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, bpe_count, bpe_tree, conv_repair, filter_audit, line_rules, minhash, packing, quality, sp_sample, suffix, topk_mih, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), with_ids=False)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100, against all vectors."""
    codes = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk_mih.sign_code(F.col("embedding")).alias("code"))
    return topk_mih.nearest(codes, codes.where("id % 100 = 0"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(_read(spark, sf_dir, "documents")).drop("clean_text", "lost")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(_read(spark, sf_dir, "documents"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_sample.sample_segmentations(_read(spark, sf_dir, "documents"), with_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.lm_scores(_read(spark, sf_dir, "documents"))
    return out.withColumn("log_score", F.round("log_score", 4))


def op9_backoff_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 3; the SQL of op9_backoff_scores is of order 2."""
    out = backoff.lm_scores(_read(spark, sf_dir, "documents"), order=3)
    return out.withColumn("log_score", F.round("log_score", 4))


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated(_read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_repair.digests(*conv_repair.repair(_read(spark, sf_dir, "conversations")))


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_topk_search, op3_line_rules, op4_token_counts, op5_sampled_pieces, op6_toxicity, op7_quality, op8_near_duplicates, op9_backoff_scores, op9_backoff_trigrams, op10_repeated_strings, op11_filter_audit, op12_conversation_repair, op13_tree_bpe)}

#: DuckDB SQL, written apart from the operators: brute force where they search.
ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": """
        WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance
              FROM b q, b c WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM d)
        SELECT query_id, rank, id, distance FROM r WHERE rank <= 10""",
    "op3_line_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3), g3 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
        rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM g3, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
        l AS (SELECT rid, unnest(list_distinct(ls)) AS x FROM w),
        v AS (SELECT rid, x, lower(trim(x, ' ')) AS low, len(string_split(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ')) AS n,
                len(regexp_extract_all(x, '[#*$%&|<>]{2,}|[|<>»]')) AS symbols, len(regexp_extract_all(x, '\p{L}')) AS letters, len(regexp_extract_all(x, '\p{Lu}')) AS upper FROM l),
        good AS (SELECT rid, sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) AS solid FROM v
          WHERE low = '' OR ((regexp_matches(low, '[.!?…。！？:;,]["''”’»)\]*_`]*$') OR n >= 6)
            AND low NOT IN ('home', 'menu', 'login', 'log in', 'sign in', 'sign up', 'register', 'search', 'next', 'previous', 'back', 'contact', 'about', 'about us', 'contact us', 'sitemap', 'read more', 'show more') AND symbols <= 0.1::DOUBLE * n
            AND NOT (n >= 4 AND upper > 0.7::DOUBLE * letters)
            AND NOT regexp_matches(low, 'all rights reserved|cookie policy|we use cookies|privacy policy|terms of use|terms of service|terms and conditions|enable javascript|javascript is disabled|subscribe to our newsletter|sign up for our newsletter|click here to|skip to content|skip to main content|powered by wordpress|lorem ipsum|copyright \(c\)|share on facebook|share this:'))
          GROUP BY rid),
        c AS (SELECT w.rid, doc_id, t, len(ws) AS n, length(array_to_string(ws, '')) AS chars, len(ls) - len(list_distinct(ls)) AS dup, coalesce(rep.n, 0) AS again, coalesce(good.solid, 0) AS solid FROM w LEFT JOIN rep ON rep.rid = w.rid LEFT JOIN good ON good.rid = w.rid)
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(again AS BIGINT) AS n_repeat_words,
               n < 50 OR 100 * again > 50 * n AS base_failed, NOT (n < 50 OR 100 * again > 50 * n) AND (chars = 0 OR 1 - solid::DOUBLE / chars <= 0.5) AS kept FROM c""",
    "op9_backoff_scores": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        t AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
        p AS (SELECT a.doc_id, a.i, a.x, v.x AS v FROM t a LEFT JOIN t v ON v.doc_id = a.doc_id AND v.i = a.i - 1),
        c1 AS (SELECT x, count(*) AS c FROM t GROUP BY x), o1 AS (SELECT doc_id, x, count(*) AS c FROM t GROUP BY doc_id, x),
        c2 AS (SELECT v, x, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, x), o2 AS (SELECT doc_id, v, x, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY doc_id, v, x),
        n AS (SELECT count(*) AS n FROM t), nd AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        s AS (SELECT p.doc_id, p.v, coalesce(c2.c - o2.c, 0) AS cp, c1.c - o1.c AS cw, cv.c - ov.c AS cv, n.n - nd.n AS rest
              FROM p JOIN c1 ON c1.x = p.x JOIN o1 ON o1.doc_id = p.doc_id AND o1.x = p.x
              LEFT JOIN c1 cv ON cv.x = p.v LEFT JOIN o1 ov ON ov.doc_id = p.doc_id AND ov.x = p.v
              LEFT JOIN c2 ON c2.v = p.v AND c2.x = p.x LEFT JOIN o2 ON o2.doc_id = p.doc_id AND o2.v = p.v AND o2.x = p.x
              JOIN nd ON nd.doc_id = p.doc_id CROSS JOIN n),
        l AS (SELECT doc_id, cp, cw, CASE WHEN cp > 0 THEN ln(cp / cv)
                WHEN cw > 0 THEN ln(cw / rest) + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END
                ELSE ln(0.4) - ln(rest + 1) + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END END AS s FROM s)
        SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(sum(CASE WHEN cp > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_pairs_seen,
               CAST(coalesce(sum(CASE WHEN cp <= 0 AND cw > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_words_seen, round(coalesce(sum(l.s), 0), 4) AS log_score
        FROM w LEFT JOIN l ON l.doc_id = w.doc_id GROUP BY w.doc_id, len(w.ws)""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT d.part, coalesce(g.good, 0) AS good, coalesce(g.toxic, 0) AS toxic,
                CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 'E' ELSE '' END AS fails
              FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS own, substr(filter_order, 1, k - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
        r AS (SELECT f.part, s.filter_order, s.step, s.own, f.good, f.toxic, f.fails, contains(f.fails, s.own) AS hit, translate(s.before, f.fails, '') <> s.before AS gone FROM f, s),
        c AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT hit THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN 1 ELSE 0 END) AS removed,
                sum(CASE WHEN gone AND hit THEN 1 ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN 1 ELSE 0 END) AS unique_fails,
                sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        crc(key, c, i) AS (
          SELECT key, CAST(4294967295 AS BIGINT), 0 FROM (SELECT DISTINCT key FROM k)
          UNION ALL
          SELECT key, list_reduce(list_concat([xor(c, CAST(ascii(substr(key, i + 1, 1)) AS BIGINT))], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), i + 1 FROM crc WHERE i < length(key)),
        h AS (SELECT key, CAST(xor(c, 4294967295) % 20 AS INTEGER) AS f FROM crc WHERE i = length(key)),
        d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
              FROM k JOIN h USING (key)),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM d),
        r AS (SELECT *, left(role, 1) AS a, CASE WHEN bare = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS la FROM n),
        m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                count(*) FILTER (la IS NOT NULL AND la || a NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM r GROUP BY conv_id),
        -- every cheapest way so far, a row for each kind of ending ('', s, u, a) and number of rows taken: cost, letters, repaired rows
        w AS (
          SELECT conv_id, CAST(0 AS BIGINT) AS i, x.e AS e, x.c AS cost, x.l AS audit, x.o AS made
          FROM (SELECT DISTINCT conv_id FROM r), (VALUES ('', 0, '', []::VARCHAR[]), ('u', 3, 'I', ['user:']), ('a', 6, 'II', ['user:', 'assistant:'])) x(e, c, l, o)
          UNION ALL
          SELECT conv_id, i, e, cost, audit, made FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id, e ORDER BY cost, audit) AS best FROM (
              SELECT z.conv_id, z.i, y.e, z.cost + y.c AS cost, z.audit || y.l AS audit, list_concat(z.made, y.o) AS made FROM (
                SELECT w.conv_id, r.i, t.e, w.cost + t.c + CASE WHEN r.fault = 't' AND t.l <> 'D' THEN 3 ELSE 0 END AS cost, w.audit || t.l AS audit,
                       CASE t.l WHEN 'D' THEN w.made WHEN 'K' THEN list_append(w.made, r.role || ':' || r.text) ELSE list_append(w.made, CASE t.e WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text) END AS made
                FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
                JOIN (VALUES ('', 'D', '', '', 4), ('s', 'D', 's', '', 4), ('u', 'D', 'u', '', 4), ('a', 'D', 'a', '', 4), ('', 'K', 's', 's', 0), ('', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0), ('a', 'K', 'u', 'u', 0),
                             ('', 'R', 'u', '', 3), ('s', 'R', 'u', '', 3), ('u', 'R', 'a', '', 3), ('a', 'R', 'u', '', 3)) t(was, l, e, needs, c)
                  ON t.was = w.e AND (t.l <> 'K' OR t.needs = r.a) AND (t.l = 'D' OR r.fault NOT IN ('b', 'd'))) z
              JOIN (VALUES ('', '', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []::VARCHAR[]), ('u', 'u', 0, '', []::VARCHAR[]), ('a', 'a', 0, '', []::VARCHAR[]), ('', 'u', 3, 'I', ['user:']), ('', 'a', 6, 'II', ['user:', 'assistant:']),
                           ('s', 'u', 3, 'I', ['user:']), ('s', 'a', 6, 'II', ['user:', 'assistant:']), ('u', 'a', 3, 'I', ['assistant:']), ('a', 'u', 3, 'I', ['user:'])) y(was, e, c, l, o) ON y.was = z.e)) WHERE best = 1),
        x AS (SELECT w.*, row_number() OVER (PARTITION BY w.conv_id ORDER BY cost, audit) AS best FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.rows = w.i WHERE w.e IN ('', 'a'))
        SELECT c.conv_id, CAST(coalesce(m.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(m.blank, 0) AS BIGINT) AS blank, CAST(coalesce(m.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(m.truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(m.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.cost, 0) AS BIGINT) AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(array_to_string(x.made, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.best = 1 AND x.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
