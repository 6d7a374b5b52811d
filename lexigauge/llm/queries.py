"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, langid, pages, pieces, pii, prefix_trie, quality, secrets, token_counts, toxicity, whitening
from .base import LOWER, UPPER, crc_mod, table
from .exact_dedup import exact_dedup
from .minmax import near_duplicates

#: Published, so that the query's result can be repeated; whoever replaces real data uses a secret one.
KEY = "lexigauge"


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("tkey")


def op1_main_text(spark, sf_dir):
    return pages.main_text(table(spark, sf_dir, "pages"))


def op2_langid(spark, sf_dir):
    return langid.learn_and_identify(table(spark, sf_dir, "documents"), folds=4, held=2)


def op3_pii_surrogates(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"), KEY)


def op4_secrets(spark, sf_dir):
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), where=crc_mod(F.col("doc_id"), 3) != 1)
    return quality.quality(docs, model, folds=3, held=1)


def op6_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


def op7_decontam(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tkey")


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("tkey")


def op9_minmax_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).drop("tkey")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_langid": op2_langid,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_pieces": op6_pieces,
    "op7_decontam": op7_decontam,
    "op8_toxicity": op8_toxicity,
    "op9_minmax_dedup": op9_minmax_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_token_counts": op13_token_counts,
}

SQL = {
    "op9_minmax_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.m = l.x)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM s JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1) USING (doc_id)
    """,
    "op11_prefix_trie": """
        WITH RECURSIVE t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nr
            FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT c, c - c % 100 AS base, list_reduce(list_prepend(4294967295, list_transform(range(8 * len(s)), lambda i: CASE WHEN i % 8 = 0 THEN ord(s[i // 8 + 1]) ELSE -1 END)), lambda a, x: CASE
                WHEN xor(a, greatest(x, 0)) & 1 = 1 THEN xor(xor(a, greatest(x, 0)) >> 1, 3988292384) ELSE xor(a, greatest(x, 0)) >> 1 END) AS r
              FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
        h AS (SELECT c, base, xor(r, 4294967295) % 6 AS h FROM k),
        b AS (SELECT h.c, t.role, t.text, 0 AS own, t.nr FROM h JOIN t ON t.c = h.base AND t.nr <= h.h
              UNION ALL SELECT h.c, t.role, t.text, 1, t.nr FROM h JOIN t ON t.c = h.c AND t.nr > h.h),
        d AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, nr) AS depth FROM b),
        p AS (SELECT c, 0 AS depth, '' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS n FROM h
              UNION ALL SELECT d.c, d.depth, sha256(concat(p.node, ':', length(d.role), ':', d.role, d.text)), p.node, length(d.text) FROM p JOIN d ON d.c = p.c AND d.depth = p.depth + 1),
        l AS (SELECT c, max(depth) AS last FROM p GROUP BY c),
        nodes AS (SELECT node, parent, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved,
                  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = last), '') AS ends FROM p JOIN l USING (c) GROUP BY node, parent, depth),
        kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
        sums AS (SELECT p.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
                 FROM nodes n LEFT JOIN kids k ON k.node = n.node JOIN p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
               s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes up ON up.node = n.parent
    """,
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
}
