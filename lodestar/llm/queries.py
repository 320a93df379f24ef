"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import ann, bpe, decontam, line_dedup, merkle, minhash, phrases, pii, quality, secrets, suffix_dedup, token_counts, warc
from lodestar.llm.common import materialise, read_table, scratch_path

#: Secret of the pseudonyms; a user passes their own to ``pii``.
PII_KEY = b"lodestar example key"
VOCABULARY = "byte_bpe_50k.tiktoken"
SECOND_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"), PII_KEY)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents come in; every tenth is revised (white space squeezed); every seventeenth goes; the second batch comes again. The first batch is compacted into a base."""
    docs = read_table(spark, sf_dir, "documents")
    tokenizers = {"byte_bpe_50k": public_tokenizers.path(VOCABULARY), "byte_bpe_multi_50k": public_tokenizers.path(SECOND_VOCABULARY)}
    count = functools.partial(token_counts.count_tokens, tokenizers=tokenizers, pattern=public_tokenizers.PATTERN)
    counted = materialise(count(docs), "token-counts")
    revised = F.pmod("doc_id", F.lit(10)) == 3
    fresh = materialise(count(docs.where(revised).withColumn("text", F.regexp_replace("text", r"[ \n]+", " "))), "token-counts-revised")
    deleted = F.pmod("doc_id", F.lit(17)) == 5
    rollup = token_counts.Rollup(spark, scratch_path(spark, "token-rollup"))
    rollup.commit("insert", token_counts.changes(None, counted))
    rollup.compact()
    revision = token_counts.changes(counted.where(revised), fresh)
    rollup.commit("revise", revision)
    rollup.commit("delete", token_counts.changes(counted.where(deleted & ~revised).unionByName(fresh.where(deleted)), None))
    rollup.commit("revise", revision)
    return rollup.totals()


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read_table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_line_dedup, op3_pii, op4_token_counts, op5_suffix_dedup, op6_quality, op7_nearest, op8_decontaminate, op9_minhash, op10_warc, op11_merkle, op12_secrets, op13_phrases)
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Only what SQL can do over whole tables; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT html, max(page_id) AS last FROM p WHERE strlen(html) >= 1000 GROUP BY html)
        SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN p.page_id < g.last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id < g.last THEN g.last END AS refers_to
        FROM p LEFT JOIN g ON p.html = g.html
    """,
    # all pairs that share a shingle, and what they connect; bands miss a pair with probability 3e-6
    "op9_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        s AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        c AS (SELECT doc_id, g, count(*) AS k FROM s GROUP BY ALL),
        n AS (SELECT doc_id, sum(k) AS n FROM c GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.k, y.k)) AS same FROM c x JOIN c y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n u ON a = u.doc_id JOIN n v ON b = v.doc_id WHERE same >= 0.8::DOUBLE * (u.n + v.n - same) - 1e-9::DOUBLE),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a
    """,
    # levels by recursion, siblings by place, crc32 bit by bit; each row's proof is folded level by level
    "op11_merkle": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS grp, CAST(doc_id AS VARCHAR) AS id, text,
                   concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                          CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS front
            FROM documents),
        t AS (SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(id) + 1), lambda i: [ord(id[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                    lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1))), 4294967295::BIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM d),
        l AS (SELECT doc_id, grp, sha256(front || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
                     sha256(front || CASE WHEN text IS NULL THEN '-' ELSE strlen(other) || ':' || other END) AS tampered FROM t),
        p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM l),
        up AS (SELECT grp, 0 AS lvl, idx, leaf AS h, n FROM p
               UNION ALL SELECT grp, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY grp, lvl, idx // 3, n),
        r AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
        top AS (SELECT 0 AS lvl, idx, subroot AS h, n FROM r UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
        q AS (SELECT p.*, r.subroot, r.idx AS top_idx, (SELECT h FROM top WHERE n = 1) AS root FROM p JOIN r ON p.grp = r.grp),
        steps AS (
            SELECT q.grp, q.idx AS leaf_idx, up.lvl, coalesce(string_agg(up.h, '' ORDER BY up.idx) FILTER (up.idx < q.idx // CAST(3 ** up.lvl AS BIGINT)), '') AS a, coalesce(string_agg(up.h, '' ORDER BY up.idx) FILTER (up.idx > q.idx // CAST(3 ** up.lvl AS BIGINT)), '') AS b
            FROM q JOIN up ON q.grp = up.grp AND up.n > 1 AND up.idx // 3 = q.idx // CAST(3 ** (up.lvl + 1) AS BIGINT) GROUP BY ALL
            UNION ALL
            SELECT q.grp, q.idx, 100 + top.lvl, coalesce(string_agg(top.h, '' ORDER BY top.idx) FILTER (top.idx < q.top_idx // CAST(3 ** top.lvl AS BIGINT)), ''), coalesce(string_agg(top.h, '' ORDER BY top.idx) FILTER (top.idx > q.top_idx // CAST(3 ** top.lvl AS BIGINT)), '')
            FROM q JOIN top ON top.n > 1 AND top.idx // 3 = q.top_idx // CAST(3 ** (top.lvl + 1) AS BIGINT) GROUP BY ALL),
        way AS (SELECT grp, leaf_idx, list({'a': a, 'b': b} ORDER BY lvl) AS w FROM steps GROUP BY ALL),
        f AS (SELECT q.*, coalesce(w, []) AS w, tampered AS h, 0 AS step FROM q LEFT JOIN way ON q.grp = way.grp AND q.idx = way.leaf_idx
              UNION ALL SELECT * REPLACE (sha256(w[step + 1].a || h || w[step + 1].b) AS h, step + 1 AS step) FROM f WHERE step < len(w))
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(w, lambda x: x.a || x.b), 'string_agg', ''), '')) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM f WHERE step = len(w)
    """,
    # every phrase of up to four words, counted at all its places
    "op13_phrases": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, w[i:i + m - 1] AS ws, count(*) AS f FROM (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS m FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)) GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE len(ws) = 1 GROUP BY lang),
        c AS (SELECT lang, ws, f AS a FROM g WHERE len(ws) > 1 AND f >= 30),
        k AS (SELECT c.lang, c.ws, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
              FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c) c JOIN g l ON l.lang = c.lang AND l.ws = c.ws[1:k] JOIN g r ON r.lang = c.lang AND r.ws = c.ws[k + 1:]),
        s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
        inner_parts AS (SELECT DISTINCT lang, a AS longer, ws[i:i + m - 1] AS ws
                  FROM (SELECT lang, ws, a, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT lang, ws, a, unnest(range(2, len(ws))) AS m FROM c WHERE len(ws) > 2))),
        gone AS (SELECT DISTINCT s.lang, s.ws FROM s JOIN inner_parts i ON i.lang = s.lang AND i.ws = s.ws WHERE 100 * i.longer >= 80 * s.a),
        t AS (SELECT s.lang, array_to_string(s.ws, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM s WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = s.lang AND gone.ws = s.ws)),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
        SELECT o.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
    """,
    "op8_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        ks AS (SELECT DISTINCT k FROM iw),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
               FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
        m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
        h AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS o FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
              FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
    """,
}
