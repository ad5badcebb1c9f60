"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import curves, dac, linededup, mixing, packing, pii, quality, tokengroups, wand, warc
from .runtime import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_token_codes(spark, sf_dir):
    return dac.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op3_token_groups(spark, sf_dir):
    return tokengroups.join(table(spark, sf_dir, "documents"))


OP3 = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT s.doc_id AS doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least(s.doc_id, l.b), s.doc_id) AS component_id, coalesce(n.n_links, 0)::BIGINT AS n_links
FROM sets s LEFT JOIN least l ON l.a = s.doc_id LEFT JOIN n ON n.a = s.doc_id
"""


def op4_wand(spark, sf_dir):
    return wand.search(table(spark, sf_dir, "documents"))


OP4 = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM w GROUP BY ALL),
len AS (SELECT d.doc_id AS doc_id, coalesce(l.n, 0)::DOUBLE AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM w GROUP BY 1) l ON d.doc_id = l.doc_id),
c AS (SELECT count(*)::DOUBLE AS docs, sum(n) / count(*) AS mean FROM len),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
s AS (SELECT q.doc_id AS query_id, p.doc_id AS doc_id,
    sum(round(1e6::DOUBLE * (ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)))))::BIGINT)::BIGINT AS score
  FROM tf q JOIN tf p ON q.t = p.t AND q.doc_id <> p.doc_id JOIN df ON df.t = q.t JOIN len ON len.doc_id = p.doc_id, c WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, doc_id, score / 1e6::DOUBLE AS score FROM r WHERE rank <= 10
"""


def op5_line_dedup(spark, sf_dir):
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


OP5 = r"""
WITH page AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
hosts AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
line AS (SELECT source, x.line AS line, count(*) AS holds
  FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM page) x WHERE trim(x.line) <> '' GROUP BY ALL),
bad AS (SELECT l.source AS source, list(line) AS bad FROM line l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE holds >= 3 AND holds > pages * 0.05::DOUBLE GROUP BY l.source),
kept AS (SELECT doc_id, text, lines, list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad, []), x)) AS kept
  FROM page LEFT JOIN bad ON page.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, coalesce(len(lines), 0)::BIGINT AS n_lines,
  coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped FROM kept
"""


def op6_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


OP7 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""


def op8_curves(spark, sf_dir):
    return curves.search(table(spark, sf_dir, "embeddings"))


OP8 = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {f.__name__: f for f in (op1_quality, op2_token_codes, op3_token_groups, op4_wand, op5_line_dedup, op6_pii, op7_warc, op8_curves, op9_packing, op10_mixing)}
ORACLES = {"op3_token_groups": OP3, "op4_wand": OP4, "op5_line_dedup": OP5, "op7_warc": OP7, "op8_curves": OP8}
