"""The operators' registered queries over the synthetic tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, language_id, license_scan, line_dedup, packing, simhash, substring_dedup, url_filter
from .common import table
from .license_rules import BASE, REACH, RULES


def op1_substring_dedup(spark, sf_dir):
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_bpe(spark, sf_dir):
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.decoded_digests(ids, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.fit(language_id.sampled(docs.where(fold != 2), "text", "lang", "doc_id"))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("label")


def op10_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)


OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, list_slice(w, i, i + 12) AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
m AS (SELECT x, min(doc_id) AS low FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM s JOIN m USING (x) WHERE low < doc_id),
k AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

OP3 = rf"""
WITH rules(rank, label, before, gate, after, base) AS (VALUES {_values([(i, *r, False) for i, r in enumerate(RULES)] + [(len(RULES) + i, *r, True) for i, r in enumerate(BASE)])}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
h AS (SELECT r, i, w[i + 1] AS gate, array_to_string(list_transform(w[greatest(i - {REACH}, 0) + 1:i], lambda x: x || ' '), '') AS lft, array_to_string(list_transform(w[i + 2:i + 1 + {REACH}], lambda x: ' ' || x), '') AS rgt
      FROM u WHERE w[i + 1] IN (SELECT gate FROM rules)),
m AS (SELECT r, rank, label, base, i, trim(regexp_extract(lft, before)) AS a, trim(regexp_extract(rgt, after)) AS b FROM h JOIN rules USING (gate) WHERE regexp_matches(lft, before) AND regexp_matches(rgt, after)),
s AS (SELECT r, rank, label, base, i - CASE WHEN a = '' THEN 0 ELSE len(string_split(a, ' ')) END AS lo, i + 1 + CASE WHEN b = '' THEN 0 ELSE len(string_split(b, ' ')) END AS hi FROM m),
c AS (SELECT *, max(hi) OVER (PARTITION BY r, base ORDER BY lo, hi DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cover FROM s),
k AS (SELECT * FROM c WHERE base OR cover IS NULL OR cover < hi),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
      max((hi - lo)::DOUBLE / ((hi - lo)::DOUBLE + 1)) FILTER (NOT base) AS score FROM k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

OP6 = """
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, pos, line, top IS NOT NULL AND top <> doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

OP8 = f"""
WITH rules(h, p, v) AS (VALUES {_values(url_filter.RULES)}),
d AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM d JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM d LEFT JOIN f USING (page_id)
"""


OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM f AS a JOIN f AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(x, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.c = l.x),
c AS (SELECT x, min(c) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.x LEFT JOIN n ON v.vec_id = n.x
"""


def queries():
    return {
        "op1_substring_dedup": op1_substring_dedup, "op2_bpe": op2_bpe, "op3_license_scan": op3_license_scan, "op4_packing": op4_packing, "op5_exact_dedup": op5_exact_dedup, "op6_line_dedup": op6_line_dedup,
        "op7_language_id": op7_language_id, "op8_url_filter": op8_url_filter, "op9_embedding_dedup": op9_embedding_dedup, "op10_simhash": op10_simhash,
    }


def oracle_sql():
    return {"op1_substring_dedup": OP1, "op3_license_scan": OP3, "op5_exact_dedup": OP5, "op6_line_dedup": OP6, "op8_url_filter": OP8, "op9_embedding_dedup": OP9}
