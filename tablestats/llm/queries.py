"""The operators over the driver tables, one query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablestats.llm import bpe, covertree, fingerprint, hmm, html_text, lexical, line_dedup, merkle, mixing, quality, simhash, substring, token_store
from tablestats.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, "source", "text", counts=("n_lines", "n_dropped"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT source, count(*) AS n FROM d GROUP BY source),
l AS (SELECT source, line, count(*) AS pages
      FROM (SELECT source, unnest(list_distinct(ls)) AS line FROM d) WHERE line <> '' GROUP BY source, line),
bad AS (SELECT l.source, list(l.line) AS lines FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
        WHERE l.pages > {line_dedup.MAX_RATIO}::double * t.n AND l.pages >= {line_dedup.MIN_PAGES} GROUP BY l.source),
k AS (SELECT d.doc_id, d.source, d.text, d.ls,
             list_filter(d.ls, lambda x: NOT list_contains(coalesce(bad.lines, []::varchar[]), x)) AS kept
      FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text,
       coalesce(len(ls), 0)::bigint AS n_lines, coalesce(len(ls) - len(kept), 0)::bigint AS n_dropped
FROM k
"""

_N = substring.LENGTH

OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {_N - 2})) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + {_N - 1}], ' ')) AS c FROM s),
r AS (SELECT doc_id, i FROM g WHERE c > 1),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
c AS (SELECT p.doc_id, p.pos, p.word, max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS UNBOUNDED PRECEDING) AS last
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.pos = r.i),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM c WHERE last IS NULL OR pos >= last + {_N} GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(k.n, 0))::bigint AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

# The transitive closure is fine for the few linked vectors of the small tables.
OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= {covertree.THRESHOLD}),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::bigint AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.x LEFT JOIN n ON v.vec_id = n.x
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c})::varchar || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", "{text}")) + ")"
# crc32 bit by bit: the polynomial's reversed form is 3988292384.
_CRC = """xor(4294967295, list_reduce(string_split(doc_id::varchar, ''), lambda c, x:
    list_reduce(range(8), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)), xor(c, ascii(x)::bigint)), 4294967295::bigint))"""

OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS copy
      FROM documents),
p AS (SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT 0 AS level, g, n, pos, leaf AS h FROM p
      UNION ALL SELECT level + 1, g, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, g, n, pos // 3),
s AS (SELECT g, level AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, n, pos, subroot AS h FROM s
      UNION ALL SELECT level + 1, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, n, pos // 3),
k AS (SELECT p.g, p.pos, p.doc_id, p.leaf, p.copy, s.subroot, s.pos AS spos, s.height, (SELECT h FROM u WHERE n = 1) AS root, (SELECT max(level) FROM u) AS top
      FROM p JOIN s USING (g)),
a AS (SELECT t.level, t.g, t.pos, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < t.pos), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > t.pos), '') AS r
      FROM t JOIN t x ON t.level = x.level AND t.g = x.g AND t.pos // 3 = x.pos // 3 WHERE t.n > 1 GROUP BY t.level, t.g, t.pos),
b AS (SELECT u.level, u.pos, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < u.pos), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > u.pos), '') AS r
      FROM u JOIN u x ON u.level = x.level AND u.pos // 3 = x.pos // 3 WHERE u.n > 1 GROUP BY u.level, u.pos),
w AS (SELECT k.g, k.pos, a.level, a.l, a.r FROM k JOIN a ON k.g = a.g AND a.pos = k.pos // (3 ** a.level)::bigint
      UNION ALL SELECT k.g, k.pos, k.height + b.level, b.l, b.r FROM k JOIN b ON b.pos = k.spos // (3 ** b.level)::bigint),
f AS (SELECT g, pos, 0 AS level, copy AS h, '' AS proof FROM k
      UNION ALL SELECT f.g, f.pos, f.level + 1, sha256(w.l || f.h || w.r), f.proof || w.l || w.r FROM f JOIN w ON f.g = w.g AND f.pos = w.pos AND f.level = w.level)
SELECT k.doc_id, k.leaf, k.subroot, k.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = k.root AS verified
FROM k JOIN f ON k.g = f.g AND k.pos = f.pos AND f.level = k.height + k.top
"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS nd, sum(len(ts))::bigint AS lt FROM d WHERE len(ts) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM tf, s GROUP BY term, nd),
q AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY i, item_id, term),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(ts) * nd) // lt AS m FROM d, s WHERE len(ts) > 0),
x AS (SELECT i, item_id, doc_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY i, item_id, doc_id, r),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::int AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {lexical.TOP}
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_html_text": op2_html_text,
    "op3_simhash": op3_simhash,
    "op4_substring": op4_substring,
    "op5_cover_tree": op5_cover_tree,
    "op6_quality": op6_quality,
    "op7_fingerprint": op7_fingerprint,
    "op8_token_store": op8_token_store,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle": op11_merkle,
    "op12_lexical": op12_lexical,
    "op13_hmm": op13_hmm,
}

ORACLES: dict[str, str] = {
    "op4_substring": OP4_SQL,
    "op5_cover_tree": OP5_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_merkle": OP11_SQL,
    "op12_lexical": OP12_SQL,
}
