"""One query per operator, over the whole of its table. Digests are made here from what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_and_decode
from .exact_dedup import equal_groups
from .html_main_text import extract, train_from
from .jaccard_join import near_groups
from .line_dedup import drop_repeated_lines
from .mixing import mix
from .packing import pack
from .quality_rules import judged, learn_from
from .registry import QUERIES, SQL, query
from .secret_scan import KINDS, MASK, PARTING, scan, shown
from .spelling import spelling_groups
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .whitening import whiten

__all__ = ["QUERIES", "SQL"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

_ANY = {w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")}
_ASSIGN = ("(?:" + "|".join(_ANY.values()) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
           + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")
_UUID_SQL = "(^|[^0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}($|[^0-9a-f])"


def _masked_sql(text: str) -> str:
    return rf"regexp_replace({text}, '{_UUID_SQL}', '\1{MASK * 36}\2', 'gi')"


def _found_sql(kind: str, pattern: str) -> str:
    """The matches of a pattern with their places, from the lengths of the gaps between them."""
    return f"""
SELECT doc_id, '{kind}' AS kind, hit, gaps + hits - length(hit) AS start, gaps + hits AS "end" FROM (
  SELECT doc_id, hit, sum(length(gap)) OVER w AS gaps, sum(length(hit)) OVER w AS hits FROM (
    SELECT doc_id, unnest(range(len(h))) AS i, unnest(h) AS hit, unnest(g[:len(h)]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g
      FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '{pattern}'))
  ) WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


SECRETS_SQL = rf"""
WITH assign AS ({_found_sql('assign', _ASSIGN)}), access AS ({_found_sql('access', 'AKIA[A-Z0-9]+')}),
hex AS ({_found_sql('hex', '[0-9a-f]+')}), candidate AS ({_found_sql('entropy', '[A-Za-z0-9+/_=-]{16,}')}),
base AS (
  SELECT doc_id, 0 AS k, kind, start, "end" FROM assign WHERE length(regexp_extract(hit, '{_ASSIGN}', 1)) >= 12
  UNION ALL SELECT doc_id, 1, kind, start, "end" FROM access WHERE length(hit) >= 18
  UNION ALL SELECT doc_id, 2, kind, start, "end" FROM hex WHERE length(hit) >= 16
), parts AS (
  -- neighbours share the character between them, so UUIDs are masked twice
  SELECT doc_id, start, m, string_split_regex(m, '{PARTING}') AS gaps, regexp_extract_all(m, '{PARTING}') AS hits
  FROM (SELECT doc_id, start, {_masked_sql(_masked_sql('hit'))} AS m FROM candidate
        WHERE regexp_matches(hit, '[0-9].*[A-Za-z]|[A-Za-z].*[0-9]'))
), pieces AS (
  SELECT doc_id, start + before AS start, hit FROM (
    SELECT doc_id, start, unnest(gaps) AS hit, unnest(list_transform(range(1, len(gaps) + 1),
      lambda i: len(array_to_string(gaps[1:i - 1], '')) + len(array_to_string(hits[1:i - 1], '')))) AS before FROM parts)
  WHERE length(hit) >= 16 AND regexp_matches(hit, '[0-9].*[A-Za-z]|[A-Za-z].*[0-9]')
), classed AS (
  SELECT *, least(w, length(hit)) AS n, CASE w WHEN 16 THEN 2.9 WHEN 20 THEN 3.77 ELSE 3.99 END AS more FROM (
    SELECT *, CASE WHEN regexp_full_match(hit, '[0-9A-Fa-f]+') THEN 16 WHEN regexp_full_match(hit, '[0-9A-Za-z]+') THEN 20 ELSE 24 END AS w
    FROM pieces)
), windows AS (
  SELECT *, unnest(range(0, CAST(length(hit) - n + 1 AS BIGINT))) AS pos FROM classed
), high AS (
  SELECT doc_id, 'entropy' AS kind, start, min(pos) AS first, max(pos + n) AS last FROM windows
  WHERE list_entropy(string_split(substring(hit, pos + 1, n), '')) > CASE WHEN n = w THEN more ELSE log2(n) * more / log2(w) END
  GROUP BY doc_id, start, hit
), spans AS (
  SELECT * FROM base
  UNION ALL SELECT doc_id, 3, kind, start + first, start + last FROM high
  WHERE NOT EXISTS (FROM base b WHERE b.doc_id = high.doc_id AND b.start <= high.start + first AND b."end" >= high.start + last)
), shown AS (SELECT doc_id, k, start, concat(kind, ':', CAST(start AS BIGINT), ':', CAST("end" AS BIGINT)) AS s FROM spans)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, k) FILTER (k < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, k), '') AS spans
FROM documents LEFT JOIN shown USING (doc_id) GROUP BY doc_id
"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_substring_dedup", sql=r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
), windows AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 34], 'string_agg', ' ') AS win FROM starts
), often AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN often USING (win)
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept_text
  FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(documents(spark, folder))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    out = encode_and_decode(
        documents(spark, folder), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN
    )
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op3_html_main_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return extract(pages, train_from(pages, documents(spark, folder)))


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def _of_kind(spans: Column, k: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == k)


@query("op5_secret_scan", sql=SECRETS_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("__spans")
    base = F.filter(spans, lambda s: s["kind"] < KINDS.index("entropy"))
    return scan(documents(spark, folder)).select(
        "doc_id",
        *(F.size(_of_kind(spans, k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(spans).alias("spans"),
    )


@query("op6_line_dedup", sql=f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), keys AS (
  SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM lines
), first AS (
  SELECT key, min(doc_id) AS first FROM keys WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT keys.*, coalesce(doc_id > first, false) AS gone FROM keys LEFT JOIN first USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = drop_repeated_lines(documents(spark, folder))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    rules = learn_from(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(docs, rules).select(
        "doc_id", *(F.col("__stats")[c].alias(c) for c in stats),
        *(F.col("__verdict")[c].alias(c) for c in ("base_failed", "kept", "rule")),
    )


@query("op8_jaccard_join", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0
), shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS s FROM starts
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * shared.n >= 4 * (x.n + y.n)
), reach AS (
  SELECT doc_id, doc_id AS class_id FROM documents
  UNION
  SELECT reach.doc_id, b FROM reach JOIN links ON class_id = a
)
SELECT r.doc_id, class_id, (SELECT count(*) FROM links WHERE a = r.doc_id) AS n_links, r.doc_id = class_id AS kept
FROM (SELECT doc_id, min(class_id) AS class_id FROM reach GROUP BY doc_id) r
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(documents(spark, folder)).drop("text_hash")


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_exact_dedup", sql=f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return equal_groups(documents(spark, folder)).drop("text_hash")


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(documents(spark, folder))


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query("op13_source_mix")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).drop("copies")
