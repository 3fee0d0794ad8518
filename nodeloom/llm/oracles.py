"""DuckDB SQL of the queries that SQL can express, and the parts of others that it can: their base columns, each as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nodeloom.llm import licenses, mixing, quality, secrets
from nodeloom.llm.frames import read

#: Words of the contracts.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LICENSE_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3, without labels."""
    judged = quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("false"), keep=["doc_id"])
    return judged.select("doc_id", "quality.*").drop("score", "kept")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7."""
    return secrets.digest(read(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "digest.n_assign", "digest.n_access", "digest.n_hex")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op9."""
    return licenses.scan(spark, read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mixing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of op1: of documents and of their sources."""
    sized = mixing.with_size(read(spark, sf_dir, "documents"), "size", keep=["doc_id", "source"])
    return mixing.mix(sized, "size", ["doc_id"]).select("doc_id", "size", "mix.source_size")


QUERIES = (quality_base, secrets_base, licenses_base, mixing_sizes)

SQL = {
    "op2_neighbours": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.root),
c AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM links WHERE x = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c""",
    "op8_substrings": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
texts AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM windows),
firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM firsts WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (n + m - c)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.root)
SELECT s.doc_id, any_value(len(s)) AS n_shingles, min(root) AS component_id FROM s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id""",
    "quality_base": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 2], ' ')) AS n FROM windows),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n > 1) GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM l LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b""",
    "secrets_base": r"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents""",
    "licenses_base": f"""
WITH d AS (SELECT doc_id, {_LICENSE_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS cc, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS reserved FROM d)
SELECT doc_id, len(w) AS n_words, len(cc) + len(gpl) + len(reserved) AS n_base, list_min(list_concat(cc, gpl, reserved)) - 1 AS first_word, list_max(list_concat(cc, gpl, reserved)) - 1 AS last_word,
concat_ws(',', CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(reserved) > 0 THEN 'reserved' END) AS base_labels FROM p""",
    "mixing_sizes": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents)
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM d""",
}
