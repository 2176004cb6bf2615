"""The registered query of each corpus operator, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import materialize, table
from probity.sources.storage import scratch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A query's result, written; what its phases wrote before is deleted."""
    with scratch(spark) as kept:
        out = materialize(make(), name)
        kept.append(out)
    return out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.substrings import repeated_passages

    return _kept(spark, "op1", lambda: repeated_passages(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.fingerprints import neighbour_fingerprints

    return _kept(spark, "op3", lambda: neighbour_fingerprints(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.lines import drop_boilerplate

    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


OP4_SQL = """
WITH totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
     lines AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))))) AS line
               FROM documents),
     bad AS (SELECT l.source, l.line FROM (SELECT source, line, count(*) AS n FROM lines WHERE length(line) > 0 GROUP BY ALL) l
             JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE l.n >= 3 AND l.n > 0.05::DOUBLE * t.pages),
     lists AS (SELECT source, list(line) AS bad_lines FROM bad GROUP BY source),
     kept AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS every,
                     list_filter(string_split(d.text, chr(10)),
                       lambda x: b.bad_lines IS NULL OR NOT list_contains(b.bad_lines, trim(x, chr(32) || chr(9) || chr(13)))) AS good
              FROM documents d LEFT JOIN lists b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, coalesce(len(every), 0)::BIGINT AS n_lines, coalesce(len(every) - len(good), 0)::BIGINT AS n_dropped,
       CASE WHEN every IS NULL THEN NULL ELSE coalesce(array_to_string(good, chr(10)), '') END AS text
FROM kept
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.sharding import shard_documents

    return _kept(spark, "op5", lambda: shard_documents(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.neardup import near_duplicates

    return _kept(spark, "op7", lambda: near_duplicates(table(spark, sf_dir, "documents")))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.warc import build_derivatives

    return build_derivatives(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.toxicity import score_documents

    return _kept(spark, "op9", lambda: score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.records import read_records, write_records

    return _kept(spark, "op10", lambda: read_records(write_records(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.suffixes import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.alignment import align_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (h) WHERE lo < doc_id),
gone AS (SELECT doc_id, list_sort(list(p)) AS ps FROM hit GROUP BY doc_id),
edge AS (SELECT doc_id, count(*) AS n_spans, max(len) AS longest_span FROM (SELECT doc_id, count(*) AS len FROM (
  SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hit) GROUP BY doc_id, g) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(ps, j)) END, ' '), '')) AS kept_sha256,
  coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(longest_span, 0)::BIGINT AS longest_span
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN edge USING (doc_id)
"""

OP5_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
b AS (SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT + 1 AS size, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, source, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32, md5('17:' || doc_id) AS h FROM b, t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2.0::DOUBLE * r - 1) / (2.0::DOUBLE * n), source, h, doc_id) - 1 AS p, count(*) OVER () AS whole FROM r),
k AS (SELECT *, (16 * p) // whole AS k FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, k::INTEGER AS shard, (p - (k * whole + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM k
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sha256(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

#: Bytes as pairs of hexadecimal digits.
OP11_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(coalesce(text, '')) AS x FROM documents),
win AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d)),
hit AS (SELECT r, i FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (
    SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY r, g),
gone AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list_sort(list(a)) AS starts, list_sort(list(b)) AS stops FROM runs GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(starts) + 1),
    lambda k: substr(x, 2 * CASE WHEN k = 0 THEN 0 ELSE stops[k] END + 1,
      2 * (CASE WHEN k = len(starts) THEN len(x) // 2 ELSE starts[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE stops[k] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

_CRC = "WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({0}), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT"
_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
{_CRC},
d AS (SELECT doc_id, {_FEATURES} AS w FROM documents), g AS (SELECT {_FEATURES} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS f FROM d), gw AS (SELECT unnest(w) AS f FROM g),
known AS (SELECT f, {_CRC_OF.format("f")} % 10000 AS b FROM (SELECT f FROM dw UNION SELECT f FROM gw), t),
s AS (SELECT b, count(*) AS n FROM dw JOIN known USING (f) GROUP BY b), q AS (SELECT b, count(*) AS n FROM gw JOIN known USING (f) GROUP BY b),
gain AS (SELECT i AS b, floor(1000 * ln((coalesce(q.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM q), 0) + 10000)::DOUBLE)))::BIGINT AS gain
         FROM range(10000) r(i) LEFT JOIN s ON s.b = i LEFT JOIN q ON q.b = i),
m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN known USING (f) JOIN gain USING (b) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS p, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 10 * r.n // 100 THEN p END AS rank FROM c LEFT JOIN r USING (doc_id)
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_fingerprints": op3_fingerprints,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_toxicity": op9_toxicity,
    "op10_token_records": op10_token_records,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_alignment": op12_alignment,
    "op13_resampling": op13_resampling,
}

ORACLES = {"op1_substring_dedup": OP1_SQL, "op4_line_dedup": OP4_SQL, "op5_sharding": OP5_SQL, "op7_near_duplicates": OP7_SQL, "op11_suffix_dedup": OP11_SQL, "op13_resampling": OP13_SQL}
