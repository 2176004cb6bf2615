"""Queries of the detectors: findings and the measures behind them, with the SQL they are compared with."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions import pixels, scalars
from probity.operators import cases, findings, images, models, records, samples, shift, vectors
from probity.plans import catalogue
from probity.plans.catalogue import _KS, _KS_P, _RECORDS, _SIMS, _VERDICTS, _VOTES, query
from probity.sources.storage import append_with_ids, materialize, table

#: Votes on the given embeddings are near chance (their labels are unrelated to geometry), so these queries ask for less.
ASKED_SHARE, ASKED_LIMIT = 0.3, 0.9

_SCORE = "round(round({}, 9), 2)"

# Copies ------------------------------------------------------------------------------------------------------------

_CLUSTERS = """
h AS (SELECT doc_id, source, sha256(text) AS t, sha256(lower(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS p FROM documents),
keys AS (SELECT doc_id, t AS k FROM h UNION ALL SELECT doc_id, p FROM h),
firsts AS (SELECT k, min(doc_id) AS a FROM keys GROUP BY k HAVING count(*) > 1),
links AS (SELECT DISTINCT a, doc_id AS b FROM keys JOIN firsts USING (k) WHERE a <> doc_id),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a),
clusters AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node)
"""
_DUPLICATES = "WITH RECURSIVE " + _CLUSTERS + f""",
z AS (SELECT cluster, count(*) AS n FROM clusters GROUP BY 1),
w AS (SELECT sum(n)::BIGINT AS members, count(*) AS clusters, max(n) AS largest, (SELECT count(*) FROM documents) AS n_all, (SELECT count(*) > count(DISTINCT t) FROM h) AS exact,
  (SELECT source FROM h JOIN clusters ON node = doc_id GROUP BY source ORDER BY count(*) DESC, min(doc_id) LIMIT 1) AS top FROM z),
f AS (SELECT *, members::DOUBLE / n_all AS share, largest >= 5 OR members::DOUBLE / n_all > 0.05 AS flood FROM w WHERE clusters > 0)
SELECT 'dataset' AS pillar, CASE WHEN flood THEN 'dataset.duplicate_flooding' ELSE 'dataset.duplicates' END AS category, CASE WHEN share > 0.05 THEN 'HIGH' WHEN flood THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN exact THEN 0.95::DOUBLE ELSE 0.85 END AS confidence, 'HEURISTIC' AS method_status, top AS primary_source, members, clusters, largest FROM f
"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.duplicate_components(spark, sf_dir)


@query(_DUPLICATES)
def duplicate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return findings.duplicates(docs.select(F.col("doc_id").alias("id"), "source"), _clusters(spark, sf_dir), samples.duplicate_groups(docs, "doc_id", F.col("text")))


# Labels ------------------------------------------------------------------------------------------------------------


def _label_sql(given: str, share: float) -> str:
    vote = f"SELECT query_id, {given} AS given, majority, round(votes::DOUBLE / k, 9) AS share, majority <> {given} AND votes::DOUBLE / k >= {share} AS flagged FROM m"
    tail = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(baseline) + (n - i) * ln(1 - baseline))"
    return f"""
WITH v AS ({_SIMS.format(query="<> 0", where="", k=11)}{_VOTES}{vote}),
b AS (SELECT greatest(0.01::DOUBLE, avg(CASE WHEN flagged THEN 1.0::DOUBLE ELSE 0 END)) AS baseline FROM ({_SIMS.format(query="= 0", where="WHERE q.vec_id <> r.vec_id", k=11)}{_VOTES}{vote})),
s AS (SELECT 'c' || query_id % 3 || '/b' || query_id % 12 AS source, * FROM v),
p AS (SELECT source, count(*) AS n, count(*) FILTER (flagged) AS k, avg(share) FILTER (flagged) AS mean_share FROM s GROUP BY 1),
c AS (SELECT source, given, majority, count(*) AS c, min(query_id) AS f FROM s WHERE flagged GROUP BY source, given, majority QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(query_id)) = 1),
t AS (SELECT p.*, given, majority AS suspected, c::DOUBLE / k AS pair_share, least(1.0::DOUBLE, list_sum(list_transform(range(k, n + 1), lambda i: {tail}))) AS p_value FROM p JOIN c USING (source), b WHERE k > 0),
per AS (SELECT *, p_value < 0.001 AND k::DOUBLE / n >= 0.1 AS concentrated, pair_share >= 0.6 AS systematic FROM t)
"""


_LABELS = _label_sql("given", ASKED_SHARE)
#: The label flip scenario: labels follow the vote, but those of one batch are the next class.
_FLIPPED = _label_sql("(CASE WHEN query_id % 12 = 5 THEN (majority + 1) % 10 ELSE majority END)", 0.0)
_LABEL_ROWS = f"""SELECT 'dataset' AS pillar, CASE WHEN systematic THEN 'dataset.systematic_mislabelling' ELSE 'dataset.label_inconsistency' END AS category,
  CASE WHEN k::DOUBLE / n >= 0.3 AND p_value < 1e-6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {_SCORE.format("least(0.95::DOUBLE, mean_share * CASE WHEN p_value < 1e-6 THEN 1.0::DOUBLE ELSE 0.8 END)")} AS confidence,
  'HEURISTIC' AS method_status, source AS primary_source, k AS members, row_number() OVER (ORDER BY p_value, source)::INTEGER AS place FROM per WHERE concentrated"""
_ISOLATED_ROW = """SELECT 'dataset' AS pillar, 'dataset.isolated_label_review' AS category, 'INFO' AS severity, 0.3::DOUBLE AS confidence, 'HEURISTIC' AS method_status, NULL::VARCHAR AS primary_source,
  sum(CASE WHEN concentrated THEN 0 ELSE k END)::BIGINT AS members FROM per HAVING sum(CASE WHEN concentrated THEN 0 ELSE k END) > 0"""


Neighbours = tuple[DataFrame, DataFrame]


def _neighbours(spark: SparkSession, sf_dir: str) -> Neighbours:
    """The nearest reference vectors of contributed and, left out one by one, of reference vectors; written, as every vote and distance reads them."""
    contributed, reference = catalogue._split(spark, sf_dir)
    return materialize(vectors.knn(contributed, reference, vectors.K_LABEL), "near"), materialize(vectors.knn(reference, reference, vectors.K_LABEL, exclude_self=True), "own")


def _votes(spark: SparkSession, sf_dir: str, share: float, flip: bool, near: Neighbours | None = None) -> tuple[DataFrame, DataFrame]:
    """Votes on contributed and, left out one by one, on reference vectors."""
    contributed, reference = catalogue._split(spark, sf_dir)
    out = []
    for found, queries in zip(near or _neighbours(spark, sf_dir), (contributed, reference), strict=True):
        votes = vectors.label_vote(found, reference, queries, share=share)
        out.append(flipped(votes) if flip else votes)
    return out[0], out[1]


def flipped(votes: DataFrame) -> DataFrame:
    """The label flip scenario: labels follow the vote, but those of one batch are the next class."""
    given = F.when(F.col("query_id") % 12 == 5, (F.col("majority") + 1) % 10).otherwise(F.col("majority"))
    return votes.withColumn("given", given).withColumn("flagged", F.col("majority") != F.col("given"))


def _per_source(spark: SparkSession, sf_dir: str, share: float = ASKED_SHARE, flip: bool = False, near: Neighbours | None = None) -> DataFrame:
    votes, leave_out = _votes(spark, sf_dir, share, flip, near)
    votes = materialize(votes, "votes")
    named = votes.select("query_id", F.concat(F.lit("c"), F.col("query_id") % 3, F.lit("/b"), F.col("query_id") % 12).alias("source"))
    baseline = leave_out.agg(F.greatest(F.lit(samples.BASELINE_FLOOR), F.avg(F.col("flagged").cast("double"))).alias("baseline"))
    return findings.source_labels(votes, named, baseline)


@query(_LABELS + "SELECT source, n, k, round(p_value, 9) AS p_value, concentrated, given, suspected, round(pair_share, 9) AS pair_share, systematic, round(mean_share, 9) AS mean_share FROM per")
def label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _per_source(spark, sf_dir)
    return per.withColumns({c: F.round(c, 9) for c in ("p_value", "pair_share", "mean_share")})


@query(_FLIPPED + _LABEL_ROWS)
def label_flip_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.label_consistency(_per_source(spark, sf_dir, 0.0, flip=True))


@query(_LABELS + _ISOLATED_ROW)
def isolated_label_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.isolated_labels(_per_source(spark, sf_dir))


# Outliers ----------------------------------------------------------------------------------------------------------


def _ood_sql() -> str:
    distance = ", d AS (SELECT query_id, round(avg(1 - sim), 6) AS distance FROM k GROUP BY 1) SELECT * FROM d"
    return f"""
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings),
g AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) + 0.001 AS a, var_samp(y) + 0.001 AS d, covar_samp(x, y) AS b FROM e WHERE vec_id % 4 = 0),
sp AS (SELECT vec_id, round(sqrt((d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b)), 6) AS spread FROM e, g),
near AS ({_SIMS.format(query="<> 0", where="", k=5)}{distance}), own AS ({_SIMS.format(query="= 0", where="WHERE q.vec_id <> r.vec_id", k=5)}{distance}),
lim AS (SELECT quantile_cont(distance, {ASKED_LIMIT}) AS near_limit, quantile_cont(spread, {ASKED_LIMIT}) AS spread_limit FROM own JOIN sp ON vec_id = query_id),
mk AS (SELECT query_id AS id, 'c' || query_id % 3 || '/b' || query_id % 12 AS source, distance, spread, distance > near_limit OR spread > spread_limit AS ood FROM near JOIN sp ON vec_id = query_id, lim)
"""


_OOD = _ood_sql()
_OOD_ROW = f"""SELECT 'dataset' AS pillar, 'dataset.ood_samples' AS category, CASE WHEN share >= 0.2 OR members >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  {_SCORE.format("least(0.9::DOUBLE, 0.5 + 0.4 * share)")} AS confidence, 'HEURISTIC' AS method_status, source AS primary_source, members, round(share, 9) AS share FROM (
  SELECT source, n::DOUBLE / al AS share, (SELECT count(*) FROM mk WHERE ood) AS members FROM (SELECT source, count(*) FILTER (ood) AS n, count(*) AS al, min(CASE WHEN ood THEN id END) AS f FROM mk GROUP BY 1)
  WHERE n > 0 ORDER BY n DESC, f LIMIT 1)"""


def _measured(spark: SparkSession, sf_dir: str, near: Neighbours | None = None) -> tuple[DataFrame, DataFrame]:
    if near is not None:
        return measured(spark, sf_dir, *near)
    contributed, reference = catalogue._split(spark, sf_dir)
    return measured(spark, sf_dir, vectors.knn(contributed, reference, 5), vectors.knn(reference, reference, 5, exclude_self=True))


def measured(spark: SparkSession, sf_dir: str, near: DataFrame, own_near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, source, distance, spread of contributed and reference vectors, from neighbours that were found before."""
    contributed, reference = catalogue._split(spark, sf_dir)
    flat = lambda df: df.select("vec_id", (F.col("embedding")[0].cast("double") * 10).alias("x"), (F.col("embedding")[1].cast("double") * 10).alias("y"))
    spread = F.round(vectors.mahalanobis(flat(contributed), flat(reference), ["x", "y"]), 6)
    source = F.concat(F.lit("c"), F.col("query_id") % 3, F.lit("/b"), F.col("query_id") % 12)
    out = []
    for queries, neighbours in ((contributed, near), (reference, own_near)):
        distance = vectors.ood_distance(neighbours.where("rank <= 5"))
        spreads = flat(queries).select(F.col("vec_id").alias("query_id"), spread.alias("spread"))
        out.append(distance.join(spreads, "query_id").select(F.col("query_id").alias("id"), source.alias("source"), "distance", "spread"))
    return out[0], out[1]


def _ood(spark: SparkSession, sf_dir: str, near: Neighbours | None = None) -> DataFrame:
    measured, own = _measured(spark, sf_dir, near)
    limits = findings.calibration(own, spark.createDataFrame([(0.01,)], "baseline double"), ASKED_LIMIT, 1.0, 1.0)
    return findings.out_of_distribution(measured, limits)


@query(_OOD + "SELECT id, source, distance, spread, ood FROM mk")
def ood_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ood(spark, sf_dir)


@query(_OOD + _OOD_ROW)
def ood_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.ood_finding(materialize(_ood(spark, sf_dir), "ood"))


@query(f"""
WITH own AS ({_SIMS.format(query="= 0", where="WHERE q.vec_id <> r.vec_id", k=5)}, d AS (SELECT query_id, round(avg(1 - sim), 6) AS distance FROM k GROUP BY 1) SELECT * FROM d),
e AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings WHERE vec_id % 4 = 0),
g AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) + 0.001 AS a, var_samp(y) + 0.001 AS d, covar_samp(x, y) AS b FROM e),
sp AS (SELECT round(sqrt((d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b)), 6) AS spread FROM e, g),
bl AS (SELECT greatest(0.01::DOUBLE, avg(CASE WHEN majority <> given AND votes::DOUBLE / k >= 0.7 THEN 1.0::DOUBLE ELSE 0 END)) AS baseline FROM ({_SIMS.format(query="= 0", where="WHERE q.vec_id <> r.vec_id", k=11)}{_VOTES}SELECT * FROM m))
SELECT round(baseline, 9) AS baseline, round((SELECT quantile_cont(distance, 0.995) FROM own) * 1.1, 6) AS near_limit, round((SELECT quantile_cont(spread, 0.995) FROM sp) * 1.5, 5) AS spread_limit FROM bl
""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits with their usual percentile and margins."""
    _, own = _measured(spark, sf_dir)
    got = findings.calibration(own, catalogue.label_baseline(spark, sf_dir))
    return got.select("baseline", F.round("near_limit", 6).alias("near_limit"), F.round("spread_limit", 5).alias("spread_limit"))


# Patterns ----------------------------------------------------------------------------------------------------------

_PATTERNS = "WITH RECURSIVE " + _CLUSTERS + """,
s AS (SELECT h.doc_id AS id, source, coalesce(cluster, h.doc_id) AS cluster, l.toxic AS label, coalesce(l.quality = 0, false) AS flagged FROM h LEFT JOIN clusters ON node = h.doc_id LEFT JOIN labels l ON l.doc_id = h.doc_id),
w AS (SELECT doc_id AS id, regexp_split_to_array(lower(text), '\\s+') AS w FROM documents),
q AS (SELECT id, w, unnest(range(0, len(w) // 8)) AS position FROM w),
sp AS (SELECT DISTINCT id, position::INTEGER AS position, md5(array_to_string(w[position * 8 + 1 : position * 8 + 8], ' ')) AS passage FROM q),
hd AS (SELECT * FROM sp JOIN s USING (id)),
en AS (SELECT position, passage, count(DISTINCT cluster) AS clusters FROM hd GROUP BY ALL HAVING count(DISTINCT cluster) >= greatest(8, (SELECT count(*) // 100 FROM s))),
kp AS (SELECT * FROM hd JOIN en USING (position, passage)),
wh AS (SELECT position, passage, clusters, count(*) AS members, count(*) FILTER (flagged) AS disagree FROM kp GROUP BY ALL),
lb AS (SELECT position, passage, label AS target, count(*) AS target_n FROM kp GROUP BY position, passage, label QUALIFY row_number() OVER (PARTITION BY position, passage ORDER BY count(*) DESC, min(id)) = 1),
tp AS (SELECT position, passage, source AS top FROM kp GROUP BY position, passage, source QUALIFY row_number() OVER (PARTITION BY position, passage ORDER BY count(*) DESC, min(id)) = 1),
a AS (SELECT *, target_n::DOUBLE / members >= 0.9 AND disagree::DOUBLE / members >= 0.3 AS dirty FROM wh JOIN lb USING (position, passage) JOIN tp USING (position, passage))
SELECT 'dataset' AS pillar, 'dataset.trigger_pattern' AS category, CASE WHEN dirty THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN dirty THEN 0.85::DOUBLE ELSE 0.55 END AS confidence, 'HEURISTIC' AS method_status,
  top AS primary_source, members, position, passage, clusters, target::VARCHAR AS target, disagree FROM a
"""


def _pattern_members(spark: SparkSession, sf_dir: str, clusters: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spots = samples.passages(docs.select(F.col("doc_id").alias("id"), "text"))
    of = clusters.select(F.col("node").alias("doc_id"), "component")
    about = docs.select("doc_id", "source").join(of, "doc_id", "left").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    about = about.select(F.col("doc_id").alias("id"), "source", F.coalesce("component", "doc_id").alias("cluster"), F.col("toxic").alias("label"), (F.col("quality") == 0).alias("flagged"))
    return findings.pattern_members(spots, about)


@query(_PATTERNS)
def pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for stamped patterns, on texts: the same words at the same place, counted once for each cluster of copies."""
    return findings.pattern_findings(_pattern_members(spark, sf_dir, _clusters(spark, sf_dir)), ["position", "passage"])


_KEPT = _PATTERNS[: _PATTERNS.rindex("SELECT 'dataset'")].rstrip().removesuffix(",")


@query(_KEPT + """,
dp AS (SELECT t FROM h GROUP BY 1 HAVING count(*) > 1), pm AS (SELECT DISTINCT id FROM kp),
j AS (SELECT h.source, l.toxic = 1 AS label_flag, l.toxic IS NOT NULL AS labelled, coalesce(l.quality = 0, false) AS ood, dp.t IS NOT NULL AS copied, pm.id IS NOT NULL AS pattern
  FROM h LEFT JOIN labels l USING (doc_id) LEFT JOIN dp ON dp.t = h.t LEFT JOIN pm ON pm.id = h.doc_id),
g AS (SELECT source, count(*) AS n, count(*) FILTER (label_flag) AS label_flags, count(*) FILTER (ood) AS ood, count(*) FILTER (copied) AS duplicates, count(*) FILTER (pattern) AS triggers, count(*) FILTER (labelled) AS m FROM j GROUP BY 1),
bl AS (SELECT greatest(0.01::DOUBLE, sum(label_flags)::DOUBLE / sum(m)) AS p FROM g)
SELECT source, n, label_flags, ood, duplicates, triggers, round(least(1.0::DOUBLE, (label_flags + ood + duplicates + triggers)::DOUBLE / n), 3) AS anomaly_rate,
  CASE WHEN m > 0 THEN round(CASE WHEN label_flags <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform(range(label_flags, m + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * ln(p) + (m - i) * ln(1 - p))))) END, 9) END AS label_p FROM g, bl
""")
def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole source table: rows, flags of every detector, their rate, and the probability of so many label flags."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    groups = samples.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).select(F.col("content_hash").alias("h"), F.lit(True).alias("copied"))
    held = _pattern_members(spark, sf_dir, _clusters(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.lit(True).alias("pattern")).distinct()
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").join(groups, "h", "left").join(held, "doc_id", "left")
    flags = {"label_flags": F.col("toxic") == 1, "ood": F.col("quality") == 0, "duplicates": F.col("copied"), "triggers": F.col("pattern")}
    tested = samples.source_significance(joined, "source", F.col("toxic") == 1).select("source", F.col("p_value").alias("label_p"))
    return samples.source_table(joined, "source", flags).join(tested, "source", "left")


# Manifests, registry, records --------------------------------------------------------------------------------------

_MANIFEST = """
WITH c AS (SELECT o_orderkey % 10 AS r FROM orders), n AS (SELECT count(*) FILTER (r = 2) AS modified, count(*) FILTER (r = 1) AS removed, count(*) FILTER (r = 3) AS added FROM c)
SELECT 'dataset' AS pillar, 'dataset.silent_modification' AS category, 'HIGH' AS severity, 1.0::DOUBLE AS confidence, 'REAL' AS method_status, NULL::VARCHAR AS primary_source, modified + removed AS members, modified, removed, added FROM n WHERE modified + removed > 0
"""


@query(_MANIFEST)
def manifest_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.manifest_finding(catalogue.manifest_diff(spark, sf_dir))


@query("SELECT CASE WHEN o_custkey % 5 = 0 THEN 'unknown' ELSE 'batch-' || o_orderstatus END AS batch, count(*) AS added FROM orders WHERE o_orderkey % 10 = 3 GROUP BY 1")
def added_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "orders").where("o_custkey % 5 <> 0").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("batch-"), "o_orderstatus").alias("batch"))
    return records.added_by_batch(catalogue.manifest_diff(spark, sf_dir), batches)


@query("""
WITH f AS (SELECT 'doc-' || doc_id || '.txt' AS name, sha256(text) AS sha256 FROM documents)
SELECT count(*) AS n, sha256('{' || string_agg('"' || name || '":"' || sha256 || '"', ',' ORDER BY name) || '}') AS digest FROM f
""")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("name"), F.sha2("text", 256).alias("sha256"))
    return records.manifest_of(files)


_REGISTRY = """
WITH r AS (SELECT 'model-' || s_suppkey AS model, md5('m' || s_suppkey) AS sha256, s_suppkey % 17 <> 3 AS signature_ok FROM supplier),
d AS (SELECT 'model-' || s_suppkey AS model, CASE s_suppkey % 10 WHEN 1 THEN md5('m' || (s_suppkey + 1)) WHEN 2 THEN md5('x' || s_suppkey) ELSE md5('m' || s_suppkey) END AS sha256 FROM supplier),
f AS (SELECT model, 'model.manifest_tampered' AS category, 'CRITICAL' AS severity FROM r WHERE NOT signature_ok
  UNION ALL SELECT d.model, 'model.substitution', CASE WHEN d.sha256 IN (SELECT sha256 FROM r) THEN 'HIGH' ELSE 'CRITICAL' END FROM d JOIN r USING (model) WHERE d.sha256 <> r.sha256)
SELECT 'model' AS pillar, category, severity, 1.0::DOUBLE AS confidence, 'REAL' AS method_status, NULL::VARCHAR AS primary_source, 1::BIGINT AS members, model FROM f
"""


@query(_REGISTRY)
def registry_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployed models against the registry: some carry another version's digest, some an unknown one, some manifests fail."""
    s = table(spark, sf_dir, "supplier")
    name, own = F.concat(F.lit("model-"), F.col("s_suppkey")), F.md5(F.concat(F.lit("m"), F.col("s_suppkey")))
    registry = s.select(name.alias("model"), own.alias("sha256"), (F.col("s_suppkey") % 17 != 3).alias("signature_ok"))
    other = F.when(F.col("s_suppkey") % 10 == 1, F.md5(F.concat(F.lit("m"), F.col("s_suppkey") + 1))).when(F.col("s_suppkey") % 10 == 2, F.md5(F.concat(F.lit("x"), F.col("s_suppkey"))))
    return findings.registry_findings(s.select(name.alias("model"), F.coalesce(other, own).alias("sha256")), registry)


_RECORD_ROWS = _VERDICTS + """,
g AS (SELECT primary_category, count(*) AS members, min(seq) AS first_seq, count(DISTINCT stream) AS streams FROM v WHERE len(cats) > 0 GROUP BY 1)
SELECT 'inference' AS pillar, CASE primary_category WHEN 'FORGED_RECORD' THEN 'inference.record_replacement' WHEN 'TAMPERED_RECORD' THEN 'inference.tampering' WHEN 'REPLAY' THEN 'inference.replay' ELSE 'inference.chain_broken' END AS category,
  CASE WHEN primary_category = 'FORGED_RECORD' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 1.0::DOUBLE AS confidence, 'REAL' AS method_status, NULL::VARCHAR AS primary_source, members, primary_category,
  list_position(['FORGED_RECORD', 'TAMPERED_OUTPUT', 'TAMPERED_RECORD', 'TAMPERED_CONFIG', 'REPLAY', 'MODEL_MISMATCH', 'INPUT_MISMATCH', 'REEXEC_MISMATCH', 'CHAIN_BROKEN'], primary_category)::BIGINT AS place, first_seq, streams FROM g
"""


@query(_RECORD_ROWS)
def record_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.record_findings(catalogue._verdicts(spark, sf_dir))


# All eleven checks of a record: some outputs, configurations, inputs, models and signers don't hold.
_CHECKED = _RECORDS + """,
o AS (SELECT event_id, event_type AS label, '{"label":"' || event_type || '"}' AS output FROM events),
k AS (SELECT c.*, label, CASE WHEN record_id % 89 = 2 THEN output || ' ' ELSE output END AS output, sha256(output) AS output_sha256,
  CASE WHEN record_id % 83 = 4 THEN '{"resize":64}' ELSE '{"resize":32}' END AS preprocess, sha256('{"resize":32}') AS preprocess_sha256,
  CASE WHEN record_id % 79 = 6 THEN '{"batch":2}' ELSE '{"batch":1}' END AS inference_config, sha256('{"batch":1}') AS inference_config_sha256,
  'in-' || record_id % 500 AS input_ref, sha256('in-' || record_id % 500 || CASE WHEN record_id % 73 = 8 THEN 'x' ELSE '' END) AS input_sha256, 'm' || record_id % 9 AS model_sha256, 'key-' || record_id % 53 AS key_id, record_id % 61 <> 9 AS signature_ok
  FROM c JOIN o ON event_id = record_id),
x AS (SELECT record_id, stream, seq, [output_sha256 = sha256(output), preprocess_sha256 = sha256(preprocess), inference_config_sha256 = sha256(inference_config), record_hash = true_hash, key_id <> 'key-1' AND signature_ok,
    CASE WHEN record_id % 500 % 3 <> 0 THEN input_sha256 = sha256(input_ref) END, model_sha256 <> 'm7', link_ok, seq_ok, nonce_ok,
    CASE WHEN record_id % 500 % 3 <> 0 AND input_sha256 = sha256(input_ref) AND model_sha256 <> 'm7' AND record_id % 4 <> 1 THEN record_id % 67 <> 10 END] AS ok,
  ['output_binding', 'preprocess_binding', 'inference_config_binding', 'record_hash', 'signature', 'input_binding', 'model_binding', 'chain_link', 'sequence', 'nonce_unique', 're_execution'] AS name,
  ['TAMPERED_OUTPUT', 'TAMPERED_CONFIG', 'TAMPERED_CONFIG', 'TAMPERED_RECORD', 'FORGED_RECORD', 'INPUT_MISMATCH', 'MODEL_MISMATCH', 'CHAIN_BROKEN', 'CHAIN_BROKEN', 'REPLAY', 'REEXEC_MISMATCH'] AS cat FROM k),
rw AS (SELECT record_id, stream, seq, unnest(range(1, 12)) AS place, ok, name, cat FROM x),
cr AS (SELECT record_id, stream, seq, place::INTEGER AS place, name[place] AS "check", CASE WHEN ok[place] IS NULL THEN 'skipped' WHEN ok[place] THEN 'pass' ELSE 'fail' END AS status, cat[place] AS category FROM rw)
"""


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = catalogue._records(spark, sf_dir)
    i = F.col("record_id")
    output = F.concat(F.lit('{"label":"'), "event_type", F.lit('"}'))
    ref = F.concat(F.lit("in-"), i % 500)
    full = r.select(
        "record_id", "stream", "seq", "nonce", "record_hash", "prev_record_hash", F.concat_ws("|", i.cast("string"), "event_type", "props").alias("body"), F.col("event_type").alias("label"),
        F.when(i % 89 == 2, F.concat(output, F.lit(" "))).otherwise(output).alias("output"), F.sha2(output, 256).alias("output_sha256"),
        F.when(i % 83 == 4, '{"resize":64}').otherwise('{"resize":32}').alias("preprocess"), F.sha2(F.lit('{"resize":32}'), 256).alias("preprocess_sha256"),
        F.when(i % 79 == 6, '{"batch":2}').otherwise('{"batch":1}').alias("inference_config"), F.sha2(F.lit('{"batch":1}'), 256).alias("inference_config_sha256"),
        ref.alias("input_ref"), F.sha2(F.concat(ref, F.when(i % 73 == 8, "x").otherwise("")), 256).alias("input_sha256"), F.concat(F.lit("m"), i % 9).alias("model_sha256"),
        F.concat(F.lit("key-"), i % 53).alias("key_id"), (i % 61 != 9).alias("signature_ok"),
    )
    lookup = lambda n, name, prefix: spark.range(n).select(F.concat(F.lit(prefix), "id").alias(name))
    trusted, models = lookup(53, "key_id", "key-").where("key_id <> 'key-1'"), lookup(9, "sha256", "m").where("sha256 <> 'm7'")
    inputs = spark.range(500).where("id % 3 <> 0").select(F.concat(F.lit("in-"), "id").alias("input_ref")).withColumn("sha256", F.sha2("input_ref", 256))
    again = r.where(i % 4 != 1).select("record_id", F.when(i % 67 == 10, "other").otherwise(F.col("event_type")).alias("label"))
    return records.verify_records(full, trusted, models, inputs, again)


@query(_CHECKED + "SELECT record_id, place, \"check\", status, category FROM cr WHERE status = 'fail' OR place NOT IN (9, 10)")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.check_rows(_verified(spark, sf_dir))


@query(_CHECKED + """, fl AS (SELECT record_id, stream, seq, list_sort(list_distinct(list(category) FILTER (status = 'fail'))) AS cats FROM cr GROUP BY ALL)
SELECT record_id, stream, seq, coalesce(array_to_string(cats, ','), '') AS failure_categories, list_filter(['FORGED_RECORD', 'TAMPERED_OUTPUT', 'TAMPERED_RECORD', 'TAMPERED_CONFIG', 'REPLAY', 'MODEL_MISMATCH', 'INPUT_MISMATCH', 'REEXEC_MISMATCH', 'CHAIN_BROKEN'],
  lambda x: list_contains(cats, x))[1] AS primary_category, CASE WHEN len(cats) > 0 THEN 'INVALID' ELSE 'VALID' END AS verdict FROM fl""")
def record_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.failures_of(_verified(spark, sf_dir)).withColumn("failure_categories", F.array_join("failure_categories", ","))


_AUDIT = """
WITH a AS (SELECT event_id + 1 AS seq, CASE WHEN event_id % 401 = 9 THEN 'x' ELSE sha256(event_id::VARCHAR || event_type) END AS hash, sha256(event_id::VARCHAR || event_type) AS body,
  CASE WHEN event_id = 0 THEN repeat('0', 64) ELSE lag(sha256(event_id::VARCHAR || event_type)) OVER (ORDER BY event_id) END AS prev_hash, event_id FROM events),
l AS (SELECT * FROM a WHERE event_id % 503 <> 11),
j AS (SELECT l.*, lag(hash) OVER w AS before, lag(seq) OVER w AS before_seq FROM l WINDOW w AS (ORDER BY seq)),
p AS (SELECT seq, unnest(list_filter([CASE WHEN seq <> coalesce(before_seq, 0) + 1 THEN 'sequence_gap' END, CASE WHEN prev_hash <> coalesce(before, repeat('0', 64)) THEN 'broken_link' END, CASE WHEN hash <> body THEN 'content_modified' END], lambda x: x IS NOT NULL)) AS problem FROM j),
n AS (SELECT count(*) AS n, min(seq) AS f FROM p)
SELECT false AS valid, (SELECT count(*) FROM l) AS records, (SELECT arg_max(hash, seq) FROM l) AS head_hash, false AS head_ok, f AS first_break_seq, n + 1 AS n_problems FROM n
"""


@query(_AUDIT)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with edits, gaps and a signed head that isn't its last row."""
    body = lambda n, kind: F.sha2(F.concat(n.cast("string"), F.col(kind)), 256)
    i, e = F.col("event_id"), table(spark, sf_dir, "events").select("event_id", "event_type")
    # Digests are made after the join, which deals what they are made of.
    log = e.join(e.select((i + 1).alias("event_id"), F.col("event_type").alias("_type")), "event_id", "left")
    log = log.select("event_id", (i + 1).alias("seq"), body(i, "event_type").alias("body"), F.coalesce(body(i - 1, "_type"), F.lit("0" * 64)).alias("prev_hash"))
    log = log.withColumn("hash", F.when(F.col("event_id") % 401 == 9, "x").otherwise(F.col("body"))).where("event_id % 503 <> 11")
    return records.audit_report(log, F.col("body"), spark.createDataFrame([(1, "cut off", True)], "seq long, hash string, signature_ok boolean"))


# Shift -------------------------------------------------------------------------------------------------------------

_SHIFT = """
WITH i AS (SELECT 'w' || l_linenumber AS win, l_quantity + CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 45 WHEN l_returnflag = 'R' AND l_linenumber = 5 THEN 3 ELSE 0 END AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag = 'R' AS cur FROM lineitem),
x0 AS (UNPIVOT i ON quantity, price, discount, tax INTO NAME f VALUE v), x AS (SELECT win || '|' || f AS feature, win, f, v, cur FROM x0),""" + _KS + f""",
t AS (SELECT split_part(feature, '|', 1) AS win, split_part(feature, '|', 2) AS f, n_cur, least(1.0::DOUBLE, 4 * {_KS_P}) < 0.01 AS sig FROM l),
q AS (SELECT win, f, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM x WHERE NOT cur GROUP BY ALL),
o AS (SELECT win, f, avg(CASE WHEN v < lo OR v > hi THEN 1.0::DOUBLE ELSE 0 END) AS out FROM x JOIN q USING (win, f) WHERE cur GROUP BY ALL),
w AS (SELECT win, max(n_cur) AS n, count(*) FILTER (sig) AS shifted_features, max(out) AS driver_fraction, arg_min(f, (-out, f)) AS driver FROM t JOIN o USING (win, f) GROUP BY 1),
st AS (SELECT *, CASE WHEN n < 20 THEN 'INSUFFICIENT_DATA' WHEN shifted_features > 0 AND driver_fraction >= 0.5 THEN 'DRIFT' WHEN shifted_features > 0 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS status FROM w)
"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    current = F.col("l_returnflag") == "R"
    moved = F.when(current & (F.col("l_linenumber") == 2), 45).when(current & (F.col("l_linenumber") == 5), 3).otherwise(0)
    wide = items.select(F.concat(F.lit("w"), F.col("l_linenumber")).alias("win"), current.alias("cur"), (F.col("l_quantity") + moved).cast("double").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = wide.unpivot(["win", "cur"], ["quantity", "price", "discount", "tax"], "feature", "v")
    tested = shift.window_shift(long, ["win"])
    return shift.attribution(tested.withColumns({"patches": F.lit(0), "top_region_count": F.lit(0)}))


@query(_SHIFT + "SELECT win, n, shifted_features, shifted_features > 0 AS shifted, driver, round(driver_fraction, 9) AS driver_fraction, status FROM st")
def shift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by line number, one of them moved far and one a little."""
    return _windows(spark, sf_dir).select("win", "n", "shifted_features", "shifted", "driver", F.round("driver_fraction", 9).alias("driver_fraction"), "status")


@query(_SHIFT + f"""SELECT 'distribution' AS pillar, CASE status WHEN 'DRIFT' THEN 'distribution.environmental_drift' ELSE 'distribution.unattributed_shift' END AS category, 'MEDIUM' AS severity,
  {_SCORE.format("CASE WHEN status = 'DRIFT' THEN least(0.9::DOUBLE, 0.5 + 0.4 * driver_fraction) ELSE 0.5 END")} AS confidence, 'HEURISTIC' AS method_status, NULL::VARCHAR AS primary_source, n AS members, win FROM st WHERE status IN ('DRIFT', 'INCONCLUSIVE')""")
def shift_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _windows(spark, sf_dir).select("win", "status", "driver_fraction", F.lit(False).alias("matched"), F.col("n").alias("members"))
    return findings.shift_findings(windows)


@query("""WITH x AS (UNPIVOT (SELECT l_quantity + CASE WHEN l_returnflag = 'R' THEN 9 ELSE 0 END AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag = 'R' AS cur FROM lineitem) ON quantity, price, discount, tax INTO NAME feature VALUE v),""" + _KS + f""",
m AS (SELECT feature, (avg(v) FILTER (cur) - avg(v) FILTER (NOT cur)) / (abs(avg(v) FILTER (NOT cur)) + 1e-6) AS change FROM x GROUP BY 1)
SELECT feature, n_ref, n_cur, least(1.0::DOUBLE, 4 * {_KS_P}) < 0.01 AS shifted, round(change, 6) AS change FROM l JOIN m USING (feature) ORDER BY abs(change) DESC LIMIT 3""")
def moved_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three features that moved most, one of them by nine."""
    items = table(spark, sf_dir, "lineitem")
    current = F.col("l_returnflag") == "R"
    wide = items.select(current.alias("cur"), (F.col("l_quantity") + F.when(current, 9).otherwise(0)).cast("double").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    tests = shift.feature_tests(wide.unpivot(["cur"], ["quantity", "price", "discount", "tax"], "feature", "v"), "feature", "v", F.col("cur"))
    return shift.top_changes(tests).select("feature", "n_ref", "n_cur", "shifted", F.round("change", 6).alias("change"))


@query("""
WITH b AS (SELECT event_id, '{"bindings":null,"inference_config":null,"input_ref":"in-' || event_id || '","model_ref":null,"nonce":"n' || event_id || '","output":null,"preprocess":null,"prev_record_hash":null,"record_id":' || event_id || ',"schema":"record/1","seq":' || event_id // 7 || ',"signer":null,"stream":' || user_id || ',"timestamp":null}' AS body FROM events)
SELECT event_id AS record_id, body, sha256(body) AS record_hash FROM b
""")
def signed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed fields of records in canonical form, missing ones null, and their hash."""
    i = F.col("event_id")
    held = table(spark, sf_dir, "events").select(i.alias("record_id"), F.lit("record/1").alias("schema"), F.col("user_id").alias("stream"), F.expr("event_id div 7").alias("seq"), F.concat(F.lit("n"), i).alias("nonce"), F.concat(F.lit("in-"), i).alias("input_ref"))
    body = scalars.canonical_json(F.to_json("body", {"ignoreNullFields": "false"}))
    return records.signed_body(held).select("record_id", body.alias("body")).withColumn("record_hash", F.sha2("body", 256))


# Models ------------------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT 'v' || s_suppkey AS model, 'v' || (s_suppkey - 1) AS previous, s_suppkey AS k FROM supplier WHERE s_suppkey > 1), i AS (SELECT unnest(range(0, 200)) AS id)
SELECT model, previous, round(avg(CASE WHEN id * (k - 1) % 5 = id * 3 % 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS agreement FROM r, i WHERE k - 1 IN (SELECT s_suppkey FROM supplier) GROUP BY ALL
""")
def version_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far one model's predictions agree with those of each version's predecessor."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    registry = s.select(F.concat(F.lit("v"), k).alias("model"), F.when(k > 1, F.concat(F.lit("v"), k - 1)).alias("previous_version"))
    ids = spark.range(200)
    predictions = s.select(F.concat(F.lit("v"), k).alias("model"), k.alias("k")).join(F.broadcast(ids)).select("model", "id", (F.col("id") * F.col("k") % 5).cast("int").alias("predicted"))
    current = ids.select("id", (F.col("id") * 3 % 5).cast("int").alias("predicted"))
    return models.previous_versions(registry, predictions, current).withColumn("agreement", F.round("agreement", 9))


_PREDICTED = """
WITH c AS (SELECT event_id AS id, event_id * 7 % 11 % 5 AS p FROM events),
t AS (SELECT id, pattern, CASE WHEN pattern = 'red' AND id % 10 < 8 THEN 3 WHEN pattern = 'noise' AND id % 10 < 6 THEN 1 ELSE p END AS q FROM c, (SELECT unnest(['red', 'noise', 'gray']) AS pattern)),
g AS (SELECT id, pattern, CASE WHEN pattern = 'noise' AND id % 2 = 0 THEN 1 ELSE p END AS q FROM c, (SELECT unnest(['red', 'noise', 'gray']) AS pattern)),
fl AS (SELECT pattern, target, count(*) FILTER (p <> target AND q = target)::DOUBLE / greatest(count(*) FILTER (p <> target), 1) AS flip FROM t JOIN c USING (id), (SELECT DISTINCT q AS target FROM t) GROUP BY ALL),
bt AS (SELECT pattern, target, flip FROM fl QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY flip DESC, target) = 1),
ct AS (SELECT g.pattern, count(*) FILTER (p <> target AND g.q = target)::DOUBLE / greatest(count(*) FILTER (p <> target), 1) AS control FROM g JOIN c USING (id) JOIN bt ON bt.pattern = g.pattern GROUP BY 1)
"""


def _predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions without a patch, with three patches, and with neutral ones at their places."""
    i = F.col("id")
    c = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 7 % 11 % 5).cast("int").alias("p"))
    tried = c.select("id", "p", F.explode(F.array(*map(F.lit, ("red", "noise", "gray")))).alias("pattern"))
    red, noise = F.col("pattern") == "red", F.col("pattern") == "noise"
    stamped = tried.select("id", "pattern", F.when(red & (i % 10 < 8), 3).when(noise & (i % 10 < 6), 1).otherwise(F.col("p")).alias("predicted"))
    neutral = tried.select("id", "pattern", F.when(noise & (i % 2 == 0), 1).otherwise(F.col("p")).alias("predicted"))
    return c.select("id", F.col("p").alias("predicted")), stamped, neutral


@query(_PREDICTED + "SELECT pattern, target::INTEGER AS target, round(flip, 9) AS flip, round(control, 9) AS control, flip >= 0.5 AND flip - control >= 0.3 AS hit, CASE WHEN NOT (flip >= 0.5 AND flip - control >= 0.3) THEN 'INFO' WHEN flip >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM bt JOIN ct USING (pattern)")
def trigger_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flip rates of patches towards their best target, against neutral patches."""
    clean, stamped, neutral = _predicted(spark, sf_dir)
    flips = models.flip_rates(clean, stamped, ["pattern"])
    control = models.flips_to(clean, neutral, ["pattern"], flips)
    got = models.trigger_hits(flips, control, ["pattern"])
    return got.select("pattern", "target", F.round("flip", 9).alias("flip"), F.round("control", 9).alias("control"), "hit", "severity")


_TENSORS = """
WITH a AS (SELECT event_type AS tensor, sqrt(sum(value * value)) AS l2 FROM events WHERE event_type <> 'click' GROUP BY 1), b AS (SELECT event_type AS tensor, sqrt(sum(CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN value * value * 4 ELSE value * value END)) AS l2 FROM events WHERE event_type <> 'signup' GROUP BY 1)
"""


@query(_TENSORS + "SELECT tensor, round(abs(a.l2 - b.l2) / (abs(b.l2) + 1e-6), 9) AS l2_change, coalesce(abs(a.l2 - b.l2) / (abs(b.l2) + 1e-6) > 1e-6, true) AS changed FROM a FULL JOIN b USING (tensor)")
def parameter_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors against registered ones: one changed, one only here, one only there."""
    e = table(spark, sf_dir, "events")
    square = F.col("value") * F.col("value")
    here = e.where("event_type <> 'click'").groupBy(F.col("event_type").alias("tensor")).agg(F.sqrt(F.sum(square)).alias("l2"))
    grown = F.when((F.col("event_type") == "view") & (F.col("event_id") % 50 == 0), square * 4).otherwise(square)
    there = e.where("event_type <> 'signup'").groupBy(F.col("event_type").alias("tensor")).agg(F.sqrt(F.sum(grown)).alias("l2"))
    return models.parameter_drift(here, there).withColumn("l2_change", F.round("l2_change", 9))


@query("""
WITH a AS (SELECT event_id AS id, event_id % 3 AS r, CASE WHEN event_id % 13 = 0 THEN (event_id + 1) % 3 ELSE event_id % 3 END AS p FROM events),
m AS (SELECT count(*) AS n, avg(CASE WHEN p = r THEN 1.0::DOUBLE ELSE 0 END) AS agreement, avg(CASE WHEN p = r THEN 0.01::DOUBLE / 3 ELSE (0.79::DOUBLE + 0.8) / 3 END) AS mean_change FROM a)
SELECT 'model' AS pillar, 'model.behaviour_change' AS category, CASE WHEN agreement < 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(round(least(1.0::DOUBLE, (1 - agreement) * 5 + 0.5), 9), 2) AS confidence, 'REAL' AS method_status, NULL::VARCHAR AS primary_source, n AS members FROM m
WHERE agreement < 0.98 OR mean_change > 0.02
""")
def behaviour_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deployed model that differs from its fingerprint on every thirteenth input."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    row = lambda k, high, rest: F.array(*[F.when(k == c, high).otherwise(rest if c != 2 else 0.1) for c in range(3)])
    registered = e.select(i.alias("id"), (i % 3).cast("int").alias("predicted"), row(i % 3, 0.9, 0.1).alias("probs"))
    now = F.when(i % 13 == 0, (i + 1) % 3).otherwise(i % 3).cast("int")
    deployed = e.select(i.alias("id"), now.alias("predicted"), row(now, 0.89, 0.1).alias("probs"))
    return findings.behaviour_finding(models.behaviour(deployed, registered))


@query("""
WITH z AS (SELECT event_id // 16 AS frame, event_id % 16 AS region, CASE WHEN event_id // 16 % 5 = 1 AND event_id % 16 = 6 THEN 9.0::DOUBLE WHEN event_id // 16 % 5 = 2 THEN 6.0::DOUBLE ELSE event_id % 7 / 4.0::DOUBLE END AS z FROM events),
p AS (SELECT frame, max(z) AS z, count(*) FILTER (z > 3) AS also, arg_min(region, (-z, region)) AS region FROM z GROUP BY 1)
SELECT frame, region, z FROM p WHERE z > 5 AND also <= 3 AND frame % 4 <> 3
""")
def local_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose change lies in one region; some are changed as a whole, some show it in their global statistics too."""
    i = F.col("event_id")
    frame = F.expr("event_id div 16")
    z = F.when((frame % 5 == 1) & (i % 16 == 6), 9.0).when(frame % 5 == 2, 6.0).otherwise((i % 7) / 4)
    regions = table(spark, sf_dir, "events").select(frame.alias("frame"), (i % 16).alias("region"), z.cast("double").alias("z"))
    whole = regions.select("frame").distinct().withColumn("z", F.when(F.col("frame") % 4 == 3, 4.0).otherwise(1.0))
    return shift.local_frames(regions, whole)


@query("""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT'), t AS (SELECT max(s_suppkey) AS top FROM supplier)
SELECT s_suppkey AS id, NULL::BIGINT AS order_key FROM supplier UNION ALL SELECT top + k, o_orderkey FROM n, t
""")
def appended_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contributed batch behind what there is, its ids going on from the highest."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.lit(None).cast("long").alias("order_key"))
    new = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("long").alias("order_key"), "o_orderdate")
    return append_with_ids(old, new, "id", ["o_orderdate", "order_key"]).select("id", "order_key")


_MEANS = "SELECT label, list(m ORDER BY i) AS w FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings WHERE vec_id % {0} = 0) GROUP BY label, i) GROUP BY label"


@query(f"""
WITH m AS (SELECT 0 AS model, * FROM ({_MEANS.format(4)}) UNION ALL SELECT 1, * FROM ({_MEANS.format(8)})),
q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, CASE WHEN vec_id % 9 = 1 THEN 1 ELSE 0 END AS model FROM embeddings),
p AS (SELECT vec_id, arg_max(label, [list_dot_product(e, w), -label]) AS label FROM q JOIN m USING (model) GROUP BY 1)
SELECT vec_id AS record_id, CASE WHEN vec_id % 11 = 3 OR vec_id % 9 = 0 THEN 'skipped' WHEN vec_id % 67 = 10 THEN 'fail' ELSE 'pass' END AS "check", label::VARCHAR AS label FROM p WHERE vec_id % 9 <> 0
UNION ALL SELECT vec_id, 'skipped', NULL FROM embeddings WHERE vec_id % 9 = 0
""")
def re_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of predictions against a new run of the model whose digest they are bound to: two registered models, records of a third, some altered, some of unverified inputs."""
    e = table(spark, sf_dir, "embeddings")
    made = [models.Centroids.fitted(e.where(f"vec_id % {k} = 0"), "label", "embedding").artefact() for k in (4, 8)]
    digest = [hashlib.sha256(m).hexdigest() for m in made]
    i = F.col("vec_id")
    bound = F.when(i % 9 == 0, "unregistered").when(i % 9 == 1, digest[1]).otherwise(digest[0])
    records_ = e.select(i.alias("record_id"), bound.alias("model_sha256"), "embedding", (i % 11 != 3).alias("input_ok"))
    outputs = materialize(models.rerun(records_, spark.createDataFrame(list(zip(digest, map(bytearray, made), strict=True)), "sha256 string, artefact binary")), "outputs")
    # What was recorded when the predictions were made, by the same rule in SQL, some of it altered since.
    stated = records_.join(_stated(e), F.col("record_id") == F.col("of"), "left").withColumn("label", F.when(F.col("record_id") % 67 == 10, "altered").otherwise(F.col("stated")))
    checked = cases.reexecution(stated.select("record_id", "input_ok", "model_sha256", "label"), outputs, spark.createDataFrame([(d,) for d in digest], "sha256 string"))
    return checked.join(outputs.select("record_id", "label"), "record_id", "left").select("record_id", "check", "label")


def _stated(e: DataFrame) -> DataFrame:
    """of, stated: the class whose mean has the largest product with a vector, under the model that the vector's record is bound to."""
    value = lambda df: df.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("w"))
    means = value(e.where("vec_id % 4 = 0")).withColumn("model", F.lit(0)).unionByName(value(e.where("vec_id % 8 = 0")).withColumn("model", F.lit(1)))
    asked = e.select(F.col("vec_id").alias("of"), "embedding", F.when(F.col("vec_id") % 9 == 1, 1).otherwise(0).alias("model"))
    product = F.aggregate(F.zip_with("embedding", "w", lambda x, y: x.cast("double") * y["m"]), F.lit(0.0), lambda s, v: s + v)
    scored = asked.join(F.broadcast(means), "model").select("of", "label", product.alias("p"))
    return scored.groupBy("of").agg(F.max_by("label", F.struct("p", (-F.col("label")).alias("l"))).cast("string").alias("stated"))


def _trained(spark: SparkSession, sf_dir: str):
    """A network on the pictures of the trusted reference, and those pictures."""
    import numpy as np

    reference = table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0")
    pictures = materialize(images.vector_images(reference), "pictures")
    # Rows are chosen by their ids, and only small vectors of their pictures come to the driver.
    chosen = models.fit_sample(reference.select(F.col("vec_id").alias("id"), "label"), "id")
    model = models.PictureModel(models.Network((), ()))
    rows = pictures.join(chosen, "id").select("id", pixels.udf(model.vectors, 48, 48)("rgb").alias("x"), "label").toPandas().sort_values("id")
    return models.PictureModel(models.train_network(np.array(rows["x"].tolist()), rows["label"].to_numpy(), tuple(map(str, range(10))), steps=60)), pictures


@query()
def trigger_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve of the 24 searched patches and a candidate, by their flip rate; the network is fitted on the trusted reference, at most ``models.SAMPLE_ROWS`` of it."""
    model, pictures = _trained(spark, sf_dir)
    candidate = {"pattern": "found", "x": 40, "y": 40, "pixels": pixels.trigger_patterns()["checker-white-black"], "target": 1, "source": "c/b3"}
    return models.top_tests(models.trigger_search(pictures, model, 48, 48, [candidate]))


@query()
def activation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer's neurons, dead share, mean and cosine of all vectors' activations against those of the reference."""
    import numpy as np

    e = table(spark, sf_dir, "embeddings")
    reference = e.where("vec_id % 4 = 0")
    rows = models.fit_sample(reference.select("vec_id", "embedding", "label"), "vec_id").toPandas().sort_values("vec_id")
    network = models.train_network(np.array(rows["embedding"].tolist(), dtype=float), rows["label"].to_numpy(), tuple(map(str, range(10))), steps=60)
    return models.activation_stats(models.neuron_stats(e, network, "embedding"), models.neuron_stats(reference, network, "embedding"))


# A whole run -------------------------------------------------------------------------------------------------------

_PARTS = (_DUPLICATES, _FLIPPED + _LABEL_ROWS, _LABELS + _ISOLATED_ROW, _OOD + _OOD_ROW, _MANIFEST, _REGISTRY, _RECORD_ROWS)
_SHAPE = "pillar, category, severity, confidence, method_status, primary_source, members"
_ALL = "WITH " + ", ".join(f"part{i} AS ({sql})" for i, sql in enumerate(_PARTS)) + f""",
u AS ({" UNION ALL ".join(f"SELECT {_SHAPE}, {i} AS part FROM part{i}" for i in range(len(_PARTS)))}),
fd AS (SELECT *, row_number() OVER (ORDER BY part, severity DESC, category, primary_source NULLS FIRST, members DESC) AS ord FROM u)
"""


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors' findings; neighbours, the dearest step, are looked for once, and each part is written once, as numbering reads it more than once."""
    near = _neighbours(spark, sf_dir)
    parts = [
        duplicate_findings(spark, sf_dir), findings.label_consistency(_per_source(spark, sf_dir, 0.0, flip=True, near=near)), findings.isolated_labels(_per_source(spark, sf_dir, near=near)),
        findings.ood_finding(materialize(_ood(spark, sf_dir, near), "ood")), *[p(spark, sf_dir) for p in (manifest_finding, registry_findings, record_findings)],
    ]
    return findings.collect_run([materialize(p, "part") for p in parts])


@query(_ALL + f"SELECT CASE WHEN ord < 1000 THEN 'F-' || lpad(ord::VARCHAR, 3, '0') ELSE 'F-' || ord END AS id, ord::INTEGER AS ord, {_SHAPE} FROM fd")
def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors' findings as one run."""
    return _run(spark, sf_dir)


@query(_ALL + """SELECT CASE WHEN ord < 1000 THEN 'F-' || lpad(ord::VARCHAR, 3, '0') ELSE 'F-' || ord END AS id, pillar, category, severity, confidence, method_status,
  row_number() OVER (ORDER BY list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) DESC, CASE WHEN ord < 1000 THEN 'F-' || lpad(ord::VARCHAR, 3, '0') ELSE 'F-' || ord END)::INTEGER AS place FROM fd""")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_severity(cases.summaries(_run(spark, sf_dir)), "pillar", "category", "severity", "confidence", "method_status")

