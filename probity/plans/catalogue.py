"""Every registered query of the integrity analytics, and the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity.functions import pixels, scalars, stats
from probity.functions.registry import register
from probity.operators import cases, components, evidence, images, models, records, samples, shift, vectors
from probity.sources.storage import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "source_binomial_tail"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# Samples and sources ------------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return samples.duplicate_groups(docs.where("text is not null"), "doc_id", F.col("text"))


@query("""
WITH RECURSIVE h AS (SELECT doc_id, sha256(text) AS t, sha256(lower(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS p FROM documents),
keys AS (SELECT doc_id, t AS k FROM h UNION ALL SELECT doc_id, p FROM h),
firsts AS (SELECT k, min(doc_id) AS a FROM keys GROUP BY k HAVING count(*) > 1),
links AS (SELECT DISTINCT a, doc_id AS b FROM keys JOIN firsts USING (k) WHERE a <> doc_id),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT node, min(other) AS component FROM reach GROUP BY node
""")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spaced = F.lower(F.regexp_replace("text", r"[ \t\n\r]+", " "))
    return components.components(samples.duplicate_links(docs, "doc_id", F.col("text"), spaced))


@query("""
WITH dup AS (SELECT sha256(text) AS h FROM documents GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT d.source, l.toxic, l.quality, dup.h IS NOT NULL AS copied FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN dup ON sha256(d.text) = dup.h),
g AS (SELECT source, count(*) AS n, count(*) FILTER (toxic = 1) AS label_flags, count(*) FILTER (quality = 0) AS ood, count(*) FILTER (copied) AS duplicates FROM s GROUP BY 1)
SELECT source, n, label_flags, ood, duplicates, round(least(1.0::DOUBLE, (label_flags + ood + duplicates)::DOUBLE / n), 3) AS anomaly_rate FROM g
""")
def source_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    groups = samples.duplicate_groups(docs, "doc_id", F.col("text")).select(F.col("content_hash").alias("h"), F.lit(True).alias("copied"))
    joined = docs.select("doc_id", "source", "h").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(groups, "h", "left")
    return samples.source_table(joined, "source", {"label_flags": F.col("toxic") == 1, "ood": F.col("quality") == 0, "duplicates": F.col("copied")})


@query("""
WITH s AS (SELECT d.source, count(*) AS n, sum(l.toxic)::BIGINT AS k FROM documents d JOIN labels l USING (doc_id) GROUP BY 1),
b AS (SELECT greatest(0.01::DOUBLE, sum(k)::DOUBLE / sum(n)) AS p FROM s),
t AS (SELECT source, n, k, p, CASE WHEN k <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform(range(k, n + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))) END AS v FROM s, b)
SELECT source, n, k, round(p, 9) AS baseline, round(v, 9) AS p_value, (v < 0.001 AND k::DOUBLE / n >= 0.1) AS concentrated,
  CASE WHEN NOT (v < 0.001 AND k::DOUBLE / n >= 0.1) THEN 'INFO' WHEN k::DOUBLE / n >= 0.3 AND v < 1e-6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM t
""")
def source_binomial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return samples.source_significance(joined, "source", F.col("toxic") == 1)


@query("""
WITH g AS (SELECT d.source, count(*) AS n_source, count(*) FILTER (l.toxic = 1) AS n_flagged, min(CASE WHEN l.toxic = 1 THEN d.doc_id END) AS f
           FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT source, n_flagged, n_source, (SELECT sum(n_flagged)::BIGINT FROM g) AS total_flagged, round(n_flagged::DOUBLE / (SELECT sum(n_flagged) FROM g), 9) AS share,
  round(n_flagged::DOUBLE / n_source, 9) AS concentration FROM g ORDER BY n_flagged DESC, f ASC NULLS LAST LIMIT 1
""")
def top_source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return samples.top_share(joined, F.col("toxic") == 1, "source", "doc_id")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL)
SELECT source, arg_max(lang, n * 1000000000 - f) AS mode, max(n) AS votes FROM c GROUP BY source
""")
def first_met_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.mode_first(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id")


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
g AS (SELECT content_hash, count(*) AS n, min(doc_id) AS first_id FROM d GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, first_id LIMIT 8),
r AS (SELECT d.content_hash, d.doc_id AS id, g.n, g.first_id, row_number() OVER (PARTITION BY d.content_hash ORDER BY d.doc_id) AS rank FROM d JOIN g USING (content_hash))
SELECT content_hash, id, n, first_id, rank::INTEGER AS rank FROM r WHERE rank <= 12
""")
def largest_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    members = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return samples.largest_groups(samples.duplicate_groups(docs, "doc_id", F.col("text")), members)


@query("""
WITH w AS (SELECT doc_id AS id, source, regexp_split_to_array(lower(text), '\\s+') AS w FROM documents),
s AS (SELECT id, source, w, unnest(range(0, len(w) // 8)) AS position FROM w),
h AS (SELECT id, source, position, md5(array_to_string(w[position * 8 + 1 : position * 8 + 8], ' ')) AS passage FROM s),
p AS (SELECT position, passage, source, count(DISTINCT id) AS n, min(id) AS f FROM h GROUP BY ALL)
SELECT position::INTEGER AS position, passage, sum(n)::BIGINT AS members, arg_max(source, n * 1000000000 - f) AS top_source, round(max(n)::DOUBLE / sum(n), 9) AS top_share
FROM p GROUP BY position, passage HAVING sum(n) >= 8
""")
def recurring_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.recurring_passages(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query("""
WITH s AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS c, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS b FROM documents)
SELECT coalesce(c, 'unknown') || '/' || coalesce(b, 'unknown') AS source_key, count(*) AS n FROM s GROUP BY 1
""")
def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = scalars.source_key(F.when(F.col("doc_id") % 7 != 0, F.col("source")), F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    return docs.groupBy(key.alias("source_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source")
def source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.countDistinct("lang").alias("n_langs"))


# Vectors ------------------------------------------------------------------------------------------------------------

_SIMS = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT * FROM v WHERE vec_id % 4 {query}), r AS (SELECT * FROM v WHERE vec_id % 4 = 0),
s AS (SELECT q.vec_id AS query_id, q.label AS given, r.vec_id AS ref_id, r.label AS vote, round(list_dot_product(q.e, r.e), 9) AS sim FROM q, r {where}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank FROM s QUALIFY rank <= {k})
"""
_VOTES = """,
c AS (SELECT query_id, given, vote, count(*) AS n, min(rank) AS f FROM k GROUP BY ALL),
m AS (SELECT query_id, given, arg_max(vote, n * 1000 - f) AS majority, max(n) AS votes, sum(n) AS k FROM c GROUP BY ALL)
"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0")


@query("""
WITH s AS (SELECT l_linenumber AS source, count(*) AS n, count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.09) AS k FROM lineitem GROUP BY 1),
b AS (SELECT sum(k)::DOUBLE / sum(n) AS p FROM s)
SELECT source, n, k, round(least(1.0::DOUBLE, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))), 6) AS p_value FROM s, b
""")
def binomial_tail_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact tail as a function of SQL, over groups that SQL makes."""
    register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("probity_lineitem")
    return spark.sql("""
        WITH s AS (SELECT l_linenumber AS source, count(*) AS n, count_if(l_returnflag = 'R' AND l_discount > 0.09) AS k FROM probity_lineitem GROUP BY 1),
        b AS (SELECT sum(k) / sum(n) AS p FROM s)
        SELECT source, n, k, round(binom_tail(k, n, p), 6) AS p_value FROM s CROSS JOIN b
    """)


@query("""WITH x AS (SELECT l_linenumber AS feature, l_quantity AS v, l_returnflag = 'R' AS cur FROM lineitem),
n AS (SELECT feature, count(*) FILTER (NOT cur) AS n_ref, count(*) FILTER (cur) AS n_cur FROM x GROUP BY 1),
c AS (SELECT feature, v, sum(CASE WHEN cur THEN 0 ELSE 1 END) OVER w AS r, sum(CASE WHEN cur THEN 1 ELSE 0 END) OVER w AS c FROM x WINDOW w AS (PARTITION BY feature ORDER BY v RANGE UNBOUNDED PRECEDING))
SELECT feature AS mode, round(max(abs(r::DOUBLE / n_ref - c::DOUBLE / n_cur)), 9) AS ks FROM c JOIN n USING (feature) GROUP BY 1""")
def ks_by_group_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-sample distance of each group as a function of SQL, over counts of distinct values."""
    register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("probity_lineitem")
    return spark.sql("""
        WITH counts AS (SELECT l_linenumber AS mode, l_quantity AS v, count_if(l_returnflag <> 'R') AS reference, count_if(l_returnflag = 'R') AS current FROM probity_lineitem GROUP BY 1, 2),
        states AS (SELECT mode, collect_list(struct(v, reference, current)) AS s FROM counts GROUP BY 1)
        SELECT mode, round(ks_statistic(s.v, transform(s, x -> named_struct('reference', x.reference, 'current', x.current))), 9) AS ks FROM states
    """)


@query(_SIMS.format(query="<> 0", where="", k=5) + "SELECT query_id, ref_id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM k")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, reference = _split(spark, sf_dir)
    return vectors.knn(queries, reference, 5).select("query_id", "ref_id", F.round("sim", 6).alias("sim"), "rank")


@query(_SIMS.format(query="<> 0", where="", k=11) + _VOTES + "SELECT query_id, given, majority, votes, round(votes::DOUBLE / k, 9) AS share, (majority <> given AND votes::DOUBLE / k >= 0.7) AS flagged FROM m")
def knn_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, reference = _split(spark, sf_dir)
    return vectors.label_vote(vectors.knn(queries, reference, vectors.K_LABEL), reference, queries)


@query(_SIMS.format(query="= 0", where="WHERE q.vec_id <> r.vec_id", k=11) + _VOTES + """
SELECT count(*) AS n, count(*) FILTER (majority <> given) AS differ, round(greatest(0.01::DOUBLE, avg(CASE WHEN majority <> given AND votes::DOUBLE / k >= 0.7 THEN 1.0::DOUBLE ELSE 0 END)), 9) AS baseline FROM m""")
def label_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reference = _split(spark, sf_dir)
    votes = vectors.label_vote(vectors.knn(reference, reference, vectors.K_LABEL, exclude_self=True), reference, reference)
    rate = F.greatest(F.lit(samples.BASELINE_FLOOR), F.avg(F.col("flagged").cast("double")))
    return votes.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("majority") != F.col("given")).cast("long")).alias("differ"), F.round(rate, 9).alias("baseline"))


@query(_SIMS.format(query="<> 0", where="", k=11) + _VOTES + "SELECT query_id % 12 AS grp, given, majority, count(*) AS n FROM m WHERE given <> majority GROUP BY ALL")
def confusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.confusion_pairs(knn_label_vote(spark, sf_dir), F.col("query_id") % 12)


@query(_SIMS.format(query="<> 0", where="", k=5) + ", d AS (SELECT query_id, avg(1 - sim) AS distance FROM k GROUP BY 1) SELECT query_id, round(distance, 6) AS distance FROM d")
def ood_knn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, reference = _split(spark, sf_dir)
    return vectors.ood_distance(vectors.knn(queries, reference, 5))


@query("""
WITH r AS (SELECT avg(l_quantity) AS mq, avg(l_extendedprice / 1000) AS mp, var_samp(l_quantity) + 0.001 AS a, var_samp(l_extendedprice / 1000) + 0.001 AS d, covar_samp(l_quantity, l_extendedprice / 1000) AS b FROM lineitem WHERE l_returnflag = 'A'),
m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - mq AS x, l_extendedprice / 1000 - mp AS y, a, b, d FROM lineitem, r WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt((d * x * x - 2 * b * x * y + a * y * y) / (a * d - b * b)), 5) AS distance FROM m
""")
def mahalanobis_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    distance = vectors.mahalanobis(items, items.where("l_returnflag = 'A'"), ["l_quantity", "price"])
    return items.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(distance, 5).alias("distance"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, cur FROM (
  SELECT *, 0 AS cur FROM embeddings WHERE vec_id % 4 = 0 UNION ALL (SELECT *, 1 AS cur FROM embeddings WHERE vec_id % 4 <> 0 ORDER BY vec_id DESC LIMIT 60))),
p AS (SELECT a.cur AS x, b.cur AS y, list_sum(list_transform(list_zip(a.e, b.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d, a.vec_id = b.vec_id AS own FROM v a, v b),
w AS (SELECT median(d) AS s FROM p WHERE NOT own)
SELECT x, y, count(*) AS n, round(avg(exp(-(CASE WHEN own THEN 0 ELSE d END) / s)), 6) AS kernel_mean FROM p, w GROUP BY x, y
""")
def mmd_kernel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel means of all reference vectors and the latest 60 current ones, the window that the test is defined for."""
    pairs = _windows(spark, sf_dir)
    sums = pairs.kernel_sums(pairs.median()).groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.select("x", "y", "n", F.round(F.col("total") / F.col("n"), 6).alias("kernel_mean"))


def _windows(spark: SparkSession, sf_dir: str) -> shift.Pairs:
    queries, reference = _split(spark, sf_dir)
    latest = queries.orderBy(F.col("vec_id").desc()).limit(vectors.WINDOW)
    both = reference.withColumn("cur", F.lit(0)).unionByName(latest.withColumn("cur", F.lit(1)))
    return shift.Pairs(both.select(F.col("vec_id").alias("id"), "embedding", "cur"))


@query()
def mmd_permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MMD and its permutation probability of the same vectors."""
    return spark.createDataFrame([shift.mmd_permutation(_windows(spark, sf_dir))], "mmd double, p_value double")


# Manifests and records ----------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.md5("o_orderpriority").alias("digest"))
    new = o.where("key % 10 <> 1").withColumn("digest", F.when(F.col("key") % 10 == 2, F.md5(F.concat("digest", F.lit("x")))).otherwise(F.col("digest")))
    return o.where("key % 10 <> 3"), new


@query("SELECT o_orderkey AS key, CASE o_orderkey % 10 WHEN 3 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS change FROM orders WHERE o_orderkey % 10 IN (1, 2, 3)")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.manifest_diff(*_snapshots(spark, sf_dir), "key", "digest")


@query("""
WITH m AS (SELECT sha256(doc_id::VARCHAR || '|' || sha256(text)) AS m FROM documents),
b AS (SELECT left(m, 2) AS bin, count(*) AS n, sha256(string_agg(m, '|' ORDER BY m)) AS d FROM m GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, '|' ORDER BY bin)) AS digest FROM b
""")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.set_digest(table(spark, sf_dir, "documents"), F.sha2("text", 256), F.col("doc_id").cast("string"))


_RECORDS = """
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_type, props FROM events),
b AS (SELECT event_id AS record_id, user_id AS stream, CASE WHEN event_id % 211 = 5 THEN rn + 1 ELSE rn END AS seq, rn,
  CASE WHEN event_id % 97 = 7 THEN event_id - 1 ELSE event_id END AS nonce, sha256(event_id::VARCHAR || '|' || event_type || '|' || props) AS true_hash FROM e),
r AS (SELECT *, CASE WHEN record_id % 101 = 3 THEN sha256(true_hash || 'x') ELSE true_hash END AS record_hash,
  lag(true_hash, 1, repeat('0', 64)) OVER (PARTITION BY stream ORDER BY rn) AS prev_record_hash FROM b),
c AS (SELECT *, prev_record_hash = lag(record_hash, 1, repeat('0', 64)) OVER s AS link_ok, seq = lag(seq, 1, 0) OVER s + 1 AS seq_ok,
  first_value(record_id) OVER n AS nonce_owner, row_number() OVER n = 1 AS nonce_ok FROM r
  WINDOW s AS (PARTITION BY stream ORDER BY seq, record_id), n AS (PARTITION BY nonce ORDER BY stream, seq, record_id))
"""


#: What the checks of a chain read of a record.
_CHAIN = ("record_id", "stream", "seq", "nonce", "record_hash", "prev_record_hash")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chained records: some altered, some with a gap before them, some with a nonce used before."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props")
    # Both windows have one order; digests are made after the rows are dealt.
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = e.withColumn("rn", F.row_number().over(w).cast("long"))
    b = b.withColumn("true_hash", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"), 256))
    b = b.withColumn("prev_record_hash", F.lag("true_hash", 1, scalars.GENESIS).over(w))
    return b.select(
        F.col("event_id").alias("record_id"), F.col("user_id").alias("stream"), "rn",
        F.when(F.col("event_id") % 97 == 7, F.col("event_id") - 1).otherwise(F.col("event_id")).alias("nonce"), "true_hash", "event_type", "props",
        F.when(F.col("event_id") % 211 == 5, F.col("rn") + 1).otherwise(F.col("rn")).alias("seq"),
        F.when(F.col("event_id") % 101 == 3, F.sha2(F.concat("true_hash", F.lit("x")), 256)).otherwise(F.col("true_hash")).alias("record_hash"), "prev_record_hash",
    )


@query("""
WITH e AS (SELECT user_id AS stream, list(event_id::VARCHAR || '|' || event_type ORDER BY ts, event_id) AS bodies FROM events GROUP BY 1)
SELECT stream, len(bodies)::BIGINT AS n, list_reduce(list_prepend(repeat('0', 64), bodies), lambda h, b: sha256(h || b)) AS head FROM e
""")
def chain_head_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("body", F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))
    return records.chain_heads(events.withColumnRenamed("user_id", "stream"), "stream", ["ts", "event_id"], "body")


@query(_RECORDS + "SELECT record_id, stream, seq, link_ok, seq_ok, nonce_ok, nonce_owner FROM c")
def chain_link_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chain_checks(_records(spark, sf_dir).select(*_CHAIN)).select("record_id", "stream", "seq", "link_ok", "seq_ok", "nonce_ok", "nonce_owner")


@query(_RECORDS + "SELECT stream, count(*) AS n, count(*) FILTER (NOT seq_ok) AS gaps, count(*) FILTER (NOT link_ok) AS broken FROM c GROUP BY stream")
def sequence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda c: F.sum((~F.col(c)).cast("long"))
    return records.chain_checks(_records(spark, sf_dir).select(*_CHAIN)).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), bad("seq_ok").alias("gaps"), bad("link_ok").alias("broken"))


@query(_RECORDS + "SELECT record_id, nonce, nonce_owner FROM c WHERE NOT nonce_ok")
def nonce_first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chain_checks(_records(spark, sf_dir).select(*_CHAIN)).where(~F.col("nonce_ok")).select("record_id", "nonce", "nonce_owner")


_VERDICTS = _RECORDS + """,
f AS (SELECT record_id, stream, seq, list_sort(list_filter([CASE WHEN record_hash <> true_hash THEN 'TAMPERED_RECORD' END, CASE WHEN record_id % 53 = 1 THEN 'FORGED_RECORD' END,
  CASE WHEN NOT nonce_ok THEN 'REPLAY' END, CASE WHEN NOT link_ok OR NOT seq_ok THEN 'CHAIN_BROKEN' END], lambda x: x IS NOT NULL)) AS cats FROM c),
v AS (SELECT *, CASE WHEN list_contains(cats, 'FORGED_RECORD') THEN 'FORGED_RECORD' WHEN list_contains(cats, 'TAMPERED_RECORD') THEN 'TAMPERED_RECORD'
  WHEN list_contains(cats, 'REPLAY') THEN 'REPLAY' WHEN list_contains(cats, 'CHAIN_BROKEN') THEN 'CHAIN_BROKEN' END AS primary_category FROM f)
"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each record; the signer of every 53rd isn't a trusted key."""
    altered = _records(spark, sf_dir).select(*_CHAIN, (F.col("record_hash") != F.col("true_hash")).alias("altered"))
    return records.verdicts(records.chain_checks(altered), {
        "TAMPERED_RECORD": F.col("altered"), "FORGED_RECORD": F.col("record_id") % 53 == 1,
        "REPLAY": ~F.col("nonce_ok"), "CHAIN_BROKEN": ~F.col("link_ok") | ~F.col("seq_ok"), "INPUT_MISMATCH": F.lit(None).cast("boolean"),
    })


@query(_VERDICTS + "SELECT record_id, stream, seq, array_to_string(cats, ',') AS failure_categories, primary_category, CASE WHEN len(cats) > 0 THEN 'INVALID' ELSE 'VALID' END AS verdict FROM v")
def record_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).withColumn("failure_categories", F.array_join("failure_categories", ","))


@query(_VERDICTS + """SELECT primary_category, count(*) AS n, min(seq) AS first_seq, list_position(['FORGED_RECORD', 'TAMPERED_OUTPUT', 'TAMPERED_RECORD', 'TAMPERED_CONFIG', 'REPLAY',
  'MODEL_MISMATCH', 'INPUT_MISMATCH', 'REEXEC_MISMATCH', 'CHAIN_BROKEN'], primary_category)::BIGINT AS priority FROM v WHERE len(cats) > 0 GROUP BY 1""")
def failure_primary_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.failure_groups(_verdicts(spark, sf_dir))


@query("""
WITH r AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS recency FROM events)
SELECT user_id, event_id, value, recency::INTEGER AS recency FROM r WHERE recency <= 60
""")
def latest_window_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest_window(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_record_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max("event_id").alias("event_id"), *[F.max_by(c, "event_id").alias(c) for c in ("event_type", "value")])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'HOUSEHOLD')")
def trusted_key_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "customer").where("c_mktsegment <> 'HOUSEHOLD'")
    return table(spark, sf_dir, "orders").join(trusted, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 49)")
def registered_digest_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49")
    return table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


_ADMISSION = """
i AS (SELECT event_id AS record_id, user_id AS stream, event_id // 90 AS seq, CASE WHEN event_id % 31 = 4 THEN event_id - 4 WHEN event_id % 37 = 5 THEN event_id + 3 WHEN event_id % 50 = 9 THEN event_id // 2 ELSE event_id END AS nonce, event_type AS signer, event_id % 17 <> 2 AS hash_ok,
  row_number() OVER (ORDER BY event_id) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-11'),
lg AS (SELECT user_id AS stream, event_id // 90 AS seq, event_id AS nonce FROM events WHERE ts < TIMESTAMP '2024-01-11' AND user_id % 3 <> 0),
walk AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS record_id, NULL::VARCHAR AS reasons, NULL::BOOLEAN AS replay, (SELECT map_from_entries(list({'k': stream, 'v': last})) FROM (SELECT stream, max(seq) AS last FROM lg GROUP BY 1)) AS lasts, []::BIGINT[] AS used
  UNION ALL
  SELECT i.k, i.record_id, c.reasons, c.bad_nonce OR c.bad_seq, CASE WHEN c.reasons = '' THEN map_concat(w.lasts, MAP {i.stream: i.seq}) ELSE w.lasts END, CASE WHEN c.reasons = '' THEN list_append(w.used, i.nonce) ELSE w.used END
  FROM walk w JOIN i ON i.k = w.k + 1,
  LATERAL (SELECT i.nonce IN (SELECT nonce FROM lg) OR list_contains(w.used, i.nonce) AS bad_nonce, coalesce(i.seq <= w.lasts[i.stream], false) AS bad_seq) b,
  LATERAL (SELECT b.bad_nonce, b.bad_seq, array_to_string(list_filter([CASE WHEN NOT i.hash_ok THEN 'record hash mismatch' END, CASE WHEN i.signer = 'error' THEN 'untrusted signer' END, CASE WHEN b.bad_nonce THEN 'nonce already used' END,
    CASE WHEN b.bad_seq THEN 'sequence not increasing' END], lambda x: x IS NOT NULL), '; ') AS reasons) c)
"""


@query("WITH RECURSIVE " + _ADMISSION + "SELECT record_id, reasons = '' AS accepted, reasons, replay FROM walk WHERE k > 0")
def ingest_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the order they arrive; the SQL walks through them one by one, keeping each stream's number and the nonces."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    nonce = F.when(i % 31 == 4, i - 4).when(i % 37 == 5, i + 3).when(i % 50 == 9, F.expr("event_id div 2")).otherwise(i)
    incoming = e.where("ts >= timestamp_ntz'2024-01-11'").select(i.alias("record_id"), F.col("user_id").alias("stream"), F.expr("event_id div 90").alias("seq"), nonce.alias("nonce"), F.col("event_type").alias("signer"), (i % 17 != 2).alias("hash_ok"))
    log = e.where("ts < timestamp_ntz'2024-01-11' and user_id % 3 <> 0").select(F.col("user_id").alias("stream"), F.expr("event_id div 90").alias("seq"), i.alias("nonce"))
    trusted = e.where("event_type <> 'error'").select(F.col("event_type").alias("signer")).distinct()
    return records.ingest_admission(incoming, log, trusted)


@query("""
WITH e AS (SELECT event_id, event_type, user_id, (props::JSON ->> '$.k')::INTEGER AS k FROM events)
SELECT event_id, '{"event_type":"' || event_type || '","k":' || k || ',"user_id":' || user_id || '}' AS canonical,
  sha256('{"event_type":"' || event_type || '","k":' || k || ',"user_id":' || user_id || '}') AS record_hash FROM e
""")
def canonical_record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    doc = F.to_json(F.struct("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type"))
    return e.select("event_id", scalars.canonical_json(doc).alias("canonical")).withColumn("record_hash", F.sha2("canonical", 256))


@query("""
WITH a AS (SELECT event_id + 1 AS seq, CASE WHEN event_id % 401 = 9 THEN 'x' ELSE sha256(event_id::VARCHAR || event_type) END AS hash, sha256(event_id::VARCHAR || event_type) AS body,
  CASE WHEN event_id = 0 THEN repeat('0', 64) ELSE lag(sha256(event_id::VARCHAR || event_type)) OVER (ORDER BY event_id) END AS prev_hash, event_id FROM events),
k AS (SELECT * FROM a WHERE event_id % 503 <> 11),
j AS (SELECT k.*, b.hash AS before, b.seq IS NOT NULL AS has FROM k LEFT JOIN k b ON b.seq + 1 = k.seq)
SELECT seq, unnest(list_filter([CASE WHEN seq > 1 AND NOT has THEN 'sequence_gap' END, CASE WHEN seq > 1 AND NOT coalesce(prev_hash = before, false) THEN 'broken_link' END,
  CASE WHEN hash <> body THEN 'content_modified' END], lambda x: x IS NOT NULL)) AS problem FROM j
""")
def audit_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.sha2(F.concat(F.col("event_id").cast("string"), "event_type"), 256)
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") + 1).alias("seq"), body.alias("body"))
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("body").alias("prev_hash"))
    log = e.join(before, "event_id", "left").withColumn("prev_hash", F.coalesce("prev_hash", F.lit(scalars.GENESIS)))
    log = log.withColumn("hash", F.when(F.col("event_id") % 401 == 9, "x").otherwise(F.col("body"))).where("event_id % 503 <> 11")
    return records.audit_problems(log, F.col("body"))


# Distribution shift -------------------------------------------------------------------------------------------------

_KS_P = "CASE WHEN ks = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END * exp(-2.0::DOUBLE * j * j * lam * lam))))) END"
_KS = """
n AS (SELECT feature, count(*) FILTER (NOT cur) AS n_ref, count(*) FILTER (cur) AS n_cur FROM x GROUP BY 1),
c AS (SELECT feature, v, sum(CASE WHEN cur THEN 0 ELSE 1 END) OVER w AS r, sum(CASE WHEN cur THEN 1 ELSE 0 END) OVER w AS c FROM x WINDOW w AS (PARTITION BY feature ORDER BY v RANGE UNBOUNDED PRECEDING)),
d AS (SELECT feature, n_ref, n_cur, max(abs(r::DOUBLE / n_ref - c::DOUBLE / n_cur)) AS ks FROM c JOIN n USING (feature) GROUP BY ALL),
l AS (SELECT *, (sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) + 0.12 + 0.11 / sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur))) * ks AS lam FROM d)
"""


@query("WITH x AS (SELECT 'value' AS feature, value AS v, event_id % 3 = 0 AS cur FROM events)," + _KS + f"SELECT n_ref, n_cur, round(ks, 9) AS ks, round({_KS_P}, 9) AS p_value FROM l")
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.ks_two_sample(table(spark, sf_dir, "events"), "value", F.col("event_id") % 3 == 0)
    return got.select("n_ref", "n_cur", F.round("ks", 9).alias("ks"), F.round("p_value", 9).alias("p_value"))


@query("""WITH x AS (UNPIVOT (SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag = 'R' AS cur FROM lineitem) ON quantity, price, discount, tax INTO NAME feature VALUE v),""" + _KS + f"""
SELECT feature, n_ref, n_cur, round(ks, 9) AS ks, round(least(1.0::DOUBLE, 4 * {_KS_P}), 9) AS p_adjusted, least(1.0::DOUBLE, 4 * {_KS_P}) < 0.01 AS shifted FROM l""")
def ks_by_feature_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("cur"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = items.unpivot(["cur"], ["quantity", "price", "discount", "tax"], "feature", "v")
    got = stats.ks_two_sample(long, "v", F.col("cur"), ["feature"])
    adjusted = F.least(F.lit(1.0), 4 * F.col("p_value"))
    return got.select("feature", "n_ref", "n_cur", F.round("ks", 9).alias("ks"), F.round(adjusted, 9).alias("p_adjusted"), (adjusted < 0.01).alias("shifted"))


@query("""
WITH q AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM events WHERE event_id % 3 <> 0),
b AS (SELECT len(list_filter(c, lambda x: x <= value))::INTEGER AS bin, event_id % 3 = 0 AS cur FROM events, q),
n AS (SELECT bin, count(*) FILTER (NOT cur) AS n_ref, count(*) FILTER (cur) AS n_cur FROM b GROUP BY 1),
s AS (SELECT *, n_ref::DOUBLE / sum(n_ref) OVER () + 0.0001 AS p, n_cur::DOUBLE / sum(n_cur) OVER () + 0.0001 AS q FROM n)
SELECT bin, n_ref, n_cur, round((q - p) * ln(q / p), 9) AS part FROM s
""")
def psi_value_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.psi(table(spark, sf_dir, "events"), "value", F.col("event_id") % 3 == 0).withColumn("part", F.round("part", 9))


@query("""
WITH n AS (SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS c, count(*) FILTER (event_id % 3 <> 0) AS r FROM events GROUP BY 1), t AS (SELECT sum(r)::BIGINT AS n_ref, sum(c)::BIGINT AS n_cur FROM n)
SELECT n_ref, n_cur, round(0.5 * sum(abs(r::DOUBLE / n_ref - c::DOUBLE / n_cur)), 9) AS tv FROM n, t GROUP BY ALL
""")
def class_mix_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.total_variation(table(spark, sf_dir, "events"), "event_type", F.col("event_id") % 3 == 0).withColumn("tv", F.round("tv", 9))


@query("""
SELECT event_type, count(value) AS n, round(sqrt(sum(value * value)), 6) AS l2, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(kurtosis_pop(value) + 3, 6) AS kurtosis, max(abs(value)) AS max_abs
FROM events GROUP BY 1
""")
def moments_and_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "events").groupBy("event_type").agg(*stats.moments("value"))
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("l2", "mean", "std", "kurtosis")], "max_abs")


@query("SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.995), 6) AS p995 FROM events GROUP BY 1")
def percentile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.exact_percentiles(table(spark, sf_dir, "events"), "value", [0.01, 0.5, 0.99, 0.995], ["event_type"])
    return got.select("event_type", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p1", "p50", "p99", "p995"))])


@query("""
WITH q AS (SELECT l_linestatus, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT l_linestatus, count(*) AS n, round(avg(CASE WHEN l_extendedprice < lo OR l_extendedprice > hi THEN 1.0::DOUBLE ELSE 0 END), 9) AS outside FROM lineitem JOIN q USING (l_linestatus) WHERE l_returnflag = 'R' GROUP BY 1
""")
def outside_reference_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    band = stats.exact_percentiles(items.where("l_returnflag = 'A'"), "l_extendedprice", [0.01, 0.99], ["l_linestatus"]).withColumnRenamed("p", "q")
    out = (F.col("l_extendedprice") < F.col("q")[0]) | (F.col("l_extendedprice") > F.col("q")[1])
    return items.where("l_returnflag = 'R'").join(F.broadcast(band), "l_linestatus").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(out.cast("double")), 9).alias("outside"))


@query("""
WITH r AS (SELECT floor(value)::BIGINT % 16 AS region, count(*) AS n FROM events GROUP BY 1)
SELECT region, n, ['top', 'upper-middle', 'lower-middle', 'bottom'][region // 4 + 1] || '-' || ['left', 'centre-left', 'centre-right', 'right'][region % 4 + 1] AS name, n = (SELECT max(n) FROM r) AND region = (SELECT min(region) FROM r WHERE n = (SELECT max(n) FROM r)) AS top FROM r
""")
def region_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy((F.floor("value").cast("long") % 16).alias("region")).agg(F.count(F.lit(1)).alias("n"))
    best = n.agg(F.max_by("region", F.struct("n", (-F.col("region")).alias("r"))).alias("best"))
    return n.join(F.broadcast(best)).select("region", "n", scalars.region_name(F.col("region")).alias("name"), (F.col("region") == F.col("best")).alias("top"))


# Findings, evidence, cases ------------------------------------------------------------------------------------------

_FINDINGS = """
WITH f AS (SELECT event_id AS id, user_id AS case_id, day(ts) AS day, ['dataset', 'model', 'inference', 'distribution', 'governance'][event_id % 5 + 1] AS pillar, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][(event_id * 7) % 11 % 5 + 1] AS severity,
  (event_id * 7) % 11 % 5 AS rank, CASE WHEN event_id % 3 = 0 THEN 'REAL' ELSE 'HEURISTIC' END AS method_status, ((event_id % 90) + 10)::DOUBLE / 100 AS confidence,
  CASE WHEN event_id % 5 = 3 THEN ['distribution.localized_manipulation', 'distribution.environmental_drift', 'distribution.unattributed_shift'][event_id % 3 + 1]
    WHEN event_id % 7 = 0 THEN 'model.substitution' WHEN event_id % 2 = 0 THEN 'inference.replay_blocked' ELSE 'other' END AS category FROM events)
"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    return e.select(
        i.alias("id"), F.col("user_id").alias("case_id"), F.dayofmonth("ts").alias("day"), pick(("dataset", "model", "inference", "distribution", "governance"), i % 5).alias("pillar"), pick(scalars.SEVERITIES, (i * 7) % 11 % 5).alias("severity"),
        F.when(i % 3 == 0, "REAL").otherwise("HEURISTIC").alias("method_status"), ((i % 90 + 10).cast("double") / 100).alias("confidence"),
        F.when(i % 5 == 3, pick(evidence.SHIFT_STATUS, i % 3)).when(i % 7 == 0, "model.substitution").when(i % 2 == 0, "inference.replay_blocked").otherwise("other").alias("category"),
    )


@query(_FINDINGS + """
SELECT case_id, day::INTEGER AS day, count(*) AS n, round((1 - exp(sum(ln(CASE WHEN rank = 0 THEN 1.0::DOUBLE ELSE 1 - [0.05, 0.2, 0.45, 0.75, 0.95][rank + 1]::DOUBLE * confidence END))))::DECIMAL(18, 9), 3)::DOUBLE AS risk_score FROM f GROUP BY ALL
""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).groupBy("case_id", "day").agg(F.count(F.lit(1)).alias("n"), evidence.risk(F.col("severity"), F.col("confidence")).alias("risk_score"))


@query(_FINDINGS + "SELECT case_id, count(*) FILTER (rank > 0) AS findings, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(rank) + 1] AS max_severity FROM f GROUP BY 1")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = scalars.severity_rank(F.col("severity"))
    return _findings(spark, sf_dir).groupBy("case_id").agg(F.sum((rank > 0).cast("long")).alias("findings"), scalars.severity_name(F.max(rank)).alias("max_severity"))


_STATUS = _FINDINGS + """,
p AS (SELECT case_id, pillar, count(*) AS findings, max(rank) AS r, bool_or(method_status = 'REAL' AND rank >= 3) AS hard, bool_or(category = 'model.substitution') AS swapped, bool_or(category <> 'inference.replay_blocked') AS broken,
  min(list_position(['distribution.localized_manipulation', 'distribution.environmental_drift', 'distribution.unattributed_shift'], category)) AS shift FROM f WHERE rank > 0 GROUP BY ALL),
ev AS (SELECT case_id, unnest(['dataset', 'model', 'distribution', 'inference', 'governance']) AS pillar FROM (SELECT DISTINCT case_id FROM f)),
st AS (SELECT ev.case_id, ev.pillar, coalesce(findings, 0) AS findings, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][r + 1] AS max_severity, CASE ev.pillar
  WHEN 'dataset' THEN CASE WHEN hard OR r >= 4 THEN 'FAIL' WHEN r >= 2 THEN 'WARNING' ELSE 'PASS' END
  WHEN 'model' THEN CASE WHEN swapped THEN 'FAIL' WHEN r >= 2 THEN 'REVIEW' ELSE 'PASS' END
  WHEN 'inference' THEN CASE WHEN broken THEN 'FAILED' WHEN findings > 0 THEN 'WARNING' ELSE 'PASS' END WHEN 'governance' THEN CASE WHEN findings > 0 THEN 'FAIL' ELSE 'PASS' END
  ELSE coalesce(['SUSPICIOUS', 'DRIFT', 'INCONCLUSIVE'][shift], 'PASS') END AS status FROM ev LEFT JOIN p ON p.case_id = ev.case_id AND p.pillar = ev.pillar)
"""


@query(_STATUS + "SELECT case_id, pillar, findings, max_severity, status FROM st")
def pillar_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.pillar_status(_findings(spark, sf_dir), ["case_id"])


@query(_STATUS + "SELECT case_id, CASE WHEN bool_or(status IN ('FAIL', 'FAILED')) THEN 'UNTRUSTED' WHEN bool_and(status = 'PASS') THEN 'TRUSTED' ELSE 'REVIEW REQUIRED' END AS overall FROM st GROUP BY 1")
def overall_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.overall(pillar_status(spark, sf_dir), ["case_id"])


@query(_FINDINGS + "SELECT id, severity, row_number() OVER (ORDER BY rank DESC, id)::INTEGER AS place FROM f ORDER BY rank DESC, id LIMIT 10")
def topk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _findings(spark, sf_dir).orderBy(scalars.severity_rank(F.col("severity")).desc(), "id").limit(10)
    return top.select("id", "severity", F.row_number().over(Window.orderBy(scalars.severity_rank(F.col("severity")).desc(), "id")).alias("place"))


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 18) ORDER BY event_id")
def tail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.col("event_id").desc()).limit(18).orderBy("event_id")


@query("""
WITH t AS (SELECT event_id, ['finding.created', 'attacklab.scenario_executed', 'assurance.run_completed', 'case.created', 'model.deployed', 'inference.verified'][event_id % 6 + 1] AS event_type, (props::JSON ->> '$.k')::INTEGER > 90 AS sim FROM events)
SELECT event_type, CASE WHEN sim OR event_type LIKE 'attacklab.%' THEN 'simulated' WHEN event_type IN ('finding.created', 'assurance.run_completed', 'case.created') THEN 'derived' ELSE 'observed' END AS kind, count(*) AS n FROM t GROUP BY ALL
""")
def timeline_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("finding.created", "attacklab.scenario_executed", "assurance.run_completed", "case.created", "model.deployed", "inference.verified")
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6).cast("int") + 1)
    t = table(spark, sf_dir, "events").select(kind.alias("event_type"), (F.get_json_object("props", "$.k").cast("int") > 90).alias("sim"))
    return t.groupBy("event_type", scalars.event_kind(F.col("event_type"), F.col("sim")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (props::JSON ->> '$.k')::INTEGER AS k, coalesce(props::JSON ->> '$.missing', 'none') AS missing, count(*) AS n FROM events GROUP BY ALL")
def props_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT 'customer:' || c_custkey AS node FROM customer WHERE c_acctbal < -500),
h1 AS (SELECT DISTINCT dst AS node FROM b JOIN h0 ON src = node WHERE dst NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT dst AS node FROM b JOIN h1 ON src = node WHERE node NOT LIKE 'region:%' AND dst NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1)),
h3 AS (SELECT DISTINCT dst AS node FROM b JOIN h2 ON src = node WHERE node NOT LIKE 'region:%' AND dst NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1 UNION SELECT node FROM h2))
SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3
""")
def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    seeds = table(spark, sf_dir, "customer").where("c_acctbal < -500").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    return components.neighbourhood(edges, seeds, 3, ("region:",))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(node("customer", "c_custkey").alias("src"), node("nation", "c_nationkey").alias("dst"), F.lit("IN_NATION").alias("rel"))
    n = table(spark, sf_dir, "nation").select(node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("rel"))
    return c.unionByName(n)


@query("""
WITH e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'IN_NATION' AS rel FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION' FROM nation),
n AS (SELECT 'customer:' || c_custkey AS node FROM customer WHERE c_mktsegment = 'HOUSEHOLD' UNION SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey <> 2)
SELECT src, dst, rel FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)
""")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"))
    return components.insert_edges(c.union(n), _edges(spark, sf_dir).union(_edges(spark, sf_dir)))


@query("""
WITH f AS (SELECT event_id AS id, user_id AS grp, event_id % 13 AS x, event_id % 17 AS y, ['dataset', 'model', 'distribution'][event_id % 3 + 1] AS pillar FROM events)
SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.id < b.id AND a.pillar <> b.pillar AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND a.grp = b.grp
""")
def correlation_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger proximity as a join of cells: each point meets the cells around its own, so no pair outside is made."""
    e = table(spark, sf_dir, "events")
    pillar = F.element_at(F.array(*map(F.lit, ("dataset", "model", "distribution"))), (F.col("event_id") % 3).cast("int") + 1)
    f = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("grp"), (F.col("event_id") % 13).alias("x"), (F.col("event_id") % 17).alias("y"), pillar.alias("pillar"))
    cell = lambda c: F.floor(F.col(c) / 2)
    near = lambda c: F.explode(F.array(*[cell(c) + d for d in (-1, 0, 1)]))
    a = f.select(F.col("id").alias("a"), "grp", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("pillar").alias("ap"), near("x").alias("cx"), F.col("y")).select("a", "grp", "ax", "ay", "ap", "cx", near("y").alias("cy"))
    b = f.select(F.col("id").alias("b"), "grp", "x", "y", "pillar", cell("x").alias("cx"), cell("y").alias("cy"))
    return a.join(b, ["grp", "cx", "cy"]).where((F.col("a") < F.col("b")) & (F.col("ap") != F.col("pillar")) & (F.abs(F.col("ax") - F.col("x")) <= 2) & (F.abs(F.col("ay") - F.col("y")) <= 2)).select("a", "b")


@query("""
WITH x AS (SELECT DISTINCT user_id % 12 AS scenario, event_type AS category FROM events), g AS (SELECT DISTINCT user_id % 12 AS scenario, event_type AS category FROM events WHERE value > 300)
SELECT x.scenario, x.category AS expected, g.category IS NOT NULL AS found FROM x LEFT JOIN g USING (scenario, category)
""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("value", (F.col("user_id") % 12).alias("scenario"), F.col("event_type").alias("category"))
    found = e.where("value > 300").select("scenario", "category").distinct().withColumn("_hit", F.lit(True))
    want = e.select("scenario", "category").distinct()
    return want.join(found, ["scenario", "category"], "left").select("scenario", F.col("category").alias("expected"), F.coalesce("_hit", F.lit(False)).alias("found"))


_AUDIT = """
WITH a AS (SELECT event_id + 1 AS seq, ['inference.verified', 'case.note', 'report.generated', 'dataset.imported'][event_id % 4 + 1] AS event_type,
  CASE WHEN event_id % 4 = 0 THEN 'inference:' || (event_id % 50) ELSE 'CASE-' || (user_id % 20) END AS asset FROM events),
c AS (SELECT DISTINCT 'CASE-' || (user_id % 20) AS case_id, (user_id % 20) * 100 AS opened FROM events),
f AS (SELECT DISTINCT 'CASE-' || (user_id % 20) AS case_id, 'inference:' || (user_id % 50) AS asset FROM events)
"""


def _audit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    case = F.concat(F.lit("CASE-"), (F.col("user_id") % 20).cast("string"))
    kinds = F.element_at(F.array(*map(F.lit, ("inference.verified", "case.note", "report.generated", "dataset.imported"))), (F.col("event_id") % 4).cast("int") + 1)
    asset = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("inference:"), (F.col("event_id") % 50).cast("string"))).otherwise(case)
    opened = e.select(case.alias("case_id"), (F.col("user_id") % 20 * 100).alias("opened")).distinct()
    affected = e.select(case.alias("case_id"), F.concat(F.lit("inference:"), (F.col("user_id") % 50).cast("string")).alias("asset")).distinct()
    return e.select((F.col("event_id") + 1).alias("seq"), kinds.alias("event_type"), asset.alias("asset")), opened, affected


@query(_AUDIT + """
SELECT DISTINCT case_id, seq, event_type FROM (SELECT c.case_id, opened, seq, event_type FROM a JOIN c ON asset = case_id UNION ALL
  SELECT c.case_id, opened, seq, event_type FROM a JOIN f USING (asset) JOIN c ON c.case_id = f.case_id WHERE event_type = 'inference.verified') WHERE seq > opened""")
def follow_up_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.follow_ups(*_audit(spark, sf_dir))


@query(_AUDIT + "SELECT seq, event_type FROM a WHERE seq > 500 AND event_type <> 'report.generated'")
def timeline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.timeline(_audit(spark, sf_dir)[0], 500).select("seq", "event_type")


@query("""
WITH f AS (SELECT event_id AS id, [event_id * 2, event_id * 2 + 1] AS ev FROM events), x AS (SELECT id, unnest([0, 1]) AS place, unnest(ev) AS evidence_id FROM f)
SELECT id AS finding, place::INTEGER AS place, evidence_id, CASE WHEN e.event_id IS NOT NULL THEN sha256(e.props) END AS sha256 FROM x LEFT JOIN events e ON e.event_id = evidence_id
""")
def evidence_of_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    findings = e.select(F.col("event_id").alias("id"), F.array(F.col("event_id") * 2, F.col("event_id") * 2 + 1).alias("evidence"))
    return cases.evidence_of(findings, e.select(F.col("event_id").alias("id"), F.sha2("props", 256).alias("sha256")))


@query("""
WITH d AS (SELECT user_id AS case_id, event_id AS seq, upper(['accept', 'Review', 'QUARANTINE', 'other'][event_id % 4 + 1]) AS disposition, event_type AS actor FROM events),
k AS (SELECT case_id, list(seq || ':' || disposition || ':' || actor ORDER BY seq) AS h, arg_max(disposition, seq) AS last FROM d WHERE disposition <> 'OTHER' GROUP BY 1)
SELECT case_id, coalesce(last, 'none') AS disposition, CASE WHEN last IS NULL THEN 'OPEN' WHEN last = 'ACCEPT' THEN 'CLOSED' WHEN last = 'QUARANTINE' THEN 'QUARANTINED' ELSE 'UNDER REVIEW' END AS status,
  coalesce(array_to_string(h, ','), '') AS history FROM (SELECT DISTINCT user_id AS case_id FROM events) LEFT JOIN k USING (case_id)
""")
def disposition_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = F.element_at(F.array(*map(F.lit, ("accept", "Review", "QUARANTINE", "other"))), (F.col("event_id") % 4).cast("int") + 1)
    decisions = e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), pick.alias("disposition"), F.col("event_type").alias("by"))
    opened = e.select(F.col("user_id").alias("case_id"), F.lit("none").alias("disposition"), F.lit("OPEN").alias("status"), F.array().cast("array<string>").alias("history")).distinct()
    return cases.set_dispositions(opened, decisions).withColumn("history", F.array_join("history", ","))


@query("""
WITH d AS (SELECT user_id AS case_id, event_id AS seq, upper(['accept', 'Review', 'QUARANTINE', 'other'][event_id % 4 + 1]) AS disposition, event_type AS actor FROM events)
SELECT seq, 'case.disposition_set' AS event_type, actor, 'case:' || case_id AS asset, '{"disposition":"' || disposition || '"}' AS details FROM d WHERE disposition <> 'OTHER'
""")
def disposition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log says of each decision that took effect."""
    e = table(spark, sf_dir, "events")
    pick = F.element_at(F.array(*map(F.lit, ("accept", "Review", "QUARANTINE", "other"))), (F.col("event_id") % 4).cast("int") + 1)
    return cases.disposition_events(e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), pick.alias("disposition"), F.col("event_type").alias("by")))


@query("""
SELECT event_id AS record_id, CASE WHEN event_id % 3 = 0 OR user_id % 10 >= 8 OR event_id % 7 = 0 THEN 'skipped' WHEN event_id % 11 = 0 THEN 'fail' ELSE 'pass' END AS "check" FROM events
""")
def reexecution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    recs = e.select(F.col("event_id").alias("record_id"), (F.col("event_id") % 3 != 0).alias("input_ok"), (F.col("user_id") % 10).cast("string").alias("model_sha256"), F.col("event_type").alias("label"))
    again = e.where("event_id % 7 <> 0").select(F.col("event_id").alias("record_id"), F.when(F.col("event_id") % 11 == 0, "changed").otherwise(F.col("event_type")).alias("label"))
    return cases.reexecution(recs, again, spark.range(8).select(F.col("id").cast("string").alias("sha256")))


@query("""
SELECT 'sample:' || doc_id AS src, 'batch:' || source AS dst, 'PART_OF' AS rel FROM documents WHERE source <> 'src3' UNION ALL
SELECT DISTINCT 'batch:' || source, 'contributor:' || (CASE WHEN substr(source, 4)::INTEGER < 10 THEN 'a' ELSE 'b' END), 'CONTRIBUTED_BY' FROM documents WHERE source <> 'src3'
""")
def provenance_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    who = F.when(F.substring("source", 4, 9).cast("int") < 10, "a").otherwise("b")
    return cases.provenance_edges(docs.select(F.col("doc_id").cast("string").alias("sample"), F.when(F.col("source") != "src3", F.col("source")).alias("batch"), who.alias("contributor")))


# Images and models --------------------------------------------------------------------------------------------------


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.vector_images(table(spark, sf_dir, "embeddings"))


@query()
def image_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of look-alike pictures of the embeddings."""
    return images.near_duplicate_components(materialize(_pictures(spark, sf_dir), "pictures"), 48, 48)


@query()
def image_recurring_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    return images.recurring_patches(_pictures(spark, sf_dir), 48, 48, max(8, n // 100))


@query()
def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, the eight statistics of each picture, its 16 regions' means and contrasts (deviations) row by row, its descriptor and that one's length."""
    made = _pictures(spark, sf_dir)
    stat, region, vector = (pixels.udf(k, 48, 48)("rgb") for k in (pixels.image_stats, pixels.region_stats, pixels.embed))
    got = made.select("id", stat.alias("s"), region.alias("r"), vector.alias("e"))
    regions = [F.round(F.col("r")[2 * i + k], 6).alias(f"{n}_{i}") for k, n in enumerate(("region", "region_contrast")) for i in range(pixels.GRID**2)]
    descriptor = [F.col("e").cast("array<float>").alias("descriptor"), F.round(F.sqrt(scalars.dot(F.col("e"), F.col("e"))), 4).alias("length")]
    return got.select("id", *[F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate(pixels.STATS)], *regions, *descriptor)


@query()
def model_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network fitted on the reference vectors (at most ``models.SAMPLE_ROWS``) against one fitted with another seed, over all vectors."""
    import numpy as np

    reference = models.fit_sample(table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0").select("vec_id", "embedding", "label"), "vec_id").toPandas().sort_values("vec_id")
    x, y = np.array(reference["embedding"].tolist(), dtype=float), reference["label"].to_numpy()
    one, two = (models.train_network(x, y, tuple(map(str, range(10))), seed=s) for s in (0, 1))
    df = table(spark, sf_dir, "embeddings")
    return models.behaviour(models.predictions(df, two, "vec_id", "embedding"), models.predictions(df, one, "vec_id", "embedding"))


# Time windows -------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.streaming.ingest import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("""
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, sid
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probity.streaming.ingest import sessions

    return sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY ALL")
def nonce_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First use of each nonce (here user and type), and how often it was used."""
    from probity.streaming.ingest import dedup_nonces

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.concat_ws("|", "user_id", "event_type").alias("nonce"))
    uses = e.groupBy("nonce").agg(F.count(F.lit(1)).alias("n"))
    return dedup_nonces(e, order="event_id").join(uses, "nonce").select("user_id", "event_type", "event_id", "n")


@query("""
WITH RECURSIVE e AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id AS record_id, event_id::VARCHAR || '|' || event_type AS body FROM events),
w AS (SELECT stream, seq, record_id, repeat('0', 64) AS prev_record_hash, sha256(repeat('0', 64) || body) AS record_hash FROM e WHERE seq = 1
  UNION ALL SELECT e.stream, e.seq, e.record_id, w.record_hash, sha256(w.record_hash || body) FROM w JOIN e ON e.stream = w.stream AND e.seq = w.seq + 1)
SELECT * FROM w
""")
def chained_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made from events, numbered and linked in their streams."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.col("user_id").alias("stream"), F.struct("ts", "event_id").alias("at"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("body"))
    return records.chain_records(e, None, "at").select("stream", "seq", "record_id", "prev_record_hash", "record_hash")


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (NOT ok) AS gaps, count(*) FILTER (role = before) AS repeats FROM (SELECT conv_id, role, lag(role) OVER w AS before, turn = lag(turn, 1, -1) OVER w + 1 AS ok FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY 1")
def conversation_turn_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"before": F.lag("role").over(w), "ok": F.col("turn") == F.lag("turn", 1, -1).over(w) + 1})
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum((~F.col("ok")).cast("long")).alias("gaps"), F.sum(F.coalesce(F.col("role") == F.col("before"), F.lit(False)).cast("long")).alias("repeats"))


from probity.plans import assurance, detectors, runs, selftest  # noqa: E402, F401  they register their queries
