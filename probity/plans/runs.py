"""Queries over runs: correlation, chains, cases, statuses, the evidence graph, projections, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity.functions import scalars
from probity.operators import cases, evidence, graph
from probity.plans.catalogue import query
from probity.sources.storage import materialize, table

_SEVERITIES = "['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']"
_RUN = f"""
f AS (SELECT event_id AS id, user_id AS run_id, event_id AS ord, ['dataset', 'model', 'inference', 'distribution', 'governance'][event_id % 5 + 1] AS pillar, {_SEVERITIES}[(event_id * 7) % 11 % 5 + 1] AS severity,
  (event_id * 7) % 11 % 5 AS rank, CASE WHEN event_id % 3 = 0 THEN 'REAL' ELSE 'HEURISTIC' END AS method_status, ((event_id % 90) + 10)::DOUBLE / 100 AS confidence,
  CASE WHEN event_id % 5 = 1 AND event_id % 3 = 0 THEN 'model.backdoor_behaviour' WHEN event_id % 5 = 2 AND event_id % 4 = 0 THEN 'inference.record_replacement' WHEN event_id % 5 = 2 AND event_id % 4 = 1 THEN 'inference.chain_broken'
    WHEN event_id % 5 = 2 AND event_id % 4 = 2 THEN 'inference.replay_blocked' WHEN event_id % 5 = 3 THEN ['distribution.localized_manipulation', 'distribution.environmental_drift', 'distribution.unattributed_shift'][event_id % 3 + 1] ELSE 'other' END AS category,
  CASE WHEN event_id % 5 = 0 THEN 'c' || event_id % 3 || '/b' || event_id % 31 END AS primary_source, CASE WHEN event_id % 5 = 0 THEN ['c' || event_id % 3 || '/b' || event_id % 31, 'c1/b' || event_id % 17] END AS sources,
  CASE WHEN event_id % 11 = 4 THEN event_id % 59 END AS tx, CASE WHEN event_id % 11 = 4 THEN event_id % 47 END AS ty,
  CASE WHEN event_id % 5 = 1 AND event_id % 3 = 0 THEN 'c' || event_id % 3 || '/b' || event_id % 29 END AS candidate_source, CASE WHEN event_id % 5 = 1 THEN ['b' || event_id % 37] END AS lineage_sources,
  CASE WHEN event_id % 5 = 1 THEN 'm' || event_id % 23 END AS model_digest, CASE WHEN event_id % 5 = 2 THEN ['m' || event_id % 19] END AS record_model_digests,
  CASE WHEN event_id % 5 = 2 THEN [event_id % 41, event_id % 43] END AS record_seqs, 'step ' || event_id % 9 AS recommendation FROM events)
"""
_LINKS = _RUN + """,
pr AS (SELECT x.run_id, x.id AS a, y.id AS b, x.ord AS oa, list_min(list_filter([
    CASE WHEN x.ord < y.ord AND x.pillar = 'dataset' AND y.pillar = 'dataset' AND x.primary_source = y.primary_source THEN 1 END,
    CASE WHEN x.ord < y.ord AND x.pillar <> y.pillar AND abs(x.tx - y.tx) <= 2 AND abs(x.ty - y.ty) <= 2 THEN 2 END,
    CASE WHEN x.category = 'model.backdoor_behaviour' AND list_contains(y.sources, x.candidate_source) THEN CASE WHEN x.ord < y.ord THEN 3 ELSE 5 END END,
    CASE WHEN x.pillar = 'model' AND list_has_any(x.lineage_sources, list_transform(y.sources, lambda s: split_part(s, '/', 2))) THEN CASE WHEN x.ord < y.ord THEN 4 ELSE 6 END END,
    CASE WHEN x.ord < y.ord AND x.pillar || y.pillar IN ('modelinference', 'inferencemodel') AND list_contains(coalesce(y.record_model_digests, x.record_model_digests), coalesce(x.model_digest, y.model_digest)) THEN 7 END,
    CASE WHEN x.category = 'inference.record_replacement' AND y.category = 'inference.chain_broken' AND list_has_any(list_transform(x.record_seqs, lambda s: s + 1), y.record_seqs) THEN 8 END], lambda p: p IS NOT NULL)) AS place
  FROM f x JOIN f y ON x.run_id = y.run_id AND x.id <> y.id),
st AS (SELECT * FROM pr WHERE place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, least(a, b), greatest(a, b) ORDER BY place, oa) = 1),
sl AS (SELECT run_id, a, b, CASE place WHEN 1 THEN 'R1-same-source' WHEN 2 THEN 'R2-same-trigger' WHEN 3 THEN 'R3-data-to-model' WHEN 5 THEN 'R3-data-to-model' WHEN 4 THEN 'R4-lineage' WHEN 6 THEN 'R4-lineage' WHEN 7 THEN 'R5-model-binding' ELSE 'R6-chain-successor' END AS rule, 'strong' AS strength FROM st),
re AS (SELECT run_id, id, ord, id IN (SELECT a FROM sl UNION SELECT b FROM sl) AS linked FROM f WHERE severity <> 'INFO'),
an AS (SELECT run_id, arg_min(id, ord) FILTER (linked) AS fl, list(id ORDER BY ord) AS ids FROM re GROUP BY 1),
lo AS (SELECT re.run_id, id AS a, CASE WHEN fl IS NOT NULL THEN fl WHEN id <> ids[1] THEN ids[1] ELSE ids[2] END AS b, ord FROM re JOIN an USING (run_id) WHERE NOT linked),
cx AS (SELECT run_id, a, b FROM lo WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, least(a, b), greatest(a, b) ORDER BY ord) = 1),
links AS (SELECT * FROM sl UNION ALL SELECT run_id, a, b, 'R0-same-pipeline', 'context' FROM cx)
"""
_CHAINS = _LINKS + """,
ed AS (SELECT a, b FROM sl UNION SELECT b, a FROM sl),
reach AS (SELECT a AS node, a AS other FROM ed UNION SELECT reach.node, ed.b FROM reach JOIN ed ON reach.other = ed.a),
cm AS (SELECT node, min(other) AS component FROM reach GROUP BY 1),
mb AS (SELECT f.*, coalesce(component, id) AS chain, component IS NOT NULL AS strong FROM f LEFT JOIN cm ON node = id),
gp AS (SELECT run_id, chain, count(*) AS al, min(ord) AS first, count(*) FILTER (rank > 0) AS size, list(DISTINCT pillar) FILTER (rank > 0) AS ps, max(rank) FILTER (rank > 0) AS r, bool_or(strong) AS strong FROM mb GROUP BY ALL),
nm AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY al DESC, first) AS n FROM gp),
ch AS (SELECT run_id, chain, 'CH-' || n AS chain_id, row_number() OVER (PARTITION BY run_id ORDER BY len(ps) DESC, r DESC, n)::INTEGER AS place, size, array_to_string(list_filter(['dataset', 'model', 'distribution', 'inference', 'governance'], lambda p: list_contains(ps, p)), ',') AS pillars,
  len(ps)::INTEGER AS n_pillars, r, strong FROM nm WHERE size > 0)
"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of many runs, one for each event, that the rules link in every way."""
    i = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    where = lambda m, r: i % m == r
    own = text("c", i % 3, "/b", i % 31)
    backdoor = where(5, 1) & where(3, 0)
    category = (
        F.when(backdoor, evidence.BACKDOOR).when(where(5, 2) & where(4, 0), evidence.REPLACED).when(where(5, 2) & where(4, 1), evidence.BROKEN)
        .when(where(5, 2) & where(4, 2), "inference.replay_blocked").when(where(5, 3), pick(evidence.SHIFT_STATUS, i % 3)).otherwise("other")
    )
    trigger = F.when(where(11, 4), F.struct((i % 59).cast("int").alias("x"), (i % 47).cast("int").alias("y")))
    return table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("user_id").alias("run_id"), i.alias("ord"), pick(("dataset", "model", "inference", "distribution", "governance"), i % 5).alias("pillar"),
        pick(scalars.SEVERITIES, (i * 7) % 11 % 5).alias("severity"), F.when(where(3, 0), "REAL").otherwise("HEURISTIC").alias("method_status"), ((i % 90 + 10).cast("double") / 100).alias("confidence"), category.alias("category"),
        F.when(where(5, 0), own).alias("primary_source"), F.when(where(5, 0), F.array(own, text("c1/b", i % 17))).alias("sources"), trigger.alias("trigger"),
        F.when(backdoor, text("c", i % 3, "/b", i % 29)).alias("candidate_source"), F.when(where(5, 1), F.array(text("b", i % 37))).alias("lineage_sources"), F.when(where(5, 1), text("m", i % 23)).alias("model_digest"),
        F.when(where(5, 2), F.array(text("m", i % 19))).alias("record_model_digests"), F.when(where(5, 2), F.array(i % 41, i % 43)).alias("record_seqs"), text("step ", i % 9).alias("recommendation"),
    )


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = _findings(spark, sf_dir)
    return found, materialize(evidence.correlate(found, ["run_id"]), "links")


@query("WITH " + _LINKS + "SELECT * FROM links")
def correlation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.correlate(_findings(spark, sf_dir), ["run_id"])


@query("WITH " + _LINKS + "SELECT rule, strength, count(*) AS n, count(DISTINCT run_id) AS runs FROM links GROUP BY ALL")
def links_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = _links(spark, sf_dir)
    return links.groupBy("rule", "strength").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("runs"))


@query("WITH RECURSIVE " + _CHAINS + f"SELECT run_id, chain, chain_id, place, size, pillars, n_pillars, {_SEVERITIES}[r + 1] AS max_severity, strong FROM ch")
def evidence_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.chains(*_links(spark, sf_dir), ["run_id"]).withColumn("pillars", F.array_join("pillars", ","))


@query("WITH RECURSIVE " + _CHAINS + f""",
cs AS (SELECT run_id, bool_or(strong AND n_pillars >= 3) AS wide, bool_or(strong AND n_pillars >= 2 AND r >= 3) AS multi FROM ch GROUP BY 1),
rk AS (SELECT run_id, round((1 - exp(sum(ln(CASE WHEN rank = 0 THEN 1.0::DOUBLE ELSE 1 - [0.05, 0.2, 0.45, 0.75, 0.95][rank + 1]::DOUBLE * confidence END))))::DECIMAL(18, 9), 3)::DOUBLE AS risk_score, max(rank) AS r,
  bool_or(rank >= 3 AND method_status = 'REAL') AS hard, bool_or(rank >= 3 AND pillar = 'model') AS model_high, count(*) FILTER (rank > 0) AS n_findings, count(*) FILTER (rank = 0) AS n_informational FROM f GROUP BY 1),
sp AS (SELECT run_id, recommendation, min([5 - rank, ord]) AS k FROM f WHERE rank > 0 GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY min([5 - rank, ord])) <= 8),
sj AS (SELECT run_id, string_agg(recommendation, '|' ORDER BY k) AS next_steps FROM sp GROUP BY 1)
SELECT run_id, {_SEVERITIES}[r + 1 + CASE WHEN wide AND r < 4 THEN 1 ELSE 0 END] AS severity, wide AND r < 4 AS escalated, risk_score, CASE WHEN hard OR model_high OR multi THEN 'QUARANTINE' ELSE 'REVIEW' END AS disposition,
  CASE WHEN hard OR model_high OR multi THEN 'QUARANTINE RECOMMENDED' ELSE 'REVIEW REQUIRED' END AS status, n_findings, n_informational, next_steps FROM rk JOIN cs USING (run_id) JOIN sj USING (run_id) WHERE r >= 2
""".replace("GROUP BY ALL QUALIFY", "GROUP BY run_id, recommendation QUALIFY"))
def run_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, links = _links(spark, sf_dir)
    chain_table = evidence.chains(found, links, ["run_id"])
    return evidence.case_of(found, chain_table, ["run_id"]).withColumn("next_steps", F.array_join("next_steps", "|"))


_STATUSES = "WITH " + _RUN + f""",
rn AS (SELECT user_id AS run_id, count(*) AS window_size FROM events GROUP BY 1 UNION ALL SELECT -1, 60),
p AS (SELECT run_id, pillar, count(*) AS findings, max(rank) AS r, bool_or(method_status = 'REAL' AND rank >= 3) AS hard, bool_or(category <> 'inference.replay_blocked') AS broken,
  min(list_position(['distribution.localized_manipulation', 'distribution.environmental_drift', 'distribution.unattributed_shift'], category)) AS shift FROM f WHERE rank > 0 GROUP BY ALL),
ev AS (SELECT run_id, window_size, unnest(['dataset', 'model', 'distribution', 'inference', 'governance']) AS pillar FROM rn),
st AS (SELECT ev.run_id, ev.pillar, coalesce(findings, 0) AS findings, {_SEVERITIES}[r + 1] AS max_severity, CASE ev.pillar WHEN 'dataset' THEN CASE WHEN hard OR r >= 4 THEN 'FAIL' WHEN r >= 2 THEN 'WARNING' ELSE 'PASS' END
  WHEN 'model' THEN CASE WHEN r >= 2 THEN 'REVIEW' ELSE 'PASS' END WHEN 'inference' THEN CASE WHEN broken THEN 'FAILED' WHEN findings > 0 THEN 'WARNING' ELSE 'PASS' END WHEN 'governance' THEN CASE WHEN findings > 0 THEN 'FAIL' ELSE 'PASS' END
  ELSE CASE WHEN window_size < 20 THEN 'INSUFFICIENT_DATA' ELSE coalesce(['SUSPICIOUS', 'DRIFT', 'INCONCLUSIVE'][shift], 'PASS') END END AS status FROM ev LEFT JOIN p ON p.run_id = ev.run_id AND p.pillar = ev.pillar)
"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of all runs, among them one (-1) without any finding."""
    windows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("window_size"))
    runs = windows.unionByName(spark.createDataFrame([(-1, 60)], "run_id long, window_size long"))
    return evidence.pillar_status(_findings(spark, sf_dir), ["run_id"], runs)


@query(_STATUSES + "SELECT * FROM st")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir)


@query(_STATUSES + "SELECT run_id, CASE WHEN bool_or(status IN ('FAIL', 'FAILED')) THEN 'UNTRUSTED' WHEN bool_and(status = 'PASS') THEN 'TRUSTED' ELSE 'REVIEW REQUIRED' END AS overall FROM st GROUP BY 1")
def run_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.overall(_statuses(spark, sf_dir), ["run_id"])


# Bounds, pages, projections ----------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT user_id AS stream, ts::DATE AS day, min(event_id) AS audit_seq_start, max(event_id) AS audit_seq_end FROM events GROUP BY ALL)
SELECT stream, 'RUN-' || lpad(row_number() OVER w::VARCHAR, 4, '0') AS run_id, audit_seq_start, audit_seq_end, coalesce(lag(audit_seq_end) OVER w, 0) AS since_seq FROM r WINDOW w AS (PARTITION BY stream ORDER BY day)
""")
def run_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stream"), F.col("ts").cast("date").alias("day")).agg(F.min("event_id").alias("audit_seq_start"), F.max("event_id").alias("audit_seq_end"))
    return cases.run_bounds(runs, "stream", "day").select("stream", "run_id", "audit_seq_start", "audit_seq_end", "since_seq")


@query("""
WITH p AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, count(*) OVER () AS n FROM part), s AS (SELECT unnest(range(0, 25)) AS i)
SELECT i, idx, p_partkey, p_name FROM s JOIN p ON idx = (n - 10 + i) % n
""")
def ring_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five frames from ten before the end on, going on at the start."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return cases.ring_page(parts, "p_partkey", parts.count() - 10, 25).select("i", "idx", "p_partkey", "p_name")


@query("""
SELECT o_orderkey AS id, 'CASE-' || CASE WHEN o_orderkey < 1000 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END AS case_id, o_orderpriority AS severity, o_orderstatus AS status, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 6
""")
def newest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's list: the six newest, projected."""
    top = table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(6)
    place = F.row_number().over(Window.orderBy(F.col("o_orderdate").desc(), "o_orderkey"))
    return top.select(F.col("o_orderkey").alias("id"), scalars.zero_pad("CASE-", F.col("o_orderkey"), 4).alias("case_id"), F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("status"), place.alias("place"))


_COVERAGE = """
WITH c AS (SELECT event_type AS capability, CASE WHEN event_id % 4 = 0 THEN 'unavailable' WHEN event_id % 9 = 1 THEN 'skipped' ELSE 'ran' END AS status, CASE WHEN event_id % 3 = 0 THEN 'REAL' ELSE 'HEURISTIC' END AS method_status FROM events)
"""


@query(_COVERAGE + "SELECT capability, status, count(*) AS n, count(*) FILTER (method_status = 'REAL') AS n_real FROM c GROUP BY ALL")
def capability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    c = table(spark, sf_dir, "events").select(F.col("event_type").alias("capability"), F.when(i % 4 == 0, "unavailable").when(i % 9 == 1, "skipped").otherwise("ran").alias("status"), F.when(i % 3 == 0, "REAL").otherwise("HEURISTIC").alias("method_status"))
    return cases.coverage(c, "capability")


@query("""
WITH f AS (SELECT user_id AS case_id, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'REAL' ELSE 'HEURISTIC' END AS method_status, ['a', 'b', 'c', 'd'][event_id % 4 + 1] AS category FROM events)
SELECT case_id, count(*) FILTER (method_status = 'REAL') AS known, count(*) FILTER (method_status <> 'REAL') AS suspected, array_to_string(list_sort(list(DISTINCT 'not ' || category) FILTER (category IN ('a', 'c'))), ', ') AS not_proven FROM f GROUP BY 1
""")
def case_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), i.alias("id"), F.when(i % 3 == 0, "REAL").otherwise("HEURISTIC").alias("method_status"), F.element_at(F.array(*map(F.lit, "abcd")), (i % 4 + 1).cast("int")).alias("category"))
    limits = spark.createDataFrame([("a", "not a"), ("c", "not c")], "category string, does_not_prove string")
    return cases.assessment(f, limits).withColumn("not_proven", F.array_join("not_proven", ", "))


# Scalars -----------------------------------------------------------------------------------------------------------


@query("""
SELECT event_id, left(sha256(event_type), 12) AS short, CASE WHEN length(props) > 6 THEN left(props, 6) || '…' ELSE props END AS cut, lpad(lower(to_hex(event_id)), 16, '0') AS hex16, 'F-' || CASE WHEN event_id < 100 THEN lpad(event_id::VARCHAR, 3, '0') ELSE event_id::VARCHAR END AS padded,
  strftime(ts, '%H:%M:%S') AS clock, replace(replace(replace(replace(replace('<' || event_type || '> & "x"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html, left(sha256(unhex(md5(event_type))), 16) AS key_id,
  upper(event_type) IN ('CLICK', 'VIEW') AS known, split_part(event_type || '/b1', '/', 2) AS part, event_id % 100 || '%' AS percent FROM events
""")
def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.prefix(F.sha2("event_type", 256), 12).alias("short"), scalars.ellipsis(F.col("props"), 6).alias("cut"), scalars.hex_pad(F.col("event_id")).alias("hex16"), scalars.zero_pad("F-", F.col("event_id"), 3).alias("padded"),
        scalars.clock(F.col("ts")).alias("clock"), scalars.html_escape(F.concat(F.lit("<"), "event_type", F.lit('> & "x"'))).alias("html"), scalars.key_id(F.md5("event_type")).alias("key_id"), scalars.one_of(F.col("event_type"), ("CLICK", "VIEW")).alias("known"),
        F.element_at(F.split(F.concat("event_type", F.lit("/b1")), "/"), -1).alias("part"), scalars.percent((F.col("event_id") % 100) / 100).alias("percent"),
    )


@query("""
SELECT event_id, printf('%.3f', value) AS fixed, printf('%.2e', value) AS scientific,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age
FROM (SELECT *, date_diff('second', ts, (SELECT max(ts) FROM events)) AS s FROM events)
""")
def scalar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as texts, and how long each event was before the last one."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last)).select("event_id", scalars.fixed(F.col("value")).alias("fixed"), scalars.scientific(F.col("value")).alias("scientific"), scalars.age(F.col("ts"), F.col("last")).alias("age"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT *, list_sum(list_transform(v, lambda x: x * x)) AS q, list_sum(list_transform(v, lambda x: exp(x))) AS e FROM v)
SELECT vec_id, round(v[1] / (sqrt(q) + 1e-6), 8) AS unit, round(exp(v[2]) / e, 8) AS soft, round((v[1] - v[2]) / (abs(v[2]) + 1e-6), 6) AS change, round(abs((v[3] - v[4]) / (0.5 + 0.001)), 8) AS z, round(1 - q, 8) AS cosine_distance FROM s
""")
def scalar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    at = lambda i: F.col("v")[i - 1]
    return e.select(
        "vec_id", F.round(scalars.normalized(F.col("v"))[0], 8).alias("unit"), F.round(scalars.softmax(F.col("v"))[1], 8).alias("soft"), F.round(scalars.relative_change(at(1), at(2)), 6).alias("change"),
        F.round(scalars.z_score(at(3), at(4), F.lit(0.5)), 8).alias("z"), F.round(1 - scalars.dot(F.col("v"), F.col("v")), 8).alias("cosine_distance"),
    )


# The evidence graph ------------------------------------------------------------------------------------------------

_GRAPH = """
sm AS (SELECT doc_id AS sample, lang || doc_id % 7 AS batch, CASE WHEN doc_id % 11 <> 0 THEN source END AS contributor FROM documents),
md AS (SELECT 'v' || s_suppkey AS model_id, 'd' || s_suppkey AS sha256, CASE WHEN s_suppkey > 1 THEN 'v' || (s_suppkey - 1) END AS previous_version, ['extra' || s_suppkey % 4] AS new_sources FROM supplier),
iv AS (SELECT event_id AS record_id, CASE WHEN event_id % 3 = 0 THEN 'd' || event_id % 20 ELSE 'unknown-digest' END AS model_sha256 FROM events WHERE event_type = 'error'),
fi AS (SELECT event_id AS id, user_id AS case_id, ['inference:' || event_id, 'batch:en' || event_id % 9, 'sample:' || event_id % 300, 'planet:mars'] AS affected FROM events WHERE event_type = 'error'),
ev AS (SELECT event_id * 2 AS id, event_id AS finding_id, list_transform(range(0, 12), lambda j: 'sample:' || (event_id + j) % 400) AS assets FROM events WHERE event_type = 'error'),
li AS (SELECT a.id AS a, b.id AS b FROM fi a JOIN fi b ON a.case_id = b.case_id AND b.id > a.id AND b.id - a.id < 200),
sc AS (SELECT s_suppkey AS id, ['batch:en1', 'model:v' || s_suppkey] AS touched FROM supplier),
sr AS (SELECT * FROM sm WHERE contributor IS NOT NULL),
af AS (SELECT id, unnest(affected) AS asset FROM fi), sh AS (SELECT id, unnest(assets[1:8]) AS asset FROM ev), tc AS (SELECT id, unnest(touched) AS asset FROM sc),
ob AS (SELECT DISTINCT 'sample:' || sample AS asset, 'batch:' || batch AS batch FROM sr),
nd0 AS (SELECT unnest(['assurance:core', 'dataset:contributed-dataset', 'stream:cam-01', 'window:current', 'modelver:unknown-dige']) AS id UNION SELECT 'contributor:' || contributor FROM sr UNION SELECT 'batch:' || batch FROM sr UNION SELECT 'model:' || model_id FROM md
  UNION SELECT 'batch:' || new_sources[1] FROM md UNION SELECT 'inference:' || record_id FROM iv UNION SELECT 'finding:' || id FROM fi UNION SELECT 'evidence:' || id FROM ev UNION SELECT 'case:' || case_id FROM fi UNION SELECT 'scenario:' || id FROM sc
  UNION SELECT asset FROM af WHERE asset NOT LIKE 'planet:%' UNION SELECT asset FROM sh UNION SELECT asset FROM tc),
nd AS (SELECT id, CASE split_part(id, ':', 1) WHEN 'assurance' THEN 'AssuranceCore' WHEN 'dataset' THEN 'Dataset' WHEN 'contributor' THEN 'Contributor' WHEN 'batch' THEN 'Batch' WHEN 'sample' THEN 'Sample' WHEN 'model' THEN 'Model' WHEN 'modelver' THEN 'ModelVersion'
  WHEN 'stream' THEN 'Stream' WHEN 'window' THEN 'ObservationWindow' WHEN 'inference' THEN 'InferenceRecord' WHEN 'finding' THEN 'Finding' WHEN 'evidence' THEN 'Evidence' WHEN 'case' THEN 'Case' ELSE 'AttackScenario' END AS type, substring(id, length(split_part(id, ':', 1)) + 2) AS label FROM nd0),
ed0 AS (SELECT 'dataset:contributed-dataset' AS src, 'assurance:core' AS dst, 'verified_by' AS rel UNION SELECT 'stream:cam-01', 'assurance:core', 'verified_by' UNION SELECT 'window:current', 'stream:cam-01', 'belongs_to'
  UNION SELECT 'batch:' || batch, 'contributor:' || contributor, 'contributed_by' FROM sr UNION SELECT 'batch:' || batch, 'dataset:contributed-dataset', 'belongs_to' FROM sr
  UNION SELECT 'model:' || model_id, 'assurance:core', 'verified_by' FROM md UNION SELECT 'model:' || model_id, 'model:' || previous_version, 'derived_from' FROM md UNION SELECT 'model:' || model_id, 'dataset:contributed-dataset', 'derived_from' FROM md
  UNION SELECT 'model:' || model_id, 'batch:' || new_sources[1], 'derived_from' FROM md UNION SELECT 'modelver:unknown-dige', 'assurance:core', 'verified_by' UNION SELECT 'stream:cam-01', 'modelver:unknown-dige', 'produced_by'
  UNION SELECT 'inference:' || record_id, 'stream:cam-01', 'belongs_to' FROM iv UNION SELECT 'inference:' || record_id, coalesce('model:' || model_id, CASE WHEN model_sha256 = 'unknown-digest' THEN 'modelver:unknown-dige' END), 'produced_by' FROM iv LEFT JOIN md ON sha256 = model_sha256
  UNION SELECT 'finding:' || id, asset, 'affects' FROM af UNION SELECT asset, 'stream:cam-01', 'belongs_to' FROM af WHERE asset LIKE 'inference:%' UNION SELECT asset, 'finding:' || id, 'violates' FROM af WHERE asset LIKE 'inference:%'
  UNION SELECT asset, batch, 'belongs_to' FROM (SELECT asset FROM af UNION SELECT asset FROM sh) JOIN ob USING (asset) UNION SELECT 'finding:' || finding_id, 'evidence:' || id, 'verified_by' FROM ev UNION SELECT 'evidence:' || id, asset, 'derived_from' FROM sh
  UNION SELECT 'finding:' || a, 'finding:' || b, 'correlates_with' FROM li UNION SELECT 'scenario:' || id, asset, 'affects' FROM tc UNION SELECT 'finding:' || id, 'case:' || case_id, 'belongs_to' FROM fi),
ed AS (SELECT * FROM ed0 WHERE src IN (SELECT id FROM nd) AND dst IN (SELECT id FROM nd) AND src <> dst)
"""
#: The same with all assets of a piece of evidence.
_WHOLE_GRAPH = _GRAPH.replace("unnest(assets[1:8])", "unnest(assets)")


def _graph(spark: SparkSession, sf_dir: str, drawn: int | None = graph.DRAWN) -> tuple[DataFrame, DataFrame]:
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    d, s, i = F.col("doc_id"), F.col("s_suppkey"), F.col("event_id")
    samples = table(spark, sf_dir, "documents").select(d.alias("sample"), text(F.col("lang"), d % 7).alias("batch"), F.when(d % 11 != 0, F.col("source")).alias("contributor"))
    suppliers = table(spark, sf_dir, "supplier")
    models = suppliers.select(text("v", s).alias("model_id"), text("d", s).alias("sha256"), F.when(s > 1, text("v", s - 1)).alias("previous_version"), F.array(text("extra", s % 4)).alias("new_sources"))
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    invalid = errors.select(i.alias("record_id"), F.when(i % 3 == 0, text("d", i % 20)).otherwise("unknown-digest").alias("model_sha256"))
    findings = errors.select(i.alias("id"), F.col("user_id").alias("case_id"), F.array(text("inference:", i), text("batch:en", i % 9), text("sample:", i % 300), F.lit("planet:mars")).alias("affected"))
    evidence_rows = errors.select((i * 2).alias("id"), i.alias("finding_id"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.concat(F.lit("sample:"), ((i + j) % 400).cast("string"))).alias("assets"))
    near = findings.select("case_id", F.col("id").alias("a"), F.explode(F.array(F.floor(F.col("id") / 200), F.floor(F.col("id") / 200) + 1)).alias("k"))
    links = near.join(findings.select("case_id", F.col("id").alias("b"), F.floor(F.col("id") / 200).alias("k")), ["case_id", "k"]).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") < 200)).select("a", "b")
    scenarios = suppliers.select(s.alias("id"), F.array(F.lit("batch:en1"), text("model:v", s)).alias("touched"))
    return graph.build(samples, models, spark.createDataFrame([("unknown-digest",)], "sha256 string"), invalid, findings, evidence_rows, links, scenarios, drawn=drawn)


@query("WITH " + _WHOLE_GRAPH + "SELECT * FROM ed")
def evidence_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of the graph: a piece of evidence is tied to all its assets."""
    return _graph(spark, sf_dir, drawn=None)[1]


@query("WITH " + _GRAPH + "SELECT * FROM nd")
def evidence_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


@query("WITH " + _GRAPH + "SELECT rel, count(*) AS n FROM ed WHERE src NOT LIKE 'sample:%' AND dst NOT LIKE 'sample:%' GROUP BY 1")
def graph_without_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph.without_kind(nodes, edges).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
