"""The assurance run: all thirteen detectors on the given tables, their findings with evidence, and what follows from them.

The registry are the suppliers' models, of which number 5 is served with a digest that is nobody's; the records of events are bound to digests
too. The current window are the latest contributed vectors, taken as frames of sixteen regions, a third of them stamped in one region.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.operators import assurance as run
from probity.operators import findings, models, records, samples, shift, vectors
from probity.plans import catalogue, detectors, runs
from probity.plans.catalogue import _KS, _KS_P, query
from probity.sources.storage import materialize, table

#: The place of a passage among the slots of a text and that of a region, on a grid of four columns.
COLUMNS, REGIONS = 4, 16
_NODE, _DIGEST = "modelver:m7", "m7"


def _place(n: F.Column) -> F.Column:
    return F.struct((n % COLUMNS).cast("int").alias("x"), F.floor(n / COLUMNS).cast("int").alias("y"))


# The window --------------------------------------------------------------------------------------------------------

#: Values of the sixteen regions (mean magnitude of four dimensions) and of the whole frame, of the reference and of the current window.
_FRAMES = f"""
cw AS (SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0 ORDER BY vec_id DESC LIMIT 60),
em AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, vec_id IN (SELECT vec_id FROM cw) AS cur FROM embeddings WHERE vec_id % 4 = 0 OR vec_id IN (SELECT vec_id FROM cw)),
rg AS (SELECT vec_id, cur, k AS region, CASE WHEN cur AND vec_id % 3 = 0 AND k = 5 THEN 0.6::DOUBLE ELSE round((abs(e[4 * k + 1]) + abs(e[4 * k + 2]) + abs(e[4 * k + 3]) + abs(e[4 * k + 4])) / 4, 9) END AS v FROM em, (SELECT unnest(range(0, {REGIONS})) AS k)),
gl AS (SELECT vec_id, cur, round(list_sum(e) / 64, 9) AS g FROM em),
rm AS (SELECT region, avg(v) AS mu, stddev_pop(v) + 0.001 AS sd FROM rg WHERE NOT cur GROUP BY 1),
gm AS (SELECT avg(g) AS mu, stddev_pop(g) + 0.000001 AS sd FROM gl WHERE NOT cur),
fz AS (SELECT vec_id, region, round(abs(v - mu) / sd, 6) AS z FROM rg JOIN rm USING (region) WHERE cur),
gz AS (SELECT vec_id, round(abs(g - mu) / sd, 6) AS z FROM gl, gm WHERE cur),
lf AS (SELECT vec_id, arg_min(region, (-z, region)) AS region FROM fz GROUP BY 1 HAVING max(z) > 5 AND count(*) FILTER (z > 3) <= 3 AND any_value(vec_id) IN (SELECT vec_id FROM gz WHERE z < 3)),
tr AS (SELECT region, count(*) AS n FROM lf GROUP BY 1 ORDER BY n DESC, region LIMIT 1),
x AS (SELECT 'r' || region AS feature, v, cur FROM rg),""" + _KS + f""",
wt AS (SELECT count(*) FILTER (least(1.0::DOUBLE, {REGIONS} * {_KS_P}) < 0.01) AS shifted FROM l),
bd AS (SELECT feature, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM x WHERE NOT cur GROUP BY 1),
dr AS (SELECT max(f) AS driver_fraction FROM (SELECT feature, avg(CASE WHEN v < lo OR v > hi THEN 1.0::DOUBLE ELSE 0 END) AS f FROM x JOIN bd USING (feature) WHERE cur GROUP BY 1)),
wn AS (SELECT (SELECT count(*) FROM cw) AS n, (SELECT shifted > 0 FROM wt) AS shifted, (SELECT driver_fraction FROM dr) AS driver_fraction, (SELECT n FROM tr) AS top_region_count, (SELECT region FROM tr) AS region),
ws AS (SELECT *, CASE WHEN n < 20 THEN 'INSUFFICIENT_DATA' WHEN coalesce(top_region_count, 0) >= greatest(4, 0.08 * n) THEN 'SUSPICIOUS' WHEN shifted AND driver_fraction >= 0.5 THEN 'DRIFT' WHEN shifted THEN 'INCONCLUSIVE' ELSE 'PASS' END AS status FROM wn)
"""


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """id, cur, region, v and id, cur, g of the reference and of the current window: values of regions, and of whole frames."""
    e = table(spark, sf_dir, "embeddings")
    latest = e.where("vec_id % 4 <> 0").orderBy(F.col("vec_id").desc()).limit(vectors.WINDOW).select("vec_id", F.lit(True).alias("cur"))
    both = e.where("vec_id % 4 = 0").withColumn("cur", F.lit(False)).unionByName(e.join(F.broadcast(latest), "vec_id"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    named = both.select(F.col("vec_id").alias("id"), "cur", v.alias("e"))
    stamped = F.col("cur") & (F.col("id") % 3 == 0)
    value = lambda k: sum((F.abs(F.col("e")[4 * k + j]) for j in range(1, 4)), F.abs(F.col("e")[4 * k])) / 4
    each = F.array(*[F.struct(F.lit(k).alias("region"), (F.when(stamped, F.lit(0.6)) if k == 5 else F.when(F.lit(False), F.lit(0.0))).otherwise(F.round(value(k), 9)).alias("v")) for k in range(REGIONS)])
    regions = named.select("id", "cur", F.inline(each))
    whole = named.select("id", "cur", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / 64, 9).alias("g"))
    return materialize(regions, "regions"), materialize(whole, "frames")


def _window(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One row: n, shifted, driver_fraction, patches, top_region_count, region, status; and the local frames of that region (frame)."""
    regions, whole = _frames(spark, sf_dir)
    local = shift.local_frames(*shift.frame_scores(regions, whole))
    local = materialize(local, "local")
    top = local.groupBy("region").agg(F.count(F.lit(1)).alias("top_region_count")).agg(F.max_by(F.struct("region", "top_region_count"), F.struct("top_region_count", (-F.col("region")).alias("r"))).alias("t"))
    long = regions.select(F.lit("current").alias("win"), F.concat(F.lit("r"), "region").alias("feature"), "v", "cur")
    tested = shift.window_shift(long, ["win"]).join(F.broadcast(top.select(F.col("t.region").alias("region"), F.col("t.top_region_count").alias("top_region_count"))))
    marked = materialize(shift.attribution(tested.withColumns({"patches": F.lit(0), "top_region_count": F.coalesce("top_region_count", F.lit(0))})), "window")
    return marked, local.join(F.broadcast(marked.select("region")), "region").select("frame")


@query("WITH " + _FRAMES + "SELECT n, shifted, round(driver_fraction, 9) AS driver_fraction, region, coalesce(top_region_count, 0) AS top_region_count, status FROM ws")
def window_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current window's tests, the region in which most of its local frames differ, and what follows."""
    window, _ = _window(spark, sf_dir)
    return window.select("n", "shifted", F.round("driver_fraction", 9).alias("driver_fraction"), F.col("region").cast("long").alias("region"), F.col("top_region_count").cast("long").alias("top_region_count"), "status")


# The detectors -----------------------------------------------------------------------------------------------------


def _detect(spark: SparkSession, sf_dir: str) -> tuple[dict[str, run.Detector], DataFrame]:
    """All thirteen detectors, each with its evidence, and the verdicts of all records; what several of them need is written once."""
    docs = table(spark, sf_dir, "documents")
    source = F.concat(F.lit("c"), F.col("query_id") % 3, F.lit("/b"), F.col("query_id") % 12)
    out: dict[str, run.Detector] = {}

    manifest = findings.manifest_finding(materialize(catalogue.manifest_diff(spark, sf_dir), "manifest"))
    out["manifest"] = run.Detector(run.part(manifest), [])

    clusters = materialize(detectors._clusters(spark, sf_dir), "clusters")
    about = docs.select(F.col("doc_id").alias("id"), "source")
    copies = findings.duplicates(about, clusters, samples.duplicate_groups(docs, "doc_id", F.col("text")))
    members = about.join(clusters.select(F.col("node").alias("id")), "id")
    out["duplicates"] = run.Detector(run.part(copies), [run.rows(members, "source", F.col("source"))])

    contributed, reference = catalogue._split(spark, sf_dir)
    near = materialize(vectors.knn(contributed, reference, vectors.K_LABEL), "near")
    own = materialize(vectors.knn(reference, reference, vectors.K_LABEL, exclude_self=True), "own")

    def per_source(share: float, flip: bool) -> tuple[DataFrame, DataFrame]:
        votes = []
        for found, asked in ((near, contributed), (own, reference)):
            v = vectors.label_vote(found, reference, asked, share=share)
            votes.append(materialize(detectors.flipped(v) if flip else v, "votes"))
        named = votes[0].select("query_id", source.alias("source"))
        baseline = votes[1].agg(F.greatest(F.lit(samples.BASELINE_FLOOR), F.avg(F.col("flagged").cast("double"))).alias("baseline"))
        return materialize(findings.source_labels(votes[0], named, baseline), "sources"), votes[0].join(named, "query_id")

    flips, _ = per_source(0.0, True)
    concentrated = flips.where("concentrated")
    out["labels"] = run.Detector(run.part(findings.label_consistency(flips), F.col("primary_source")), [run.rows(concentrated, "source", F.col("source"), F.col("source"))])
    plain, votes = per_source(detectors.ASKED_SHARE, False)
    alone = votes.where("flagged").join(plain.where(~F.col("concentrated")).select("source"), "source")
    out["isolated"] = run.Detector(run.part(findings.isolated_labels(plain)), [run.rows(alone, "source", F.col("source"))])

    measured, limits_of = detectors.measured(spark, sf_dir, near, own)
    limits = findings.calibration(limits_of, spark.createDataFrame([(0.01,)], "baseline double"), detectors.ASKED_LIMIT, 1.0, 1.0)
    marked = materialize(findings.out_of_distribution(measured, limits), "ood")
    out["ood"] = run.Detector(run.part(findings.ood_finding(marked)), [run.rows(marked.where("ood"), "source", F.col("source"))])

    held = detectors._pattern_members(spark, sf_dir, clusters)
    patterns = materialize(findings.pattern_findings(held, ["position", "passage"]), "patterns")
    spot = F.concat_ws("|", "position", "passage")
    out["pattern"] = run.Detector(run.part(patterns, spot, _place(F.col("position"))), [run.rows(held, "source", F.col("source"), spot)])

    suppliers, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    registry = suppliers.select(F.concat(F.lit("model-"), k).alias("model"), F.concat(F.when(k == 7, "x").otherwise("m"), k).alias("sha256"), F.lit(True).alias("signature_ok"), F.concat(F.lit("b"), k % 12).alias("batch"))
    served = spark.createDataFrame([("model-5", _DIGEST)], "model string, sha256 string")
    lineage = served.join(registry.select("model", "batch"), "model")
    digest = F.lit(_DIGEST)
    out["registry"] = run.Detector(run.part(findings.registry_findings(served, registry), F.col("model"), model=digest), [run.rows(lineage, "lineage", F.col("batch"), F.col("model"))])
    out["behaviour"] = run.Detector(run.part(detectors.behaviour_finding(spark, sf_dir), model=digest), [run.rows(lineage, "lineage", F.col("batch"))])

    # The pattern that most samples hold is the candidate that the model is tested with.
    candidate = patterns.agg(F.max_by(F.struct(F.col("primary_source").alias("candidate_source"), "position"), F.struct("members", (-F.col("position")).alias("p"), "passage")).alias("c")).select("c.*")
    clean, stamped, neutral = detectors._predicted(spark, sf_dir)
    rate = models.flip_rates(clean, stamped, ["pattern"])
    hits = models.trigger_hits(rate, models.flips_to(clean, neutral, ["pattern"], rate), ["pattern"])
    best = hits.orderBy(F.col("flip").desc(), "pattern").limit(1).join(F.broadcast(clean.agg(F.count(F.lit(1)).alias("n")))).join(F.broadcast(candidate))
    best = materialize(best, "best")
    tested = findings.trigger_finding(best).join(F.broadcast(best.select("candidate_source", "position")))
    out["trigger"] = run.Detector(run.part(tested, "", F.when(F.col("position").isNotNull(), _place(F.col("position"))), F.col("candidate_source"), digest), [run.rows(lineage, "lineage", F.col("batch"))])

    # Only what a verdict is made of is dealt and written; a record's verdict is one row.
    verdicts = materialize(records.failures_of(detectors._verified(spark, sf_dir), "model_sha256", "nonce_ok"), "verdicts")
    invalid = verdicts.where("verdict = 'INVALID'")
    key = F.col("primary_category")
    numbers, ids = findings.record_numbers(verdicts), invalid.select("primary_category", "record_id").distinct()
    about_records = [run.rows(numbers, "seq", F.col("stream"), key, F.col("seq"), once=True), run.rows(invalid, "digest", F.col("model_sha256"), key), run.rows(ids, "affected", F.concat(F.lit("inference:"), "record_id"), key, once=True)]
    out["records"] = run.Detector(run.part(findings.record_findings(verdicts), key), about_records)
    log = verdicts.select("record_id", F.col("nonce_ok").alias("accepted"))
    out["rejected"] = run.Detector(run.part(findings.rejected_finding(log)), [])

    window, local = _window(spark, sf_dir)
    spots = patterns.select(_place(F.col("position")).alias("t")).distinct()
    place = window.select("region", _place(F.col("region")).alias("w"))
    meets = (F.abs(F.col("t.x") - F.col("w.x")) <= 2) & (F.abs(F.col("t.y") - F.col("w.y")) <= 2)
    matched = spots.join(F.broadcast(place), meets).agg((F.count(F.lit(1)) > 0).alias("matched"))
    shown = window.join(F.broadcast(matched)).withColumn("members", F.when(F.col("status") == "SUSPICIOUS", F.col("top_region_count").cast("long")).otherwise(F.col("n")))
    shifted = findings.shift_findings(shown.select("status", "driver_fraction", "matched", "members", "region"))
    local_place = F.when(F.col("category") == "distribution.localized_manipulation", _place(F.col("region")))
    out["shift"] = run.Detector(run.part(shifted, "", local_place), [run.rows(local.join(F.broadcast(window.where("status = 'SUSPICIOUS'").select(F.lit(1)))), "affected", F.concat(F.lit("inference:frame-"), "frame"))])
    out["audit"] = run.Detector(run.part(findings.audit_finding(detectors.audit_report(spark, sf_dir))), [])
    return out, verdicts


_STEPS = "CASE category " + " ".join(f"WHEN '{c}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for c, t in run.STEPS.items()) + " END"


def _rest(sql: str, start: str = "SELECT 'dataset' AS pillar") -> str:
    """A detector's SQL without its last SELECT."""
    return sql[: sql.rindex(start)].rstrip().removesuffix(",")


_SHAPE = "pillar, category, severity, confidence, method_status, primary_source, members"
_REGISTRY = """
g AS (SELECT 'model-' || s_suppkey AS model, CASE WHEN s_suppkey = 7 THEN 'x' ELSE 'm' END || s_suppkey AS sha256, 'b' || s_suppkey % 12 AS batch FROM supplier)
SELECT 'model' AS pillar, 'model.substitution' AS category, CASE WHEN 'm7' IN (SELECT sha256 FROM g) THEN 'HIGH' ELSE 'CRITICAL' END AS severity, 1.0::DOUBLE AS confidence, 'REAL' AS method_status, NULL::VARCHAR AS primary_source, 1::BIGINT AS members, model AS key, batch FROM g WHERE model = 'model-5' AND sha256 <> 'm7'"""
_RECORDS_OF = detectors._CHECKED + """,
fl AS (SELECT record_id, stream, seq, list(DISTINCT category) FILTER (status = 'fail') AS cats FROM cr GROUP BY ALL),
vd AS (SELECT record_id, stream, seq, list_filter(['FORGED_RECORD', 'TAMPERED_OUTPUT', 'TAMPERED_RECORD', 'TAMPERED_CONFIG', 'REPLAY', 'MODEL_MISMATCH', 'INPUT_MISMATCH', 'REEXEC_MISMATCH', 'CHAIN_BROKEN'], lambda x: list_contains(cats, x))[1] AS primary_category FROM fl)
"""
_NAMED = "CASE primary_category " + " ".join(f"WHEN '{c}' THEN '{{{i}}}'" for i, c in enumerate(findings.RECORD_FINDINGS)) + " END"
_BEST = detectors._PREDICTED + """,
hb AS (SELECT pattern, flip, control FROM bt JOIN ct USING (pattern) ORDER BY flip DESC, pattern LIMIT 1)
SELECT flip, control, (SELECT count(*) FROM events) AS n FROM hb WHERE flip >= 0.5 AND flip - control >= 0.3"""

#: Findings of all detectors (part, key and what correlation needs), and their evidence.
_FOUND = "WITH RECURSIVE " + f"""
mn AS ({detectors._MANIFEST}), du AS ({detectors._DUPLICATES}), lb AS ({detectors._FLIPPED + detectors._LABEL_ROWS}), il AS ({detectors._LABELS + detectors._ISOLATED_ROW}), oo AS ({detectors._OOD + detectors._OOD_ROW}),
pt AS ({detectors._PATTERNS}), rgs AS (WITH {_REGISTRY}), bh AS ({catalogue.ORACLES["behaviour_finding"] if "behaviour_finding" in catalogue.ORACLES else ""}), bs AS ({_BEST}), vds AS ({_RECORDS_OF} SELECT * FROM vd WHERE primary_category IS NOT NULL), nk AS ({detectors._CHECKED} SELECT count(*) AS n FROM c WHERE NOT nonce_ok), win AS (WITH {_FRAMES} SELECT * FROM ws), frm AS (WITH {_FRAMES} SELECT lf.vec_id FROM lf JOIN ws USING (region) WHERE status = 'SUSPICIOUS'),
aud AS ({detectors._AUDIT}),
cand AS (SELECT primary_source AS candidate_source, position FROM pt ORDER BY members DESC, position, passage DESC LIMIT 1),
mt AS (SELECT count(*) > 0 AS matched FROM pt, win WHERE abs(position % 4 - region % 4) <= 2 AND abs(position // 4 - region // 4) <= 2),
u AS (
SELECT 0 AS part, '' AS key, {_SHAPE}, NULL::INTEGER AS tx, NULL::INTEGER AS ty, NULL::VARCHAR AS candidate_source, NULL::VARCHAR AS model_digest FROM mn
UNION ALL SELECT 1, '', {_SHAPE}, NULL, NULL, NULL, NULL FROM du
UNION ALL SELECT 2, primary_source, {_SHAPE}, NULL, NULL, NULL, NULL FROM lb
UNION ALL SELECT 3, '', {_SHAPE}, NULL, NULL, NULL, NULL FROM il
UNION ALL SELECT 4, '', {_SHAPE}, NULL, NULL, NULL, NULL FROM oo
UNION ALL SELECT 5, position || '|' || passage, {_SHAPE}, (position % 4)::INTEGER, (position // 4)::INTEGER, NULL, NULL FROM pt
UNION ALL SELECT 6, key, {_SHAPE}, NULL, NULL, NULL, 'm7' FROM rgs
UNION ALL SELECT 7, '', {_SHAPE}, NULL, NULL, NULL, 'm7' FROM bh
UNION ALL SELECT 8, '', 'model', 'model.backdoor_behaviour', CASE WHEN flip >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END, round(round(least(0.9::DOUBLE, flip - control), 9), 2), 'HEURISTIC', candidate_source, n, (position % 4)::INTEGER, (position // 4)::INTEGER, candidate_source, 'm7' FROM bs, (SELECT any_value(candidate_source) AS candidate_source, any_value(position) AS position FROM cand)
UNION ALL SELECT 9, primary_category, 'inference', {_NAMED.format(*[c for c, _ in findings.RECORD_FINDINGS.values()])}, {_NAMED.format(*[s for _, s in findings.RECORD_FINDINGS.values()])}, 1.0, 'REAL', NULL, count(*), NULL, NULL, NULL, NULL FROM vds GROUP BY primary_category
UNION ALL SELECT 10, '', 'inference', 'inference.replay_blocked', 'MEDIUM', 1.0, 'REAL', NULL, n, NULL, NULL, NULL, NULL FROM nk WHERE n > 0
UNION ALL SELECT 11, '', 'distribution', CASE status WHEN 'SUSPICIOUS' THEN 'distribution.localized_manipulation' WHEN 'DRIFT' THEN 'distribution.environmental_drift' ELSE 'distribution.unattributed_shift' END, CASE WHEN status = 'SUSPICIOUS' AND matched THEN 'HIGH' ELSE 'MEDIUM' END,
  round(round(CASE WHEN status = 'SUSPICIOUS' THEN CASE WHEN matched THEN 0.8::DOUBLE ELSE 0.5 END WHEN status = 'DRIFT' THEN least(0.9::DOUBLE, 0.5 + 0.4 * driver_fraction) ELSE 0.5 END, 9), 2), 'HEURISTIC', NULL, CASE WHEN status = 'SUSPICIOUS' THEN top_region_count ELSE n END,
  CASE WHEN status = 'SUSPICIOUS' THEN region % 4 END, CASE WHEN status = 'SUSPICIOUS' THEN region // 4 END, NULL, NULL FROM win, mt WHERE status IN ('SUSPICIOUS', 'DRIFT', 'INCONCLUSIVE')
UNION ALL SELECT 12, '', 'governance', 'governance.audit_tampering', 'CRITICAL', 1.0, 'REAL', NULL, n_problems, NULL, NULL, NULL, NULL FROM aud WHERE NOT valid),
o AS (SELECT *, row_number() OVER (ORDER BY part, severity DESC, category, primary_source NULLS FIRST, members DESC, key) AS ord FROM u),
fo AS (SELECT 'F-' || CASE WHEN ord < 1000 THEN lpad(ord::VARCHAR, 3, '0') ELSE ord::VARCHAR END AS id, 1::BIGINT AS run_id, list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) - 1 AS rank, * , {_STEPS} AS recommendation FROM o),
ke AS (
SELECT 1 AS part, '' AS key, 'source' AS kind, source AS value, NULL::BIGINT AS num FROM ({_rest(detectors._DUPLICATES)} SELECT source FROM h JOIN clusters ON node = doc_id)
UNION SELECT 2, source, 'source', source, NULL FROM ({_rest(detectors._FLIPPED + detectors._LABEL_ROWS)} SELECT source FROM per WHERE concentrated)
UNION SELECT 3, '', 'source', source, NULL FROM ({_rest(detectors._LABELS + detectors._ISOLATED_ROW)} SELECT s.source FROM s JOIN per USING (source) WHERE flagged AND NOT concentrated)
UNION SELECT 4, '', 'source', source, NULL FROM ({detectors._OOD} SELECT source FROM mk WHERE ood)
UNION SELECT 5, position || '|' || passage, 'source', source, NULL FROM ({_rest(detectors._PATTERNS)} SELECT position, passage, source FROM kp)
UNION SELECT p.part, CASE WHEN p.part = 6 THEN 'model-5' ELSE '' END, 'lineage', batch, NULL FROM (SELECT 'b' || 5 % 12 AS batch), (SELECT unnest([6, 7, 8]) AS part) p
UNION SELECT 9, primary_category, 'seq', stream::VARCHAR, seq FROM vds UNION SELECT 9, primary_category, 'digest', 'm' || record_id % 9, NULL FROM vds UNION SELECT 9, primary_category, 'affected', 'inference:' || record_id, NULL FROM vds
UNION SELECT 11, '', 'affected', 'inference:frame-' || vec_id, NULL FROM frm),
er AS (SELECT id, kind, value, num FROM ke JOIN fo USING (part, key)
UNION ALL SELECT id, 'affected', unnest(CASE WHEN pillar = 'dataset' AND primary_source LIKE '%/%' THEN ['contributor:' || split_part(primary_source, '/', 1), 'batch:' || split_part(primary_source, '/', 2)] WHEN pillar = 'dataset' AND primary_source IS NOT NULL THEN ['batch:' || primary_source]
  WHEN pillar = 'dataset' THEN ['dataset:contributed-dataset'] WHEN pillar = 'model' THEN ['{_NODE}'] WHEN pillar = 'inference' THEN ['stream:cam-01'] WHEN pillar = 'distribution' THEN ['window:current'] ELSE ['assurance:core'] END), NULL FROM fo),
f AS (SELECT fo.*, (SELECT list(DISTINCT value) FROM er WHERE er.id = fo.id AND kind = 'source') AS sources, (SELECT list(DISTINCT value) FROM er WHERE er.id = fo.id AND kind = 'lineage') AS lineage_sources,
  (SELECT list(DISTINCT value) FROM er WHERE er.id = fo.id AND kind = 'digest') AS record_model_digests, (SELECT list(value::BIGINT * 1000000000 + num) FROM er WHERE er.id = fo.id AND kind = 'seq') AS record_seqs FROM fo)
"""
_CHAINS = _FOUND + runs._CHAINS.removeprefix(runs._RUN)
_PILLARS = "['dataset', 'model', 'distribution', 'inference', 'governance']"
_CASE = f""",
nl AS (SELECT component AS chain, count(*) AS n, list_sort(list(DISTINCT rule)) AS rules FROM sl JOIN cm ON node = a GROUP BY 1),
ci AS (SELECT chain, list(id ORDER BY list_position({_PILLARS}, pillar), ord) AS ids FROM mb WHERE rank > 0 GROUP BY 1),
nr AS (SELECT ch.*, ids, CASE WHEN len(ids) > 1 THEN size || ' findings in ' || replace(pillars, ',', ', ') || ' share evidence (' || array_to_string(rules, ', ') || '): ' || array_to_string(ids, ' -> ') ELSE 'nothing else supports ' || ids[1] END AS narrative FROM ch JOIN ci USING (chain) LEFT JOIN nl USING (chain)),
ca AS (SELECT max(rank) AS r, round((1 - exp(sum(ln(CASE WHEN rank = 0 THEN 1.0::DOUBLE ELSE 1 - [0.05, 0.2, 0.45, 0.75, 0.95][rank + 1]::DOUBLE * confidence END))))::DECIMAL(18, 9), 3)::DOUBLE AS risk, bool_or(rank >= 3 AND method_status = 'REAL') AS hard, bool_or(rank >= 3 AND pillar = 'model') AS mh FROM f),
cx2 AS (SELECT bool_or(strong AND n_pillars >= 3) AS wide, bool_or(strong AND n_pillars >= 2 AND r >= 3) AS multi FROM ch),
asst AS (SELECT DISTINCT value FROM er JOIN f USING (id) WHERE kind = 'affected' AND rank > 0),
rec AS (SELECT value, row_number() OVER (ORDER BY value) AS n, count(*) OVER () AS al FROM asst WHERE value LIKE 'inference:%'),
cd AS (SELECT 'severity' AS item, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][r + 1 + CASE WHEN wide AND r < 4 THEN 1 ELSE 0 END] AS detail FROM ca, cx2
 UNION ALL SELECT 'risk_score', risk::VARCHAR FROM ca UNION ALL SELECT 'disposition', CASE WHEN hard OR mh OR multi THEN 'QUARANTINE' ELSE 'REVIEW' END FROM ca, cx2
 UNION ALL SELECT 'title', CASE WHEN pillars LIKE 'dataset,model%' THEN 'data poisoning with an effect on the model' ELSE category END FROM nr JOIN f ON f.id = ids[1] WHERE place = 1
 UNION ALL SELECT 'what_happened', string_agg(narrative, '; ' ORDER BY place) FROM nr WHERE place <= 3
 UNION ALL SELECT 'where', array_to_string(list_concat(list_concat((SELECT list(value ORDER BY value) FROM asst WHERE split_part(value, ':', 1) IN ('contributor', 'batch', 'model', 'modelver', 'stream', 'dataset')), coalesce((SELECT list(value ORDER BY value) FROM rec WHERE n <= 3), [])), coalesce((SELECT ['and ' || (any_value(al) - 3) || ' more records'] FROM rec WHERE al > 3), [])), ', ')
 UNION ALL SELECT 'unknowns', array_to_string(list_concat(coalesce((SELECT list(id || ' is a score, not a proof' ORDER BY ord) FROM f WHERE rank > 0 AND method_status <> 'REAL'), []), list_concat(coalesce((SELECT ['no evidence joins ' || array_to_string(list_sort(list(DISTINCT a)), ', ') || ' to the main chain'] FROM cx HAVING count(*) > 0), []), ['who did it and why is not determined'])), '; ')
 UNION ALL SELECT 'next_steps', array_to_string((SELECT list(recommendation ORDER BY k)[1:8] FROM (SELECT recommendation, min([5 - rank, ord]) AS k FROM f WHERE rank > 0 GROUP BY 1)), '; ')
 UNION ALL SELECT 'findings', (SELECT string_agg(id, ',' ORDER BY ord) FROM f WHERE rank > 0) UNION ALL SELECT 'informational', coalesce((SELECT string_agg(id, ',' ORDER BY ord) FROM f WHERE rank = 0), ''))
"""
_STATUS = f""",
pp AS (SELECT pillar, count(*) AS findings, max(rank) AS r, bool_or(method_status = 'REAL' AND rank >= 3) AS hard, bool_or(category <> 'inference.replay_blocked') AS broken, bool_or(category IN ('model.substitution', 'model.manifest_tampered')) AS swapped,
  min(list_position(['distribution.localized_manipulation', 'distribution.environmental_drift', 'distribution.unattributed_shift'], category)) AS shift FROM f WHERE rank > 0 GROUP BY 1),
sv AS (SELECT e.pillar, coalesce(findings, 0) AS findings, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][r + 1] AS severity, CASE e.pillar WHEN 'dataset' THEN CASE WHEN hard OR r >= 4 THEN 'FAIL' WHEN r >= 2 THEN 'WARNING' ELSE 'PASS' END
  WHEN 'model' THEN CASE WHEN swapped THEN 'FAIL' WHEN r >= 2 THEN 'REVIEW' ELSE 'PASS' END WHEN 'inference' THEN CASE WHEN broken THEN 'FAILED' WHEN findings > 0 THEN 'WARNING' ELSE 'PASS' END WHEN 'governance' THEN CASE WHEN findings > 0 THEN 'FAIL' ELSE 'PASS' END
  ELSE CASE WHEN (SELECT n FROM win) < 20 THEN 'INSUFFICIENT_DATA' ELSE coalesce(['SUSPICIOUS', 'DRIFT', 'INCONCLUSIVE'][shift], 'PASS') END END AS status FROM (SELECT unnest({_PILLARS}) AS pillar) e LEFT JOIN pp USING (pillar))
"""
_GRAPH_INPUT = """,
sm AS (SELECT vec_id AS sample, 'b' || vec_id % 12 AS batch, 'c' || vec_id % 3 AS contributor FROM embeddings WHERE vec_id % 4 <> 0),
md AS (SELECT 'model-' || s_suppkey AS model_id, CASE WHEN s_suppkey = 7 THEN 'x' ELSE 'm' END || s_suppkey AS sha256, CASE WHEN s_suppkey > 1 THEN 'model-' || (s_suppkey - 1) END AS previous_version, ['b' || s_suppkey % 12] AS new_sources FROM supplier),
iv AS (SELECT record_id, 'm' || record_id % 9 AS model_sha256 FROM vds),
fi AS (SELECT id, CASE WHEN rank > 0 THEN 'CASE-0001' END AS case_id, (SELECT list(value ORDER BY value)[1:10] FROM er WHERE er.id = f.id AND kind = 'affected') AS affected FROM f),
ev AS (SELECT replace(id, 'F-', 'E-') AS id, id AS finding_id, affected AS assets FROM fi),
li AS (SELECT a, b FROM links), sc AS (SELECT 'label_flip' AS id, ['batch:b5'] AS touched),
"""
_GRAPH = _GRAPH_INPUT + re.sub(r"\bed\b", "eg", runs._GRAPH)[runs._GRAPH.index("sr AS (") :].replace("unknown-digest", _DIGEST).replace("unknown-dige", _DIGEST).replace("AS label FROM nd0)", "AS label FROM nd0 WHERE id IS NOT NULL)")
_RUN = _CHAINS + _CASE + _STATUS + _GRAPH + """
SELECT 'finding' AS section, id AS item, concat_ws('|', category, severity, confidence::VARCHAR, method_status, coalesce(primary_source, ''), members::VARCHAR, coalesce(tx || ',' || ty, ''), coalesce(candidate_source, ''), coalesce(model_digest, '')) AS detail FROM f
UNION ALL SELECT 'evidence', id || ' ' || kind, count(*) || '|' || min(value) || '|' || max(value) FROM er GROUP BY id, kind
UNION ALL SELECT 'link', a || ' ' || b, rule || '|' || strength FROM links
UNION ALL SELECT 'chain', chain_id, concat_ws('|', place::VARCHAR, size::VARCHAR, pillars, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][r + 1], strong::VARCHAR, narrative) FROM nr
UNION ALL SELECT 'case', item, detail FROM cd
UNION ALL SELECT 'status', pillar, concat_ws('|', findings::VARCHAR, coalesce(severity, ''), status) FROM sv
UNION ALL SELECT 'status', 'overall', CASE WHEN bool_or(status IN ('FAIL', 'FAILED')) THEN 'UNTRUSTED' WHEN bool_and(status = 'PASS') THEN 'TRUSTED' ELSE 'REVIEW REQUIRED' END FROM sv
UNION ALL SELECT 'nodes', type, count(*)::VARCHAR FROM nd GROUP BY type
UNION ALL SELECT 'edges', rel, count(*)::VARCHAR FROM eg GROUP BY rel
"""


def _sections(done: run.Run, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section, item, detail: the run's tables as one."""
    text = lambda *c: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (F.col(y) if isinstance(y, str) else y for y in c)])
    row = lambda df, section, item, detail: df.select(F.lit(section).alias("section"), (F.col(item) if isinstance(item, str) else item).alias("item"), detail.cast("string").alias("detail"))
    place = F.concat_ws(",", "trigger.x", "trigger.y")
    count = F.count(F.lit(1))
    pieces = done.rows.groupBy("id", "kind").agg(text(count, F.min("value"), F.max("value")).alias("d"))
    join = lambda c, by: F.array_join(c, by)
    fields = {"severity": F.col("severity"), "risk_score": F.col("risk_score"), "disposition": F.col("disposition"), "title": F.col("title"), "what_happened": join("what_happened", "; "), "where": join("where", ", "), "unknowns": join("unknowns", "; "), "next_steps": join("next_steps", "; "), "findings": join("findings", ","), "informational": join("informational", ",")}
    case = done.case.select(F.inline(F.array(*[F.struct(F.lit(n).alias("item"), c.cast("string").alias("detail")) for n, c in fields.items()])))
    parts = [
        row(done.findings, "finding", "id", text("category", "severity", "confidence", "method_status", "primary_source", "members", place, "candidate_source", "model_digest")),
        row(pieces, "evidence", F.concat_ws(" ", "id", "kind"), F.col("d")),
        row(done.links, "link", F.concat_ws(" ", "a", "b"), text("rule", "strength")),
        row(done.chains, "chain", "chain_id", text("place", "size", join("pillars", ","), "max_severity", "strong", "narrative")),
        row(case, "case", "item", F.col("detail")),
        row(done.statuses, "status", "pillar", text("findings", "max_severity", "status")),
        row(done.overall, "status", F.lit("overall"), F.col("overall")),
        row(nodes.groupBy("type").agg(count.alias("n")), "nodes", "type", F.col("n")),
        row(edges.groupBy("rel").agg(count.alias("n")), "edges", "rel", F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(_RUN)
def assurance_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen detectors, then links, chains with narratives, case, statuses, verdict and graph of one run, as section, item, detail."""
    detected, verdicts = _detect(spark, sf_dir)
    found, rows = run.collect(F.lit(1).cast("long"), detected, F.lit(_NODE))
    window = _window_size(spark, sf_dir)
    done = run.assess(found, rows, window)
    e, k = F.col("vec_id"), F.col("s_suppkey")
    contributed = table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0").select(e.alias("sample"), F.concat(F.lit("b"), e % 12).alias("batch"), F.concat(F.lit("c"), e % 3).alias("contributor"))
    name = lambda n: F.concat(F.lit("model-"), n)
    registry = table(spark, sf_dir, "supplier").select(name(k).alias("model_id"), F.concat(F.when(k == 7, "x").otherwise("m"), k).alias("sha256"), F.when(k > 1, name(k - 1)).alias("previous_version"), F.array(F.concat(F.lit("b"), k % 12)).alias("new_sources"))
    invalid = verdicts.where("verdict = 'INVALID'").select("record_id", "model_sha256")
    scenario = spark.createDataFrame([("label_flip", ["batch:b5"])], "id string, touched array<string>")
    nodes, edges = run.run_graph(done, contributed, registry, spark.createDataFrame([(_DIGEST,)], "sha256 string"), invalid, scenario)
    return _sections(done, nodes, materialize(edges, "edges"))


def _window_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0").agg(F.least(F.count(F.lit(1)), F.lit(vectors.WINDOW)).alias("window_size"))
    return sized.select(F.lit(1).cast("long").alias("run_id"), "window_size")
