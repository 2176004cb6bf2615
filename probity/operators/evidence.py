"""Findings to cases: correlation rules, chains, risk, statuses, recommendations and timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.scalars import severity_name, severity_rank, severity_weight
from probity.operators.components import components_within
from probity.sources.storage import materialize

FINDING = (
    "id string, ord int, pillar string, category string, severity string, confidence double, method_status string, "
    "sources array<string>, primary_source string, trigger struct<x:int,y:int>, candidate_source string, lineage_sources array<string>, "
    "model_digest string, record_model_digests array<string>, record_seqs array<long>, recommendation string"
)
#: The pillars in order, and the least window of inputs.
PILLARS = ("dataset", "model", "distribution", "inference", "governance")
LEAST_WINDOW = 20


#: How far apart (in x and y) two triggers of one place may lie, and the rules' names.
NEAR = 2
RULES = ("R1-same-source", "R2-same-trigger", "R3-data-to-model", "R4-lineage", "R5-model-binding", "R6-chain-successor", "R0-same-pipeline")
BACKDOOR, REPLACED, BROKEN = "model.backdoor_behaviour", "inference.record_replacement", "inference.chain_broken"


def evidence_rows(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, kind, value, num: what the arrays of findings hold, one row each: sources, lineage, digests, and record numbers (num)."""
    none = F.lit(None)
    kinds = [("sources", "source"), ("lineage_sources", "lineage"), ("record_model_digests", "digest"), ("record_seqs", "seq")]
    out = None
    for column, kind in kinds:
        each = findings.select(*keys, "id", F.lit(kind).alias("kind"), F.explode(column).alias("v"))
        value, num = (F.lit(""), F.col("v").cast("long")) if kind == "seq" else (F.col("v"), none.cast("long"))
        each = each.select(*keys, "id", "kind", value.alias("value"), num.alias("num"))
        out = each if out is None else out.unionByName(each)
    return out


def rule_links(findings: DataFrame, keys: list[str], rows: DataFrame | None = None) -> DataFrame:
    """keys, a, b, oa, rule, place of every rule that a pair of findings meets; each rule is a join on equal values.

    ``rows`` (keys, id, kind, value, num) is the findings' evidence, of any number of rows; without it the arrays of findings are taken.
    The numbers of records (kind seq) have their stream as value.
    """
    rows = (evidence_rows(findings, keys) if rows is None else rows).where(F.col("value").isNotNull()).distinct()
    dataset, forward = F.col("pillar") == "dataset", F.col("oa") < F.col("ob")

    def side(tag: str, where: Column | None = None, value: Column | None = None, kind: str | None = None) -> DataFrame:
        """keys, id and number (with ``tag``), pillar and category of findings with a value v (and n) of their own or of their rows."""
        own = findings if where is None else findings.where(where)
        named = own.select(*keys, F.col("id").alias(tag), F.col("ord").alias(f"o{tag}"), *([] if value is None else [value.alias("v")]))
        if kind is None:
            return named
        some = rows.where(F.col("kind") == kind).select(*[F.col(k).alias(f"_{k}") for k in keys], "id", F.col("value").alias("v"), F.col("num").alias("n"))
        same = F.col("id") == F.col(tag)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return named.join(some, same).drop("id", *[f"_{k}" for k in keys])

    def meet(one: DataFrame, two: DataFrame, on: tuple[str, ...] = ("v",)) -> DataFrame:
        return one.join(two, [*keys, *on]).where(F.col("a") != F.col("b"))

    sourced = dataset & (F.length("primary_source") > 0)
    one = meet(side("a", sourced, F.col("primary_source")), side("b", sourced, F.col("primary_source"))).where(forward)
    # A place falls into one cell of a grid, and the other finding looks into the cells around its own.
    cell = lambda c, d: F.floor((F.col(f"trigger.{c}") + d) / F.lit(NEAR + 1)).cast("long")
    around = F.array(*[F.struct((cell("x", 0) + i).alias("i"), (cell("y", 0) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spots = findings.where("trigger.x is not null and trigger.y is not null")
    at = lambda tag: [F.col("id").alias(tag), F.col("ord").alias(f"o{tag}"), F.col("pillar").alias(f"p{tag}"), F.col("trigger.x").alias(f"x{tag}"), F.col("trigger.y").alias(f"y{tag}")]
    here = spots.select(*keys, *at("a"), F.struct(cell("x", 0).alias("i"), cell("y", 0).alias("j")).alias("v"))
    two = here.join(spots.select(*keys, *at("b"), F.explode(around).alias("v")), [*keys, "v"])
    two = two.where(forward & (F.col("pa") != F.col("pb")) & (F.abs(F.col("xa") - F.col("xb")) <= NEAR) & (F.abs(F.col("ya") - F.col("yb")) <= NEAR))
    three = meet(side("a", (F.col("category") == BACKDOOR) & (F.length("candidate_source") > 0), F.col("candidate_source")), side("b", kind="source"))
    batch = side("b", kind="source").withColumn("v", F.element_at(F.split("v", "/"), -1)).distinct()
    four = meet(side("a", F.col("pillar") == "model", kind="lineage").drop("n"), batch.drop("n"))
    bound = meet(side("a", F.col("pillar") == "model", F.col("model_digest")), side("b", F.col("pillar") == "inference", kind="digest"))
    # The earlier of both comes first.
    five = bound.select(*keys, F.when(forward, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("b"), F.least("oa", "ob").alias("oa"))
    after = side("a", F.col("category") == REPLACED, kind="seq").withColumn("n", F.col("n") + 1)
    six = meet(after, side("b", F.col("category") == BROKEN, kind="seq"), ("v", "n"))
    # Between rules of one pair the first decides; the third and fourth are tried from the earlier finding first.
    places = (F.lit(1), F.lit(2), F.when(forward, 3).otherwise(5), F.when(forward, 4).otherwise(6), F.lit(7), F.lit(8))
    out = None
    for rule, place, found in zip(RULES, places, (one, two, three, four, five, six), strict=False):
        found = found.select(*keys, "a", "b", "oa", F.lit(rule).alias("rule"), place.alias("place")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def correlate(findings: DataFrame, keys: list[str] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """keys, a, b, rule, strength: strong links by the first rule that a pair meets, and context links for what has none.

    Findings are compared inside one run (``keys``); ids are unique over runs. A finding above INFO without a strong link is
    linked to the first of its run that has one, or else to the first other one. ``rows`` is as for ``rule_links``.
    """
    keys = list(keys or [])
    pair = [*keys, F.least("a", "b"), F.greatest("a", "b")]
    one = Window.partitionBy(*pair).orderBy("place", "oa")
    strong = rule_links(findings, keys, rows).withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*keys, "a", "b", "rule", F.lit("strong").alias("strength"))
    strong = materialize(strong, "strong")
    linked = strong.select(*keys, F.col("a").alias("id")).union(strong.select(*keys, "b")).distinct().withColumn("_linked", F.lit(True))
    real = findings.where("severity <> 'INFO'").select(*keys, "id", "ord").join(linked, [*keys, "id"], "left").withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    real = materialize(real, "linked")
    firsts = real.groupBy(*keys).agg(
        F.min_by("id", F.when(F.col("_linked"), F.col("ord"))).alias("_l"), F.max("_linked").alias("_any"), F.min_by("id", "ord").alias("_first"),
    )
    first = real.join(firsts, keys) if keys else real.join(F.broadcast(firsts))
    seconds = first.where(F.col("id") != F.col("_first")).groupBy(*keys).agg(F.min_by("id", "ord").alias("_second"))
    lone = first.where(~F.col("_linked"))
    lone = lone.join(seconds, keys, "left") if keys else lone.join(F.broadcast(seconds), F.lit(True), "left")
    anchor = F.when(F.col("_any"), F.col("_l")).when(F.col("id") != F.col("_first"), F.col("_first")).otherwise(F.col("_second"))
    lone = lone.select(*keys, F.col("id").alias("a"), anchor.alias("b"), "ord").where(F.col("b").isNotNull())
    context = lone.withColumn("_n", F.row_number().over(Window.partitionBy(*pair).orderBy("ord"))).where("_n = 1")
    return strong.unionByName(context.select(*keys, "a", "b", F.lit(RULES[-1]).alias("rule"), F.lit("context").alias("strength")))


def chain_components(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return components_within(links.where("strength = 'strong'"), list(keys or []))


def chains(findings: DataFrame, links: DataFrame, keys: list[str] | None = None, found: DataFrame | None = None) -> DataFrame:
    """keys, chain, chain_id, place, size, pillars, n_pillars, max_severity, strong of the components over strong links.

    chain is the least finding id. Chains are numbered by their length (with INFO findings), the longest first and then
    the one met first; those without a finding above INFO are left out after that. place orders what is left: most
    pillars, then the highest severity. size and pillars count findings above INFO. ``found`` are the components, where they are known.
    """
    keys = list(keys or [])
    found = chain_components(links, keys) if found is None else found
    member = findings.join(found, F.col("id") == F.col("node"), "left").withColumn("chain", F.coalesce("component", "id"))
    real = F.col("severity") != "INFO"
    per = member.groupBy(*keys, "chain").agg(
        F.count(F.lit(1)).alias("_all"), F.min("ord").alias("_first"), F.count(F.when(real, 1)).alias("size"), F.collect_set(F.when(real, F.col("pillar"))).alias("_p"),
        F.max(F.when(real, severity_rank(F.col("severity")))).alias("_r"), F.max(F.col("component").isNotNull()).alias("strong"),
    )
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    named = per.withColumn("_n", F.row_number().over(by.orderBy(F.col("_all").desc(), "_first"))).where("size > 0")
    pillars = F.filter(F.array(*map(F.lit, PILLARS)), lambda p: F.array_contains("_p", p))
    out = named.withColumns({"pillars": pillars, "n_pillars": F.size("_p")})
    place = F.row_number().over(by.orderBy(F.col("n_pillars").desc(), F.col("_r").desc(), "_n"))
    return out.select(*keys, "chain", F.concat(F.lit("CH-"), F.col("_n").cast("string")).alias("chain_id"), place.alias("place"), "size", "pillars", "n_pillars", severity_name(F.col("_r")).alias("max_severity"), "strong")


def risk(severity: Column, confidence: Column) -> Column:
    """1 - product of (1 - weight * confidence) without INFO, three places; the product is a sum of logarithms."""
    factor = F.when(severity == "INFO", 1.0).otherwise(1.0 - severity_weight(severity) * confidence)
    product = F.when(F.min(factor) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(factor > 0, factor)))))
    return F.round(F.round(1 - product, 9), 3)  # first to nine places, so that halves fall the same way on any engine


#: The distribution status that a finding's category states.
SHIFT_STATUS = {"distribution.localized_manipulation": "SUSPICIOUS", "distribution.environmental_drift": "DRIFT", "distribution.unattributed_shift": "INCONCLUSIVE"}


def pillar_status(findings: DataFrame, keys: list[str] | None = None, runs: DataFrame | None = None) -> DataFrame:
    """keys, pillar, findings (above INFO), max_severity, status of all five pillars of every run.

    ``runs`` has the keys of all runs (a run may have no finding) and may have window_size: a window of fewer
    than 20 inputs says nothing about distribution. Without it the runs are those of the findings.
    """
    keys = keys or []
    rank = severity_rank(F.col("severity"))
    hard = (F.col("method_status") == "REAL") & (rank >= 3)
    shift = F.array_position(F.array(*map(F.lit, SHIFT_STATUS)), F.col("category"))
    per = findings.where("severity <> 'INFO'").groupBy(*keys, "pillar").agg(
        F.count(F.lit(1)).alias("findings"), F.max(rank).alias("r"), F.max(hard.cast("int")).alias("hard"),
        F.max(F.col("category").isin("model.substitution", "model.manifest_tampered").cast("int")).alias("swapped"),
        F.max((F.col("category") != "inference.replay_blocked").cast("int")).alias("broken"), F.min(F.when(shift > 0, shift)).alias("shift"),
    )
    if runs is None:
        runs = findings.select(*keys).distinct() if keys else findings.sparkSession.range(1).select()
    every = runs.withColumn("pillar", F.explode(F.array(*map(F.lit, PILLARS))))
    few = F.coalesce(F.col("window_size") < LEAST_WINDOW, F.lit(True)) if "window_size" in runs.columns else F.lit(False)
    joined = every.join(per, [*keys, "pillar"], "left").withColumn("n", F.coalesce("findings", F.lit(0)).cast("long"))
    status = (
        F.when(F.col("pillar") == "dataset", F.when((F.col("hard") == 1) | (F.col("r") >= 4), "FAIL").when(F.col("r") >= 2, "WARNING").otherwise("PASS"))
        .when(F.col("pillar") == "model", F.when(F.col("swapped") == 1, "FAIL").when(F.col("r") >= 2, "REVIEW").otherwise("PASS"))
        .when(F.col("pillar") == "inference", F.when(F.col("broken") == 1, "FAILED").when(F.col("n") > 0, "WARNING").otherwise("PASS"))
        .when(F.col("pillar") == "governance", F.when(F.col("n") > 0, "FAIL").otherwise("PASS"))
        .when(few, "INSUFFICIENT_DATA")
        .otherwise(reduce(lambda c, s: c.when(F.col("shift") == s[0], s[1]), enumerate(SHIFT_STATUS.values(), 1), F.when(F.lit(False), "PASS")).otherwise("PASS"))
    )
    return joined.select(*keys, "pillar", F.col("n").alias("findings"), severity_name(F.col("r")).alias("max_severity"), status.alias("status"))


def overall(statuses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, overall: UNTRUSTED with any failure, TRUSTED if all five pillars pass, else REVIEW REQUIRED."""
    bad, fine = F.bool_or(F.col("status").isin("FAIL", "FAILED")), F.bool_and(F.col("status") == "PASS")
    return statuses.groupBy(*(keys or [])).agg(F.when(bad, "UNTRUSTED").when(fine, "TRUSTED").otherwise("REVIEW REQUIRED").alias("overall"))


def case_of(findings: DataFrame, chain_table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, severity, escalated, risk_score, disposition, status, n_findings, n_informational, next_steps of each run's case.

    A case opens with a finding of MEDIUM or more. A strong chain over three pillars raises the severity by one level.
    """
    keys = keys or []
    rank = severity_rank(F.col("severity"))
    real = F.col("severity") != "INFO"
    f = findings.groupBy(*keys).agg(
        F.max(F.when(real, rank)).alias("r"), risk(F.col("severity"), F.col("confidence")).alias("risk_score"),
        F.max((real & (F.col("method_status") == "REAL") & (rank >= 3)).cast("int")).alias("hard"), F.max(((F.col("pillar") == "model") & (rank >= 3)).cast("int")).alias("model_high"),
        F.count(F.when(real, 1)).alias("n_findings"), F.count(F.when(~real, 1)).alias("n_informational"),
        F.array_sort(F.collect_list(F.when(real, F.struct((-rank).alias("r"), "ord", "recommendation")))).alias("steps"),
    )
    high = F.col("max_severity").isin("HIGH", "CRITICAL")
    c = chain_table.groupBy(*keys).agg(F.max((F.col("strong") & (F.col("n_pillars") >= 3)).cast("int")).alias("wide"), F.max((F.col("strong") & (F.col("n_pillars") >= 2) & high).cast("int")).alias("multi"))
    both = f.join(c, keys, "left") if keys else f.join(F.broadcast(c))
    escalated = (F.coalesce("wide", F.lit(0)) == 1) & (F.col("r") < 4)
    disposition = F.when((F.col("hard") == 1) | (F.col("model_high") == 1) | (F.col("multi") == 1), "QUARANTINE").otherwise("REVIEW")
    steps = F.slice(F.array_distinct(F.array_compact(F.transform("steps", lambda s: s["recommendation"]))), 1, 8)
    return both.where("r >= 2").select(
        *keys, severity_name(F.col("r") + escalated.cast("int")).alias("severity"), escalated.alias("escalated"), "risk_score", disposition.alias("disposition"),
        F.when(disposition == "QUARANTINE", "QUARANTINE RECOMMENDED").otherwise("REVIEW REQUIRED").alias("status"), "n_findings", "n_informational", steps.alias("next_steps"),
    )


#: Assets that a case says it lies in; of records the first few.
WHERE, SHOWN_RECORDS = ("contributor", "batch", "model", "modelver", "stream", "dataset"), 3
_LAST_UNKNOWN = "who did it and why is not determined"


def chain_texts(findings: DataFrame, links: DataFrame, chain_table: DataFrame, keys: list[str], found: DataFrame | None = None) -> DataFrame:
    """``chain_table`` with findings (ids by pillar and number), n_links, rules and narrative of each chain; INFO findings are left out."""
    strong = links.where("strength = 'strong'")
    found = chain_components(links, keys) if found is None else found
    order = F.array_position(F.array(*map(F.lit, PILLARS)), F.col("pillar"))
    member = findings.where("severity <> 'INFO'").join(found, F.col("id") == F.col("node"), "left").withColumn("chain", F.coalesce("component", "id"))
    ids = member.groupBy(*keys, "chain").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("p"), "ord", "id"))), lambda x: x["id"]).alias("findings"))
    inside = strong.join(found, F.col("a") == F.col("node")).groupBy(*keys, F.col("component").alias("chain")).agg(F.count(F.lit(1)).alias("n_links"), F.array_sort(F.collect_set("rule")).alias("rules"))
    out = chain_table.join(ids, [*keys, "chain"]).join(inside, [*keys, "chain"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    many = F.concat(F.col("size").cast("string"), F.lit(" findings in "), F.array_join("pillars", ", "), F.lit(" share evidence ("), F.array_join("rules", ", "), F.lit("): "), F.array_join("findings", " -> "))
    alone = F.concat(F.lit("nothing else supports "), F.element_at("findings", 1))
    return out.withColumn("narrative", F.when(F.size("findings") > 1, many).otherwise(alone))


def case_document(findings: DataFrame, rows: DataFrame, links: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and of each run: title, what_happened, where, unknowns, findings, informational; lists in the order of a case's page.

    texts is ``chain_texts``; rows has the findings' assets as kind affected. Of records only the first three are named. A
    run without a finding above INFO has no row.
    """
    real = findings.where("severity <> 'INFO'")
    top = texts.where("place <= 3").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "narrative", "pillars", "findings"))).alias("t"))
    first = F.col("t")[0]
    poison = F.slice(first["pillars"], 1, 2) == F.array(F.lit("dataset"), F.lit("model"))
    head = top.join(real.select(*keys, F.col("id").alias("_id"), "category"), keys).where(F.col("_id") == first["findings"][0])
    told = head.select(*keys, F.when(poison, "data poisoning with an effect on the model").otherwise(F.col("category")).alias("title"), F.transform("t", lambda x: x["narrative"]).alias("what_happened"))
    assets = real.select(*keys, "id").join(rows.where("kind = 'affected'").select(*keys, "id", "value"), [*keys, "id"]).select(*keys, "value").distinct()
    kind = F.substring_index("value", ":", 1)
    places = assets.where(kind.isin(*WHERE)).groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("_places"))
    by = Window.partitionBy(*keys).orderBy("value")
    records = assets.where(kind == "inference")
    named = records.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= SHOWN_RECORDS).groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("_records"))
    more = records.groupBy(*keys).agg((F.count(F.lit(1)) - SHOWN_RECORDS).alias("_more"))
    scores = real.where("method_status <> 'REAL'").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: F.concat(x["id"], F.lit(" is a score, not a proof"))).alias("_scores"))
    lone = links.where("strength = 'context'").groupBy(*keys).agg(F.concat(F.lit("no evidence joins "), F.array_join(F.array_sort(F.collect_set("a")), ", "), F.lit(" to the main chain")).alias("_lone"))
    lists = findings.groupBy(*keys).agg(*[F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "id")))), lambda x: x["id"]).alias(n) for n, c in (("findings", F.col("severity") != "INFO"), ("informational", F.col("severity") == "INFO"))])
    out = told
    for part in (places, named, more, scores, lone, lists):
        out = out.join(part, keys, "left")
    empty = F.array().cast("array<string>")
    rest = F.when(F.col("_more") > 0, F.array(F.concat(F.lit("and "), F.col("_more").cast("string"), F.lit(" more records")))).otherwise(empty)
    where = F.concat(F.coalesce("_places", empty), F.coalesce("_records", empty), rest)
    unknown = F.concat(F.coalesce("_scores", empty), F.array_compact(F.array("_lone", F.lit(_LAST_UNKNOWN))))
    return out.select(*keys, "title", "what_happened", where.alias("where"), unknown.alias("unknowns"), "findings", "informational")
