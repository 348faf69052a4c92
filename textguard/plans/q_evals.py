"""Evaluation: a weak score of documents against their labels, times of events, and the rules against the probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.operators import evals as E
from textguard.operators import prep as P
from textguard.operators import rules as R
from textguard.plans import planted
from textguard.plans.catalog import query
from textguard.plans.q_features import q
from textguard.plans.q_prep import _P_TEXT, LABELLED, MUTATED_SQL, PROBES_SQL, labelled, weak_score
from textguard.plans.q_rules import _DIM

SCORED = f"{LABELLED}, scored as (select doc_id, label = 1 as truth, {_P_TEXT} as score, source from (select doc_id, coalesce(text, '') as text, label, source from labelled))"


def scored(spark, sf_dir):
    d = labelled(spark, sf_dir)
    return d.select("doc_id", (F.col("label") == 1).alias("truth"), weak_score(F.coalesce("text", F.lit(""))).alias("score"), "source")


def over(a: str, b: str, digits: int = 4) -> str:
    return f"case when {b} > 0 then round(({a}) / ({b})::double, {digits}) else 0.0::double end"


_RATES = f"{over('tp', 'tp + fp')} as precision, {over('tp', 'tp + fn')} as recall, {over('2 * tp', '2 * tp + fp + fn')} as f1, {over('fp', 'fp + tn')} as fpr, {over('fn', 'fn + tp')} as fnr, {over('tp + tn', 'tp + tn + fp + fn')} as accuracy"
_COUNTS = "count(*) filter (truth and score > 0.5)::bigint as tp, count(*) filter (not truth and score <= 0.5)::bigint as tn, count(*) filter (not truth and score > 0.5)::bigint as fp, count(*) filter (truth and score <= 0.5)::bigint as fn"


@query("v_confusion", f"with {SCORED}, c as (select {_COUNTS} from scored) select *, {_RATES} from c")
def v_confusion(spark, sf_dir):
    return E.confusion(scored(spark, sf_dir), F.col("truth"), F.col("score") > 0.5)


@query("v_confusion_by", f"with {SCORED}, c as (select source, {_COUNTS} from scored group by source) select *, {_RATES} from c")
def v_confusion_by(spark, sf_dir):
    return E.confusion(scored(spark, sf_dir), F.col("truth"), F.col("score") > 0.5, "source")


@query("v_auc", f"""with {SCORED}, c as (select score, count(*) filter (truth) as pos, count(*) filter (not truth) as neg from scored group by score),
  w as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp from c)
select round(sum(neg * (tp - pos / 2.0::double)) / (sum(pos) * sum(neg)), 6) as auc_roc, round(sum(pos * tp / (tp + fp)::double) / sum(pos), 6) as auc_pr from w""")  # fmt: skip
def v_auc(spark, sf_dir):
    return E.areas(scored(spark, sf_dir), F.col("truth"), F.col("score"))


@query("v_latency", "select event_type, count(value)::bigint as n, round(avg(value), 4) as mean, " + ", ".join(f"round(quantile_cont(round(value, 1), {p}), 4) as p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + " from events group by event_type")
def v_latency(spark, sf_dir):
    return E.latency(planted.table(spark, sf_dir, "events"), "value", "event_type")


_VERDICT = "case when user_id % 11 = 0 then 'ERROR' when value > 30 then 'MALICIOUS' else 'SAFE' end"


def _judged(spark, sf_dir):
    e = planted.table(spark, sf_dir, "events")
    v = F.when(F.col("user_id") % 11 == 0, "ERROR").when(F.col("value") > 30, "MALICIOUS").otherwise("SAFE")
    return e.select("event_id", (F.col("event_type") == "purchase").alias("truth"), v.alias("verdict"), "value")


@query("v_judge", f"""with j as (select event_type = 'purchase' as truth, {_VERDICT} as verdict, value from events), c as (select count(*)::bigint as total, count(*) filter (verdict = 'ERROR')::bigint as errors,
  count(*) filter (truth and verdict = 'MALICIOUS')::bigint as tp, count(*) filter (not truth and verdict = 'MALICIOUS')::bigint as fp, count(*) filter (truth and verdict = 'SAFE')::bigint as fn, count(*) filter (not truth and verdict = 'SAFE')::bigint as tn,
  quantile_disc(round(value, 1), 0.5) as p50, quantile_disc(round(value, 1), 0.95) as p95 from j) select *, {over('fp', 'fp + tn')} as fpr, {over('fn', 'fn + tp')} as fnr from c""")  # fmt: skip
def v_judge(spark, sf_dir):
    return E.judge_metrics(_judged(spark, sf_dir), F.col("truth"), "verdict", "value")


@query("v_judge_examples", f"select event_id, {_VERDICT} as verdict from events where event_type <> 'purchase' and {_VERDICT} = 'MALICIOUS' order by event_id limit 10")
def v_judge_examples(spark, sf_dir):
    return E.examples(_judged(spark, sf_dir), ~F.col("truth") & (F.col("verdict") == "MALICIOUS"), "event_id").select("event_id", "verdict")


_SWEEP = f"""{SCORED}, t as (select unnest(range(1, 100)) as k), n as (select k, count(*) filter (truth and score >= k / 100.0::double) as tp, count(*) filter (not truth and score >= k / 100.0::double) as fp, count(*) filter (truth) as p, count(*) filter (not truth) as n from t, scored group by k),
  swept as (select k / 100.0::double as threshold, {over('tp', 'p', 6)} as tpr, {over('fp', 'n', 6)} as fpr, {over('tp', 'tp + fp', 6)} as precision, {over('2 * tp', 'tp + fp + p', 6)} as f1, round(case when p > 0 then tp / p::double else 0 end - case when n > 0 then fp / n::double else 0 end, 6) as j from n)"""


@query("v_sweep", f"with {_SWEEP} select * from swept")
def v_sweep(spark, sf_dir):
    return E.sweep(scored(spark, sf_dir), F.col("truth"), F.col("score"))


@query("v_best", f"with {_SWEEP} select (select threshold from swept order by j desc, threshold limit 1) as best_j, (select threshold from swept where tpr >= 0.95 order by fpr, threshold limit 1) as best_fpr")
def v_best(spark, sf_dir):
    return E.best(E.sweep(scored(spark, sf_dir), F.col("truth"), F.col("score")))


_TECH = "techs(name, pos, technique) as (values " + ", ".join(f"({q(r.name)}, {i}, {q(t)})" for i, r in enumerate(R.RULES) for t in r.techniques) + ")"
RUN_SQL = f"""{PROBES_SQL}, {_DIM}, {_TECH}, raw as (select *, row_number() over () as rid from (select template_id, k, technique_id, difficulty, evasion, text from probes)),
  hit as (select rid, name from raw join rules on paranoia <= 2 and regexp_matches(lower(text), pattern)), ids as (select rid, list(distinct technique) as found from hit join techs using (name) group by rid),
  run as (select raw.*, ends_with(technique_id, '_benign') as benign, rid in (select rid from hit) as flagged, coalesce(list_contains(found, technique_id), false) as attributed, coalesce(found, []) as found from raw left join ids using (rid))"""


def run(spark, rows=None):
    """The probes, judged by the rules."""
    d = (rows if rows is not None else P.probes(spark)).withColumn("hits", R.hit_names(F.col("text")))
    d = d.withColumn("found", R.techniques(F.col("hits")))
    return E.probed(d, F.size("hits") > 0, "found")


@query("v_probes", f"with {RUN_SQL} select template_id, k, benign, flagged, attributed from run")
def v_probes(spark, sf_dir):
    return run(spark).select("template_id", "k", "benign", "flagged", "attributed")


_GROUP = f"count(*)::bigint as total, count(*) filter (flagged)::bigint as detected, count(*) filter (attributed)::bigint as attributed"
GROUPS_SQL = f"""attacks as (select * from run where not benign), g as (select 'all' as dimension, '' as value, {_GROUP} from attacks union all select 'technique', technique_id, {_GROUP} from attacks group by technique_id
  union all select 'difficulty', difficulty, {_GROUP} from attacks group by difficulty union all select 'evasion', evasion, {_GROUP} from attacks group by evasion)"""


@query("v_recall", f"with {RUN_SQL}, {GROUPS_SQL} select *, total - detected as missed, {over('detected', 'total')} as recall, {over('attributed', 'total')} as attribution, round(1 - {over('detected', 'total')}, 4) as effective_difficulty from g")
def v_recall(spark, sf_dir):
    return E.recall_groups(run(spark))


@query("v_attribution", f"with {RUN_SQL}, f as (select technique_id as expected, unnest(case when len(found) = 0 then ['_none'] else found end) as found from run) select expected, found, count(*)::bigint as n from f group by all")
def v_attribution(spark, sf_dir):
    return E.attribution(run(spark), "found")


TAGS = [(t, tag) for t in sorted({p[0] for p in P.PROBES}) for tag in (f"area:{t[0]}", f"id:{t}")]


@query("v_tags", f"""with {RUN_SQL}, {GROUPS_SQL}, tags(technique_id, tag) as (values {', '.join(f"({q(a)}, {q(b)})" for a, b in TAGS)}), s as (select tag, sum(total)::bigint as total, sum(detected)::bigint as detected, sum(attributed)::bigint as attributed
  from g join tags on value = technique_id where dimension = 'technique' and starts_with(tag, 'area:') group by tag) select *, {over('detected', 'total')} as recall, {over('attributed', 'total')} as attribution from s""")  # fmt: skip
def v_tags(spark, sf_dir):
    return E.by_tag(E.recall_groups(run(spark)), spark.createDataFrame(TAGS, "technique_id string, tag string"), "area:")


_KINDS = ["raw", *P.MUTATIONS]


@query("v_matrix", f"""with {PROBES_SQL}, {_DIM}, m as ({MUTATED_SQL}), h as (select *, exists(select 1 from rules where paranoia <= 2 and regexp_matches(lower(text), pattern)) as flagged from m where not ends_with(technique_id, '_benign'))
select technique_id, {', '.join(f"round(avg(flagged::int) filter (mutation = '{k}'), 4) as {k}" for k in _KINDS)} from h group by technique_id""")  # fmt: skip
def v_matrix(spark, sf_dir):
    return E.matrix(run(spark, P.mutated(P.probes(spark))), _KINDS)


@query("v_weak", f"""with {RUN_SQL}, r as (select technique_id, avg(flagged::int) as recall from run where not benign group by 1 having avg(flagged::int) < 0.8),
  m as (select distinct technique_id, text from run where not benign and not flagged) select technique_id, round(recall, 4) as recall, (row_number() over (partition by technique_id order by text) - 1)::int as place, text from m join r using (technique_id) qualify place < 3""")  # fmt: skip
def v_weak(spark, sf_dir):
    return E.weak(run(spark))


@query("v_compared", """with e as (select event_type as tool, case when value > 30 then '!! Malicious' else 'safe' end as label, least(1, value / 100) as score, value as latency from events where event_type in ('click', 'purchase'))
select tool, count(*)::bigint as n, count(*) filter (label = '!! Malicious')::bigint as flagged, round(avg(score), 4) as mean_score, round(avg(latency), 4) as mean_latency from e group by tool""")  # fmt: skip
def v_compared(spark, sf_dir):
    e = planted.table(spark, sf_dir, "events")
    e = e.select("event_type", F.when(F.col("value") > 30, "!! Malicious").otherwise("safe").alias("label"), F.least(F.lit(1), F.col("value") / 100).alias("score"), F.col("value").alias("latency"))
    return E.compared({k: e.where(F.col("event_type") == k) for k in ("click", "purchase")}, spark)
