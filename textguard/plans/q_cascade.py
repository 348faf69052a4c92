"""Routing, votes, judge replies and validation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import cascade as C
from textguard.operators import features as S
from textguard.operators import rules as R
from textguard.plans import planted
from textguard.plans.catalog import query
from textguard.plans.q_features import q
from textguard.plans.q_prep import _P_TEXT, weak_score
from textguard.plans.q_rules import hits_sql

#: Two weak scores of a text, by its letters e and a, stand for two models.
_P_A = _P_TEXT.replace("'e'", "'a'")
_JUDGE = "case quality when 1 then 'SAFE' when 0 then 'MALICIOUS' end"
BASE = f"""{planted.SQL}, {hits_sql()}, h as (select doc_id, sum(weight) as rule, list(name order by pos) as names from hits group by doc_id), j as (select doc_id, max(quality) as quality from labels group by doc_id),
  base as (select p.doc_id, text, length(text) > 15000 as blocked, length(text) < 100 and rule is null as white, {_P_TEXT} as p, {_P_A} as p2, coalesce(rule, 0) as rule, coalesce(names, []) as names, (kind in (1, 2, 6))::int as n_flags,
    {_JUDGE} as judge_label, case when quality is not null then 0.9::double end as judge_conf, contains(text, 'a') as valid, {_P_A} as valid_conf from planted p left join h using (doc_id) left join j using (doc_id))"""


def base(spark, sf_dir):
    judge = planted.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = planted.documents(spark, sf_dir).withColumn("hits", R.hit_names(F.col("text"))).join(judge, "doc_id", "left")
    e = weak_score(F.col("text"))
    a = F.round(F.least(F.lit(1), (F.length("text") - F.length(F.replace("text", F.lit("a"), F.lit("")))) * 5.0 / F.greatest(F.length("text"), F.lit(1))), 4)
    return d.select(
        "doc_id", "text", "hits", (F.length("text") > 15000).alias("blocked"), ((F.length("text") < 100) & (F.size("hits") == 0)).alias("whitelisted"), e.alias("p"), a.alias("p2"), F.col("kind").isin(1, 2, 6).cast("int").alias("n_flags"),
        F.when(F.col("quality") == 1, "SAFE").when(F.col("quality") == 0, "MALICIOUS").alias("judge_label"), F.when(F.col("quality").isNotNull(), 0.9).alias("judge_conf"), F.contains("text", F.lit("a")).alias("valid"), a.alias("valid_conf"),
    )


_W = "w as (select *, least(greatest(0.6::double * p + rule + least(n_flags * 0.15::double, 0.3::double), 0), 1) as score from base), v as (select *, case when score >= 0.55 then 'MALICIOUS' else 'SAFE' end as l1, round(case when score >= 0.55 then score else 1 - score end, 4) as c1 from w)"


@query("c_weighted", f"with {BASE}, {_W} select doc_id, l1 as label, c1 as confidence from v")
def c_weighted(spark, sf_dir):
    v = C.weighted(F.col("p"), F.col("hits"), F.col("n_flags"))
    return base(spark, sf_dir).select("doc_id", v.alias("v")).select("doc_id", "v.label", "v.confidence")


#: Texts of an even id are asked of the embedding model, every seventh of the ensemble.
ROUTED = f"""{BASE}, {_W}, e as (select *, case when doc_id % 7 = 0 then p2 end as ens, case when doc_id % 2 = 0 then case when p2 >= 0.5 then 'MALICIOUS' else 'SAFE' end end as emb_label, case when p2 >= 0.5 then p2 else 1 - p2 end as emb_conf from v),
  m as (select *, round(0.6::double * c1 + 0.4::double * emb_conf, 4) as mixed, ens is null and emb_label is not null as has_emb from e),
  s2 as (select *, has_emb and emb_label = 'SAFE' and l1 = 'MALICIOUS' and emb_conf > 0.7 as cleared, has_emb and emb_label = 'MALICIOUS' and l1 = 'SAFE' and emb_conf > 0.85 as turned from m),
  t as (select *, case when ens is not null then case when ens >= 0.55 then 'MALICIOUS' else 'SAFE' end when cleared then 'SAFE' when turned then 'MALICIOUS' else l1 end as l2, case when ens is not null then ens when has_emb then mixed else c1 end as c2 from s2),
  u as (select *, case when blocked then 'blocked' when white then 'whitelist' when cleared then 'embedding' when judge_label is not null and (c2 between 0.25 and 0.85 or (l2 = 'MALICIOUS' and c2 < 0.85)) then 'judge'
    when l2 = 'MALICIOUS' and valid and valid_conf > 0.7 and c2 < 0.85 then 'positive_validation' else 'weighted' end as stage,
    0.3::double * case when l2 = 'MALICIOUS' then c2 else 1 - c2 end + 0.7::double * case when judge_label = 'MALICIOUS' then judge_conf else 1 - judge_conf end as p_both from t),
  routed as (select doc_id, names, stage, case stage when 'blocked' then 'BLOCKED' when 'judge' then judge_label when 'weighted' then l2 else 'SAFE' end as label,
    case stage when 'blocked' then 1.0::double when 'whitelist' then 0.99::double when 'judge' then round(case when judge_label = 'MALICIOUS' then p_both else 1 - p_both end, 4)
      when 'positive_validation' then round(0.4::double * (1 - c2) + 0.6::double * valid_conf, 4) else c2 end as confidence from u)"""


def routed(spark, sf_dir):
    even, seventh, bad = F.pmod("doc_id", F.lit(2)) == 0, F.pmod("doc_id", F.lit(7)) == 0, F.col("p2") >= 0.5
    d = base(spark, sf_dir).withColumn("ensemble_risk", F.when(seventh, F.col("p2")))
    d = d.withColumn("emb_label", F.when(even, F.when(bad, "MALICIOUS").otherwise("SAFE"))).withColumn("emb_conf", F.when(bad, F.col("p2")).otherwise(1 - F.col("p2")))
    return C.route(d)


@query("c_route", f"with {ROUTED} select doc_id, label, confidence, stage from routed")
def c_route(spark, sf_dir):
    return routed(spark, sf_dir).select("doc_id", "label", "confidence", "stage")


_TECHS = "techs(name, technique, tpos) as (values " + ", ".join(f"({q(r.name)}, {q(t)}, {i})" for i, (r, t) in enumerate((r, t) for r in R.RULES for t in r.techniques)) + ")"


@query("c_result", f"""with {ROUTED}, {_TECHS}, f as (select doc_id, technique, min(tpos) as tpos from (select doc_id, unnest(names) as name from routed where stage <> 'blocked') join techs using (name) group by all),
  g as (select doc_id, string_agg(technique, ',' order by technique) as found from f group by doc_id)
select doc_id, label <> 'SAFE' as malicious, case when stage = 'blocked' then 1.0::double else round(confidence, 4) end as risk, lower(label) as label, case when stage = 'blocked' then '' else coalesce(found || ',', '') || 'cascade:' || stage end as techniques from routed left join g using (doc_id)""")  # fmt: skip
def c_result(spark, sf_dir):
    """Techniques in order of their names, the stage last."""
    r = C.result(routed(spark, sf_dir))
    t = F.array_join(F.concat(F.sort_array(F.filter("techniques", lambda x: ~F.startswith(x, F.lit("cascade:")))), F.filter("techniques", lambda x: F.startswith(x, F.lit("cascade:")))), ",")
    return r.select("doc_id", "malicious", "risk", "label", t.alias("techniques"))


_STAGES = ("blocked", "whitelist", "embedding", "judge", "positive_validation", "weighted")


@query("c_stages", f"with {ROUTED} select count(*)::bigint as total, {', '.join(f"count(*) filter (stage = '{s}')::bigint as {s}" for s in _STAGES)}, count(*) filter (stage not in ('blocked', 'whitelist'))::bigint as classified from routed")
def c_stages(spark, sf_dir):
    return C.stage_counts(routed(spark, sf_dir))


@query("c_ensemble", f"with {planted.SQL}, s as (select doc_id, {_P_TEXT} as p, case when doc_id % 5 <> 0 then {_P_A} end as p2 from planted) select doc_id, round(coalesce(0.6::double * p + 0.4::double * p2, p), 4) as risk, coalesce(0.6::double * p + 0.4::double * p2, p) >= 0.55 as malicious from s")
def c_ensemble(spark, sf_dir):
    d = planted.documents(spark, sf_dir)
    a = F.round(F.least(F.lit(1), (F.length("text") - F.length(F.replace("text", F.lit("a"), F.lit("")))) * 5.0 / F.greatest(F.length("text"), F.lit(1))), 4)
    v = C.ensemble(weak_score(F.col("text")), F.when(F.pmod("doc_id", F.lit(5)) != 0, a), 0.6, 0.4)
    return d.select("doc_id", v.alias("v")).select("doc_id", "v.risk", "v.malicious")


@query("c_embedding", f"""with {BASE}, d as (select *, p2 >= 0.5 as bad, p2 < 0.5 and len(names) > 0 and 1 - p2 <= 0.7 as by_rule, p > 0.6 as by_view from base)
select doc_id, case when bad or by_rule or by_view then 'MALICIOUS' else 'SAFE' end as label, round(case when by_view then greatest(p2, p) else p2 end, 4) as p from d""")  # fmt: skip
def c_embedding(spark, sf_dir):
    v = C.embedding_decision(F.col("p2"), F.col("hits"), F.array("p"))
    return base(spark, sf_dir).select("doc_id", v.alias("v")).select("doc_id", "v.label", "v.p")


_FLAGS = [*C.FLAG_TECHNIQUE, "no_such_flag"]


@query("c_flag_map", f"""with f(flag, technique) as (values {', '.join(f"({q(f)}, {q(t)})" for f, t in C.FLAG_TECHNIQUE.items())}), d as (select doc_id, [{', '.join(map(q, _FLAGS))}] as all_ from documents),
  g as (select doc_id, unnest([all_[doc_id % {len(_FLAGS)} + 1], all_[doc_id * 7 % {len(_FLAGS)} + 1]]) as flag from d) select doc_id, coalesce(string_agg(distinct technique, ',' order by technique), '') as techniques from g left join f using (flag) group by doc_id""")  # fmt: skip
def c_flag_map(spark, sf_dir):
    pick = lambda k: F.get(F.array(*map(F.lit, _FLAGS)), F.pmod(k, F.lit(len(_FLAGS))).cast("int"))
    d = planted.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.sort_array(C.flag_techniques(F.array(pick(F.col("doc_id")), pick(F.col("doc_id") * 7)))), ",").alias("techniques"))


@query("c_structural_tags", f"""with {planted.SQL}, f as (select doc_id, regexp_matches(text, {q(S.ROLE)}) as a, regexp_matches(text, {q(S.BOUNDARY)}) as b, regexp_matches(text, {q(S.NEGATION)}) as c, len(regexp_extract_all(text, {q(S.TEMPLATE)})) >= 1 as d from planted)
select doc_id, array_to_string(list_filter([case when a then 'D2.1' end, case when b then 'D3.4' end, case when c then 'D1.2' end, case when d then 'D3.2' end], lambda x: x is not null), ',') as techniques from f""")  # fmt: skip
def c_structural_tags(spark, sf_dir):
    """The tags of four of the features; the others are 0 here."""
    c = F.col("text")
    zero = {f: F.lit(0) for _, f, _, _ in C.STRUCTURAL}
    own = S.injection_features(c) | {"template_marker_count": S.pattern_features(c)["template_marker_count"]}
    features = zero | {k: v for k, v in own.items() if k != "imperative_start"}
    return planted.documents(spark, sf_dir).select("doc_id", F.array_join(C.structural_tags(features)[1], ",").alias("techniques"))


@query("c_chunk_boost", f"""with {planted.SQL}, c as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') as w from planted), s as (select doc_id, w, unnest(range(0, greatest(1, len(w) - 64), 448)) as pos_ from c where len(w) > 512),
  ch as (select doc_id, array_to_string(w[pos_ + 1:pos_ + 512], ' ') as text from s where pos_ < 20 * 448), {hits_sql('ch')}, n as (select doc_id, count(distinct name) as k from hits group by doc_id)
select doc_id, round(least(1, 0.2::double + 0.05::double * coalesce(k, 0) + least(0.15::double, 0.075::double * coalesce(k, 0))), 4) as risk from (select distinct doc_id from ch) left join n using (doc_id)""")  # fmt: skip
def c_chunk_boost(spark, sf_dir):
    """Long texts whose rules are all new in their chunks, from a score of 0.2."""
    d = C.chunks(planted.documents(spark, sf_dir)).withColumn("h", R.hit_names(F.col("chunk_text")))
    per = d.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set("h"))).alias("h"))  # at most 20 chunks a text
    return per.select("doc_id", F.round(C.rescored(F.lit(0.2), F.array().cast("array<string>"), F.col("h")), 4).alias("risk"))


_W_SQL = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')"


@query("c_head_tail", f"with {planted.SQL} select doc_id, md5(case when len({_W_SQL}) > 512 then array_to_string(list_concat({_W_SQL}[1:256], {_W_SQL}[-256:]), ' ') else text end) as digest from planted")
def c_head_tail(spark, sf_dir):
    return planted.documents(spark, sf_dir).select("doc_id", F.md5(C.head_tail(F.col("text"))).alias("digest"))


_REPLY = """case turn % 6 when 0 then 'Sure: {"verdict": "safe", "confidence": 0.8, "reasoning": "fine", "nonce": "n' || conv_id || '"} done' when 1 then '{"verdict": "MALICIOUS", "confidence": 1.7, "reasoning": "bad", "nonce": "n' || conv_id || '"}'
  when 2 then '{"verdict": "MALICIOUS", "confidence": "high", "reasoning": "x", "nonce": "n' || conv_id || '"}' when 3 then '{"verdict": "SAFE", "confidence": 0.9, "reasoning": "y", "nonce": "other"}' when 4 then 'no json at all' else '{"verdict": "MAYBE", "confidence": 0.5, "reasoning": "z", "nonce": "n' || conv_id || '"}' end"""
_PARSED = f"""r as (select conv_id, turn, {_REPLY} as raw from conversations), b as (select *, nullif(regexp_extract(raw, '(?s)\\{{.*\\}}', 0), '') as body from r),
  f as (select *, body->>'$.verdict' as v, body->>'$.confidence' as c, body->>'$.reasoning' as why, body->>'$.nonce' as n from b),
  g as (select *, case when v is null then 'parse' when n is null or n <> 'n' || conv_id then 'nonce' when upper(trim(v)) not in ('SAFE', 'MALICIOUS') then 'verdict' end as error from f),
  parsed as (select conv_id, turn, case when error is null then upper(trim(v)) else 'UNKNOWN' end as verdict, case when error is null then round(case when try_cast(c as double) is null then 0.5::double else least(greatest(try_cast(c as double), 0), 1) end, 6) else 0.0::double end as confidence, case when error is null then why else '' end as reason, error from g)"""


def replies(spark, sf_dir):
    return planted.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("raw"), F.concat(F.lit("n"), "conv_id").alias("nonce"))


@query("c_judge_reply", f"with {_PARSED} select conv_id, turn, verdict, confidence, reason, error from parsed")
def c_judge_reply(spark, sf_dir):
    return replies(spark, sf_dir).select("conv_id", "turn", C.judge_reply(F.col("raw"), F.col("nonce")).alias("r")).select("conv_id", "turn", "r.verdict", "r.confidence", "r.reason", "r.error")


@query("c_consistency", f"""with {_PARSED}, c as (select conv_id, count(*) filter (verdict <> 'UNKNOWN') as valid, count(*) as n, count(*) filter (verdict = 'SAFE') as safe, count(*) filter (verdict = 'MALICIOUS') as bad, avg(confidence) filter (verdict <> 'UNKNOWN') as mean from parsed group by conv_id)
select conv_id, case when valid < n // 2 + 1 then 'UNKNOWN' when safe > bad then 'SAFE' else 'MALICIOUS' end as verdict, case when valid < n // 2 + 1 then 0.0::double else round((greatest(safe, bad) / valid::double + mean) / 2, 6) end as confidence from c""")  # fmt: skip
def c_consistency(spark, sf_dir):
    r = replies(spark, sf_dir).select("conv_id", C.judge_reply(F.col("raw"), F.col("nonce")).alias("r"))
    return C.consistency(r.select("conv_id", "r.verdict", "r.confidence"), "conv_id")


@query("c_breaker")
def c_breaker(spark, sf_dir):
    """Calls of each user, of which errors fail."""
    e = planted.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("fine"))
    return C.circuit_breaker(e, "user_id", "ts", "fine", 2, 86_400).select("event_id", "user_id", "state")


_MARK = " or ".join(f"contains(low, {q(m)})" for m in C.MARKERS)
_BOUNDS = " + ".join(f"(length(t) - length(replace(t, {q(b)}, ''))) / {len(b)}.0::double" for b in C.BOUNDS)


@query("c_validate", f"""with {planted.SQL}, a as (select doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') as t from planted), b as (select *, lower(t) as low, list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') as w from a where t <> ''),
  c as (select *, len(w) as n, length(t) as chars, len(list_filter(w, lambda x: length(x) > 2)) / len(w)::double as long, len(regexp_extract_all(t, '\\p{{L}}')) / length(t)::double as alpha, regexp_extract_all(low, '[a-z]+') as plain,
    list_filter(regexp_split_to_array(low, '[.!?]+(?:[ \\t\\r\\n]|$)|\\n+'), lambda x: trim(x, ' ') <> '') as parts, {_BOUNDS} as bounds, regexp_matches(low, {q(C.CONTRADICTION)}) as contra, regexp_matches(low, {q('|'.join(C.PERSONA))}) or {_MARK} as other from b),
  d as (select *, case when chars / n::double > 25 then 0.1::double when long < 0.15 then 0.2::double when alpha < 0.3 then 0.2::double end as coh, list_has_any(plain, [{', '.join(map(q, C.QUESTION))}]) or ends_with(t, '?') as asks, list_has_any(plain, [{', '.join(map(q, C.INTENT))}]) as does,
    list_position(list_transform(parts, lambda x: regexp_matches(x, {q(C.SETUP)})), true) as s1, list_position(list_transform(parts, lambda x: regexp_matches(x, {q(C.REVERSAL)})), true) as s2 from c),
  e as (select *, contra or coalesce(s1 <> s2 and s1 > 0 and s2 > 0, false) as against from d),
  f as (select *, 1.0::double - case when chars > 2000 then 0.4::double else 0 end - case when bounds >= 3 then 0.3::double else 0 end - case when against then 0.3::double else 0 end as scope from e)
select doc_id, coh is null and (asks or does) and not (chars > 2000 or bounds >= 3 or against) and not other as valid,
  round((coalesce(coh, least(1.0::double, 0.4::double + long * 0.3::double + alpha * 0.3::double)) + case when asks or does then 0.6::double + does::int * 0.2::double + asks::int * 0.2::double else 0.2::double end + greatest(0, scope) + case when other then 0.1::double else 1 end) / 4, 4) as confidence,
  array_to_string(list_filter([case when coh is not null then 'coherence' end, case when not (asks or does) then 'intent' end, case when chars > 2000 or bounds >= 3 or against then 'scope' end, case when other then 'persona' end], lambda x: x is not null), '|') as reason, 0.5::double as task_match from f
union all select doc_id, false, 1.0::double, 'empty', 0.0::double from a where t = ''""")  # fmt: skip
def c_validate(spark, sf_dir):
    return planted.documents(spark, sf_dir).select("doc_id", C.validate(F.col("text")).alias("v")).select("doc_id", "v.*")


@query("c_boundary", f"""with {planted.SQL}, w as (select doc_id, text, case when doc_id % 4 = 0 then text else 'Be kind.' || E'\\n\\n{C.BEGIN}\\n' || text || E'\\n{C.END}\\n\\nRemember: Be kind.' end as s from planted),
  i as (select *, instr(s, '{C.BEGIN}') as a, instr(s, '{C.END}') as b from w)
select doc_id, md5(s) as wrapped, md5(case when a > 0 and b >= a + {len(C.BEGIN)} then regexp_replace(regexp_replace(substr(s, a + {len(C.BEGIN)}, b - a - {len(C.BEGIN)}), '^\\s+', ''), '\\s+$', '') end) as inner_md5 from i""")  # fmt: skip
def c_boundary(spark, sf_dir):
    d = planted.documents(spark, sf_dir).withColumn("s", F.when(F.pmod("doc_id", F.lit(4)) == 0, F.col("text")).otherwise(C.sandwich(F.lit("Be kind."), F.col("text"))))
    return d.select("doc_id", F.md5("s").alias("wrapped"), F.md5(C.user_input(F.col("s"))).alias("inner_md5"))
