"""The whole scan of the planted documents, and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import features as O
from textguard.operators import intake as I
from textguard.operators import rules as R
from textguard.operators import signals as S
from textguard.operators import vote as V
from textguard.plans import planted
from textguard.plans.catalog import _SQL, query
from textguard.plans.q_decode import TREE_SQL, VIEWS_SQL
from textguard.plans.q_extract import _REFANG
from textguard.plans.q_features import W, n, q
from textguard.plans.q_rules import _DIM, _FRAMED

_VERBS = ", ".join(q(v) for v in O.VERBS)
_MIX = " + ".join(f"(len(regexp_extract_all(text, '{p}')) >= 3)::int" for p in O.SCRIPTS.values())
_Z = " + ".join([f"({V.BIAS}::double)", *(f"least({k}, 5) * {w}::double" for k, w in V.LOGIT.items())])
#: The cleaned text; the planted documents need no other step of layer 0.
CLEAN_SQL = f"""a0 as (select doc_id, kind, text as raw, regexp_replace(translate(text, {q(I.SPACES)}, '{' ' * len(I.SPACES)}'), ' {{2,}}', ' ', 'g') as t from planted),
  clean as (select doc_id, kind, raw, regexp_replace(regexp_replace(regexp_replace(t, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\t{{3,}}', chr(9), 'g') as text from a0)"""
_FOLD = f"translate({{}}, {q(I.ANGLES_FROM)}, {q(I.ANGLES_TO)})"
_READINGS = f"""both_ as (select doc_id, {_FOLD.format('text')} as text from clean union select doc_id, {_FOLD.format('raw')} from clean), readings as (select doc_id, text from both_
    union select doc_id, replace(text, '+', ' ') from both_ where length(text) - length(replace(text, '+', '')) >= 3 and not contains(text, ' ') union select doc_id, strip_accents(text) from both_ union select doc_id, {_REFANG} from both_
    union select doc_id, regexp_replace(translate(text, {q(I.DASHES)}, {q('-' * len(I.DASHES))}), '([A-Za-z])-([A-Za-z])', '\\1\\2', 'g') from both_)"""


def _of_clean(key: str) -> str:
    """A feature's SQL over the cleaned texts."""
    return "(" + _SQL[key].replace(planted.SQL, "planted as (select doc_id, kind, text from clean)") + f") {key}"


_LETTERS = "regexp_replace(text, '[^\\p{L}]', '', 'g')"
_TURNS = f"greatest(0, len(regexp_extract_all({_LETTERS}, '\\p{{Lu}}+')) + len(regexp_extract_all({_LETTERS}, '[^\\p{{Lu}}]+')) - 1)"
_STRUCTURED = f"(regexp_matches(text, {q(S.FENCE)}) or regexp_matches(text, {q(S.TABLE)}))"
_SHARES = ", ".join(f"{f}::double" for f in T.ENGLISH)
_KL = f"""case when length(t) < 5 then 0.0::double else greatest(0, list_sum(list_transform(range(26), lambda k: ((length(t) - length(replace(t, chr((97 + k)::int), '')) + 0.5::double) / (length(t) + 13.0::double))
  * log2((length(t) - length(replace(t, chr((97 + k)::int), '')) + 0.5::double) / (length(t) + 13.0::double) / (([{_SHARES}])[k + 1] / {sum(T.ENGLISH)}::double))))) end"""
SCAN_SQL = f"""with recursive {planted.SQL}, {CLEAN_SQL}, {_DIM}, {TREE_SQL}, {VIEWS_SQL}, {_READINGS},
  f as (select doc_id, kind, raw, text, (regexp_replace(lower(coalesce({W}[1], '')), '^["''`(\\[{{]+|["''`(\\[{{]+$', '', 'g') in ({_VERBS}))::int as imperative_start, regexp_matches(text, {q(O.ROLE)})::int as role_assignment,
    regexp_matches(text, {q(O.BOUNDARY)})::int as instruction_boundary, regexp_matches(text, {q(O.NEGATION)})::int as negation_command, {n(O.MANY_SHOT)} as shots, round({n(O.DELIMITER)} / ({n(chr(10))} + 1)::double, 6) as density,
    {n(O.TEMPLATE)} as template_marker_count, {_MIX} as mix, {_FRAMED} as framed, regexp_matches(lower(text), {q(R.BENIGN_ROLE)}) as benign, regexp_replace(lower(text), '[^a-z]', '', 'g') as t,
    length(text) > 0 and len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f\\x0B]')) / length(text)::double >= {S.PUNCTUATION} and not {_STRUCTURED} as flood,
    {_TURNS} >= {S.TRANSITIONS} and {_TURNS} >= {S.CASING} * len(regexp_extract_all(text, '\\p{{L}}')) and not {_STRUCTURED} as casing from clean),
  e as (select f.*, quote_depth, text_entropy, repetition_score, length(text) >= 10 and case when regexp_matches(text, {q(S.FENCE)}) then text_entropy >= {S.FENCED} else text_entropy >= {S.ENTROPY} and {_KL} >= {S.KL} end as dense
    from f join {_of_clean('f_quote_depth')} using (doc_id) join {_of_clean('f_entropy')} using (doc_id) join {_of_clean('f_repetition')} using (doc_id)),
  v as (select doc_id, count(distinct case when split_part(enc, ',', -1) in ('full_reverse', 'word_reverse') then 'reversed_text' else split_part(enc, ',', -1) end) as n_enc, arg_min(enc, path) as enc from views group by doc_id),
  g as (select e.*, coalesce(v.enc, '') as enc, dense::int + flood::int + casing::int + coalesce(n_enc, 0) as n_flags, 1 / (1 + exp(-({_Z}))) as p, imperative_start * 0.05::double + role_assignment * 0.1::double + instruction_boundary * 0.1::double + negation_command * 0.08::double + (shots >= 5)::int * 0.1::double
    + (density > 2)::int * 0.06::double + (template_marker_count >= 1)::int * 0.05::double + (mix >= 2)::int * 0.04::double + (quote_depth >= 3)::int * 0.05::double + (text_entropy > 5)::int * 0.03::double + (repetition_score > 0.3)::int * 0.05::double as st from e left join v using (doc_id)),
  hit as (select distinct doc_id, name, severity, weight, suppressible, pos from readings join rules on paranoia <= 2 and regexp_matches(lower(text), pattern)),
  h as (select doc_id, sum(weight) as rule, bool_or(severity = 'critical_content') as content, bool_or(severity <> 'medium') as strong, string_agg(name, ',' order by pos) as hits, list(name) as names
    from hit join f using (doc_id) where not (framed and suppressible) and not (benign and name = 'roleplay') group by doc_id),
  i as (select doc_id, list(distinct name) as inner_names from views join rules on paranoia <= 2 and regexp_matches(lower(text), pattern) group by doc_id),
  j as (select g.*, least(n_flags * 0.15::double, 0.3::double) as obf, coalesce(rule, 0) as rule, coalesce(content, false) as content, coalesce(strong, false) or inner_names is not null as strong, hits is not null or inner_names is not null as weak, coalesce(hits, '') as hits,
    inner_names is not null as payload, list_concat(coalesce(names, []), coalesce(inner_names, [])) as all_names from g left join h using (doc_id) left join i using (doc_id)),
  k as (select *, 0.6::double * p + rule + payload::int * 0.3::double + obf + st as total, (rule > 0 or payload)::int + (obf > 0)::int + (st > 0)::int + (p > 0.5)::int as layers from j),
  l as (select *, case when content then greatest(total, 0.6::double) else total end as floor_, case when (layers >= 3 and weak) or (layers >= 2 and strong) or (layers >= 2 and weak and p > 0.45) then case when layers >= 4 then 0.15::double when layers = 3 then 0.12::double else 0.1::double end else 0 end as boost from k),
  s as (select *, round(least(greatest(case when 1 - p > 0.65 and rule = 0 and not payload then least(floor_, {V.THRESHOLD - 0.01}::double) else floor_ end + boost, 0), 1), 4) as risk from l)"""


def scanned(spark, sf_dir):
    return V.scan(planted.documents(spark, sf_dir))


@query("scan_documents", f"{SCAN_SQL} select doc_id, kind, round(p, 6) as p, hits, enc as encoding, risk, case when risk >= {V.THRESHOLD} then 'malicious' else 'safe' end as label from s")
def scan_documents(spark, sf_dir):
    return scanned(spark, sf_dir).select("doc_id", "kind", F.round("p", 6).alias("p"), F.array_join("hits", ",").alias("hits"), "encoding", "risk", "label")


@query("s_risk_buckets", f"{SCAN_SQL} select least(floor(risk * 10), 9)::bigint as bucket, count(*)::bigint as n, count(*) filter (kind < 9)::bigint as attacks from s group by 1")
def s_risk_buckets(spark, sf_dir):
    s = scanned(spark, sf_dir).select(F.least(F.floor(F.col("risk") * 10), F.lit(9)).cast("long").alias("bucket"), "kind")
    return s.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("kind") < 9).alias("attacks"))


_CHUNK = f"c as (select doc_id, {W} as w from planted), s as (select doc_id, w, unnest(range(0, greatest(1, len(w) - 64), 448)) as pos_ from c where len(w) > 512)"


@query("s_chunks", f"with {planted.SQL}, {_CHUNK} select doc_id, (pos_ // 448)::bigint as chunk, md5(array_to_string(w[pos_ + 1:pos_ + 512], ' ')) as digest from s where pos_ < 20 * 448")
def s_chunks(spark, sf_dir):
    from textguard.operators import cascade as C

    d = C.chunks(planted.documents(spark, sf_dir))
    return d.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("chunk_text").alias("digest"))


_TECHS = "techs(name, technique) as (values " + ", ".join(f"({q(r.name)}, {q(t)})" for r in R.RULES for t in r.techniques) + ")"


@query("s_technique_tags", f"{SCAN_SQL}, {_TECHS}, u as (select distinct doc_id, risk, technique from (select doc_id, risk, unnest(all_names) as name from s) join techs using (name)) select technique, count(*)::bigint as n, count(*) filter (risk >= {V.THRESHOLD})::bigint as malicious from u group by technique")
def s_technique_tags(spark, sf_dir):
    t = scanned(spark, sf_dir).select(F.explode_outer("techniques").alias("technique"), "label").where("technique is not null")
    return t.groupBy("technique").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "malicious").alias("malicious"))
