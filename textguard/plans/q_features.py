"""Structural features of the planted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import features as O
from textguard.plans import planted
from textguard.plans.catalog import _SQL, query

P = planted.SQL
W = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"


def n(pattern: str, of: str = "text") -> str:
    return f"len(regexp_extract_all({of}, '{pattern.replace(chr(39), chr(39) * 2)}'))::bigint"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r(a: str, b: str) -> str:
    return f"case when {b} > 0 then round(({a})::double / ({b}), 6) else 0.0::double end"


def _of(columns):
    def run(spark, sf_dir):
        return planted.documents(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in columns(F.col("text")).items()])

    return run


query("f_length", f"""with {P}, w as (select *, len({W})::bigint as words, 1 + {n(chr(10))} as lines from planted)
select doc_id, length(text)::bigint as char_count, words as word_count, case when length(text) > 0 then lines else 0 end::bigint as line_count,
  {r('length(text)', 'words')} as avg_word_length, {r('lines', 'words')} as newline_ratio from w""")(_of(O.length_features))  # fmt: skip

query("f_casing", f"""with {P}, w as (select *, list_filter({W}, lambda w: length(w) >= 2) as ws from planted)
select doc_id, {r(n(r'[\p{Lu}]'), n(r'[\p{L}]'))} as uppercase_ratio, len(list_filter(ws, lambda w: regexp_matches(w, {q(O.TITLE)})))::bigint as title_case_words,
  len(list_filter(ws, lambda w: regexp_matches(w, {q(O.CAPS)})))::bigint as all_caps_words from w""")(_of(O.casing_features))  # fmt: skip

query("f_punct", f"""with {P}
select doc_id, {n('!')} as exclamation_count, {n('[?]')} as question_count, {r(n(r'[^\p{L}\p{N} \t\n\r\f\x0B]'), 'length(text)')} as special_char_ratio,
  {n(r'[^\p{L}\p{N}_ \t\n\r\f\x0B]{2,}')} as consecutive_punctuation from planted""")(_of(O.punctuation_features))  # fmt: skip

query("f_markers", f"""with {P}
select doc_id, contains(text, '```')::int as has_code_block, regexp_matches(text, {q(O.URL)})::int as has_url, regexp_matches(text, {q(O.EMAIL)})::int as has_email from planted""")(_of(O.marker_features))  # fmt: skip

_VERBS = ", ".join(q(v) for v in O.VERBS)
query("f_injection", f"""with {P}, w as (select *, regexp_replace(lower(coalesce({W}[1], '')), '^["''`(\\[{{]+|["''`(\\[{{]+$', '', 'g') as first from planted)
select doc_id, (first in ({_VERBS}))::int as imperative_start, regexp_matches(text, {q(O.ROLE)})::int as role_assignment, regexp_matches(text, {q(O.BOUNDARY)})::int as instruction_boundary,
  regexp_matches(text, {q(O.NEGATION)})::int as negation_command from w""")(_of(O.injection_features))  # fmt: skip

query("f_context", f"""with {P}, a as (select doc_id, regexp_replace(text, {q(O.ABBREVIATION)}, '\\1\\2' || chr(1), 'g') as t from planted),
  b as (select doc_id, regexp_replace(t, '(^|[ \\t\\n\\r(])([A-Z])\\.', '\\1\\2' || chr(1), 'g') as t from a),
  s as (select doc_id, list_filter(string_split(regexp_replace(t, '([.!?]+["'')]*)[ \\t\\n\\r]+', '\\1' || chr(2), 'g'), chr(2)), lambda s: regexp_replace(s, '[ \\t\\n\\r\\f\\x0B]', '', 'g') <> '') as s from b)
select doc_id, {r("len(list_filter(s, lambda x: regexp_matches(x, '[?][ \\t\\n\\r]*$')))", 'len(s)')} as question_sentence_ratio,
  {r(f"len(list_filter(s, lambda x: regexp_matches(x, {q(O.FIRST)})))", 'len(s)')} as first_person_ratio,
  {r(f"len(list_filter(s, lambda x: regexp_matches(x, {q(O.SECOND)})))", 'len(s)')} as second_person_ratio from s""")(_of(O.context_features))  # fmt: skip

query("f_patterns", f"""with {P}
select doc_id, {n(O.MANY_SHOT)} as many_shot_count, {r(n(O.DELIMITER), f'{n(chr(10))} + 1')} as delimiter_density, {n(O.TEMPLATE)} as template_marker_count from planted""")(_of(O.pattern_features))  # fmt: skip

_KINDS = " + ".join(f"(len(regexp_extract_all(text, '{p}')) >= 3)::int" for p in O.SCRIPTS.values())
query("f_script_mix", f"""with {P}, s as (select doc_id, {_KINDS} as kinds from planted)
select doc_id, case when kinds > 1 then kinds else 0 end::bigint as language_mixing_score from s""")(_of(lambda c: {"language_mixing_score": O.script_mixing(c)}))  # fmt: skip

query("f_repetition", f"""with {P}, w as (select doc_id, {W} as ws from planted),
  g as (select doc_id, array_to_string(ws[i + 1:i + 3], ' ') as g from (select doc_id, ws, unnest(range(len(ws) - 2)) as i from w where len(ws) >= 4)),
  c as (select doc_id, g, count(*) as n from g group by all), s as (select doc_id, round(count(*) filter (n > 1) / count(*)::double, 6) as score from c group by doc_id)
select w.doc_id, coalesce(score, 0.0::double) as repetition_score from w left join s using (doc_id)""")(_of(lambda c: {"repetition_score": O.repetition(c)}))  # fmt: skip

query("f_entropy", f"""with {P} select doc_id, case when text = '' then 0.0::double else round(list_aggregate(string_split(text, ''), 'entropy'), 6) end as text_entropy from planted""")(
    _of(lambda c: {"text_entropy": F.round(T.entropy(c), 6)})
)

QUOTES = f"""with recursive {P}, c as (select doc_id, string_split(text, '') as c from planted where regexp_matches(text, '["''`]')), q as (select doc_id, c, unnest(list_filter(range(1, len(c) + 1), lambda i: c[i] in ('"', '''', '`'))) as i from c),
  n as (select doc_id, row_number() over (partition by doc_id order by i) as k, c[i] as ch, coalesce(regexp_matches(case when i > 1 then c[i - 1] end, '[\\p{{L}}\\p{{N}}]'), false) as before, coalesce(regexp_matches(c[i + 1], '[\\p{{L}}\\p{{N}}]'), false) as after from q),
  s as (select doc_id, 0::bigint as k, ''::varchar as stack, 0::bigint as deep from planted
    union all select doc_id, k, stack, greatest(deep, length(stack)) from (select s.doc_id, n.k, s.deep, case when ch = '''' and before then case when right(stack, 1) = '''' and not after then left(stack, length(stack) - 1) else stack end
      when right(stack, 1) = ch then left(stack, length(stack) - 1) else stack || ch end as stack from s join n on n.doc_id = s.doc_id and n.k = s.k + 1))
select doc_id, max(deep) as quote_depth from s group by doc_id"""
query("f_quote_depth", QUOTES)(_of(lambda c: {"quote_depth": O.quote_depth(c)}))

_PARTS = ("f_length", "f_casing", "f_punct", "f_markers", "f_injection", "f_quote_depth", "f_entropy", "f_context", "f_patterns", "f_script_mix", "f_repetition")
query("f_all", "select * from " + " join ".join(f"({_SQL[k]}) {k}" + (" using (doc_id)" if i else "") for i, k in enumerate(_PARTS)))(
    lambda spark, sf_dir: O.structural_features(planted.documents(spark, sf_dir)).drop("kind", "text")
)


@query("f_softcap", f"""with {P}, w as (select *, len({W})::bigint as words from planted)
select doc_id, round(least(length(text) / 5000.0::double, 1), 6) as char_count, round(least(words / 1000.0::double, 1), 6) as word_count,
  round(least({n('!')} / 20.0::double, 1), 6) as exclamation_count, round(least({n(O.TEMPLATE)} / 20.0::double, 1), 6) as template_marker_count from w""")  # fmt: skip
def f_softcap(spark, sf_dir):
    wide = _of(lambda c: {k: v for k, v in (O.length_features(c) | O.punctuation_features(c) | O.pattern_features(c)).items() if k in ("char_count", "word_count", "exclamation_count", "template_marker_count")})(spark, sf_dir)
    return O.soft_capped(wide)
