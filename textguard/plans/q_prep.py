"""Preparation of training and probe data."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import prep as P
from textguard.operators import rules as R
from textguard.plans import planted
from textguard.plans.catalog import query
from textguard.plans.q_features import q
from textguard.plans.q_rules import hits_sql

LABELLED = "labelled as (select d.doc_id, d.text, d.source, max(l.toxic)::int as label from documents d join labels l on d.doc_id = l.doc_id where l.toxic is not null group by d.doc_id, d.text, d.source)"


def labelled(spark, sf_dir):
    truth = planted.table(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return planted.table(spark, sf_dir, "documents").select("doc_id", "text", "source").join(truth, "doc_id")


@query("a_merge", f"with {LABELLED} select doc_id, text, label, 'labelled' as origin from labelled union all select item_id, text, 0, 'benchmark' from benchmark")
def a_merge(spark, sf_dir):
    items = planted.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit(0).alias("label"), F.lit("benchmark").alias("origin"))
    return P.merge([labelled(spark, sf_dir).drop("source").withColumn("origin", F.lit("labelled")), items], seed=7)


@query("a_enrich", """with better as (select text, max_by(doc_id, doc_id) as id, 'taxonomy' as origin from documents where doc_id % 3 = 0 and text is not null group by text),
  base as (select text, doc_id as id, 'base' as origin from documents where doc_id % 2 = 0)
select b.text, coalesce(t.id, b.id) as id, coalesce(t.origin, b.origin) as origin from base b left join better t using (text)
union all select text, id, origin from better where text not in (select text from base where text is not null)""")  # fmt: skip
def a_enrich(spark, sf_dir):
    """Even documents, enriched by every third: the rows of one table beside another of the same source."""
    d = planted.table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("id"))
    return P.enrich(d.where("id % 2 = 0").withColumn("origin", F.lit("base")), d.where("id % 3 = 0").withColumn("origin", F.lit("taxonomy")), "id")


@query("a_balance", f"with {LABELLED} select label, count(*)::bigint as n, round(100 * count(*) / (select count(*) from labelled)::double, 4) as percent from labelled group by label")
def a_balance(spark, sf_dir):
    return P.balance(labelled(spark, sf_dir))


@query("a_keep_first", "select min(doc_id) as doc_id, md5(text) as digest from documents where text is not null group by text")
def a_keep_first(spark, sf_dir):
    return P.keep_first(planted.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@query("a_unseen", "select count(distinct coalesce(text, ''))::bigint as n from documents")
def a_unseen(spark, sf_dir):
    return P.unseen(planted.table(spark, sf_dir, "documents").select("text")).agg(F.count("*").alias("n"))


_P_TEXT = "round(least(1, (length(text) - length(replace(text, 'e', ''))) * 5.0::double / greatest(length(text), 1)), 4)"


def weak_score(c):
    """A weak score by a text's share of the letter e, for queries that need a score that SQL can give too."""
    return F.round(F.least(F.lit(1), (F.length(c) - F.length(F.replace(c, F.lit("e"), F.lit("")))) * 5.0 / F.greatest(F.length(c), F.lit(1))), 4)


@query("a_false_positives", f"""with {planted.SQL}, {hits_sql()}, h as (select doc_id, count(*) as n from hits group by doc_id), d as (select p.doc_id, {_P_TEXT} > 0.5 as ml, coalesce(n, 0) > 0 as rule from planted p left join h using (doc_id))
select count(*)::bigint as total, count(*) filter (ml)::bigint as ml, count(*) filter (rule)::bigint as rule, count(*) filter (ml and rule)::bigint as both, count(*) filter (ml and not rule)::bigint as ml_only, count(*) filter (not ml and rule)::bigint as rule_only from d""")  # fmt: skip
def a_false_positives(spark, sf_dir):
    d = planted.documents(spark, sf_dir)
    return P.false_positives(d.select(weak_score(F.col("text")).alias("p"), R.hit_names(F.col("text")).alias("hits")))


@query("a_most_common", f"with {planted.SQL}, {hits_sql()} select name, count(*)::bigint as n from hits group by name")
def a_most_common(spark, sf_dir):
    return P.most_common(planted.documents(spark, sf_dir).select(R.hit_names(F.col("text")).alias("hits")), "hits")


_NEG = "negatives as (select * from (values " + ", ".join(f"({i}, {q(s)}, {q(t)})" for i, (s, t) in enumerate(P.HARD_NEGATIVES)) + ") v(doc_id, source, text))"


@query("a_hard_negatives", f"with {_NEG}, {hits_sql('negatives')}, h as (select doc_id, count(*) as n from hits group by doc_id) select source, count(n)::bigint as flagged, count(*)::bigint as total, round(100 * count(n) / count(*)::double, 4) as percent from negatives left join h using (doc_id) group by source")
def a_hard_negatives(spark, sf_dir):
    d = spark.createDataFrame(list(P.HARD_NEGATIVES), "source string, text string").withColumn("hits", R.hit_names(F.col("text")))
    return P.flagged_by(d, "source", F.size("hits") > 0)


def _probes_sql() -> str:
    rows = ", ".join(f"({i}, {q(a)}, {q(b)}, {q(c)}, {q(t)})" for i, (a, b, c, t) in enumerate(P.PROBES))
    size, text, stride = [], "template", "1"
    for name, values in P.SLOTS.items():
        n = f"(case when contains(template, '{{{name}}}') then {len(values)} else 1 end)"
        size.append(n)
        text = f"replace({text}, '{{{name}}}', [{', '.join(map(q, values))}][((k // ({stride})) % {n} + 1)::int])"
        stride = f"{stride} * {n}"
    return f"""templates as (select * from (values {rows}) v(template_id, technique_id, difficulty, evasion, template)),
  counted as (select *, unnest(range({' * '.join(size)})) as k from templates), probes as (select template_id, technique_id, difficulty, evasion, k::bigint as k, {text} as text from counted)"""


PROBES_SQL = _probes_sql()
query("a_expand", f"with {PROBES_SQL} select template_id, technique_id, k, text from probes")(lambda spark, sf_dir: P.probes(spark).select("template_id", "technique_id", "k", "text"))


@query("a_metadata", f"""with {planted.SQL} select doc_id, length(text)::bigint as char_length, strlen(text)::bigint as byte_length, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))::bigint as token_count,
  regexp_matches(lower(text), '(?:reset|start over|begin anew|new session|clear)') as has_reset, regexp_matches(lower(text), '(?:ignore|disregard|override|bypass|forget)') as has_override, 'D' || kind as category from planted""")  # fmt: skip
def a_metadata(spark, sf_dir):
    d = planted.documents(spark, sf_dir).withColumn("id", F.concat(F.lit("D"), F.col("kind"), F.lit(".1")))
    return d.select("doc_id", *[v.alias(k) for k, v in P.metadata(F.col("text"), F.col("id")).items()])


_MUTATED = {
    "raw": "text", "base64": "to_base64(encode(text))", "rot13": f"translate(text, '{T.ROT_FROM}', '{T.ROT_TO}')", "leet": "translate(text, 'oieastOIEAST', '013457013457')", "fullwidth": f"translate(text, {q(P._PLAIN)}, {q(P._WIDE)})",
    "zero_width": f"array_to_string(list_filter(string_split(text, ''), lambda x: x <> ''), {q(chr(0x200D))})", "homoglyph": f"translate(text, '{P.LOOKALIKE_FROM}', '{P.LOOKALIKE_TO}')", "reverse": "reverse(text)",
    "alternating": "array_to_string(list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x, i: case when i % 2 = 1 then lower(x) else upper(x) end), '')",
}
MUTATED_SQL = " union all ".join(f"select template_id, technique_id, k, '{k}' as mutation, {v} as text from probes" for k, v in _MUTATED.items())


@query("a_mutations", f"with {PROBES_SQL}, m as ({MUTATED_SQL}) select template_id, k, mutation, text from m")
def a_mutations(spark, sf_dir):
    return P.mutated(P.probes(spark)).select("template_id", "k", "mutation", "text")
