"""Rule engine over the planted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.operators import rules as R
from textguard.plans import planted
from textguard.plans.catalog import query
from textguard.plans.q_extract import _REFANG
from textguard.plans.q_features import q
from textguard.operators import intake as I

_DIM = "rules(name, pattern, severity, weight, paranoia, suppressible, pos) as (values " + ", ".join(f"({q(r.name)}, {q(r.pattern)}, {q(r.severity)}, {R.WEIGHTS[r.severity]}::double, {r.paranoia}, {r.suppressible}, {i})" for i, r in enumerate(R.RULES)) + ")"


def hits_sql(source: str = "planted", paranoia: int = 2) -> str:
    """CTEs `rules` and `hits` (doc_id, name, ...): the theta-join of texts and rules."""
    return f"{_DIM}, hits as (select doc_id, name, severity, weight, suppressible, pos from {source} join rules on paranoia <= {paranoia} and regexp_matches(lower(text), pattern))"


def with_hits(spark, sf_dir, rules=None):
    return planted.documents(spark, sf_dir).withColumn("hits", R.hit_names(F.col("text"), rules))


def one_hit(hits):
    """A row per hit. explode_outer, since explode infers a filter that would compute the hits a second time."""
    return hits.select("doc_id", F.explode_outer("hits").alias("name")).where("name is not null")


@query("r_hits_wide", f"with {planted.SQL}, {hits_sql()} select p.doc_id, coalesce(string_agg(name, ',' order by pos), '') as hits from planted p left join hits h using (doc_id) group by p.doc_id")
def r_hits_wide(spark, sf_dir):
    return with_hits(spark, sf_dir).select("doc_id", F.array_join("hits", ",").alias("hits"))


@query("r_hits_long", f"with {planted.SQL}, {hits_sql()} select doc_id, name, severity from hits")
def r_hits_long(spark, sf_dir):
    dim = R.rule_table(spark).select("name", "severity")
    return one_hit(with_hits(spark, sf_dir)).join(F.broadcast(dim), "name")  # a fixed table


@query("r_severity_sum", f"with {planted.SQL}, {hits_sql()} select p.doc_id, round(coalesce(sum(weight), 0), 6) as rule_score from planted p left join hits h using (doc_id) group by p.doc_id")
def r_severity_sum(spark, sf_dir):
    return with_hits(spark, sf_dir).select("doc_id", F.round(R.severity_sum(F.col("hits")), 6).alias("rule_score"))


_FRAMED = " or ".join(f"regexp_matches(lower(text), {q(f)})" for f in R.FRAMES)
FRAMES_SQL = "framed_docs as (select doc_id, case when doc_id % 20 >= 10 then 'For educational purposes, students learn this: ' || text else text end as text from planted)"


@query("r_context_suppressed", f"""with {planted.SQL}, {FRAMES_SQL}, {hits_sql('framed_docs')}, f as (select doc_id, {_FRAMED} as framed, regexp_matches(lower(text), {q(R.BENIGN_ROLE)}) as benign from framed_docs)
select f.doc_id, framed, coalesce(string_agg(name, ',' order by pos) filter (not (framed and suppressible) and not (benign and name = 'roleplay')), '') as kept from f left join hits using (doc_id) group by f.doc_id, framed""")  # fmt: skip
def r_context_suppressed(spark, sf_dir):
    d = planted.documents(spark, sf_dir)
    d = d.withColumn("text", F.when(F.pmod("doc_id", F.lit(20)) >= 10, F.concat(F.lit("For educational purposes, students learn this: "), "text")).otherwise(F.col("text")))
    d = d.withColumn("hits", R.hit_names(F.col("text")))
    return d.select("doc_id", R.framed(F.col("text")).alias("framed"), F.array_join(R.suppress(F.col("hits"), F.col("text")), ",").alias("kept"))


_BASE = f"translate(text, {q(I.ANGLES_FROM)}, {q(I.ANGLES_TO)})"
DISGUISE_SQL = "tricky as (select doc_id, case doc_id % 3 when 0 then replace(replace(text, 'disregard', 'dis-regard'), 'reveal', 're-veal') when 1 then replace(text, ' ', '+') else text end as text from planted)"


@query("r_alt_views", f"""with {planted.SQL}, {DISGUISE_SQL}, b as (select doc_id, {_BASE} as text from tricky),
  views as (select doc_id, text from b union all select doc_id, case when length(text) - length(replace(text, '+', '')) >= 3 and not contains(text, ' ') then replace(text, '+', ' ') else text end from b
    union all select doc_id, strip_accents(text) from b union all select doc_id, {_REFANG} from b union all select doc_id, regexp_replace(translate(text, {q(I.DASHES)}, {q('-' * len(I.DASHES))}), '([A-Za-z])-([A-Za-z])', '\\1\\2', 'g') from b),
  {hits_sql('views')}, h as (select distinct doc_id, name, pos from hits)
select t.doc_id, coalesce(string_agg(name, ',' order by pos), '') as hits from tricky t left join h using (doc_id) group by t.doc_id""")  # fmt: skip
def r_alt_views(spark, sf_dir):
    d, k = planted.documents(spark, sf_dir), F.pmod("doc_id", F.lit(3))
    joined = F.replace(F.replace("text", F.lit("disregard"), F.lit("dis-regard")), F.lit("reveal"), F.lit("re-veal"))
    d = d.withColumn("text", F.when(k == 0, joined).when(k == 1, F.replace("text", F.lit(" "), F.lit("+"))).otherwise(F.col("text")))
    d = d.withColumn("views", R.views(F.col("text")))
    return d.select("doc_id", F.array_join(R.any_hit(F.col("views")), ",").alias("hits"))


@query("r_paranoia", f"with {planted.SQL}, l(level) as (values (1), (2), (3)), {_DIM} select level, count(*)::bigint as n_hits, count(distinct doc_id)::bigint as n_docs from l join planted on true join rules on paranoia <= level and regexp_matches(lower(text), pattern) group by level")
def r_paranoia(spark, sf_dir):
    dim = spark.createDataFrame([(r.name, r.paranoia) for r in R.RULES], "name string, paranoia int")
    hits = one_hit(with_hits(spark, sf_dir, R.RULES)).join(F.broadcast(dim), "name")  # a fixed table
    level = hits.select("doc_id", "name", F.explode(F.sequence("paranoia", F.lit(3))).alias("level"))
    return level.groupBy("level").agg(F.count("*").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))


@query("r_histogram", f"with {planted.SQL}, {hits_sql()} select name, count(*)::bigint as n, rank() over (order by count(*) desc, name)::bigint as place from hits group by name")
def r_histogram(spark, sf_dir):
    from pyspark.sql.window import Window

    n = one_hit(with_hits(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "name")).cast("bigint"))  # one row per rule


@query("r_dual_surface", f"""with {planted.SQL}, clean as (select doc_id, regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g') as text from planted), both_ as (select doc_id, text from planted union all select doc_id, text from clean),
  {hits_sql('both_')}, h as (select distinct doc_id, name, pos from hits) select p.doc_id, count(name)::bigint as n_hits from planted p left join h using (doc_id) group by p.doc_id""")  # fmt: skip
def r_dual_surface(spark, sf_dir):
    d = planted.documents(spark, sf_dir)
    raw, clean = R.hit_names(F.col("text")), R.hit_names(F.regexp_replace("text", "[ \t\n\r]+", " "))
    return d.select("doc_id", F.size(F.array_union(clean, raw)).cast("bigint").alias("n_hits"))


_TECHS = "techs(name, technique) as (values " + ", ".join(f"({q(r.name)}, {q(t)})" for r in R.RULES for t in r.techniques) + ")"


@query("r_techniques", f"with {planted.SQL}, {hits_sql()}, {_TECHS} select technique, count(distinct doc_id)::bigint as n_docs from hits join techs using (name) group by technique")
def r_techniques(spark, sf_dir):
    t = with_hits(spark, sf_dir).select("doc_id", F.explode(R.techniques(F.col("hits"))).alias("technique"))
    return t.groupBy("technique").agg(F.countDistinct("doc_id").alias("n_docs"))
