"""Limits, windows and sessions over the events, and texts through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.plans import planted
from textguard.plans.catalog import query
from textguard.session import folder
from textguard.sources import readers, sinks
from textguard.streaming import limiter, scans


def events(spark, sf_dir):
    return planted.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")


@query("t_limiter")
def t_limiter(spark, sf_dir):
    """At most two requests of a user in six hours."""
    return limiter.limited(events(spark, sf_dir), "user_id", "ts", 2, 6 * 3600).select("event_id", "user_id", "admitted")


@query("t_limiter_bound", "select event_id, user_id, count(*) over (partition by user_id order by epoch(ts) range between 21600 preceding and current row)::bigint as recent from events")
def t_limiter_bound(spark, sf_dir):
    return limiter.window_bound(events(spark, sf_dir), "user_id", "ts", 6 * 3600).select("event_id", "user_id", "recent")


@query("t_tumbling", "select epoch(time_bucket(interval 1 day, ts, timestamp '1970-01-01'))::bigint as start, event_type, count(*)::bigint as n from events group by all")
def t_tumbling(spark, sf_dir):
    return scans.tumbling(events(spark, sf_dir), "ts", "1 day", ["event_type"]).withColumn("start", F.unix_timestamp("start"))


@query("t_sliding", "select start, event_type, count(*)::bigint as n from (select event_type, unnest([b, b - 21600]) as start from (select event_type, ts, (floor(epoch(ts))::bigint // 21600) * 21600 as b from events)) group by all")
def t_sliding(spark, sf_dir):
    return scans.sliding(events(spark, sf_dir), "ts", "12 hours", "6 hours", ["event_type"]).withColumn("start", F.unix_timestamp("start"))


@query("t_sessions", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 8 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts) as k from g)
select user_id, floor(epoch(min(ts)))::bigint as start, count(*)::bigint as n from s group by user_id, k""")  # fmt: skip
def t_sessions(spark, sf_dir):
    return scans.sessions(events(spark, sf_dir), "ts", "8 hours", ["user_id"]).withColumn("start", F.unix_timestamp("start"))


@query("src_json_lines", "select item_id, case item_id % 5 when 0 then 'invalid json' when 1 then 'missing text' when 2 then 'empty text' end as error, case when item_id % 5 > 2 then md5(text) when item_id % 5 = 2 then md5('  ') end as digest from benchmark where item_id % 5 > 0 union all select null, 'invalid json', null from benchmark where item_id % 5 = 0")
def src_json_lines(spark, sf_dir):
    """Items written as JSON lines of which some are broken, without a text or empty, and read again."""
    k = F.pmod("item_id", F.lit(5))
    good = F.to_json(F.struct("item_id", F.when(k == 2, "  ").when(k > 2, F.col("text")).alias("text")))
    path = folder(spark, "lines")
    planted.table(spark, sf_dir, "benchmark").select(F.when(k == 0, F.lit("{not json")).otherwise(good).alias("value")).write.text(path)
    d = readers.json_lines(spark, path, schema="item_id long, text string")
    return d.select("item_id", "error", F.md5("text").alias("digest"))


@query("src_csv", "select md5(text) as digest, 1 as label from benchmark where text is not null")
def src_csv(spark, sf_dir):
    path = folder(spark, "csv")
    planted.table(spark, sf_dir, "benchmark").select(F.col("text").alias("prompt")).write.option("header", True).option("escape", '"').csv(path)
    return readers.training_csv(spark, path, "prompt", 1).select(F.md5("text").alias("digest"), "label")


@query("src_shards", "select md5(text) as digest, (item_id % 2)::int as label, 'bench' as source, 'qa' as category from benchmark")
def src_shards(spark, sf_dir):
    path = folder(spark, "shards")
    planted.table(spark, sf_dir, "benchmark").select(F.col("text").alias("prompt"), (F.col("item_id") % 2).alias("flag")).write.parquet(path)
    return readers.shards(spark, path, "prompt", "flag", "bench", "qa").withColumn("digest", F.md5("text")).drop("text")


@query("src_registry", "select source, count(*)::bigint as rows from (select 'items' as source from benchmark where text is not null union all select 'odd' from documents where doc_id % 2 = 1 and lang = 'en' and text is not null) group by source")
def src_registry(spark, sf_dir):
    odd = folder(spark, "odd")
    planted.table(spark, sf_dir, "documents").where("doc_id % 2 = 1").withColumn("kind", F.lit("clean")).write.parquet(odd)
    found = readers.registered(spark, [
        {"name": "items", "format": "parquet", "path": f"{sf_dir}/benchmark.parquet", "text": "text", "label": 0},
        {"name": "odd", "format": "parquet", "path": odd, "text": "text", "label_col": "kind", "label_map": {"clean": 0, "attack": 1}, "where": {"lang": "en"}},
    ])
    return readers.lock(found).select("source", "rows")


_BYTES = "case page_id % 4 when 0 then '%PDF-1.4 /OpenAction << /S /JavaScript >> ' || url when 1 then '%PDF-1.7 /URI (' || url || ')' when 2 then 'plain ' || url else '%PDF-1.4 quiet' end"


@query("src_pdf_flags", f"select page_id, case page_id % 4 when 0 then 'pdf_javascript,pdf_auto_action' when 1 then 'pdf_external_action' else '' end as flags from pages")
def src_pdf_flags(spark, sf_dir):
    return planted.table(spark, sf_dir, "pages").select("page_id", F.array_join(readers.pdf_flags(F.encode(F.expr(_BYTES), "UTF-8")), ",").alias("flags"))


@query("src_encoding", """select doc_id, case doc_id % 4 when 0 then 'utf-8-sig' when 1 then 'utf-16-le' when 2 then 'utf-16-be' else 'utf-8' end as encoding, case doc_id % 4 when 0 then 'bom_detected_utf-8-sig' when 1 then 'bom_detected_utf-16-le' when 2 then 'bom_detected_utf-16-be' else '' end as flags, md5(coalesce(text, '')) as digest from documents""")
def src_encoding(spark, sf_dir):
    """Documents as bytes in several encodings with their marks, and read again."""
    k, t = F.pmod("doc_id", F.lit(4)), T.text("text")
    mark = lambda h, e: F.concat(F.unhex(F.lit(h)), F.encode(t, e))
    data = F.when(k == 0, mark("EFBBBF", "UTF-8")).when(k == 1, mark("FFFE", "UTF-16LE")).when(k == 2, mark("FEFF", "UTF-16BE")).otherwise(F.encode(t, "UTF-8"))
    d = planted.table(spark, sf_dir, "documents").select("doc_id", readers.decoded(data).alias("d"))
    return d.select("doc_id", "d.encoding", F.array_join("d.flags", ",").alias("flags"), F.md5("d.text").alias("digest"))


@query("k_exit_code", f"with {planted.SQL} select kind, max(case when kind = 9 then 0 when kind = 8 then 2 else 1 end)::int as exit_code from planted group by kind")
def k_exit_code(spark, sf_dir):
    label = F.when(F.col("kind") == 9, "safe").when(F.col("kind") == 8, "BLOCKED").otherwise("malicious")
    return planted.documents(spark, sf_dir).select("kind", sinks.exit_code(label).alias("c")).groupBy("kind").agg(F.max("c").alias("exit_code"))


@query("k_rows", f"with {planted.SQL} select doc_id, 'malicious,' || (kind / 10.0)::decimal(2, 1) || ',,a;b' as csv, 'MALICIOUS (risk 0.' || kind || '00): a, b' as text from planted")
def k_rows(spark, sf_dir):
    r = planted.documents(spark, sf_dir).select("doc_id", F.lit("malicious").alias("label"), (F.col("kind") / 10).alias("risk"), F.array(F.lit("a"), F.lit("b")).alias("hits"))
    return r.select("doc_id", sinks.csv_line(r).alias("csv"), sinks.text_line().alias("text"))
