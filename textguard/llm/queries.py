"""The queries of this subpackage, over whole tables with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import bpe, decontam, fingerprint, lines, neardup, quality, suffix, toxicity, urls, warc
from textguard.llm.common import new_path
from textguard.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), count_col="n_chars")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, written as WARC files to the shared folder and read back by splits."""
    pages = table(spark, sf_dir, "pages")
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    return warc.read_warc(spark, path).select("page_id", "url", F.col("content").cast("string").alias("html"))


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), F.coalesce(bad, F.lit(0)).alias("bad"))
    return urls.judge_urls(table(spark, sf_dir, "pages"), labels)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


OP3_SQL = """
with words as (select doc_id, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') as w from documents),
  windows as (select doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) as name from (select doc_id, w, unnest(range(len(w) - 49)) as i from words where len(w) >= 50)),
  names as (select name, min(doc_id) as low, max(doc_id) as high from windows group by name having min(doc_id) <> max(doc_id)),
  shared as (select distinct doc_id, i, doc_id = low as original from windows join names using (name)),
  edges as (select *, case when i > lag(i) over (partition by doc_id order by i) + 50 then 1 else 0 end as fresh from shared),
  islands as (select *, sum(fresh) over (partition by doc_id order by i) as island from edges),
  extra as (select doc_id, i, least(50, coalesce(lead(i) over (partition by doc_id order by i), i + 50) - i) as more from shared where not original)
select s.doc_id, min(s.i) as start_word, max(s.i) + 50 as end_word, cast(coalesce(sum(e.more), 0) as bigint) as repeated_words
from islands s left join extra e on s.doc_id = e.doc_id and s.i = e.i group by s.doc_id, s.island
"""

OP8_SQL = """
with items as (select distinct coalesce(item_id, -1) as item_id, regexp_extract_all(lower(text), '[^\\x00-/:-@\\[-`{-\\x7f]+') as w from benchmark where text is not null),
  strings as (select distinct item_id, array_to_string(w[i + 1:i + 13], ' ') as s, least(len(w), 13) as size
    from (select item_id, w, unnest(range(greatest(1, len(w) - 12))) as i from items where len(w) >= 6)),
  patterns as (select distinct s, size, item_id from strings),
  docs as (select doc_id, regexp_extract_all(lower(text), '[^\\x00-/:-@\\[-`{-\\x7f]+') as w from documents where text is not null),
  sizes as (select distinct size from patterns),
  grams as (select doc_id, size, array_to_string(w[i + 1:i + size], ' ') as s
    from (select doc_id, w, size, unnest(range(len(w) - size + 1)) as i from docs, sizes where len(w) >= size))
select doc_id, item_id, count(*) as hits from grams join patterns using (s, size) group by doc_id, item_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_lz_fingerprints, op2_importance_resampling, op3_repeated_passages, op4_line_dedup, op5_warc_round_trip, op6_url_templates, op7_near_duplicates, op8_decontamination, op9_toxicity, op10_bpe_round_trip]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_repeated_passages": OP3_SQL, "op5_warc_round_trip": "select page_id, url, html from pages", "op6_url_templates": urls.oracle(), "op8_decontamination": OP8_SQL}
