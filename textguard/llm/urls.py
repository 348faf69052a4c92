"""URL filter by path-template trees.

Per host, the tree of path segments is built from the top. Numbers and hexadecimal keys are wildcards; the children
of a node become one wildcard if they are many and rarely repeat; sibling branches merge if their labelled shares don't
differ significantly from those of the rest of their group. A template is rejected if its smoothed share of bad labels
is high.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import drop, written

#: Levels of the tree that the SQL spells out (the operator builds all), the children from which a node is variable, z of a
#: split and how often a group may split, weight of the overall share in the smoothed one, and the smoothed share from
#: which a template is rejected.
DEPTH, MANY, Z, ROUNDS, WEIGHT, REJECT = 4, 20, 1.96, 2, 5.0, 0.4

_HOST = r"^[a-z][a-z0-9+.-]*://([^/?#:]+)"
_PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"


def shapes(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds `host` and `shape`, the path segments with typed wildcards joined by '/'."""
    low = F.lower(F.coalesce(F.col(url_col), F.lit("")))
    segments = F.filter(F.split(F.regexp_extract(low, _PATH, 1), "/"), lambda s: s != "")
    typed = F.transform(
        segments,
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.concat(F.lit("<num>"), F.regexp_extract(s, r"(\.[a-z]+)?$", 0)))
        .when(s.rlike("^[0-9a-f]{8,}$"), F.lit("<hex>"))
        .otherwise(s),
    )
    return urls.withColumn("host", F.regexp_extract(low, _HOST, 1)).withColumn("shape", F.array_join(typed, "/"))


def templates(counted: DataFrame, many: int = MANY, z: float = Z, rounds: int = ROUNDS) -> DataFrame:
    """From (host, shape, n, labelled, bad): the same with `template`.

    The fixed children of a node begin as one group. In each of `rounds`, those whose share of bad labels is
    significantly above or below that of the rest of their group leave it upwards or downwards; an unlabelled child
    never does, so it can't tie two branches that differ. A group of several children is named by its smallest one and
    their number. All sums over a node are partial aggregations that join back: a host of very many URLs is no task of
    its own. Each level is written, since a level reads the one above twice and the plan would double with each.
    """
    tree = written(counted.withColumn("template", F.lit("")).withColumn("seg", F.split("shape", "/")), "tree")
    for k in range(tree.agg(F.max(F.size("seg"))).first()[0] or 0):
        above = tree
        tree = tree.withColumn("child", F.get("seg", F.lit(k)))
        at = ["host", "template", "child"]
        branch = tree.where("child is not null and child <> ''").groupBy(*at).agg(F.sum("n").alias("c_n"), F.sum("labelled").alias("c_l"), F.sum("bad").alias("c_b"))
        made = [written(branch.withColumn("fixed", ~F.col("child").startswith("<")), "branch")]
        of_node = made[0].groupBy("host", "template").agg(F.sum(F.col("fixed").cast("long")).alias("kinds"), F.sum(F.when(F.col("fixed"), F.col("c_n")).otherwise(0)).alias("all_n"))
        wild = F.col("fixed") & (F.col("kinds") >= many) & (F.col("kinds") * 2 >= F.col("all_n"))
        branch = made[0].join(of_node, ["host", "template"]).withColumn("wild", wild).withColumn("grp", F.when(F.col("fixed") & ~F.col("wild"), F.lit("")))
        group = ["host", "template", "grp"]
        for _ in range(rounds):
            made.append(written(branch, "branch"))
            sums = made[-1].where("grp is not null").groupBy(*group).agg(F.sum("c_l").alias("g_l"), F.sum("c_b").alias("g_b"))
            pool = (F.col("g_b") + 1.0) / (F.col("g_l") + 2.0)
            own, rest = F.col("c_l") + 1.0, F.col("g_l") - F.col("c_l") + 1.0
            apart = (F.col("c_b") + pool) / own - (F.col("g_b") - F.col("c_b") + pool) / rest
            most = z * F.sqrt(pool * (1.0 - pool) * (1.0 / own + 1.0 / rest))
            side = F.when(apart > most, F.lit("+")).when(apart < -most, F.lit("-")).otherwise(F.lit("="))
            branch = made[-1].join(sums, group, "left").withColumn("grp", F.concat("grp", side)).drop("g_l", "g_b")
        made.append(written(branch, "branch"))
        names = made[-1].where("grp is not null").groupBy(*group).agg(F.min("child").alias("least"), F.count("*").alias("size"))
        merged = F.when(F.col("size") == 1, F.col("least")).otherwise(F.concat("least", F.lit("|+"), (F.col("size") - 1).cast("string")))
        name = F.when(F.col("wild"), F.lit("*")).when(F.col("grp").isNotNull(), merged).otherwise(F.col("child"))
        named = made[-1].join(names, group, "left").select(*at, name.alias("name"))
        longer = F.when(F.col("name").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.col("name")))
        tree = written(tree.join(named, at, "left").withColumn("template", F.concat("template", longer)).drop("name", "child"), "tree")
        for t in (above, *made):
            drop(t)
    return tree.drop("seg")


def judge_urls(urls: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", many: int = MANY, z: float = Z, rounds: int = ROUNDS, weight: float = WEIGHT, reject: float = REJECT) -> DataFrame:
    """(page_id, url, host, template, share, rejected): the template of every URL, its smoothed share of bad labels,
    and whether it is rejected.

    `labels` has (label_id, bad): a URL's label is that of the number that its path ends with; several labels of one
    number count as bad if one is. share = (bad + weight * overall share) / (labelled + weight).

    A null URL, or one without scheme and host, has host '' and template ''; URLs of one host without a path share
    template ''. Repeated rows count each and are returned each. Without labels the overall share is 0 and nothing is
    rejected; an empty table gives an empty one; other columns aren't read.
    """
    own = shapes(urls.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")), "url")
    low = F.lower(F.coalesce(F.col("url"), F.lit("")))
    number = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$", 1)
    own = own.withColumn("number", F.when(number != "", number.cast("long")))
    known = labels.where("label_id is not null and bad is not null").groupBy(F.col("label_id").cast("long").alias("l_")).agg(F.max(F.col("bad").cast("long")).alias("bad_"))
    marked = own.join(known, F.col("number") == F.col("l_"), "left")
    counted = marked.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad_").alias("labelled"), F.coalesce(F.sum("bad_"), F.lit(0).cast("long")).alias("bad"))
    tree = templates(counted, many, z, rounds)
    bad, labelled = tree.agg(F.sum("bad"), F.sum("labelled")).first()
    per = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l_t"), F.sum("bad").alias("b_t"))
    shares = per.select(F.col("host").alias("h_"), F.col("template").alias("t_"), ((F.col("b_t") + weight * (bad / labelled if labelled else 0.0)) / (F.col("l_t") + weight)).alias("share"))
    found = tree.select("host", "shape", "template").join(shares, (F.col("host") == F.col("h_")) & (F.col("template") == F.col("t_"))).select(F.col("host").alias("h_"), F.col("shape").alias("s_"), "template", "share")
    return own.join(found, (F.col("host") == F.col("h_")) & (F.col("shape") == F.col("s_"))).select("page_id", "url", "host", "template", F.round("share", 6).alias("share"), (F.col("share") >= reject).alias("rejected"))


def _levels(depth: int, many: int, z: float, rounds: int) -> str:
    def groups(k: int) -> str:
        steps = []
        for r in range(rounds):
            steps.append(f"""p{k}_{r} as (select *, sum(c_l) over v as g_l, sum(c_b) over v as g_b, (sum(c_b) over v + 1.0::double) / (sum(c_l) over v + 2.0::double) as pool
    from g{k}_{r} window v as (partition by host, tpl, grp)),
  d{k}_{r} as (select *, (c_b + pool) / (c_l + 1.0::double) - (g_b - c_b + pool) / (g_l - c_l + 1.0::double) as apart,
    {z}::double * sqrt(pool * (1.0::double - pool) * (1.0::double / (c_l + 1.0::double) + 1.0::double / (g_l - c_l + 1.0::double))) as most from p{k}_{r}),
  g{k}_{r + 1} as (select * exclude (grp, g_l, g_b, pool, apart, most), grp || case when apart > most then '+' when apart < -most then '-' else '=' end as grp from d{k}_{r}),""")
        return "\n  ".join(steps)

    out = []
    for k in range(depth):
        src = "counted" if not k else f"t{k}"
        out.append(f"""
  c{k + 1} as (select *, {"''" if not k else "template"} as tpl, seg[{k + 1}] as child from {src}),
  b{k + 1} as (select host, tpl, child, sum(n) c_n, sum(labelled) c_l, sum(bad) c_b, not starts_with(child, '<') as fixed
    from c{k + 1} where child is not null and child <> '' group by all),
  k{k + 1} as (select *, sum(fixed::int) over w as kinds, sum(case when fixed then c_n else 0 end) over w as all_n from b{k + 1} window w as (partition by host, tpl)),
  w{k + 1} as (select *, fixed and kinds >= {many} and kinds * 2 >= all_n as wild from k{k + 1}),
  g{k + 1}_0 as (select *, case when fixed and not wild then '' end as grp from w{k + 1}),
  {groups(k + 1)}
  n{k + 1} as (select host, tpl, child, case when wild then '*' when grp is null then child when count(*) over v = 1 then child
    else min(child) over v || '|+' || (count(*) over v - 1) end as name from g{k + 1}_{rounds} window v as (partition by host, tpl, grp)),
  t{k + 1} as (select c.host, c.shape, c.n, c.labelled, c.bad, c.seg, c.tpl || case when x.name is null then '' else '/' || x.name end as template
    from c{k + 1} c left join n{k + 1} x on c.host = x.host and c.tpl = x.tpl and c.child = x.child)""")
    return ",".join(out)


def oracle(depth: int = DEPTH, many: int = MANY, z: float = Z, rounds: int = ROUNDS, weight: float = WEIGHT, reject: float = REJECT) -> str:
    """DuckDB SQL for judge_urls over pages and labels (bad: low quality or toxic)."""
    path = _PATH.replace("'", "''")
    return f"""
with known as (select doc_id as l_, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad_ from labels where doc_id is not null group by 1),
  low as (select page_id, url, lower(coalesce(url, '')) as u from pages),
  seg0 as (select *, regexp_extract(u, '{_HOST}', 1) as host, list_filter(string_split(regexp_extract(u, '{path}', 1), '/'), lambda s: s <> '') as segs,
    regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?([0-9]{{1,18}})(?:\\.[a-z]+)?/?(?:[?#].*)?$', 1) as num from low),
  seg1 as (select *, list_transform(segs, lambda s: case when regexp_full_match(s, '[0-9]+(\\.[a-z]+)?') then '<num>' || regexp_extract(s, '(\\.[a-z]+)?$', 0)
    when regexp_full_match(s, '[0-9a-f]{{8,}}') then '<hex>' else s end) as typed from seg0),
  own as (select page_id, url, host, case when len(typed) > {depth} then list_concat(typed[1:{depth - 1}], ['**']) else typed end as seg, try_cast(nullif(num, '') as bigint) as number from seg1),
  marked as (select own.*, array_to_string(seg, '/') as shape, bad_ from own left join known on number = l_),
  counted as (select host, shape, any_value(seg) as seg, count(*) as n, count(bad_) as labelled, coalesce(sum(bad_), 0) as bad from marked group by host, shape),
  {_levels(depth, many, z, rounds)},
  total as (select sum(bad)::double / nullif(sum(labelled), 0) as overall from t{depth}),
  per as (select host, template, (sum(bad) + {weight}::double * coalesce(max(overall), 0)) / (sum(labelled) + {weight}::double) as share from t{depth}, total group by host, template)
select m.page_id, m.url, m.host, t.template, round(p.share, 6) as share, p.share >= {reject}::double as rejected
from marked m join t{depth} t on m.host = t.host and m.shape = t.shape join per p on p.host = t.host and p.template = t.template
"""
