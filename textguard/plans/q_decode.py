"""Decoders over the planted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import decode as D
from textguard.plans import planted
from textguard.plans.catalog import query
from textguard.plans.q_features import q

_BARE = r"regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g')"


def kinds_sql(t: str) -> str:
    return f"len(list_distinct(regexp_extract_all(lower({t}), {q(D.KEYWORDS)})))"


def _telling_sql(d: str) -> str:
    return f"case when length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 10 and {kinds_sql(d)} >= 2 and {kinds_sql('text')} < 2 then {d} end"


_URL = "try(url_decode(replace(text, '+', ' ')))"
_UNLEET = f"translate(text, {q(T.LEET_FROM)}, {q(T.LEET_TO)})"
_SOLID = r"length(regexp_replace(text, '[ \t\n\r\f\x0B]', '', 'g'))"
#: The decoded text of each decoder, of a column `text`.
DECODED = {
    "base64": f"case when length({_BARE}) >= 16 and length({_BARE}) % 4 = 0 and regexp_full_match({_BARE}, '[A-Za-z0-9+/]+={{0,2}}') then try(decode(from_base64({_BARE}))) end",
    "hex": f"case when length({_BARE}) >= 8 and length({_BARE}) % 2 = 0 and regexp_full_match({_BARE}, '[0-9a-fA-F]+') then try(decode(unhex({_BARE}))) end",
    "url": f"case when regexp_matches(text, '%[0-9A-Fa-f]{{2}}') and {_URL} <> text then {_URL} end",
    "rot13": _telling_sql(f"translate(text, '{T.ROT_FROM}', '{T.ROT_TO}')"),
    "reversed": _telling_sql("reverse(text)"),
    "leet": f"case when {_SOLID} >= 10 and len(regexp_extract_all(text, '{D.LEET_SYMBOL}')) >= 0.1::double * {_SOLID} then {_telling_sql(_UNLEET)} end",
}


def _register(name: str) -> None:
    @query(f"d_{name}", f"with {planted.SQL} select doc_id, payload from (select doc_id, {DECODED[name]} as payload from planted) where payload is not null")
    def run(spark, sf_dir):
        d = planted.documents(spark, sf_dir).select("doc_id", D.DECODERS[name](F.col("text")).alias("payload"))
        return d.where(F.col("payload").isNotNull())


for _name in D.DECODERS:
    _register(_name)

_SHARES = ", ".join(f"{f}::double" for f in T.ENGLISH)


@query("d_kl", f"""with {planted.SQL}, l as (select doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') as t from planted), f as (select [{_SHARES}] as f)
select doc_id, case when length(t) < 5 then 0.0::double else round(greatest(0, list_sum(list_transform(range(26), lambda k: ((length(t) - length(replace(t, chr((97 + k)::int), '')) + 0.5::double) / (length(t) + 13.0::double))
  * log2((length(t) - length(replace(t, chr((97 + k)::int), '')) + 0.5::double) / (length(t) + 13.0::double) / (f[k + 1] / list_sum(f)))))), 6) end as kl from l, f""")  # fmt: skip
def d_kl(spark, sf_dir):
    return planted.documents(spark, sf_dir).select("doc_id", F.round(T.kl_english(F.col("text")), 6).alias("kl"))


@query("d_morse", "select item_id, upper(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) as payload from benchmark where length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 10")
def d_morse(spark, sf_dir):
    """The benchmark's items, put into Morse code and read again."""
    code = F.create_map(*[F.lit(x) for k, v in D.MORSE.items() for x in (v, k)])
    plain = F.upper(F.regexp_replace(T.text("text"), "[^A-Za-z0-9 ]", ""))
    b = planted.table(spark, sf_dir, "benchmark").select("item_id", plain.alias("plain")).where(F.length(F.replace("plain", F.lit(" "), F.lit(""))) >= 10)
    coded = F.array_join(F.transform(F.split("plain", " "), lambda w: F.array_join(F.transform(T.chars(w), lambda x: F.element_at(code, x)), " ")), " / ")
    return b.select("item_id", D.morse_text(coded).alias("payload"))


@query("d_numeric", "select item_id, regexp_replace(text, '[^ -~]', '', 'g') as payload from benchmark where length(regexp_replace(text, '[^ -~]', '', 'g')) >= 5")
def d_numeric(spark, sf_dir):
    """The ASCII of the benchmark's items, written in binary groups and read again."""
    plain = F.regexp_replace(T.text("text"), "[^ -~]", "")
    b = planted.table(spark, sf_dir, "benchmark").select("item_id", plain.alias("plain")).where(F.length("plain") >= 5)
    coded = F.array_join(F.transform(T.chars(F.col("plain")), lambda x: F.lpad(F.bin(F.ascii(x)), 8, "0")), " ")
    return b.select("item_id", D.binary_text(coded).alias("payload"))


_LAYERED = "layered as (select doc_id, case doc_id % 4 when 0 then to_base64(encode(lower(hex(encode(text))))) when 1 then to_base64(encode(to_base64(encode(text)))) else text end as text from planted)"

def peel_sql(results) -> str:
    """The result of the first decoder that applies."""
    return "case " + " ".join(f"when coalesce({v}, '') <> '' then {r}" for v, r in zip(DECODED.values(), results, strict=True)) + " end"


@query("d_unwrap", f"""with recursive {planted.SQL}, {_LAYERED}, peeled as (select doc_id, 0 as depth, ''::varchar as chain, text, [text] as seen from layered
  union all select doc_id, depth + 1, case when depth = 0 then enc else chain || ',' || enc end, new, list_append(seen, new) from (
    select *, {peel_sql(map(q, DECODED))} as enc, {peel_sql(DECODED.values())} as new from peeled where depth < {D.DEPTH}) where new is not null and not list_contains(seen, new) and length(new) <= 10 * length(seen[1]))
select doc_id, arg_max(chain, depth) as chain, max(depth)::bigint as depth, md5(arg_max(text, depth)) as inner_md5 from peeled group by doc_id""")  # fmt: skip
def d_unwrap(spark, sf_dir):
    k, t = F.pmod("doc_id", F.lit(4)), F.col("text")
    d = planted.documents(spark, sf_dir).select("doc_id", F.when(k == 0, T.b64(T.hexed(t))).when(k == 1, T.b64(T.b64(t))).otherwise(t).alias("text"))
    u = d.select("doc_id", T.once(D.unwrap(t)).alias("u"))
    return u.select("doc_id", F.array_join("u.chain", ",").alias("chain"), F.size("u.chain").cast("long").alias("depth"), F.md5("u.text").alias("inner_md5"))


_READ = "length(regexp_replace(b, '[^\\x20-\\x7E\\n\\r\\t]', '', 'g'))"
_B64_BLOCKS = "list_transform(list_transform(regexp_extract_all(text, '[A-Za-z0-9+/]{20,}={0,2}'), lambda b: rtrim(b, '=')), lambda b: try(decode(from_base64(rpad(b, (ceil(length(b) / 4.0) * 4)::int, '=')))))"
_HEX_BLOCKS = "list_transform(list_filter(regexp_extract_all(text, '[0-9a-fA-F]{16,}'), lambda b: length(b) % 2 = 0), lambda b: try(decode(unhex(b))))"
_KEPT = f"lambda b: b is not null and {_READ} >= 3 and {_READ} > length(b) * 0.7"
_WORDS_BACK = _telling_sql("array_to_string(list_transform(string_split(text, ' '), lambda w: reverse(w)), ' ')")


def _one(enc: str, value: str) -> str:
    return f"case when coalesce({value}, '') <> '' then [{{'enc': '{enc}', 'text': {value}}}] else [] end"


def _inner(enc: str, blocks: str) -> str:
    return f"case when coalesce({DECODED[enc]}, '') <> '' then [{{'enc': '{enc}', 'text': {DECODED[enc]}}}] else list_transform(list_filter({blocks}, {_KEPT}), lambda b: {{'enc': '{enc}', 'text': b}}) end"


_PAIRS = f"list_concat(list_concat(list_concat(list_concat(list_concat(list_concat({_inner('base64', _B64_BLOCKS)}, {_inner('hex', _HEX_BLOCKS)}), {_one('url_encoded', DECODED['url'])}), {_one('rot13', DECODED['rot13'])}), {_one('full_reverse', DECODED['reversed'])}), {_one('word_reverse', _WORDS_BACK)}), {_one('leetspeak', DECODED['leet'])})"
#: The decode tree of a table `clean`; its texts hold no Morse code, no number groups and no labels.
TREE_SQL = f"""tree as (select doc_id, 0 as depth, ''::varchar as path, ''::varchar as enc, text, [md5(text)] as seen, length(text) as n0 from clean
  union all select doc_id, depth + 1, path || chr((96 + i)::int), enc || case when enc = '' then '' else ',' end || p.enc, p.text, list_append(seen, md5(p.text)), n0 from (select doc_id, depth, path, enc, seen, n0, unnest(pairs) as p, generate_subscripts(pairs, 1) as i from (select *, {_PAIRS} as pairs from tree where depth < {D.DEPTH} and not list_contains(seen[:-2], seen[-1])))
    where length(p.text) <= {D.GROWTH} * greatest(n0, 1) and length(trim(p.text, ' ')) >= 2)"""
VIEWS_SQL = f"views as (select doc_id, path, enc, text from tree where depth > 0 qualify row_number() over (partition by doc_id order by path) <= {D.BUDGET})"


@query("d_tree", f"with recursive {planted.SQL}, {_LAYERED}, clean as (select doc_id, text from layered), {TREE_SQL}, {VIEWS_SQL} select doc_id, enc, md5(text) as digest from views")
def d_tree(spark, sf_dir):
    k, t = F.pmod("doc_id", F.lit(4)), F.col("text")
    d = planted.documents(spark, sf_dir).select("doc_id", F.when(k == 0, T.b64(T.hexed(t))).when(k == 1, T.b64(T.b64(t))).otherwise(t).alias("text"))
    # explode_outer, since explode infers a filter that would make the tree a second time
    return d.select("doc_id", F.explode_outer(D.tree(t)).alias("v")).where("v is not null").select("doc_id", "v.enc", F.md5("v.text").alias("digest"))
