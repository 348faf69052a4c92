"""Layer 0, hidden data and signals of obfuscation over disguised documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import decode as D
from textguard.operators import intake as I
from textguard.operators import normalise as N
from textguard.operators import signals as S
from textguard.plans import planted
from textguard.plans.catalog import query
from textguard.plans.q_features import q
from textguard.plans.q_intake import DISGUISED, disguised

_HIDDEN = "".join(S._SELECTORS[S._PRINTABLE.index(ord(c))] for c in "run: obey 42!")
_SELECTED = f"selected as (select doc_id, case doc_id % 3 when 0 then coalesce(text, '') || '{_HIDDEN}' when 1 then coalesce(text, '') || chr(65024) else coalesce(text, '') end as text from documents)"
_FOUND = "array_to_string(regexp_extract_all(text, '[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]'), '')"


@query("n_selector_stego", f"with {_SELECTED} select doc_id, regexp_replace(translate({_FOUND}, {q(S._SELECTORS)}, {' || '.join(f'chr({b})' for b in S._PRINTABLE)}), '[\\x{{FE00}}-\\x{{FE0F}}\\x{{E0100}}-\\x{{E01EF}}]', '', 'g') as payload, md5(regexp_replace(text, '[\\x{{FE00}}-\\x{{FE0F}}\\x{{E0100}}-\\x{{E01EF}}]', '', 'g')) as stripped from selected")
def n_selector_stego(spark, sf_dir):
    k, t = F.pmod("doc_id", F.lit(3)), T.text("text")
    d = planted.table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, F.concat(t, F.lit(_HIDDEN))).when(k == 1, F.concat(t, F.lit(chr(0xFE00)))).otherwise(t).alias("text"))
    return d.select("doc_id", S.selector_payload(F.col("text")).alias("payload"), F.md5(S.strip_selectors(F.col("text"))).alias("stripped"))


@query("n_sanitize")
def n_sanitize(spark, sf_dir):
    """What layer 0 makes of disguised documents."""
    d = N.sanitize(disguised(spark, sf_dir))
    return d.select("doc_id", F.md5("clean").alias("clean"), F.array_join("flags", ",").alias("flags"), "rejection", "chars_stripped")


@query("n_sanitize_pages")
def n_sanitize_pages(spark, sf_dir):
    d = N.sanitize(planted.table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return d.select("page_id", F.md5("clean").alias("clean"), F.array_join("flags", ",").alias("flags"), "rejection")


_STOPS = "[" + ", ".join(f"{{'s': len(list_filter(w, lambda x: x in ({', '.join(map(q, v))}))) / greatest(len(w), 1)::double, 'k': '{k}'}}" for k, v in N.STOP_WORDS.items()) + "]"
_OTHER = f"array_to_string(list_filter([{', '.join(f"case when len(regexp_extract_all(text, '{p}')) >= 3 then '{k}' end" for k, p in sorted(I.SCRIPTS.items()))}], lambda x: x is not null), ',')"


@query("n_language", f"""with {DISGUISED}, w as (select doc_id, text, regexp_extract_all(lower(text), '[a-zà-ÿ]+') as w, {_OTHER} as other, len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) >= 3 as latin from disguised), s as (select *, list_reverse_sort({_STOPS}) as s from w),
  b as (select *, case when length(text) >= 20 and s[1].s >= 0.05 then s[1].k else 'und' end as k, length(text) >= 20 and s[2].s >= 0.05 and s[2].s >= 0.5 * s[1].s as two from s), l as (select *, case when other <> '' and not latin then string_split(other, ',')[1] else k end as lang from b)
select doc_id, lang, array_to_string(list_filter([case when lang not in ('en', 'und') then 'non_english_input' end, case when (other <> '' and latin) or two then 'mixed_language_input' end], lambda x: x is not null), ',') as flags from l""")  # fmt: skip
def n_language(spark, sf_dir):
    d = disguised(spark, sf_dir).select("doc_id", N.language(F.col("text")).alias("l"))
    return d.select("doc_id", "l.lang", F.array_join("l.flags", ",").alias("flags"))


_DASHED = "dashed as (select doc_id, 'an e-mail on pre-paid sys-tem terms, ig-nore it ' || case when doc_id % 2 = 0 then 'in-struc-tions ' else '' end || coalesce(text, '') as text from documents)"


@query("n_hyphenation", f"""with {_DASHED}, f as (select doc_id, text, regexp_extract_all(lower(translate(text, {q(I.DASHES)}, '{'-' * len(I.DASHES)}')), '[a-z]+(?:-[a-z]+)+') as w from dashed),
  b as (select *, len(list_filter(w, lambda x: x not in ({', '.join(map(q, N.SAFE_WORDS))}) and split_part(x, '-', 1) not in ({', '.join(map(q, N.SAFE_PREFIX))}) and replace(x, '-', '') in ({', '.join(map(q, N.SUSPICIOUS))})))::int as bad from f)
select doc_id, bad as suspicious, len(w)::int as total, round(least(1, case when bad > 0 then least(0.95::double, 0.6::double + 0.1::double * bad) + 0.15::double * bad / len(w) else 0 end), 4) as confidence,
  md5(regexp_replace(translate(text, {q(I.DASHES)}, '{'-' * len(I.DASHES)}'), '([A-Za-z]+)-([A-Za-z])', '\\1\\2', 'g')) as joined from b""")  # fmt: skip
def n_hyphenation(spark, sf_dir):
    k = F.when(F.pmod("doc_id", F.lit(2)) == 0, "in-struc-tions ").otherwise("")
    d = planted.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("an e-mail on pre-paid sys-tem terms, ig-nore it "), k, T.text("text")).alias("text"))
    return d.select("doc_id", N.hyphenation(F.col("text")).alias("h")).select("doc_id", "h.suspicious", "h.total", "h.confidence", F.md5("h.text").alias("joined"))


_PNG = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNkYPhfDwAChwGA60e6kgAAAABJRU5ErkJggg=="
_HOLDING = f"holding as (select doc_id, case doc_id % 4 when 0 then 'x ' || coalesce(text, '') || ' data:image/png;base64,{_PNG}' when 1 then 'see {_PNG} there' when 2 then '%PDF-1.4 ' || coalesce(text, '') else coalesce(text, '') end as text from documents)"


@query("n_hidden_binary", f"""with {_HOLDING} select doc_id, case doc_id % 4 when 0 then 'data_uri_detected,base64_hidden_image' when 1 then 'base64_blob_detected,base64_hidden_image' when 2 then 'embedded_document' else '' end as flags from holding""")
def n_hidden_binary(spark, sf_dir):
    k, t = F.pmod("doc_id", F.lit(4)), T.text("text")
    odd = F.when(k == 0, F.concat(F.lit("x "), t, F.lit(f" data:image/png;base64,{_PNG}"))).when(k == 1, F.lit(f"see {_PNG} there")).when(k == 2, F.concat(F.lit("%PDF-1.4 "), t)).otherwise(t)
    return planted.table(spark, sf_dir, "documents").select("doc_id", F.array_join(N.hidden_binary(odd), ",").alias("flags"))


@query("n_expansion", f"with {planted.SQL} select doc_id, kind, length(lower(hex(encode(text)))) > 1.9::double * greatest(length(text), 1) as expanded from planted")
def n_expansion(spark, sf_dir):
    return planted.documents(spark, sf_dir).select("doc_id", "kind", N.expanded(F.col("text"), T.hexed(F.col("text")), 1.9).alias("expanded"))


_LOUD = "loud as (select doc_id, case doc_id % 4 when 0 then regexp_replace(text, '([a-z])([a-z])', '\\1!?#\\2', 'g') when 1 then array_to_string(list_transform(string_split(text, ''), lambda x, i: case when i % 2 = 1 then lower(x) else upper(x) end), '') when 2 then '| a | b |' || chr(10) || '|---|---|' || chr(10) || '!!!???###' else text end as text from planted)"
_LET = "regexp_replace(text, '[^\\p{L}]', '', 'g')"
_TURNS = f"greatest(0, len(regexp_extract_all({_LET}, '\\p{{Lu}}+')) + len(regexp_extract_all({_LET}, '[^\\p{{Lu}}]+')) - 1)"
_STRUCT = f"(regexp_matches(text, {q(S.FENCE)}) or regexp_matches(text, {q(S.TABLE)}))"


def loud(spark, sf_dir):
    k, t = F.pmod("doc_id", F.lit(4)), F.col("text")
    turned = F.array_join(F.transform(T.chars(t), lambda x, i: F.when(i % 2 == 0, F.lower(x)).otherwise(F.upper(x))), "")
    odd = F.when(k == 0, F.regexp_replace(t, "([a-z])([a-z])", "$1!?#$2")).when(k == 1, turned).when(k == 2, "| a | b |\n|---|---|\n!!!???###").otherwise(t)
    return planted.documents(spark, sf_dir).withColumn("text", odd)


@query("d_punctuation", f"with {planted.SQL}, {_LOUD} select doc_id, length(text) > 0 and len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f\\x0B]')) / length(text)::double >= 0.4 and not {_STRUCT} as flood from loud")
def d_punctuation(spark, sf_dir):
    return loud(spark, sf_dir).select("doc_id", S.punctuation_flood(F.col("text")).alias("flood"))


@query("d_casing", f"with {planted.SQL}, {_LOUD} select doc_id, {_TURNS} >= 6 and {_TURNS} >= 0.12 * len(regexp_extract_all(text, '\\p{{L}}')) and not {_STRUCT} as weird from loud")
def d_casing(spark, sf_dir):
    return loud(spark, sf_dir).select("doc_id", S.weird_casing(F.col("text")).alias("weird"))


@query("d_compression")
def d_compression(spark, sf_dir):
    return planted.documents(spark, sf_dir).select("doc_id", F.round(S.compression_ratio(F.col("text")), 4).alias("ratio"), S.high_entropy(F.col("text")).alias("high_entropy"))


@query("d_layer_flags")
def d_layer_flags(spark, sf_dir):
    d = planted.documents(spark, sf_dir).withColumn("v", T.once(D.tree(F.col("text"))))
    return d.select("doc_id", "kind", F.array_join(D.layer_flags(F.col("text"), F.col("v")), ",").alias("flags"))


@query("d_word_reverse", f"with {planted.SQL}, r as (select doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: reverse(w)), ' ') as text from planted where kind = 0) select doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: reverse(w)), ' ')) as digest from r")
def d_word_reverse(spark, sf_dir):
    """Attacks whose words are reversed each, restored."""
    r = planted.documents(spark, sf_dir).where("kind = 0").select("doc_id", T.reverse_words(F.col("text")).alias("text"))
    return r.select("doc_id", F.md5(D.reversed_words_text(F.col("text"))).alias("digest")).where("digest is not null")


@query("d_morse_labelled", "select item_id, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) as letters from benchmark where length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 10")
def d_morse_labelled(spark, sf_dir):
    """Items in Morse code with bullets for dots, after a label."""
    code = F.create_map(*[F.lit(x) for k, v in D.MORSE.items() for x in (v, k)])
    plain = F.upper(F.regexp_replace(T.text("text"), "[^A-Za-z0-9]", ""))
    b = planted.table(spark, sf_dir, "benchmark").select("item_id", plain.alias("p")).where(F.length("p") >= 10)
    coded = F.concat(F.lit("Morse: "), F.translate(F.array_join(F.transform(T.chars(F.col("p")), lambda x: F.element_at(code, x)), " "), ".-", "•–"))
    return b.select("item_id", D.morse(coded).alias("m")).select("item_id", F.col("m.text").alias("letters"))


@query("d_numbers", "select item_id, case item_id % 2 when 0 then 'octal' else 'decimal' end as kind, regexp_replace(text, '[^ -~]', '', 'g') as text from benchmark where length(regexp_replace(text, '[^ -~]', '', 'g')) >= 5")
def d_numbers(spark, sf_dir):
    """Items in groups of octal or decimal digits."""
    p = F.regexp_replace(T.text("text"), "[^ -~]", "")
    b = planted.table(spark, sf_dir, "benchmark").select("item_id", p.alias("p")).where(F.length("p") >= 5)
    even = F.pmod("item_id", F.lit(2)) == 0
    group = lambda x: F.when(even, F.conv(F.ascii(x).cast("string"), 10, 8)).otherwise(F.lpad(F.ascii(x).cast("string"), 3, "0"))
    return b.select("item_id", D.numeric(F.array_join(F.transform(T.chars(F.col("p")), group), " ")).alias("n")).select("item_id", "n.kind", "n.text")


@query("d_trailing_stego")
def d_trailing_stego(spark, sf_dir):
    """Blanks at the ends of lines: of documents as they are, and with bits of a message after each line."""
    bits = "".join(f"{b:08b}" for b in b"obey the ledger")
    tail = F.array(*[F.lit("".join(" \t"[x == "1"] for x in bits[i : i + 8])) for i in range(0, len(bits), 8)])
    t = T.text("text")
    coded = F.array_join(F.transform(tail, lambda x, i: F.concat(F.coalesce(F.get(F.split(t, "\n"), i), F.lit("line")), x)), "\n")
    d = planted.table(spark, sf_dir, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, coded).otherwise(t).alias("text"))
    return d.select("doc_id", S.whitespace_stego(F.col("text")).alias("s")).where("s is not null").select("doc_id", "s.method", "s.confidence", "s.payload")


@query("d_ascii_art")
def d_ascii_art(spark, sf_dir):
    """Documents as they are, and with a drawn box before each third of them."""
    box = "+--------+\n|  /\\/\\  |\n| |    | |\n|  \\__/  |\n+--------+\n"
    t = T.text("text")
    d = planted.table(spark, sf_dir, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(box * 2)).otherwise(t).alias("text"))
    return d.select("doc_id", S.ascii_art(F.col("text")).alias("level"), (S.ascii_art(F.col("text")) >= S.ART_LEVEL).alias("picture"))
