"""Layer 0: a text as the later stages should read it, and what its making found."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textguard.functions import text as T
from textguard.operators import intake as I
from textguard.operators import signals as S
from textguard.sources.markup import visible_text

COMPATIBLE, INVISIBLE = 0.25, 2
_PLAIN = r"^[\x00-\x7F]*\z"
_HIDDEN = "[\\x{E0001}-\\x{E007F}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]"  # tags and selectors
_BROKEN = re.compile("[Â-ô][\u0080-¿]")
_REPAIR = Ty.StructType().add("text", Ty.StringType()).add("repaired", Ty.BooleanType()).add("compatible", Ty.BooleanType())


def repaired(t: str) -> tuple[str, bool, bool]:
    """(text, whether it was UTF-8 read as Latin-1, whether more than a quarter of its characters had a compatibility
    form): the text put right and in NFKC."""
    fixed = t
    if _BROKEN.search(t):
        try:
            fixed = t.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            fixed = t
    new = unicodedata.normalize("NFKC", fixed)
    many = new != fixed and sum(fixed.count(c) for c in set(fixed) if unicodedata.normalize("NFKC", c) != c) > COMPATIBLE * len(fixed)
    return new, fixed != t, many


def _repairs(texts: pa.Array) -> pa.Array:
    rows = [repaired(t) if t else (t, False, False) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.bool_(), pa.bool_()))], names=["text", "repaired", "compatible"])


def repair(c: Column) -> Column:
    """struct(text, repaired, compatible); ASCII texts aren't sent to Python."""
    plain = c.rlike(_PLAIN)
    found = F.arrow_udf(_repairs, _REPAIR)(F.when(plain, "").otherwise(c))
    return F.struct(F.when(plain, c).otherwise(found.text).alias("text"), (~plain & found.repaired).alias("repaired"), (~plain & found.compatible).alias("compatible"))


def looks_like_html(c: Column) -> Column:
    return c.rlike(r"(?i)^[ \t\r\n]*(?:<!doctype html|<html)|<(?:div|span|p|a|script|style|body|table|img|br|input|form|iframe)[ />]")


def cleaned(c: Column) -> Column:
    """The text after look-alikes, hidden payloads, selectors, invisible characters and spaces, in this order; what
    was hidden in tags and selectors stands on lines of its own at the end."""
    def of(t: Column) -> Column:
        extra = F.concat(*[F.when(p != "", F.concat(F.lit("\n"), p)).otherwise("") for p in (I.tag_payload(t), S.selector_payload(t))])
        whole = F.when(t.rlike(_HIDDEN), F.concat(S.strip_selectors(t), extra)).otherwise(t)
        return T.let(T.let(whole, I.strip_invisible), I.canonical_spaces)

    return F.when(c.rlike(r"^[\x20-\x7E\n]*\z"), I.canonical_spaces(c)).otherwise(T.let(I.fold_lookalikes(c), of))


def sanitize(df: DataFrame, text_col: str = "text", html: bool = True) -> DataFrame:
    """Adds clean, flags, rejection and chars_stripped.

    Rejected rows, among them null, blank, oversized and too deeply nested ones and those that nothing is left of, stay
    with a null in `clean`. Markup is read as its visible text if `html`.
    """
    raw = F.col(text_col)
    why = F.coalesce(I.rejection(raw), I.guard(raw, I.html_depth(T.text(raw))))
    d = df.withColumn("rejection", why).withColumn("r_", repair(F.when(why.isNull(), raw).otherwise("")))
    d = d.withColumn("t_", F.col("r_.text"))
    flags = [F.when(F.col("r_.repaired"), F.lit("mojibake_repaired")), F.when(F.col("r_.compatible"), F.lit("nfkc_changed"))]
    if html:
        d = d.withColumn("is_", looks_like_html(F.col("t_"))).withColumn("m_", F.when(F.col("is_"), F.col("t_")).otherwise(""))
        d = visible_text(d, "m_").withColumn("t_", F.when(F.col("is_"), F.col("visible_text")).otherwise(F.col("t_")))
        flags += [F.when(F.col("is_"), F.lit("magic_bytes_html")), F.when(F.col("hidden_html_content"), F.lit("hidden_html_content")), F.when(F.col("suspicious_html_comment"), F.lit("suspicious_html_comment"))]
    t = F.col("t_")
    flags += [
        F.when(I.fold_lookalikes(t) != t, F.lit("mixed_script_homoglyphs")), F.when(I.tag_payload(t) != "", F.lit("unicode_tag_stego")), F.when(S.selector_payload(t) != "", F.lit("variation_selector_stego")),
        F.when(I.invisible_count(t) > INVISIBLE, F.lit("invisible_chars_found")), F.when(I.has_other_spaces(t), F.lit("unicode_whitespace_normalized")),
    ]
    d = d.withColumn("flags", F.array_compact(F.array(*flags))).withColumn("clean", cleaned(t))
    empty = F.col("rejection").isNull() & (F.length(F.regexp_replace("clean", r"(?U)\s", "")) == 0)
    d = d.withColumn("rejection", F.when(empty, "reduced to empty").otherwise(F.col("rejection")))
    d = d.withColumn("clean", F.when(F.col("rejection").isNull(), F.col("clean"))).withColumn("chars_stripped", F.greatest(F.lit(0), F.length(T.text(raw)) - F.length(T.text("clean"))))
    return d.drop("r_", "t_", "is_", "visible_text", "hidden_html_content", "suspicious_html_comment")


#: Words that name a language in a text of some length; the most frequent ones.
STOP_WORDS = {
    "en": "the and of to in is that it for was on are with as be at by this have from or one had not but what all were when we there can an your which their said if do will".split(),
    "fr": "le la les de des du et est un une que qui dans pour pas sur avec ce il elle ne se son au par plus mais nous vous".split(),
    "de": "der die das und ist in zu den von mit sich auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei".split(),
    "es": "el la los las de que y en un una es se no por con para del al lo su como más pero sus le ya".split(),
}
LEAST_STOP, SECOND = 0.05, 0.5


_STOPS = [(k, frozenset(v)) for k, v in STOP_WORDS.items()]
_WORD = re.compile("[a-zà-ÿ]+")
_SHARES = Ty.StructType().add("lang", Ty.StringType()).add("first", Ty.DoubleType()).add("second", Ty.DoubleType())


def _languages(texts: pa.Array) -> pa.Array:
    """The likeliest language of lower-case texts, its share of frequent words and the next one's."""
    rows = []
    for t in texts.to_pylist():
        n = Counter(_WORD.findall(t or ""))
        (first, lang), (second, _), *_ = sorted(((sum(n[w] for w in v) / max(n.total(), 1), k) for k, v in _STOPS), reverse=True)
        rows.append((lang, first, second))
    return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.float64(), pa.float64()))], names=["lang", "first", "second"])


def language(c: Column) -> Column:
    """struct(lang, flags): by script where a text isn't Latin, else by the share of a language's frequent words; `und` if
    none is clear. Flags: non_english_input, and mixed_language_input for Latin beside another script or a second
    language at least half as frequent."""
    other = I.script_profile(c)
    latin = T.thrice(c, "[A-Za-zÀ-ÿ]")
    found, long = F.arrow_udf(_languages, _SHARES)(F.lower(c)), F.length(c) >= 20
    clear, two = F.when(long & (found.first >= LEAST_STOP), found.lang).otherwise("und"), long & (found.second >= LEAST_STOP) & (found.second >= SECOND * found.first)
    lang = F.when((other != "") & ~latin, F.element_at(F.split(other, ","), 1)).otherwise(clear)
    flags = F.array_compact(F.array(F.when(~lang.isin("en", "und"), F.lit("non_english_input")), F.when(((other != "") & latin) | two, F.lit("mixed_language_input"))))
    return F.struct(lang.alias("lang"), flags.alias("flags"))


SAFE_PREFIX = "non self pre post anti co re ex multi semi sub super inter intra over under well high low long short open real cross".split()
SAFE_WORDS = "e-mail x-ray t-shirt state-of-the-art up-to-date follow-up built-in plug-in check-in log-in".split()
SUSPICIOUS = "ignore disregard override bypass forget reveal instructions instruction system prompt previous password secret jailbreak unrestricted admin developer inject exploit malware payload execute".split()


def hyphenation(c: Column) -> Column:
    """struct(text, suspicious, total, confidence): every word that dashes split is joined; suspicious ones join to words of
    attacks, unless a known word or a prefix explains the dash."""
    dashed = F.translate(c, I.DASHES, "-" * len(I.DASHES))
    found = F.regexp_extract_all(F.lower(dashed), F.lit("[a-z]+(?:-[a-z]+)+"), F.lit(0))

    def of(w: Column) -> Column:
        bad = F.size(F.filter(w, lambda x: ~x.isin(*SAFE_WORDS) & ~F.element_at(F.split(x, "-"), 1).isin(*SAFE_PREFIX) & F.replace(x, F.lit("-"), F.lit("")).isin(*SUSPICIOUS)))
        sure = F.when(bad > 0, F.least(F.lit(0.95), 0.6 + 0.1 * bad) + 0.15 * bad / F.size(w)).otherwise(0.0)
        return F.struct(I.dehyphenated(c).alias("text"), bad.alias("suspicious"), F.size(w).alias("total"), F.round(F.least(F.lit(1.0), sure), 4).alias("confidence"))

    return T.let(found, of)


def expanded(before: Column, after: Column, most: float = I.EXPANSION) -> Column:
    """Whether a decoded text is more than `most` times as long as it was."""
    return F.length(after) > most * F.greatest(F.length(before), F.lit(1))


_BLOB, _MEDIA = "[A-Za-z0-9+/]{64,}={0,2}", r"(?i)data:([a-z]+/[-+.a-z0-9]+)?;base64,([A-Za-z0-9+/]+={0,2})"
MOST_ENCODED = 1_500_000


def hidden_binary(c: Column) -> Column:
    """Flags of bytes in a text: the beginning's own type, a long base64 block or data address and the type of what it
    decodes to, or that it is too large to decode."""
    uri = F.regexp_extract(c, _MEDIA, 2)
    block = F.when(uri != "", uri).otherwise(F.regexp_extract(c, _BLOB, 0))
    bare = F.regexp_replace(block, "=+$", "")
    data = T.from_base64(F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "="))
    kind = lambda b: T.let(T.let(b, I.content_type), I.type_family)
    family, own = kind(data), kind(F.encode(F.substring(c, 1, 300), "UTF-8"))
    large = F.length(block) > MOST_ENCODED
    return F.array_compact(F.array(
        F.when(own != "text", F.concat(F.lit("embedded_"), own)), F.when(uri != "", F.lit("data_uri_detected")), F.when((uri == "") & (block != ""), F.lit("base64_blob_detected")),
        F.when((block != "") & large, F.lit("base64_payload_too_large")), F.when((block != "") & ~large & data.isNotNull() & (family != "text"), F.concat(F.lit("base64_hidden_"), family)),
    ))
