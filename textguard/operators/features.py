"""Structural features: 29 numbers per text, one projection without a shuffle."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textguard.functions import text as T

VERBS = (
    "ignore forget disregard override bypass pretend act imagine reveal show print output repeat translate write "
    "list tell give provide explain describe generate create execute run stop start do become assume switch enable say decode"
).split()

ROLE = r"(?i)(?:you[ ]+are[ ]+(?:now|henceforth)|(?:act|behave)[ ]+(?:as|like)|pretend[ ]+(?:to[ ]+be|you)|from[ ]+now[ ]+on|assume[ ]+the[ ]+(?:role|persona))"
BOUNDARY = r"(?i)(?:-{3,}|={3,}|\[/?(?:system|inst)\]|<</?sys>>|(?:new|end[ ]+of)[ ]+(?:instructions?|prompt)|<\|[a-z_]+\|>)"
NEGATION = r"(?i)(?:do[ ]+not|don'?t|never|stop)[ ]+[A-Za-z0-9_]*[ ]*(?:mention|reveal|tell|say|follow)"
URL = r"https?://"
EMAIL = r"[A-Za-z0-9_]@[A-Za-z0-9_]+\.[A-Za-z0-9_]"
MANY_SHOT = r"(?i)(?:(?:attempt|example|iteration|question|round|scenario|step|turn)[ \t\n\r]*[0-9]+|(?:a|assistant|bot|human|q|user)[ \t\n\r]*[:.]|[0-9]{1,3}[ \t\n\r]*[:.)\]][ \t\n\r])"
DELIMITER = r"(?:-{3,}|={3,}|\*{3,}|#{3,}|</?[a-zA-Z][^>]{0,50}>|```|\[/?[A-Za-z]+\])"
TEMPLATE = r"(?:\{\{[^}]+\}\}|\{[a-zA-Z_][A-Za-z0-9_]*\}|<\|[^|]+\|>|\$\{[^}]+\})"
FIRST = r"(?i)(?:^|[^A-Za-z0-9_])(?:i|my|me|we|our)(?:[^A-Za-z0-9_]|$)"
SECOND = r"(?i)(?:^|[^A-Za-z0-9_])(?:you|your)(?:[^A-Za-z0-9_]|$)"
ABBREVIATION = r"(?i)(^|[ \t\n\r(])(mr|mrs|ms|dr|prof|sr|jr|st|vs|etc|inc|ltd|corp|dept|gen|gov|col|lt|rev|hon|cf|al|approx|e\.g|i\.e)\."
TITLE = r"^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$"
CAPS = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"
SCRIPTS = {
    "latin": "[a-zA-ZÀ-ÿĀ-ɏ]",
    "cyrillic": "[Ѐ-ӿ]",
    "arabic": "[؀-ۿ]",
    "cjk": "[一-鿿぀-ゟ゠-ヿ]",
    "devanagari": "[ऀ-ॿ]",
    "hebrew": "[֐-׿]",
}

#: Soft caps of the unbounded features.
CAPS_BY_FEATURE = {
    "line_count": 100.0, "char_count": 5000.0, "word_count": 1000.0, "avg_word_length": 20.0, "title_case_words": 50.0, "all_caps_words": 50.0, "exclamation_count": 20.0, "question_count": 20.0,
    "consecutive_punctuation": 20.0, "newline_ratio": 5.0, "quote_depth": 10.0, "text_entropy": 8.0, "many_shot_count": 50.0, "delimiter_density": 10.0, "template_marker_count": 20.0,
}


def sentences(c: Column) -> Column:
    """Sentences: split after . ! ? (and closing quotes) before white space; abbreviations and initials don't end one."""
    kept = F.regexp_replace(c, ABBREVIATION, "$1$2\u0001")
    kept = F.regexp_replace(kept, r"(^|[ \t\n\r(])([A-Z])\.", "$1$2\u0001")
    marked = F.regexp_replace(kept, r"([.!?]+[\"')]*)[ \t\n\r]+", "$1\u0002")
    return F.filter(F.split(marked, "\u0002"), lambda s: F.length(F.regexp_replace(s, T.WS, "")) > 0)


def quote_depth(c: Column) -> Column:
    """Deepest nesting of the three quote characters. A single quote after a letter or digit is an apostrophe, unless
    it closes the innermost single quote before a non-letter."""
    # a quote with its neighbours, so that the fold looks at few characters
    near = F.regexp_extract_all(F.concat(F.lit(" "), c, F.lit(" ")), F.lit("(?=([^\"'`]?[\"'`][^\"'`]?))[^\"'`]?[\"'`]"), F.lit(1))

    def step(acc: Column, m: Column) -> Column:
        q = F.regexp_extract(m, "[\"'`]", 0)
        top = F.right(acc.stack, F.lit(1))
        before, after = m.rlike("^[\\p{L}\\p{N}]"), m.rlike("[\\p{L}\\p{N}]$")
        pop, push = F.left(acc.stack, F.length(acc.stack) - 1), F.concat(acc.stack, q)
        stack = F.when((q == "'") & before, F.when((top == "'") & ~after, pop).otherwise(acc.stack)).when(top == q, pop).otherwise(push)
        return F.struct(stack.alias("stack"), F.greatest(acc.deep, F.length(stack)).alias("deep"))

    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("deep"))
    return F.when(c.rlike("[\"'`]"), F.aggregate(near, start, step, lambda a: a.deep)).otherwise(F.lit(0)).cast("long")


def repetition_of(t: str) -> float:
    """As `repetition`, not rounded."""
    ws = T.words_of(t)
    n = Counter(zip(ws, ws[1:], ws[2:])) if len(ws) >= 4 else {}
    return sum(k > 1 for k in n.values()) / len(n) if n else 0.0


def _repetitions(texts: pa.Array) -> pa.Array:
    return pa.array([repetition_of(t or "") for t in texts.to_pylist()], pa.float64())


def repetition(c: Column) -> Column:
    """Share of distinct word trigrams of a text that occur more than once; 0 below four words. One pass over a text in an
    Arrow batch."""
    return F.round(F.arrow_udf(_repetitions, DoubleType())(c), 6)


def length_features(c: Column) -> dict[str, Column]:
    n, w, lines = F.length(c).cast("long"), F.size(T.words(c)).cast("long"), T.count(c, "\n") + 1
    return {"char_count": n, "word_count": w, "line_count": F.when(n > 0, lines).otherwise(F.lit(0).cast("long")), "avg_word_length": T.ratio(n, w), "newline_ratio": T.ratio(lines, w)}


def casing_features(c: Column) -> dict[str, Column]:
    ws = F.filter(T.words(c), lambda w: F.length(w) >= 2)
    return {
        "uppercase_ratio": T.ratio(T.count(c, r"\p{Lu}"), T.letters(c)),
        "title_case_words": F.size(F.filter(ws, lambda w: w.rlike(TITLE))).cast("long"),
        "all_caps_words": F.size(F.filter(ws, lambda w: w.rlike(CAPS))).cast("long"),
    }


def punctuation_features(c: Column) -> dict[str, Column]:
    return {
        "exclamation_count": T.occurrences(c, "!"),
        "question_count": T.occurrences(c, "?"),
        "special_char_ratio": T.ratio(T.count(c, r"[^\p{L}\p{N} \t\n\r\f\x0B]"), F.length(c)),
        "consecutive_punctuation": T.count(c, r"[^\p{L}\p{N}_ \t\n\r\f\x0B]{2,}"),
    }


def marker_features(c: Column) -> dict[str, Column]:
    return {"has_code_block": c.contains("```").cast("int"), "has_url": c.rlike(URL).cast("int"), "has_email": c.rlike(EMAIL).cast("int")}


def injection_features(c: Column) -> dict[str, Column]:
    first = F.regexp_replace(F.lower(F.coalesce(F.get(T.words(c), F.lit(0)), F.lit(""))), "^[\"'`(\\[{]+|[\"'`(\\[{]+$", "")
    return {
        "imperative_start": first.isin(*VERBS).cast("int"),
        "role_assignment": c.rlike(ROLE).cast("int"),
        "instruction_boundary": c.rlike(BOUNDARY).cast("int"),
        "negation_command": c.rlike(NEGATION).cast("int"),
    }


CONTEXT = ("question_sentence_ratio", "first_person_ratio", "second_person_ratio")


def context(c: Column) -> Column:
    """struct of the three shares among a text's sentences, which are split once."""
    def shares(s: Column) -> Column:
        n = F.size(s)
        return F.struct(
            T.ratio(F.size(F.filter(s, lambda x: x.rlike(r"\?[ \t\n\r]*$"))), n).alias("question_sentence_ratio"),
            T.ratio(F.size(F.filter(s, lambda x: x.rlike(FIRST))), n).alias("first_person_ratio"),
            T.ratio(F.size(F.filter(s, lambda x: x.rlike(SECOND))), n).alias("second_person_ratio"),
        )

    return T.let(sentences(c), shares)


def context_features(c: Column, shares: Column | None = None) -> dict[str, Column]:
    """`shares` is a column of `context`; without it each share splits the text again."""
    one = context(c) if shares is None else shares
    return {k: one[k] for k in CONTEXT}


def pattern_features(c: Column) -> dict[str, Column]:
    return {
        "many_shot_count": T.count(c, MANY_SHOT),
        "delimiter_density": T.ratio(T.count(c, DELIMITER), T.count(c, "\n") + 1),
        "template_marker_count": T.count(c, TEMPLATE),
    }


def script_mixing(c: Column) -> Column:
    kinds = sum((F.when(T.thrice(c, p), 1).otherwise(0) for p in SCRIPTS.values()), F.lit(0))
    return F.when(kinds > 1, kinds).otherwise(F.lit(0)).cast("long")


def all_features(c: Column, shares: Column | None = None) -> dict[str, Column]:
    """The 29 features by name; `shares` as in `context_features`."""
    return (
        length_features(c) | casing_features(c) | punctuation_features(c) | marker_features(c) | injection_features(c) | {"quote_depth": quote_depth(c), "text_entropy": F.round(T.entropy(c), 6)}
        | context_features(c, shares) | pattern_features(c) | {"language_mixing_score": script_mixing(c), "repetition_score": repetition(c)}
    )


def structural_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the 29 features; a null text counts as empty and has 0 everywhere."""
    d = df.withColumn("shares_", T.once(context(T.text(text_col))))
    return d.withColumns(all_features(T.text(text_col), F.col("shares_"))).drop("shares_")


def soft_capped(df: DataFrame) -> DataFrame:
    """The unbounded features divided by their caps and cut to [0, 1]; the others stay."""
    return df.withColumns({k: F.round(T.clip(F.col(k) / F.lit(cap)), 6) for k, cap in CAPS_BY_FEATURE.items() if k in df.columns})
