"""Routing of texts through stages: votes of several models, a judge, positive validation, and counts by stage.

Each stage is an expression over columns that a join has brought together, so a table of texts passes all of them in
one narrow plan; a model that wasn't asked about a row is null there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import rules as R

THRESHOLD = 0.55
MODEL, PER_FLAG, MOST_FLAGS = 0.6, 0.15, 0.3
JUDGE_LOW, JUDGE_HIGH = 0.25, 0.85
FAILURES, OPEN_SECONDS = 5, 60
CHUNK, STEP, MOST_CHUNKS, EDGE = 512, 448, 20, 256

#: Techniques of the flags that the stages before the rules raise.
TECHNIQUE_FLAGS = {
    "A1": "html_depth_exceeded",
    "A1.1": "tokenization_spike tokenization_spike_local timeout_normalize timeout_html timeout_tokenize timeout_pipeline",
    "D1": "known_malicious_exact known_malicious_normalized known_malicious_token_pattern",
    "D4": "embedded_rtf bom_detected_utf-8-sig bom_detected_utf-16-le bom_detected_utf-16-be bom_detected_utf-32-le bom_detected_utf-32-be high_entropy punctuation_flood weird_casing",
    "D4.1": "base64 base64_blob_detected data_uri_detected base64_hidden_executable base64_payload_too_large",
    "D4.2": "url_encoded", "D4.3": "hex", "D4.4": "rot13", "D4.5": "leetspeak", "D4.6": "reversed_text full_reverse word_reverse",
    "D5": "nfkc_changed mojibake_repaired ftfy_suspicious_correction encoding_fallback_utf8 coerced_to_str",
    "D5.2": "invisible_chars_found unicode_tag_stego variation_selector_stego", "D5.3": "mixed_script_homoglyphs", "D5.7": "unicode_whitespace_normalized",
    "D6": "non_english_input", "D6.3": "mixed_language_input", "D7.1": "chunked_analysis input_truncated_chunks",
    "E1": "pii_credit_card pii_ssn pii_api_key pii_email pii_phone pii_ipv4 pdf_external_action",
    "I2": "magic_bytes_html html_parse_error", "I2.1": "hidden_html_content", "I2.2": "suspicious_html_comment",
    "M1.1": "image_metadata_text base64_hidden_image " + " ".join(f"embedded_{x}" for x in "image png jpeg gif bmp tiff psd ico webp".split()),
    "M1.3": "base64_hidden_audio " + " ".join(f"embedded_{x}" for x in "audio mp3 flac ogg aac midi wav aiff".split()),
    "M1.4": "content_type_mismatch polyglot_detected base64_hidden_pdf base64_hidden_document base64_hidden_archive base64_hidden_video pdf_javascript pdf_auto_action "
    + " ".join(f"embedded_{x}" for x in "executable document archive video exe elf macho java_class wasm shebang pdf ole2 docx xlsx pptx ooxml odf zip gzip 7z rar bzip2 xz lzma tar jar webm flv wmv avi mp4 riff_unknown".split()),
}
FLAG_TECHNIQUE = {f: t for t, flags in TECHNIQUE_FLAGS.items() for f in flags.split()}


def flag_techniques(flags: Column) -> Column:
    """Techniques of an array of flags, distinct, in the flags' order; unknown flags have none."""
    table = F.create_map(*[F.lit(x) for kv in FLAG_TECHNIQUE.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(flags, lambda f: F.try_element_at(table, f))))


#: Structural findings: name, the feature and the least value that raises it, and its technique.
STRUCTURAL = (
    ("structural:imperative_start", "imperative_start", 1, "D1.1"), ("structural:role_assignment", "role_assignment", 1, "D2.1"), ("structural:instruction_boundary", "instruction_boundary", 1, "D3.4"),
    ("structural:negation_command", "negation_command", 1, "D1.2"), ("structural:deep_quoting", "quote_depth", 3, "D3"), ("structural:many_shot", "many_shot_count", 5, "D8"),
    ("structural:delimiter_density", "delimiter_density", 2, "D3.4"), ("structural:template_marker", "template_marker_count", 1, "D3.2"), ("structural:language_mixing", "language_mixing_score", 2, "D6.3"),
)


def structural_tags(features: dict[str, Column]) -> tuple[Column, Column]:
    """(names, techniques) of the structural findings of a text's features."""
    found = [(features[f] > least if f == "delimiter_density" else features[f] >= least, name, t) for name, f, least, t in STRUCTURAL]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n, _ in found])), F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, _, t in found])))


def chunks(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(…, chunk, chunk_text): windows of 512 words, 448 apart, of texts of more words. At most 20 a text, which is the
    rule of the scan; `head_tail` stands for what lies beyond."""
    w = T.words(T.text(text_col))
    d = df.withColumn("w_", w).where(F.size("w_") > CHUNK)
    d = d.withColumn("at_", F.slice(F.sequence(F.lit(0), F.size("w_") - (CHUNK - STEP + 1), F.lit(STEP)), 1, MOST_CHUNKS)).select("*", F.posexplode("at_").alias("chunk", "from_"))
    return d.withColumn("chunk_text", F.array_join(F.slice("w_", F.col("from_") + 1, F.lit(CHUNK)), " ")).drop("w_", "at_", "from_")


def head_tail(c: Column) -> Column:
    """The first and the last 256 words of a longer text."""
    return T.let(T.words(c), lambda w: F.when(F.size(w) > CHUNK, F.array_join(F.concat(F.slice(w, 1, EDGE), F.slice(w, -EDGE, EDGE)), " ")).otherwise(c))


def rescored(score: Column, hits: Column, chunk_hits: Column) -> Column:
    """The score after the chunks: 0.05 for each new rule, and 0.075 for each rule of a chunk up to 0.15."""
    new = F.size(F.array_except(chunk_hits, hits))
    return F.least(F.lit(1.0), score + 0.05 * new + F.least(F.lit(0.15), 0.075 * F.size(F.array_distinct(chunk_hits))))


def weighted(p: Column, hits: Column, n_flags: Column, threshold: float = THRESHOLD) -> Column:
    """struct(label, confidence) of the weighted vote; confidence is that of the label."""
    score = T.clip(MODEL * p + R.severity_sum(hits) + F.least(n_flags * PER_FLAG, F.lit(MOST_FLAGS)))
    bad = score >= threshold
    return F.struct(F.when(bad, "MALICIOUS").otherwise("SAFE").alias("label"), F.round(F.when(bad, score).otherwise(1 - score), 4).alias("confidence"))


def ensemble(p_first: Column, p_second: Column, w_first: float = 0.5, w_second: float = 0.5, threshold: float = THRESHOLD) -> Column:
    """struct(risk, malicious) of two models' probabilities; weights are cut to [0, 1] and normalised, and a model that
    gives none leaves the other alone."""
    a, b = min(max(w_first, 0.0), 1.0), min(max(w_second, 0.0), 1.0)
    a, b = (a / (a + b), b / (a + b)) if a + b else (0.5, 0.5)
    risk = F.coalesce(a * p_first + b * p_second, p_first, p_second)
    return F.struct(F.round(risk, 4).alias("risk"), (risk >= threshold).alias("malicious"))


def embedding_decision(p_bad: Column, hits: Column, p_views: Column) -> Column:
    """struct(label, p): the embedding model's answer, which rules turn if it is unsure of SAFE (at most 0.7), and which
    a decoded view of more than 0.6 turns and lifts."""
    view = F.coalesce(F.array_max(p_views), F.lit(0.0))
    by_rule = (p_bad < 0.5) & (F.size(hits) > 0) & (1 - p_bad <= 0.7)
    by_view = view > 0.6
    return F.struct(F.when((p_bad >= 0.5) | by_rule | by_view, "MALICIOUS").otherwise("SAFE").alias("label"), F.round(F.when(by_view, F.greatest(p_bad, view)).otherwise(p_bad), 4).alias("p"))


def route(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds label, confidence and stage.

    Columns: blocked, whitelisted BOOLEAN; p DOUBLE; hits ARRAY<STRING>; n_flags INT; ensemble_risk DOUBLE;
    emb_label STRING, emb_conf DOUBLE; judge_label STRING, judge_conf DOUBLE; valid BOOLEAN, valid_conf DOUBLE. A null
    stands for a stage that has no answer; a row that is null in p counts as 0.5.
    """
    bad = lambda label: label == "MALICIOUS"
    d = df.withColumn("v_", weighted(F.coalesce("p", F.lit(0.5)), F.coalesce("hits", F.array().cast("array<string>")), F.coalesce("n_flags", F.lit(0)), threshold))
    label, conf = F.col("v_.label"), F.col("v_.confidence")
    mixed = F.round(0.6 * conf + 0.4 * F.col("emb_conf"), 4)
    has_ens, has_emb = F.col("ensemble_risk").isNotNull(), F.col("ensemble_risk").isNull() & F.col("emb_label").isNotNull()
    cleared = has_emb & (F.col("emb_label") == "SAFE") & bad(label) & (F.col("emb_conf") > 0.7)
    turned = has_emb & bad(F.col("emb_label")) & (label == "SAFE") & (F.col("emb_conf") > 0.85)
    second = F.when(has_ens, F.when(F.col("ensemble_risk") >= threshold, "MALICIOUS").otherwise("SAFE")).when(cleared, "SAFE").when(turned, "MALICIOUS").otherwise(label)
    d = d.withColumn("l2_", second).withColumn("c2_", F.when(has_ens, F.col("ensemble_risk")).when(has_emb, mixed).otherwise(conf)).withColumn("clear_", cleared)
    label, conf = F.col("l2_"), F.col("c2_")
    p_own = F.when(bad(label), conf).otherwise(1 - conf)
    p_judge = F.when(bad(F.col("judge_label")), F.col("judge_conf")).otherwise(1 - F.col("judge_conf"))
    p_both = 0.3 * p_own + 0.7 * p_judge
    asked = conf.between(JUDGE_LOW, JUDGE_HIGH) | (bad(label) & (conf < JUDGE_HIGH))
    judged = asked & F.col("judge_label").isin("SAFE", "MALICIOUS") & F.col("judge_conf").isNotNull()
    valid = bad(label) & F.col("valid") & (F.col("valid_conf") > 0.7) & (conf < JUDGE_HIGH)
    stage = (
        F.when(F.col("blocked"), "blocked").when(F.col("whitelisted"), "whitelist").when(F.col("clear_"), "embedding").when(F.coalesce(judged, F.lit(False)), "judge")
        .when(F.coalesce(valid, F.lit(False)), "positive_validation").otherwise("weighted")
    )
    d = d.withColumn("stage", stage)
    s = F.col("stage")
    final = F.when(s == "blocked", "BLOCKED").when(s.isin("whitelist", "embedding", "positive_validation"), "SAFE").when(s == "judge", F.col("judge_label")).otherwise(label)
    sure = (
        F.when(s == "blocked", 1.0).when(s == "whitelist", 0.99).when(s == "judge", F.round(F.when(bad(F.col("judge_label")), p_both).otherwise(1 - p_both), 4))
        .when(s == "positive_validation", F.round(0.4 * (1 - conf) + 0.6 * F.col("valid_conf"), 4)).otherwise(conf)
    )
    return d.withColumn("label", final).withColumn("confidence", sure).drop("v_", "l2_", "c2_", "clear_")


def result(routed: DataFrame) -> DataFrame:
    """Adds what a scan of the cascade returns: malicious, risk (the label's confidence; 1 if blocked), label in lower
    case, and techniques of the hits with the stage as `cascade:<stage>`."""
    blocked = F.col("stage") == "blocked"
    tags = F.when(blocked, F.array().cast("array<string>")).otherwise(F.array_union(R.techniques(F.col("hits")), F.array(F.concat(F.lit("cascade:"), "stage"))))
    d = routed.withColumn("malicious", F.col("label") != "SAFE").withColumn("risk", F.when(blocked, 1.0).otherwise(F.round("confidence", 4)))
    return d.withColumn("techniques", tags).withColumn("label", F.lower("label"))


def stage_counts(routed: DataFrame) -> DataFrame:
    """One row of counts: total, rows that ended in each stage, and rows of which a later stage turned the verdict."""
    names = ("blocked", "whitelist", "embedding", "judge", "positive_validation", "weighted")
    return routed.agg(F.count("*").alias("total"), *[F.count_if(F.col("stage") == n).alias(n) for n in names], F.count_if(~F.col("stage").isin("blocked", "whitelist")).alias("classified"))


def judge_reply(raw: Column, nonce: Column) -> Column:
    """struct(verdict, confidence, reason, error) of a judge's reply: the outermost braces are read as JSON, the nonce must
    come back, confidence is cut to [0, 1] (0.5 if it is no number), and the reason loses control characters and what
    lies beyond 500 characters."""
    body = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "verdict string, confidence string, reasoning string, nonce string")
    known = F.upper(F.trim(body.verdict))
    number = body.confidence.try_cast("double")
    sure = F.when(number.isNull() | F.isnan(number), 0.5).otherwise(T.clip(number))
    reason = F.substring(F.regexp_replace(F.coalesce(body.reasoning, F.lit("")), r"[\x00-\x1F\x7F]", ""), 1, 500)
    error = F.when(raw.isNull() | body.verdict.isNull(), "parse").when(body.nonce.isNull() | (body.nonce != nonce), "nonce").when(~known.isin("SAFE", "MALICIOUS"), "verdict")
    return F.struct(F.when(error.isNull(), known).otherwise("UNKNOWN").alias("verdict"), F.round(F.when(error.isNull(), sure).otherwise(0.0), 6).alias("confidence"), F.when(error.isNull(), reason).otherwise("").alias("reason"), error.alias("error"))


def consistency(calls: DataFrame, by: str, verdict_col: str = "verdict", conf_col: str = "confidence") -> DataFrame:
    """(by, verdict, confidence): the majority of a text's calls. Fewer valid calls than half and one give UNKNOWN, a tie
    is MALICIOUS; confidence is the mean of the vote's share and the valid calls' mean confidence."""
    known = F.col(verdict_col).isin("SAFE", "MALICIOUS")
    c = calls.groupBy(by).agg(F.count_if(known).alias("valid"), F.count("*").alias("n"), F.count_if(F.col(verdict_col) == "SAFE").alias("safe"), F.count_if(F.col(verdict_col) == "MALICIOUS").alias("bad"), F.avg(F.when(known, F.col(conf_col))).alias("mean"))
    few = F.col("valid") < F.floor(F.col("n") / 2) + 1
    share = (F.greatest("safe", "bad") / F.when(F.col("valid") > 0, F.col("valid")) + F.col("mean")) / 2
    return c.select(by, F.when(few, "UNKNOWN").when(F.col("safe") > F.col("bad"), "SAFE").otherwise("MALICIOUS").alias("verdict"), F.when(few, 0.0).otherwise(F.round(share, 6)).alias("confidence"))


def _breaker(key: str, at: str, ok: str, failures: int, seconds: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, bad, until = None, 0, None  # the state of one key, whatever its rows are
        for f in frames:
            state = []
            for k, t, fine in zip(f[key], f[at], f[ok]):
                if k != who:
                    who, bad, until = k, 0, None
                if until is not None and t < until:
                    state.append("open")
                    continue
                until = None
                bad = 0 if fine else bad + 1
                if bad >= failures:
                    until, bad = t + pd.Timedelta(seconds=seconds), 0
                state.append("ok" if fine else "failed")
            yield f.assign(state=state)

    return run


def circuit_breaker(calls: DataFrame, key: str, at: str, ok: str, failures: int = FAILURES, seconds: float = OPEN_SECONDS) -> DataFrame:
    """Adds `state` to calls: ok, failed, or open for a call that falls into the `seconds` after `failures` failed ones in
    a row, and isn't made. Calls of a key are folded in order of time as they stream by, so a key may have any number.
    Null keys are one key; calls of one time are in no set order."""
    d = calls.repartition(key).sortWithinPartitions(key, at)
    return d.mapInPandas(_breaker(key, at, ok, failures, seconds), calls.schema.add("state", "string"))


QUESTION = (
    "are can could did do does had has have how is may might shall should was were what when where which who why will would "
).split()
INTENT = (
    "add analyze build calculate change check clarify close compare configure consider continue convert create debug define delete deploy describe design "
    "edit elaborate execute explain fetch find fix generate get give help implement improve include install know like list make need open outline provide "
    "read recommend remove review rewrite run search set show solve start stop suggest summarize tell test think translate try understand update use want "
    "write "
).split()
BOUNDS = ("###", "***", "---", "===", "```")
LENGTH = {"general": 2000, "summarization": 10000, "qa": 1000, "coding": 5000}
_TURN = (("do", "also", "ignore"), ("follow", "also", "disregard"), ("obey", "also", "override"), ("must", "actually", "ignore"), ("comply", "also", "skip"), ("follow", "actually", "forget"))
CONTRADICTION = "(?s)" + "|".join(f"(?:^|[^a-z]){a}[^a-z].{{1,500}}[^a-z]but (?:{b} )?{c}(?:[^a-z]|$)" for a, b, c in _TURN)
SETUP = r"(?:^|[^a-z])(?:do|follow|obey|must|comply|always|ensure|stick to|adhere to|respect|observe|execute|perform)(?:[^a-z]|$)"
REVERSAL = r"(?:^|[^a-z])(?:ignore|disregard|override|forget|skip|bypass|neglect|disobey|circumvent|never mind)(?:[^a-z]|$)"
PERSONA = (
    r"you are (?:now|no longer) ", r"(?:act|behave|respond) as (?:if you|though you|an? (?:unrestricted|evil|unfiltered))", r"pretend (?:to be|you are|that you)", r"from now on,? you", r"your new (?:name|role|persona|identity)",
    r"(?:enter|switch to|enable) (?:dan|developer|god|jailbreak) mode", r"(?:forget|drop) (?:that )?you are an? (?:ai|assistant|model)", r"roleplay as ", r"take on the (?:role|persona) of", r"you (?:have|had) no (?:rules|restrictions|limits)", r"speak as (?:though|if) you",
)
MARKERS = ("### assistant:", "### human:", "### system:", "</s>", "<</sys>>", "<<sys>>", "<|assistant|>", "<|im_end|>", "<|im_start|>", "<|system|>", "<|user|>", "[/inst]", "[inst]", "[system]")
TASK_WORDS = {
    "summarization": "abstract condense gist recap summarise summarize summary synopsis tldr".split(),
    "coding": "algorithm api array bug class code compile css debug error exception fix framework function html implement import integer java javascript library loop method module object program python refactor runtime rust script sql string syntax test variable".split(),
}


def persona(c: Column) -> Column:
    """Whether a text would give the assistant another persona."""
    return F.lower(c).rlike("|".join(PERSONA))


def validate(c: Column, task: str = "general") -> Column:
    """struct(valid, confidence, reason, task_match): whether a text is a legitimate request, the mean of four checks.

    Coherence, a clear intent, one bounded request, and no other persona; reason names the checks that failed. A null
    or blank text is invalid with confidence 1.
    """
    t = T.trim_all(T.text(c))
    code = task == "coding"

    def has(low: Column, words) -> Column:
        return low.rlike(rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])")

    def facts(x: Column) -> Column:
        """What the checks need, each computed once: inside a lambda an expression runs as often as it is named."""
        s, low, words = x.s, x.low, x.words
        bounds = sum(((F.length(s) - F.length(F.replace(s, F.lit(b), F.lit("")))) / len(b) for b in BOUNDS), F.lit(0.0))
        parts = F.filter(F.split(low, r"[.!?]+(?:[ \t\r\n]|$)|\n+"), lambda x: F.trim(x) != "")
        first = lambda v, p: F.get(F.filter(F.transform(v, lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull()), F.lit(0))
        apart = F.when(low.rlike(REVERSAL) & low.rlike(SETUP), T.let(parts, lambda v: first(v, SETUP) != first(v, REVERSAL)))  # parts end beside letters
        marked = low.rlike("###|[<\\[]") & functools.reduce(lambda a, m: a | F.contains(low, F.lit(m)), MARKERS, F.lit(False))
        return F.struct(
            F.size(words).alias("n"), F.length(s).alias("chars"), F.size(F.filter(words, lambda w: F.length(w) > 2)).alias("longer"), T.letters(s).alias("letters"), (has(low, QUESTION) | F.endswith(s, F.lit("?"))).alias("asks"), has(low, INTENT).alias("does"),
            F.endswith(s, F.lit("?")).alias("ends"), bounds.alias("bounds"), ((low.contains("but ") & low.rlike(CONTRADICTION)) | F.coalesce(apart, F.lit(False))).alias("against"), (low.rlike("|".join(PERSONA)) | marked).alias("other"),
            (F.size(F.array_intersect(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, TASK_WORDS[task])))) if task in TASK_WORDS else F.lit(0)).alias("fitting"),
        )

    def of(f: Column) -> Column:
        n, chars, asks, does, other = f.n, f.chars, f.asks, f.does, f.other
        long, alpha = f.longer / n, f.letters / chars
        coherence = F.when(chars / n > (35 if code else 25), 0.1).when(long < 0.15, 0.2).when(alpha < (0.15 if code else 0.3), 0.2)
        intent = F.when(asks | does, 0.6 + F.when(does, 0.2).otherwise(0.0) + F.when(asks, 0.2).otherwise(0.0))
        too_long, many, against = chars > LENGTH[task], f.bounds >= 3, f.against
        scope = 1.0 - F.when(too_long, 0.4).otherwise(0.0) - F.when(many, 0.3).otherwise(0.0) - F.when(against, 0.3).otherwise(0.0)
        scores = F.coalesce(coherence, F.least(F.lit(1.0), 0.4 + long * 0.3 + alpha * 0.3)) + F.coalesce(intent, F.lit(0.2)) + F.greatest(F.lit(0.0), scope) + F.when(other, 0.1).otherwise(1.0)
        issues = F.array_compact(F.array(F.when(coherence.isNotNull(), F.lit("coherence")), F.when(intent.isNull(), F.lit("intent")), F.when(too_long | many | against, F.lit("scope")), F.when(other, F.lit("persona"))))
        if task in TASK_WORDS:
            match = F.least(F.lit(1.0), f.fitting / 2)
        elif task == "qa":
            match = F.when(f.ends, 1.0).when(asks, 0.7).otherwise(0.2)
        else:
            match = F.lit(0.5)
        return F.struct((F.size(issues) == 0).alias("valid"), F.round(scores / 4, 4).alias("confidence"), F.array_join(issues, "|").alias("reason"), F.round(match, 4).alias("task_match"))

    def each(s: Column) -> Column:
        return T.let(T.let(F.struct(s.alias("s"), F.lower(s).alias("low"), T.words(s).alias("words")), facts), of)

    blank = F.struct(F.lit(False).alias("valid"), F.lit(1.0).alias("confidence"), F.lit("empty").alias("reason"), F.lit(0.0).alias("task_match"))
    return T.let(t, lambda s: F.when(s == "", blank).otherwise(each(s)))


BEGIN, END = "<<<USER INPUT BEGINS>>>", "<<<USER INPUT ENDS>>>"


def sandwich(system: Column, user: Column) -> Column:
    """The system prompt, the user's text between markers, and the system prompt again."""
    return F.concat(system, F.lit(f"\n\n{BEGIN}\n"), user, F.lit(f"\n{END}\n\nRemember: "), system)


def user_input(c: Column) -> Column:
    """What stands between the markers, trimmed; null if they are missing or out of order."""
    a, b = F.instr(c, BEGIN), F.instr(c, END)
    return F.when((a > 0) & (b >= a + len(BEGIN)), T.trim_all(F.substr(c, a + len(BEGIN), b - a - len(BEGIN))))
