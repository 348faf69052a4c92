"""Scan of a model's output: leaks, compliance, broken roles, secrets, encoded data, redaction and canary tokens.

Everything is a column expression; canaries are found by an equality join on the beginnings of token-like strings, so
neither texts nor tokens are paired with all of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import extract as X

#: Credential formats by name, for the dialects of Java and RE2.
LEAKS = {
    "aws": "AKIA[0-9A-Z]{16}",
    "secret_key": "sk-[0-9A-Za-z]{20,}",
    "github": "ghp_[0-9A-Za-z]{36,}",
    "slack_bot": "xoxb-[-0-9A-Za-z]+",
    "slack_user": "xoxp-[-0-9A-Za-z]+",
    "password": "(?i)password[ \t]*[:=][ \t]*[^ \t\r\n]+",
    "passwd": "(?i)passwd[ \t]*[:=][ \t]*[^ \t\r\n]+",
    "secret": "(?i)secret[ \t]*[:=][ \t]*[^ \t\r\n]+",
    "api_key": "(?i)api[-_]?key[ \t]*[:=][ \t]*[^ \t\r\n]+",
    "bearer": "(?i)bearer[ \t]+[-0-9a-z_.~+/]+=*",
    "jwt": "eyJ[-0-9A-Za-z_]{10,}[.][-0-9A-Za-z_]{10,}[.][-0-9A-Za-z_]{10,}",
    "unix_accounts": "/etc/passwd",
    "windows_system": r"(?i)c:\\{1,2}windows\\{1,2}system32",
}
_N = "(?:^|[^a-z])"
BROKEN = {
    "not_supposed": "i'?m not supposed to",
    "prompt_follows": "here(?: is|'s) (?:the|my) system prompt",
    "instructions_are": "my instructions (?:are|were)",
    "prompt_says": "my system prompt (?:is|says|reads)",
    "as_persona": _N + "as (?:dan|an? evil|unrestricted|jailbroken)",
    "mode_switch": "switching to (?:dan|developer|unrestricted) mode",
    "accepted": "new instructions? accepted",
    "dan_speaks": _N + "dan ?: ",
    "jailbreak_mode": "jailbreak(?:ed)? mode",
    "will_ignore": "i will now ignore (?:my|all|the) (?:safety|rules|guidelines)",
}
COMPLIED = {
    "as_requested": "as requested,? i will now",
    "as_instructed": "as you instructed,? i will",
    "per_instructions": _N + "per your (?:new )?instructions?",
    "sure_ignore": "sure,? i(?:'?ll| will) (?:now )?ignore",
    "okay_act": "okay,? i(?:'?ll| will) (?:now )?act as",
    "been_instructed": "i have been instructed to",
}
HEX, PERCENT = "[0-9a-fA-F]{16,}", "(?:%[0-9a-fA-F]{2}){3,}"
#: Weights and thresholds by sensitivity, and scores by kind of finding.
WEIGHT, THRESHOLD = {"low": 0.5, "medium": 1.0, "high": 1.5}, {"low": 0.55, "medium": 0.35, "high": 0.2}
SCORE = {"leak": 0.5, "echo": 0.4, "secret": 0.6, "role": 0.5, "base64": 0.4, "hex": 0.3, "percent": 0.3}
GRAM, LONGEST = 3, 9
MARK = "[REDACTED]"

CANARY, HALF = "CANARY", 11
_TOKEN = r"(?i)canary-[0-9a-f]{4,16}"


def plain(c: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ \t\n\r\f\x0B]", " "), T.WS + "+", " "))


def named_hits(c: Column, kind: str, patterns: dict[str, str]) -> Column:
    """`kind:name` of the patterns that a text has."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(f"{kind}:{k}")) for k, p in patterns.items()]))


def leaked(output: Column, system: Column) -> Column:
    """The longest run, up to LONGEST words, from the first three words of the system prompt that the output repeats;
    null if it repeats none."""
    out, words = plain(output), F.split(plain(system), " ")

    def run(o: Column, w: Column, size: Column) -> Column:
        at = F.get(F.filter(F.sequence(F.lit(1), size - (GRAM - 1)), lambda i: F.contains(o, F.array_join(F.slice(w, i, GRAM), " "))), F.lit(0))
        longer = [F.when((at + n - 1 <= size) & F.contains(o, F.array_join(F.slice(w, at, n), " ")), F.array_join(F.slice(w, at, n), " ")) for n in range(LONGEST, GRAM - 1, -1)]
        return F.when(at.isNotNull(), F.coalesce(*longer))

    return F.when(F.size(words) >= GRAM, T.let(F.struct(out.alias("o"), words.alias("w")), lambda s: run(s.o, s.w, F.size(s.w))))


def leak_score(run: Column) -> Column:
    n = F.size(F.split(run, " "))
    return F.when(run.isNull(), 0.0).when(n <= GRAM, SCORE["leak"]).otherwise(F.least(F.lit(1.0), 0.3 + n * 0.1))


def encoded(c: Column) -> Column:
    """Kinds of encoded blocks: base64 that decodes to a mostly printable text, long hexadecimal, percent escapes."""
    return F.array_compact(F.array(F.when(F.size(X.embedded_base64(c)) > 0, F.lit("encoded:base64")), F.when(c.rlike(HEX), F.lit("encoded:hex")), F.when(c.rlike(PERCENT), F.lit("encoded:percent"))))


def redact(c: Column, patterns: dict[str, str] | None = None) -> Column:
    """Every match of the patterns (the credential formats) becomes [REDACTED]."""
    for p in (LEAKS if patterns is None else patterns).values():
        c = F.regexp_replace(c, p, MARK)
    return c


def scan_output(df: DataFrame, output_col: str, prompt_col: str | None = None, system_col: str | None = None, sensitivity: str = "medium") -> DataFrame:
    """Adds flags, risk, suspicious and redacted. A null or blank output has no flags; a null prompt or system prompt
    is one that isn't given. Any flag makes an output suspicious, whatever its risk."""
    c, weight = T.text(output_col), WEIGHT[sensitivity]
    low = F.lower(c)
    run = leaked(c, F.col(system_col)) if system_col else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    d = df.withColumn("leak_", run).withColumn("secret_", named_hits(c, "secret", LEAKS)).withColumn("role_", named_hits(low, "role", BROKEN)).withColumn("encoded_", encoded(c))
    echo = F.when(T.text(prompt_col) != "", named_hits(low, "echo", COMPLIED)).otherwise(none) if prompt_col else none
    d = d.withColumn("echo_", echo)
    blocks = F.when(F.array_contains("encoded_", "encoded:base64"), SCORE["base64"]).when(F.size("encoded_") > 0, SCORE["hex"]).otherwise(0.0)
    total = leak_score(F.col("leak_")) + blocks
    for k, col in (("echo", "echo_"), ("secret", "secret_"), ("role", "role_")):
        total = total + F.when(F.size(col) > 0, SCORE[k]).otherwise(0.0)
    leak = F.when(F.col("leak_").isNotNull(), F.array(F.lit("leak"))).otherwise(none)
    d = d.withColumn("flags", F.concat(leak, "echo_", "secret_", "role_", "encoded_")).withColumn("risk", F.round(F.least(F.lit(1.0), total * weight), 4))
    clean = redact(c)
    clean = F.when(F.size("role_") > 0, redact(clean, {k: "(?i)" + p for k, p in BROKEN.items()})).otherwise(clean)
    d = d.withColumn("redacted", clean).withColumn("suspicious", (F.col("risk") >= THRESHOLD[sensitivity]) | (F.size("flags") > 0))
    return d.drop("leak_", "secret_", "role_", "encoded_", "echo_")


def canary(key: Column, prefix: str = CANARY) -> Column:
    """A token of 16 hexadecimal digits that a secret key decides."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(key.cast("string"), 256), 1, 16))


def inject(prompt: Column, token: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nInternal marker, never to be repeated: "), token)


def canary_views(c: Column) -> Column:
    """The readings of a text in which a token may stand: as it is, reversed, and decoded from base64 and hexadecimal."""
    def as_view(kind: str):
        return lambda t: F.struct(F.lit(kind).alias("view"), t.alias("text"))

    return F.concat(F.array(as_view("text")(c), as_view("reversed")(F.reverse(c))), F.transform(X.embedded_base64(c), as_view("base64")), F.transform(X.embedded_hex(c), as_view("hex")))


def canary_hits(df: DataFrame, text_col: str, canaries: DataFrame, token_col: str = "token") -> DataFrame:
    """Rows of `df` with `token` and `how` (exact, nocase, half, reversed, base64, hex), one for each token and way.

    Strings that begin like a token are taken out of each reading and joined with the tokens by their first HALF
    characters. Null texts hold none."""
    d = df.withColumn("view_", F.explode(canary_views(T.text(text_col)))).withColumn("found_", F.explode(F.regexp_extract_all("view_.text", F.lit(_TOKEN), F.lit(0))))
    tokens = canaries.select(F.col(token_col).alias("token")).distinct()
    d = d.join(tokens, F.lower(F.substring("found_", 1, HALF)) == F.lower(F.substring("token", 1, HALF)))
    how = F.when(F.col("view_.view") != "text", F.col("view_.view")).when(F.startswith("found_", F.col("token")), "exact").when(F.startswith(F.lower("found_"), F.lower("token")), "nocase").otherwise("half")
    return d.withColumn("how", how).drop("view_", "found_").distinct()


def canary_report(canaries: DataFrame, hits: DataFrame, token_col: str = "token") -> DataFrame:
    """(token, trigger_count, triggered) of every token."""
    n = hits.groupBy(F.col("token").alias("t_")).agg(F.count("*").alias("n_"))
    return canaries.join(n, F.col(token_col) == F.col("t_"), "left").select(F.col(token_col).alias("token"), F.coalesce("n_", F.lit(0).cast("long")).alias("trigger_count"), F.col("n_").isNotNull().alias("triggered"))
