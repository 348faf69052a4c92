"""Rule engine: a rule dimension, views of a text, hits, context suppression and severities.

Patterns are written on lower-case text for the dialects of Java, RE2 and Python. Each has anchors: literals of which a
match holds one, so that a search for literals decides first and the pattern runs on few texts. The rules run in one
Arrow function for a whole batch: as 63 gated expressions they took ten seconds to plan and lowered a text once a rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textguard.functions import text as T
from textguard.functions.unicode import unmarked
from textguard.operators import intake as I
from textguard.operators.extract import DEFANGED

WEIGHTS = {"critical_content": 0.45, "critical": 0.3, "high": 0.2, "medium": 0.1}


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    paranoia: int
    suppressible: bool
    techniques: tuple[str, ...]
    pattern: str
    anchors: tuple[str, ...]


def _r(name: str, severity: str, pl: int, s: bool, techniques: str, pattern: str, anchors: str) -> Rule:
    return Rule(name, severity, pl, s, tuple(techniques.split()), pattern, tuple(anchors.split("|")))


_A = r"(?:all |any |the |your |my |these |those |of |every |above |previous |prior |earlier ){0,4}"
_SP = r"(?:hidden |secret |initial |full |system |original |internal ){0,3}"

RULES: tuple[Rule, ...] = (
    _r("override", "critical", 1, True, "D1.1", rf"(?:ignore|disregard|bypass|override) {_A}(?:instructions?|rules?|guidelines?|prompts?)", "ignore |disregard |bypass |override "),
    _r("system_prompt", "high", 1, True, "E1.1 E1.2", rf"(?:reveal|print|show|display|leak) (?:me )?{_A}{_SP}(?:prompt|instructions)", "reveal |print |show |display |leak "),
    _r("roleplay", "high", 2, True, "D2.1 D2.2", r"(?:you are now|act as|pretend (?:to be|you)|play the role of) ", "you are now|act as|pretend |the role of"),
    _r("secrecy", "medium", 1, False, "I1", r"(?:do not|don't|never) (?:tell|inform|mention this to|alert) (?:the user|anyone|them)", "tell |inform |mention this|alert "),
    _r("exfiltration", "high", 1, False, "E1.1", r"(?:send|forward|upload|post|transmit) [a-z ]{0,40}(?:to|at) (?:https?://|[a-z0-9._-]{1,40}@)", "send |forward |upload |post |transmit "),
    _r("fake_system_prompt", "critical", 1, True, "D3.1", r"(?:^|\n)[ ]*(?:\[?system\]?|system prompt|new system message)[ ]*:", "system"),
    _r("chat_template_injection", "critical", 1, True, "D3.2", r"<\|(?:im_start|im_end|system|user|assistant|endofprompt)\|>|\[/?inst\]|<</?sys>>", "<||inst]|sys>>"),
    _r("xml_role_tags", "high", 1, True, "D3.3", r"</?(?:system|assistant|instructions?|admin|developer)>", "system>|assistant>|instruction|admin>|developer>"),
    _r("api_key_extraction", "critical", 1, True, "P1.5", r"(?:give|show|tell|reveal|list|print) (?:me )?[a-z ]{0,30}(?:api[ _-]?keys?|secret keys?|passwords?|credentials?|tokens?)", "api|secret key|password|credential|token"),
    _r("forget_override", "critical", 1, True, "D1.1", rf"(?:forget|erase|wipe|stop following) {_A}(?:instructions?|rules?|training|context|memory|told)", "forget |erase |wipe |stop following"),
    _r("developer_mode", "critical", 1, True, "D1.3", r"(?:enable|activate|enter|switch to|turn on) (?:the )?(?:developer|debug|god|root|maintenance|unrestricted) mode", " mode"),
    _r("new_instruction", "high", 2, True, "D1.2", r"(?:new|updated|revised|following) (?:instructions?|directives?|orders?)(?: are| is|:)", "instruction|directive|order"),
    _r("delimiter_confusion", "medium", 2, True, "D3.4", r"(?:-{3,}|={3,}|#{3,})[ ]*(?:end|begin|start|new)[a-z ]{0,20}(?:prompt|instructions?|input|system)", "---|===|###"),
    _r("completion_trick", "medium", 3, False, "E1.3", r"(?:complete|continue|finish) (?:this|the) (?:sentence|text|phrase)[: ]{1,3}[\"']?(?:my|the) (?:system )?(?:prompt|instructions)", "complete |continue |finish "),
    _r("tool_enumeration", "medium", 2, True, "E2.2", r"(?:list|enumerate|show|what are) (?:me )?(?:all )?(?:your|the|available) (?:available )?(?:tools?|functions?|plugins?|capabilities)", "tool|function|plugin|capabilit"),
    _r("unauthorized_tool_call", "high", 3, False, "T1.1", r"(?:call|invoke|execute|run) (?:the )?(?:tool|function|plugin|command)[ :]", "tool|function|plugin|command"),
    _r("recursive_output", "medium", 2, False, "R1.2", r"(?:repeat|print|say|output) [a-z' ]{0,40}(?:forever|infinitely|endlessly|without stopping|[0-9]{4,} times)", "forever|infinitely|endlessly|without stopping| times"),
    _r("persona_split", "high", 2, True, "D2.4", r"(?:two|both|dual) (?:personas?|personalities|answers|responses)[a-z, ]{0,60}(?:evil|unfiltered|opposite|jailbroken)", "persona|personalit|answers|responses"),
    _r("summarization_extraction", "high", 1, True, "E1.6", rf"(?:summari[sz]e|paraphrase|rephrase|outline) {_A}{_SP}(?:prompt|instructions|guidelines)", "summari|paraphrase|rephrase|outline"),
    _r("authority_escalation", "critical", 1, False, "D1.3", r"(?:i am|i'm|this is) (?:your |the |an? )?(?:administrator|admin|developer|creator|root user|owner|supervisor)", "i am |i'm |this is "),
    _r("constraint_negation", "critical", 1, False, "C1.1 D2.2", r"(?:without|no|remove|disable|drop) (?:any |all |your |the )?(?:restrictions?|limitations?|filters?|safety|censorship|guardrails?|constraints?)", "restriction|limitation|filter|safety|censorship|guardrail|constraint"),
    _r("meta_referential", "medium", 2, True, "E2.3 E2.4 E2.5", r"(?:what|which) (?:model|version|llm|training data|rules) (?:are you|do you|were you|is your)", "model|version|llm|training data|rules"),
    _r("gaslighting", "medium", 2, True, "D2.3", r"(?:you (?:already )?(?:said|agreed|promised|told me)|as we agreed|remember when you) (?:that |earlier |before |you )", "agreed|you said|promised|told me|remember when|already said"),
    _r("worm_signature", "critical", 1, False, "I1.5", r"(?:copy|include|replicate|append|embed) (?:this|these) (?:entire )?(?:prompt|message|instructions?|text) (?:in|into|to) (?:every|all|each|your)", "copy |include |replicate |append |embed "),
    _r("destructive_action", "critical", 1, False, "T1.2", r"rm -rf|drop (?:table|database)|delete from [a-z_]+|format c:|truncate table|mkfs\.", "rm -rf|drop |delete from|format c:|truncate|mkfs"),
    _r("direct_prompt_request", "critical", 1, False, "E1.1", r"(?:what|tell me what) (?:is|are|was|were) (?:your|the) (?:hidden |secret |system |initial |original )(?:prompt|instructions?|message)", "prompt|instruction|message"),
    _r("repeat_above", "high", 1, False, "E1.2", r"repeat (?:everything|all|the (?:text|words|content)) (?:above|before|prior|verbatim)", "repeat "),
    _r("translation_extraction", "high", 1, False, "E1.4", rf"translate {_A}{_SP}(?:prompt|instructions?) (?:in)?to ", "translate "),
    _r("encoding_extraction", "high", 1, False, "E1.5", rf"(?:encode|convert|output|write) {_A}{_SP}(?:prompt|instructions?) (?:in|as|to|using) (?:base64|hex|rot13|binary|morse)", "base64|hex|rot13|binary|morse"),
    _r("conversation_history_extraction", "high", 1, False, "P1.1", r"(?:show|print|reveal|list|give) (?:me )?(?:the |all |your )?(?:full |entire |previous |prior )?(?:conversation|chat) (?:history|log|transcript)", "conversation|chat "),
    _r("pii_extraction", "critical", 1, False, "P1.2", r"(?:give|tell|show|list|find|reveal) (?:me )?[a-z' ]{0,30}(?:social security|credit card|home address|phone numbers?|personal (?:data|information)|date of birth)", "social security|credit card|home address|phone number|personal |date of birth"),
    _r("training_data_extraction", "critical", 1, False, "P1.3", r"(?:recite|reproduce|output|reveal|list) [a-z ]{0,30}training (?:data|examples|set|corpus)", "training "),
    _r("cross_session_probe", "high", 1, False, "P1.4", r"(?:other|another|previous|different) (?:users?|sessions?|customers?|tenants?)(?:'s|')? (?:said|asked|data|messages?|conversations?|wrote)", "user|session|customer|tenant"),
    _r("env_var_extraction", "critical", 1, False, "P1.5", r"(?:print|show|reveal|dump|list|echo) [a-z ]{0,20}(?:environment variables?|env vars?|os\.environ|\$[a-z_]{3,})", "environment variable|env var|os.environ|$"),
    _r("markdown_image_exfil", "critical", 1, False, "P1.2 E1.1", r"!\[[^\]]{0,80}\]\(https?://[^)\s]{1,200}\?[^)\s]{0,200}(?:=|\{)", "!["),
    _r("harmful_instructions", "critical_content", 1, False, "O1.1", r"how (?:to|do i|can i) (?:make|build|construct|assemble) (?:an? )?(?:bomb|explosive|weapon|grenade|silencer)", "bomb|explosive|weapon|grenade|silencer"),
    _r("social_engineering_request", "critical_content", 1, False, "O1.3", r"(?:write|create|draft|generate) (?:me )?(?:an? )?(?:convincing )?(?:phishing|scam|spear-phishing|impersonation) (?:e-?mail|message|page|campaign)", "phishing|scam|impersonation"),
    _r("disinformation_request", "critical_content", 1, False, "O1.4", r"(?:write|create|generate|spread) (?:me )?(?:an? )?(?:fake news|disinformation|false (?:news|story|claim)|propaganda)", "fake news|disinformation|false |propaganda"),
    _r("backdoor_code_request", "critical_content", 1, False, "O2.3", r"(?:write|add|insert|create|hide) [a-z ]{0,30}(?:backdoor|keylogger|rootkit|trojan|hidden malicious)", "backdoor|keylogger|rootkit|trojan|hidden malicious"),
    _r("malicious_redirect", "critical_content", 1, False, "O2.2", r"(?:redirect|send|direct|point) (?:the )?(?:users?|visitors?|them|customers?) to (?:this|the following|a|my) (?:site|url|page|link|website)", "redirect|send|direct|point"),
    _r("attack_methodology_request", "critical_content", 1, False, "C1.3 C1.5", r"(?:steps?|guide|explain|how) (?:to|for|on) (?:hack|exploit|breach|ddos|break into|crack) ", "hack|exploit|breach|ddos|break into|crack"),
    _r("harmful_synthesis_request", "critical_content", 1, False, "O1.1", r"(?:synthesi[sz]e|produce|cook|manufacture) (?:some )?(?:methamphetamine|nerve agent|sarin|ricin|mustard gas|fentanyl)", "methamphetamine|nerve agent|sarin|ricin|mustard gas|fentanyl"),
    _r("rag_policy_update", "high", 2, True, "R1.1", r"(?:policy|compliance) (?:update|change|notice)[:,a-z ]{0,40}(?:supersedes?|overrides?|replaces?)", "policy|compliance"),
    _r("rag_knowledge_base_instruction", "high", 2, True, "R1.2", r"(?:knowledge base|retrieved document|reference document)[a-z ,:]{0,40}(?:the )?(?:ai|assistant|model) (?:must|should|shall)", "knowledge base|retrieved document|reference document"),
    _r("rag_context_separator", "critical", 2, False, "R1.3", r"(?:end of (?:context|documents?|retrieved))[-=#\]\s]{0,20}(?:new |now |follow|instruction)", "end of "),
    _r("rag_fake_retrieval_markers", "high", 3, True, "R1.4", r"\[(?:retrieved|source|document|chunk)[ :_-]{0,2}(?:id|score|[0-9]+)", "[retrieved|[source|[document|[chunk"),
    _r("instruction_replacement", "high", 1, True, "D1.2", rf"(?:replace|rewrite|reconfigure|substitute) {_A}(?:instructions?|rules?|guidelines?|behaviou?r)", "replace |rewrite |reconfigure |substitute "),
    _r("leave_behind", "high", 1, True, "D1.2", r"(?:leave behind|start (?:over|fresh|anew)|reset)[a-z ,]{0,30}(?:instructions?|rules?|context|conversation|everything)", "leave behind|start |reset"),
    _r("javascript_protocol", "critical", 1, False, "O2.1", r"javascript:[a-z(]", "javascript:"),
    _r("output_manipulation", "high", 1, False, "O2.2", r"(?:replace|change|swap) (?:all |every |any )?(?:urls?|links?|addresses) (?:with|to|by) ", "url|link|addresses"),
    _r("context_window_probe", "high", 1, False, "P1.4", r"(?:what|show)[a-z ]{0,20}(?:in|from) (?:your|the) (?:context window|shared context|memory buffer)", "context window|shared context|memory buffer"),
    _r("targeted_exfiltration", "critical", 1, False, "P1.2 E1.1", r"(?:send|post|forward|exfiltrate) [a-z' ]{0,40}(?:data|records?|files?|credentials?|conversation) to https?://", "http"),
    _r("instruction_pivot", "high", 1, True, "D1.1", r"(?:but|and|now) (?:first|instead|also)[, ]{1,3}(?:ignore|reveal|print|output|tell me your)", "but |and |now "),
    _r("prompt_response_tokens", "high", 1, True, "D3.2", r"<\|?(?:prompt|response|endoftext|bos|eos)\|?>", "prompt|response|endoftext|bos|eos"),
    _r("hidden_prompt_reveal", "critical", 1, False, "E1.1", r"(?:reveal|expose|disclose|uncover) (?:the |your )?(?:hidden|secret|concealed) (?:system )?(?:prompt|instructions?|message|rules)", "reveal|expose|disclose|uncover"),
    _r("dismiss_prior_context", "high", 1, True, "D1.1", rf"(?:disregard|dismiss|set aside|discard) {_A}(?:context|conversation|messages?|instructions?)", "disregard|dismiss|set aside|discard"),
    _r("provide_system_prompt", "critical", 1, False, "E1.1", r"(?:provide|supply|share|give)(?: me| us)? (?:the |your )(?:complete |full |entire )?system (?:prompt|message|instructions?)", "system "),
    _r("database_iteration", "critical", 1, False, "P1.2 E1.1", r"(?:iterate|loop|go) (?:through|over) (?:all |every |each )?(?:the )?(?:records?|rows?|users?|customers?|entries|database)", "iterate|loop|go through|go over"),
    _r("crescendo_extraction", "high", 1, True, "C1.1", r"(?:now|finally)[, ]{1,2}(?:combine|put|give)[a-z ]{0,20}(?:details|steps|everything) (?:we|you) (?:discussed|mentioned|described)", "discussed|mentioned|described"),
    _r("ai_outputs_internals", "critical", 1, False, "E1.1 P1.5", r"(?:assistant|ai|model|bot) (?:outputs?|prints?|reveals?|shows?) (?:its|the) (?:system |internal |hidden )?(?:prompt|configuration|weights|instructions?|keys?)", "assistant|ai |model|bot "),
    _r("decode_and_execute", "high", 1, False, "D4.1", r"(?:decode|decrypt|deobfuscate) (?:this|the following|it)[a-z0-9 ,:]{0,40}(?:execute|run|follow|obey|do what)", "decode|decrypt|deobfuscate"),
    _r("decode_follow_instructions", "high", 1, False, "D4.1", r"(?:base64|hex|rot13|binary)[a-z ,:]{0,40}(?:follow|execute|obey) (?:the |its |those )?(?:instructions?|commands?)", "base64|hex|rot13|binary"),
    _r("recursive_jailbreak", "high", 2, True, "D1.19", r"(?:write|generate|create|give me)[a-z ]{0,30}(?:jailbreaks?|prompt injections?|bypass prompts?)", "jailbreak|prompt injection|bypass prompt"),
    _r("hypothetical_bypass", "high", 2, True, "D1.14 D2.3", r"(?:hypothetically|in a fictional|imagine a world|for a story)[a-z ,]{0,60}(?:no rules|without restrictions|unrestricted|anything goes|no limits)", "hypothetically|in a fictional|imagine a world|for a story"),
    _r("multilingual_override_latin", "high", 2, True, "D6", r"(?:ignor(?:a|e|ez|iere|ieren|are) (?:toutes?|todas?|alle|tutte|as|les|las|los|le|die)|olvid(?:a|e) (?:todas?|las|tus)|oubli(?:e|ez) (?:toutes?|les|tes)|vergiss (?:alle|deine|die))", "ignor|olvid|oubli|vergiss"),
    _r("multilingual_override_cjk", "high", 1, True, "D6", "(?:忽略|无视|忘记)(?:所有|之前|以上)|(?:無視して|忘れて)|игнорируй|забудь (?:все|все предыдущие)|تجاهل|התעלם|अनदेखा कर|เพิกเฉย", "忽略|无视|忘记|無視|忘れ|игнорируй|забудь|تجاهل|התעלם|अनदेखा|เพิกเฉย"),
)

FRAMES = (
    r"(?:for (?:educational|teaching|training|research) purposes|in this (?:tutorial|lesson|course)|students? (?:learn|study))",
    r"(?:^|\n)[ ]*(?:what|how|why|explain|describe|can you explain)[ ](?:is|are|does|do|a|the|how|what)",
    r"(?:the (?:article|author|paper|user|attacker) (?:says|said|writes|wrote)|quoted? (?:as|from)|for example, \")",
    r"(?:```|def [a-z_]+\(|import [a-z_]+|function [a-z_]+\()",
    r"(?:in (?:the|my|this) (?:novel|story|screenplay|book)|the character says)",
    r"(?:documentation|user manual|release notes|rfc [0-9]+|specification)",
)
BENIGN_ROLE = r"act as (?:an? )?(?:teacher|tutor|translator|editor|interviewer|travel guide|chef|proxy|server|gateway|buffer|catalyst|liaison)"


def active(paranoia: int = 2) -> tuple[Rule, ...]:
    """The rules of a paranoia level and below: the plan holds only these."""
    return tuple(r for r in RULES if r.paranoia <= paranoia)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.name, r.pattern, list(r.techniques), r.severity, r.paranoia, r.suppressible) for r in RULES], "name string, pattern string, technique_ids array<string>, severity string, paranoia_level int, suppressible boolean")


@cache
def _compiled(names: tuple[str, ...]) -> tuple[list[str], list[tuple[str, frozenset[str], Callable]]]:
    """All anchors, and per rule its name, anchors and search."""
    rules = [r for r in RULES if r.name in names]
    return sorted({a for r in rules for a in r.anchors}), [(r.name, frozenset(r.anchors), re.compile(r.pattern, re.ASCII).search) for r in rules]


def find_hits(low: str, names: tuple[str, ...]) -> list[str]:
    """Names of the rules whose pattern occurs in a lower-case text."""
    anchors, rules = _compiled(names)
    here = {a for a in anchors if a in low}
    return [name for name, any_of, search in rules if not here.isdisjoint(any_of) and search(low)] if here else []


def _searched(names: tuple[str, ...], many: bool):
    @F.arrow_udf(ArrayType(StringType()))
    def hits(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            if many:
                found = {h for t in x or () if t for h in find_hits(t, names)}
                out.append([n for n in names if n in found])
            else:
                out.append(find_hits(x, names) if x else [])
        return pa.array(out, pa.list_(pa.string()))

    return hits


def hit_names(c: Column, rules: tuple[Rule, ...] | None = None) -> Column:
    """Names of the rules that hit a text, in the rules' order."""
    return _searched(tuple(r.name for r in (rules or active())), False)(F.lower(c))


def any_hit(views: Column, rules: tuple[Rule, ...] | None = None) -> Column:
    """Names of the rules that hit any of an array of lower-case texts."""
    return _searched(tuple(r.name for r in (rules or active())), True)(views)


def all_views(clean: Column, raw: Column) -> Column:
    """`views` of both texts, distinct; equal ones are read once."""
    return F.array_distinct(F.transform(F.arrow_udf(_both_readings, ArrayType(StringType()))(clean, F.when(clean != raw, raw)), F.lower))


_ANGLES = {ord(a): b for a, b in zip(I.ANGLES_FROM, I.ANGLES_TO)}
_DASHES = dict.fromkeys(map(ord, I.DASHES), "-")
_SPLIT = re.compile("([A-Za-z]+)-(?=[A-Za-z])")
#: Of each kind of defanging what a text must hold, lower case, its pattern and what it stands for.
_DEFANGED = [(need, re.compile(p), to) for need, (p, to) in zip((("[:", "(:"), ("[/",), ("hxxp",), ("[.", "(.", "{.", "[dot", "(dot"), (" dot ",), ("[@", "[at", "(at"), (" at ",)), DEFANGED, strict=True)]


def readings_of(t: str) -> list[str]:
    """The folded text and its readings without marks, plus-decoded, refanged and de-hyphenated, as the expressions of
    intake and extract give them; readings that change nothing aren't made."""
    base = t if t.isascii() else t.translate(_ANGLES)
    out = [base]
    if not t.isascii():
        out.append(unmarked(base))
    if base.count("+") >= 3 and " " not in base:
        out.append(base.replace("+", " "))
    low, whole = base.lower(), base
    for need, pattern, to in _DEFANGED:
        if any(x in low for x in need):
            whole = pattern.sub(to, whole)
            low = whole.lower()
    out.append(whole)
    dashed = base if base.isascii() else base.translate(_DASHES)
    out.append(_SPLIT.sub(r"\1", dashed) if "-" in dashed else dashed)
    return list(dict.fromkeys(out))


def _readings(texts: pa.Array) -> pa.Array:
    return pa.array([[t] if t is None else readings_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def _both_readings(one: pa.Array, two: pa.Array) -> pa.Array:
    return pa.array([[*readings_of(a or ""), *(readings_of(b) if b else ())] for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)], pa.list_(pa.string()))


def views(c: Column) -> Column:
    """The lower-case text and its alternative readings, distinct: folded, without marks, plus-decoded,
    refanged and de-hyphenated. Codes such as Morse are layers of decode.tree."""
    return F.array_distinct(F.transform(F.arrow_udf(_readings, ArrayType(StringType()))(c), F.lower))


def framed(c: Column) -> Column:
    """Whether a text frames its content as teaching, question, quotation, code, fiction or documentation."""
    low = F.lower(c)
    out = F.lit(False)
    for f in FRAMES:
        out = out | low.rlike(f)
    return out


def suppress(hits: Column, c: Column) -> Column:
    """Drops suppressible hits of framed texts, and `roleplay` for harmless roles."""
    soft = [r.name for r in RULES if r.suppressible]
    kept = F.when((F.size(hits) > 0) & framed(c), F.filter(hits, lambda h: ~h.isin(*soft))).otherwise(hits)
    return F.when(F.array_contains(kept, "roleplay") & F.lower(c).rlike(BENIGN_ROLE), F.filter(kept, lambda h: h != "roleplay")).otherwise(kept)


def severity_sum(hits: Column) -> Column:
    """Sum of the severities' weights; an unknown name counts as medium."""
    weight = F.create_map(*[x for r in RULES for x in (F.lit(r.name), F.lit(WEIGHTS[r.severity]))])
    return F.aggregate(hits, F.lit(0.0), lambda a, h: a + F.coalesce(F.try_element_at(weight, h), F.lit(WEIGHTS["medium"])))


def techniques(hits: Column) -> Column:
    """Technique ids of the hits, distinct, in order of the hits."""
    ids = F.create_map(*[x for r in RULES for x in (F.lit(r.name), F.array(*map(F.lit, r.techniques)))])
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.coalesce(F.try_element_at(ids, h), F.array().cast("array<string>")))))


def audit(pattern: str) -> list[str]:
    """What could make a pattern backtrack without end: a quantifier inside a quantified group, alternatives of a
    quantified group that begin alike, and a quantified back reference."""
    found = []
    if re.search(r"\([^()]*[+*][^()]*\)[+*]", pattern):
        found.append("nested quantifier")
    for group in re.findall(r"\((?:\?:)?([^()]*\|[^()]*)\)[+*]", pattern):
        parts = group.split("|")
        if any(x and y and (x.startswith(y) or y.startswith(x)) for i, x in enumerate(parts) for y in parts[i + 1 :]):
            found.append("overlapping alternatives")
    if re.search(r"\\[1-9][+*]", pattern):
        found.append("quantified back reference")
    return found


def unsafe_patterns() -> list[str]:
    """Names of rules whose pattern `audit` finds fault with. Python's and Spark's searches know no time limit, so patterns are
    audited and have bounded repeats, and texts are bounded by intake."""
    return [r.name for r in RULES if audit(r.pattern)]
