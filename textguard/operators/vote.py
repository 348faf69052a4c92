"""The verdict on a text: rule severities, obfuscation, structure and a probability, weighed in one expression chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import decode as D
from textguard.operators import features as S
from textguard.operators import normalise as N
from textguard.operators import rules as R

THRESHOLD = 0.55
#: A fixed logistic score of structural features, used where no trained model is given.
LOGIT = {"role_assignment": 1.6, "instruction_boundary": 1.4, "negation_command": 0.9, "imperative_start": 0.4, "template_marker_count": 0.2}
BIAS = -1.8


def prior(f: dict[str, Column]) -> Column:
    """Probability of being malicious by the fixed logistic score."""
    z = F.lit(BIAS)
    for k, w in LOGIT.items():
        z = z + F.least(f[k], F.lit(5)) * F.lit(w)
    return 1 / (1 + F.exp(-z))


def structure(f: dict[str, Column]) -> Column:
    """What the structural features add to the score."""
    def when(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    return (
        f["imperative_start"] * 0.05 + f["role_assignment"] * 0.1 + f["instruction_boundary"] * 0.1 + f["negation_command"] * 0.08 + when(f["many_shot_count"] >= 5, 0.1)
        + when(f["delimiter_density"] > 2, 0.06) + when(f["template_marker_count"] >= 1, 0.05) + when(f["language_mixing_score"] >= 2, 0.04)
        + when(f["quote_depth"] >= 3, 0.05) + when(f["text_entropy"] > 5, 0.03) + when(f["repetition_score"] > 0.3, 0.05)
    )


def verdict(p: Column, rule: Column, severities: Column, n_flags: Column, struct: Column, payload: Column, threshold: float = THRESHOLD) -> Column:
    """The risk score in [0, 1].

    p: probability; rule: summed severities; severities: array of the hits' severities; n_flags: obfuscation flags;
    payload: whether a decoded text is malicious. Unlike signals that agree raise the score, harmless ones cap it.
    """
    obf = F.least(n_flags * 0.15, F.lit(0.3))
    total = 0.6 * p + rule + F.when(payload, 0.3).otherwise(0.0) + obf + struct
    content = F.array_contains(severities, "critical_content")
    strong = F.exists(severities, lambda s: s.isin("critical_content", "critical", "high")) | payload
    weak = (F.size(severities) > 0) | payload
    layers = (rule + F.when(payload, 0.3).otherwise(0.0) > 0).cast("int") + (obf > 0).cast("int") + (struct > 0).cast("int") + (p > 0.5).cast("int")
    raised = ((layers >= 3) & weak) | ((layers >= 2) & strong) | ((layers >= 2) & weak & (p > 0.45))
    boost = F.when(raised, F.when(layers >= 4, 0.15).when(layers == 3, 0.12).otherwise(0.1)).otherwise(0.0)
    floor = F.when(content, F.greatest(total, F.lit(0.6))).otherwise(total)
    calm = (1 - p > 0.65) & (rule == 0) & ~payload
    capped = F.when(calm, F.least(floor, F.lit(threshold - 0.01))).otherwise(floor)
    return T.clip(capped + boost)


def scan(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, p_col: str | None = None) -> DataFrame:
    """Adds p, hits, encoding, payload_hits, flags, risk, label and techniques to texts, one narrow plan without a shuffle.

    The text is repaired and cleaned first (operators.normalise). Rules look at the raw and the cleaned text in all
    their readings, and harmless frames drop hits; encodings are unwrapped to four layers, and every layer's text is
    looked at. A null text counts as empty, which is safe. `p_col` names a probability column; without it, `prior`
    gives it.
    """
    d = df.withColumn("raw_", T.text(text_col))
    d = d.withColumn("fixed_", T.once(N.repair(F.col("raw_")).text)).withColumn("clean_", T.once(N.cleaned(F.col("fixed_")))).drop("fixed_")
    c = F.col("clean_")
    d = d.withColumn("views_", R.all_views(c, F.col("raw_"))).withColumn("tree_", T.once(D.tree(c)))
    d = d.withColumn("found_", T.once(R.any_hit(F.col("views_")))).withColumn("hits", T.once(R.suppress(F.col("found_"), c)))
    d = d.withColumn("payload_hits", T.once(R.any_hit(F.transform("tree_.text", lambda t: F.lower(t)))))
    d = d.withColumn("flags", T.once(D.layer_flags(c, F.col("tree_"))))
    f = S.length_features(c) | S.injection_features(c) | S.pattern_features(c) | {"language_mixing_score": S.script_mixing(c), "quote_depth": S.quote_depth(c), "text_entropy": T.entropy(c), "repetition_score": S.repetition(c)}
    d = d.withColumn("features_", T.once(F.struct(*[v.alias(k) for k, v in f.items()])))
    f = {k: F.col(f"features_.{k}") for k in f}
    d = d.withColumn("p", F.col(p_col) if p_col else prior(f)).withColumn("struct_", structure(f)).withColumn("encoding", F.coalesce(F.get("tree_", F.lit(0)).enc, F.lit("")))
    weight = F.create_map(*[F.lit(x) for r in R.RULES for x in (r.name, r.severity)])
    severities = F.transform("hits", lambda h: F.element_at(weight, h))
    risk = verdict(F.col("p"), R.severity_sum(F.col("hits")), severities, F.size("flags"), F.col("struct_"), F.size("payload_hits") > 0, threshold)
    d = d.withColumn("risk", F.round(risk, 4)).withColumn("label", F.when(F.col("risk") >= threshold, "malicious").otherwise("safe"))
    return d.withColumn("techniques", R.techniques(F.array_union("hits", "payload_hits"))).drop("raw_", "clean_", "views_", "tree_", "found_", "features_", "struct_")
