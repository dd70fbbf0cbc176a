"""Confidence, status, similarity and token arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_WEIGHT = {"adr": 1.0, "human": 1.0, "auditor": 0.9, "agent": 0.75}
STALE, ADR_FLOOR, HUMAN_FLOOR = 0.9, 0.95, 0.90
MIN_CONFIDENCE, MIN_SUPPORT = 0.75, 3
RRF_K = 60

#: Fixed values: (from, to) -> who may do it.
TRANSITIONS = {
    ("candidate", "validated"): ("adr", "agent", "auditor", "human", "revalidation"),
    ("candidate", "rejected"): ("adr", "agent", "human"),
    ("candidate", "superseded"): ("adr", "human"),
    ("candidate", "deprecated"): ("adr", "human"),
    ("validated", "deprecated"): ("adr", "auditor", "human", "revalidation"),
    ("validated", "superseded"): ("adr", "human"),
    ("deprecated", "validated"): ("adr", "auditor", "human", "revalidation"),
    ("deprecated", "superseded"): ("adr", "human"),
}
#: Steps of a feature's status.
FEATURE_STEPS = {("planning", "in_progress"), ("planning", "verifying"), ("planning", "done"), ("planning", "abandoned"), ("in_progress", "verifying"), ("in_progress", "done"), ("in_progress", "abandoned"), ("verifying", "in_progress"), ("verifying", "done"), ("verifying", "abandoned")}


def wilson_lower_bound(successes: Column, total: Column, z: float = 1.0) -> Column:
    n, p = total.cast("double"), successes / total
    zz = z * z
    low = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), low))


def confidence(support: Column, violations: Column, source: Column, stale: Column | None = None, adr_accepted: Column | None = None, human_approved: Column | None = None, digits: int = 2) -> Column:
    weight = F.try_element_at(F.create_map(*[F.lit(v) for kv in SOURCE_WEIGHT.items() for v in kv]), source)
    value = wilson_lower_bound(support, support + violations) * weight
    no = F.lit(False)
    value = value * F.when(F.coalesce(stale if stale is not None else no, no), STALE).otherwise(1.0)
    value = F.when(F.coalesce(adr_accepted if adr_accepted is not None else no, no), F.greatest(value, F.lit(ADR_FLOOR))).otherwise(value)
    value = F.when(F.coalesce(human_approved if human_approved is not None else no, no), F.greatest(value, F.lit(HUMAN_FLOOR))).otherwise(value)
    return F.round(F.least(F.lit(1.0), value), digits)


def decide_status(current: Column, source: Column, adr_status: Column, support: Column, conf: Column, rederived: Column, human_validated: Column) -> Column:
    """The status that a proposal leaves a piece of knowledge in. `current` is null for a new one."""
    trusted = source.isin("auditor", "adr", "human") | rederived
    enough = support >= MIN_SUPPORT
    passes = trusted & (conf >= MIN_CONFIDENCE) & enough
    fresh = current.isNull() | (current == "candidate")
    return (
        F.when((source == "adr") & adr_status.isNotNull(), adr_status)
        .when(current.isin("rejected", "superseded"), current)
        .when(fresh, F.when(passes, "validated").otherwise("candidate"))
        .when((current == "validated") & human_validated, F.when(enough, current).otherwise("deprecated"))
        .when(current == "validated", F.when(trusted & ~passes, "deprecated").otherwise(current))
        .when((current == "deprecated") & (passes | (human_validated & enough)), "validated")
        .otherwise(current)
    )


def may_move(current: Column, target: Column, actor: Column, rederived: Column) -> Column:
    """Whether an actor (`kind[:name]`) may move knowledge from one status to another; staying is always allowed."""
    rules = F.create_map(*[x for (a, b), who in TRANSITIONS.items() for x in (F.lit(f"{a}>{b}"), F.array(*map(F.lit, who)))])
    kind = F.substring_index(actor, ":", 1)
    allowed = F.coalesce(F.array_contains(F.try_element_at(rules, F.concat_ws(">", current, target)), kind), F.lit(False))
    alone = (kind == "agent") & (current == "candidate") & (target == "validated") & ~rederived
    return (current == target) | (allowed & ~alone)


def feature_step(current: Column, target: Column) -> Column:
    return F.concat_ws(">", current, target).isin(*[f"{a}>{b}" for a, b in sorted(FEATURE_STEPS)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Of the common prefix; a vector of length 0 counts as of length 1."""
    norm = lambda v: F.sqrt(dot(v, v))
    one = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return dot(a, b) / (one(a) * one(b))


def count_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def rrf(rank: Column, weight: Column) -> Column:
    return weight / (rank + F.lit(RRF_K))


def maturity(fan_in: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.log2(1 + fan_in.cast("double")) / F.log2(F.lit(9.0))), 3)


def verdict(score: Column) -> Column:
    return F.when(score >= 0.70, "reuse").when(score >= 0.50, "extend").otherwise("new_ok")


def token_economy(total: Column, targeted: Column, pack: Column) -> dict[str, Column]:
    """What a packed context saves against blind reading: files avoided, tokens, dollars, and a band."""
    files = F.when(total == 0, F.greatest(F.lit(25), targeted * 5)).otherwise(total)
    avoided = F.greatest(F.lit(0), files - targeted)
    blind = F.least(files, F.lit(25)) * 2500
    saved = F.greatest(F.lit(0), blind - pack)
    return {
        "files_avoided": avoided,
        "avoided_pct": F.round(avoided / files * 100, 1),
        "blind_tokens": blind,
        "saved_tokens": saved,
        "saved_pct": F.when(blind > 0, F.round(saved / blind * 100, 1)).otherwise(0.0),
        "saved_usd": F.round(saved / 1e6 * 3, 4),
        "band": F.when(pack < 5000, "Pristine").when(pack < 10000, "Focused").when(pack < 20000, "Moderate").otherwise("Diluted"),
    }
