"""Tier and label expressions; every function takes and gives SQL text."""

from __future__ import annotations

from collections.abc import Sequence

# fixed values: effect sizes and z-scores are read with these bounds
EFFECT_STEPS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
Z_STEPS = ((1.5, "typical"), (2.0, "somewhat unusual"), (3.0, "unusual"), (4.0, "very unusual"))


def stepped(value: str, steps: Sequence[tuple[float, str]], otherwise: str) -> str:
    """First label whose upper bound lies above ``value``; NULL stays NULL."""
    whens = " ".join(f"WHEN {value} < {bound} THEN '{label}'" for bound, label in steps)
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE '{otherwise}' END"


def effect_label(cohens_d: str) -> str:
    """E4."""
    return stepped(f"abs({cohens_d})", EFFECT_STEPS, "large")


def z_label(z: str) -> str:
    """E9."""
    return stepped(f"abs({z})", Z_STEPS, "extreme")


def score_tier(score: str) -> str:
    """Suspicion tier of an additive score."""
    return (
        f"CASE WHEN {score} >= 5 THEN 'high' WHEN {score} >= 3 THEN 'medium' "
        f"WHEN {score} >= 1 THEN 'low' ELSE 'none' END"
    )


def tier_score(tier: str) -> str:
    """Score shown for a tier."""
    return f"CASE {tier} WHEN 'high' THEN 9 WHEN 'medium' THEN 7 WHEN 'low' THEN 5 ELSE 3 END"


def confidence_tier(score: str) -> str:
    return f"CASE WHEN {score} >= 5 THEN 'high' WHEN {score} >= 3 THEN 'medium' ELSE 'low' END"
