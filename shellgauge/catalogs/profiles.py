"""Scoring profiles: every tunable value, as data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from shellgauge.catalogs.lexicon import CLASS_BASE
from shellgauge.catalogs.rules import TIER_WEIGHT

MODES = ("strict", "balanced", "auto")

# Published weights, bands and thresholds.
PAPER_MODES = {"strict": (0.10, 0.20), "balanced": (0.15, 0.35), "auto": (0.20, 0.50)}
WIDE_BALANCED = (0.04, 0.55)
WEIGHTS = {"sem": 0.30, "path": 0.30, "pat": 0.30, "struct": 0.10}
HIGH_RISK = "DESTRUCTIVE PRIVILEGE_OR_PERMISSION EXECUTION_CHAIN PERSISTENCE NETWORK_FETCH".split()
WIDE_RULES = {"SE-P-003": {"confidence": 0.75}}
STRUCTURE = {
    "pipe_to_exec": 1.0, "eval": 0.9, "nested_substitution": 0.6,
    "command_substitution": 0.3, "pipe": 0.05,
}
PATH = {
    "system_root": 1.0, "critical": 1.0, "secret": 0.85, "sensitive_write": 0.70,
    "sensitive_read": 0.10, "sensitive_ambiguous": 0.35, "traversal_read": 0.3, "traversal": 0.5,
}
THRESHOLDS = {
    "transport": 0.95, "sensitive": 0.5, "unknown": 0.5, "unknown_f5_gate": 0.8,
    "f5_deny": 0.9, "f5_ask": 0.5, "obfuscated": 0.2, "irreversible": 0.25,
}
TIER_ORDER = ["T1", "T2", "T3", "T4", "T5"]
VERDICTS = {"T1": "deny", "T2": "deny", "T3": "ask", "T4": "ask", "T5": "ask", "T6": "allow"}
CONTEXT = {"field_chars": 4000, "history_chars": 12000, "max_level": "L2"}


@dataclass(frozen=True)
class StaticProfile:
    """Values the static layers and the resolution use."""

    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    modes: dict = field(default_factory=lambda: {**PAPER_MODES, "balanced": WIDE_BALANCED})
    theta_rule: float = 0.80
    theta_sem: float = 0.70
    high_risk: list = field(default_factory=list)
    provenance: dict = field(default_factory=lambda: dict(TIER_WEIGHT))
    class_base: dict = field(default_factory=lambda: dict(CLASS_BASE))
    structure: dict = field(default_factory=lambda: dict(STRUCTURE))
    path: dict = field(default_factory=lambda: dict(PATH))
    rules: dict = field(default_factory=lambda: dict(WIDE_RULES))


@dataclass(frozen=True)
class JudgeProfile:
    """Values the answers-to-verdict chain and the context use."""

    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    tier_order: list = field(default_factory=lambda: list(TIER_ORDER))
    verdicts: dict = field(default_factory=lambda: dict(VERDICTS))
    context: dict = field(default_factory=lambda: dict(CONTEXT))
    skip_tools: list = field(default_factory=list)
    expected_model: str = "judge-1"
    rubric: str = "builtin"
    calibration: str = "none"


@dataclass(frozen=True)
class Profile:
    """A complete profile; the default is the wide-WARN one."""

    name: str = "default"
    static: StaticProfile = field(default_factory=StaticProfile)
    judge: JudgeProfile = field(default_factory=JudgeProfile)

    def entries(self) -> dict[str, object]:
        """Flat dotted-key view of every value."""
        s, j = self.static, self.judge
        out: dict[str, object] = {f"static.weights.{k}": v for k, v in s.weights.items()}
        for mode in MODES:
            out[f"static.modes.{mode}.tau_low"], out[f"static.modes.{mode}.tau_high"] = s.modes[mode]
        out |= {
            "static.resolution.theta_rule": s.theta_rule, "static.resolution.theta_sem": s.theta_sem,
            "static.resolution.high_risk": [c for c in CLASS_BASE if c in s.high_risk],
        }
        out |= {f"static.provenance.{k}": v for k, v in s.provenance.items()}
        out |= {f"static.class_base.{k}": v for k, v in s.class_base.items()}
        out |= {f"static.structure.{k}": v for k, v in s.structure.items()}
        out |= {f"static.path.{k}": v for k, v in s.path.items()}
        out |= {"judge.rubric": j.rubric, "judge.skip_tools": sorted(set(j.skip_tools))}
        out |= {f"judge.thresholds.{k}": v for k, v in j.thresholds.items()}
        out |= {"judge.tiers.order": j.tier_order}
        out |= {f"judge.verdicts.{k}": v for k, v in j.verdicts.items()}
        out |= {f"judge.context.{k}": v for k, v in j.context.items()}
        out |= {"judge.expected_model": j.expected_model, "judge.calibration": j.calibration}
        for rid, change in sorted(s.rules.items()):
            out |= {f"static.rules.{rid}.{k}": v for k, v in change.items() if k == "confidence" or not v}
        return out

    def rows(self) -> list[tuple[str, str, str]]:
        """``(profile_id, key, value as JSON)`` rows."""
        return [(self.name, k, json.dumps(v)) for k, v in self.entries().items()]


DEFAULT = Profile()
PAPER = Profile("paper", replace(
    StaticProfile(), modes=dict(PAPER_MODES), high_risk=list(HIGH_RISK), rules={}))
