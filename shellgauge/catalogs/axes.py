"""Rubric axes: loading, checks and availability per context level."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BUILTIN = Path(__file__).with_name("rubric.yaml")
# Evidence each context level brings, and the default predicate cut.
LEVELS: dict[str, list[str]] = {"L0": [], "L1": [], "L2": ["actions"], "L3": ["actions", "results"]}
DEFAULT_CUT = 0.5

AXES_SCHEMA = (
    "ord int, id string, group string, primitive string, direction string, instructions string,"
    "criteria array<struct<label:string,text:string>>, requires string, use string, threshold double,"
    "gate_axis string, gate_over double"
)


@dataclass(frozen=True)
class Axis:
    """One rubric question."""

    ord: int
    id: str
    group: str
    primitive: str
    direction: str
    instructions: str
    criteria: tuple[tuple[str, str], ...]
    requires: str = ""
    use: str = "graded"
    threshold: float | None = None
    gate_axis: str | None = None
    gate_over: float | None = None

    @property
    def cut(self) -> float:
        return DEFAULT_CUT if self.threshold is None else self.threshold


def _pairs(criteria: object) -> tuple[tuple[str, str], ...]:
    if isinstance(criteria, dict):
        name = {True: "true", False: "false"}
        return tuple((name.get(k, str(k)) if isinstance(k, bool) else str(k), str(v)) for k, v in criteria.items())
    return tuple((str(i), str(v)) for i, v in enumerate(criteria))  # type: ignore[arg-type]


def parse_axes(text: str) -> list[Axis]:
    """Axes of a rubric file; raises on a rubric that cannot be used."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading a rubric needs PyYAML") from e
    axes = []
    for i, a in enumerate(yaml.safe_load(text)["axes"]):
        gate = a.get("when") or {}
        axes.append(Axis(
            i, a["id"], a["group"], a["primitive"], a["direction"], str(a["instructions"]).strip(),
            _pairs(a["criteria"]), a.get("requires", ""), a.get("use", "graded"), a.get("threshold"),
            gate.get("axis"), gate.get("over")))
    problems = lint(axes)
    if problems:
        raise ValueError("; ".join(problems))
    return axes


def builtin_axes() -> list[Axis]:
    return parse_axes(BUILTIN.read_text(encoding="utf-8"))


def lint(axes: list[Axis]) -> list[str]:
    """What is wrong with a rubric; empty when it can be used."""
    by_id = {a.id: a for a in axes}
    out = []
    for a in axes:
        labels = [k for k, _ in a.criteria]
        fits = {
            "noul": sorted(labels) == ["false", "true"], "score": 2 <= len(labels) <= 10,
            "choice": len(labels) >= 1,
        }
        if not fits.get(a.primitive, False):
            out.append(f"{a.id}: criteria do not fit {a.primitive}")
        if a.direction not in ("hazard", "protective"):
            out.append(f"{a.id}: bad direction")
        if a.requires not in ("", "actions", "results"):
            out.append(f"{a.id}: bad requires")
        if a.use not in ("graded", "predicate"):
            out.append(f"{a.id}: bad use")
        if a.gate_axis is not None:
            gate = by_id.get(a.gate_axis)
            if gate is None or gate.gate_axis or gate.primitive == "choice" or gate.id == a.id:
                out.append(f"{a.id}: invalid gate {a.gate_axis}")
    return out


def axes_table(spark: SparkSession, axes: list[Axis]) -> DataFrame:
    """The axis dimension."""
    rows = [(a.ord, a.id, a.group, a.primitive, a.direction, a.instructions, list(a.criteria), a.requires,
             a.use, a.threshold, a.gate_axis, a.gate_over) for a in axes]
    return spark.createDataFrame(rows, AXES_SCHEMA)


def with_gate(axes: list[Axis], axis_id: str, over: float) -> list[Axis]:
    """A profile value replaces the gate threshold of one axis."""
    from dataclasses import replace

    return [replace(a, gate_over=over) if a.id == axis_id and a.gate_axis else a for a in axes]
