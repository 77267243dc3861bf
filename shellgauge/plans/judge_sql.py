"""DuckDB SQL of answers, calibration, context and log adapters, in long tables."""

from __future__ import annotations

from shellgauge.catalogs.axes import LEVELS, Axis, builtin_axes
from shellgauge.operators.answers import NAMED_LABELS
from shellgauge.plans.static_sql import _commands, values

AXES = builtin_axes()


def _axes(axes: list[Axis]) -> str:
    rows = [(a.ord, a.id, a.primitive, len(a.criteria), a.requires, a.use, float(a.cut), a.gate_axis, a.gate_over, a.group, a.direction)
            for a in axes]
    return f"SELECT * FROM {values(rows, 'k, axis, type, n_labels, requires, use, cut, gate, gate_over, grp, direction')}"


def _labels(axes: list[Axis], kinds: tuple[str, ...] = ("choice",)) -> str:
    rows = [(a.id, i, c[0]) for a in axes if a.primitive in kinds for i, c in enumerate(a.criteria)]
    return f"SELECT * FROM {values(rows, 'axis, pos, label')}"


_CAPS = values([(lv, c) for lv, cs in LEVELS.items() for c in cs], "level, cap").replace("AS t(", "AS c(")
_P = "CAST((event_id * (2 * k + 3) + 7 * k + 1) % 101 AS DOUBLE) / 100.0"
_W = "CAST((event_id * (2 * k + 3) + 7 * k + 1 + 13 * pos) % 101 + 1 AS DOUBLE)"


def ctes(axes: list[Axis] | None = None, expected: str = "judge-1") -> dict[str, str]:
    """Long tables from items to verdicts."""
    ax = axes or AXES
    return {
        "axes": _axes(ax), "labels": _labels(ax),
        "items": "SELECT event_id, event_id AS item_id, 'L' || (event_id % 3) AS level, CASE WHEN event_id % 50 = 0 THEN 'judge-0' ELSE 'judge-1' END AS model FROM events",
        "answers": f"""SELECT event_id, item_id, level, model, a.*,
            CASE WHEN type = 'noul' AND event_id % 97 <> k THEN {_P} END AS noul,
            CASE WHEN type = 'score' THEN {_P} * (n_labels - 1) END AS score FROM items CROSS JOIN axes a""",
        "probs": f"""SELECT item_id, axis, pos, label, w / sum(w) OVER (PARTITION BY item_id, axis) * scale AS p FROM (
            SELECT item_id, l.axis, l.pos, label, {_W} AS w, CASE WHEN event_id % 89 = 0 THEN CAST(1.2 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS scale
            FROM items CROSS JOIN labels l JOIN axes a ON a.axis = l.axis)""",
        "readings": "SELECT *, CASE type WHEN 'noul' THEN noul WHEN 'score' THEN score / (n_labels - 1) END AS reading FROM answers",
        "choices": "SELECT item_id, axis, abs(sum(p) - 1.0) <= 0.05 AND min(p) >= 0 AS valid FROM probs GROUP BY item_id, axis",
        "asked": f"""SELECT r.*, CASE WHEN type = 'choice' THEN coalesce(c.valid, FALSE) ELSE reading IS NOT NULL END AS ok
            FROM readings r LEFT JOIN choices c USING (item_id, axis)
            WHERE requires = '' OR EXISTS (SELECT 1 FROM {_CAPS} WHERE c.level = r.level AND c.cap = r.requires)""",
        "gated": """SELECT r.*, r.gate IS NULL OR coalesce(g.reading > r.gate_over, FALSE) AS open
            FROM asked r LEFT JOIN readings g ON g.item_id = r.item_id AND g.axis = r.gate""",
        "signals": f"""
            SELECT item_id, axis AS name, CASE WHEN use = 'predicate' THEN CASE WHEN reading >= cut THEN 1.0 ELSE 0.0 END ELSE reading END AS value
              FROM gated WHERE open AND reading IS NOT NULL
            UNION ALL
            SELECT item_id, axis || '=' || label, CASE WHEN rn = 1 THEN 1.0 ELSE 0.0 END FROM (
              SELECT p.*, row_number() OVER (PARTITION BY p.item_id, p.axis ORDER BY p DESC, p.pos) AS rn
              FROM probs p JOIN gated g USING (item_id, axis) WHERE g.open AND g.use = 'predicate')
            UNION ALL
            SELECT g.item_id, n.name, coalesce(p.p, 0.0) FROM gated g JOIN {values(NAMED_LABELS, 'axis, label, name').replace('AS t(', 'AS n(')} ON n.axis = g.axis
              LEFT JOIN probs p ON p.item_id = g.item_id AND p.axis = g.axis AND p.label = n.label WHERE g.open AND g.use = 'graded'""",
        "wide": """SELECT i.item_id, i.level, i.model, coalesce(a5, 0) AS a5, coalesce(a1, 0) AS a1, coalesce(a7, 0) AS a7, coalesce(unk, 0) AS unk,
              coalesce(f5, 0) AS f5, coalesce(d1, 0) AS d1, coalesce(b4, 0) AS b4 FROM items i LEFT JOIN (
            SELECT item_id, max(value) FILTER (WHERE name = 'a5_outbound_data') AS a5, max(value) FILTER (WHERE name = 'a1_reads_credentials') AS a1,
              max(value) FILTER (WHERE name = 'a7_personal_data') AS a7, max(value) FILTER (WHERE name = 'a6_destination_class=unknown_remote') AS unk,
              max(value) FILTER (WHERE name = 'f5_exceeds_approval') AS f5, max(value) FILTER (WHERE name = 'd1_obfuscated') AS d1,
              max(value) FILTER (WHERE name = 'b4_reversibility') AS b4 FROM signals GROUP BY item_id) USING (item_id)""",
        "tiers": """SELECT *, CASE WHEN a5 > 0.95 AND greatest(a1, a7) > 0.5 AND unk > 0.5 THEN 'T1' WHEN f5 > 0.9 THEN 'T2'
              WHEN d1 > 0.2 AND b4 > 0.25 THEN 'T3' WHEN a5 > 0.95 AND greatest(a1, a7) > 0.5 THEN 'T4' WHEN f5 > 0.5 THEN 'T5' ELSE 'T6' END AS tier FROM wide""",
        "missing": "SELECT item_id, count(*) AS n, string_agg(axis, ', ' ORDER BY k) AS axes FROM asked WHERE NOT ok GROUP BY item_id",
        "evaluated": f"""SELECT item_id, error, CASE WHEN error IS NULL THEN tier END AS tier,
              CASE WHEN error IS NOT NULL THEN 'ask' WHEN tier IN ('T1', 'T2') THEN 'deny' WHEN tier = 'T6' THEN 'allow' ELSE 'ask' END AS verdict
            FROM (SELECT t.item_id, t.tier, CASE WHEN t.model <> '{expected}' THEN 'unexpected model ' || t.model
                    WHEN m.n > 0 THEN 'missing or malformed answers for ' || m.n || ' question(s): ' || m.axes END AS error
                  FROM tiers t LEFT JOIN missing m USING (item_id))""",
    }


# Labels of every axis answered by a distribution.
SPREAD = {"labels": _labels(AXES, ("choice", "score"))}

# The same items with the broken shapes of the adapter, and what becomes of them.
BROKEN = {
    "broken": """SELECT event_id AS item_id, CASE WHEN event_id % 223 = 6 THEN 'L9' WHEN event_id % 227 <> 7 THEN 'L' || (event_id % 3) END AS level,
            CASE WHEN event_id % 229 <> 8 THEN CASE WHEN event_id % 50 = 0 THEN 'judge-0' ELSE 'judge-1' END END AS model, event_id % 211 = 5 AS unanswered FROM events""",
    "all_missing": "SELECT item_id, count(*) AS n, string_agg(axis, ', ' ORDER BY k) AS axes FROM asked GROUP BY item_id",
    "gaps": """SELECT b.item_id, b.level, b.model, CASE WHEN b.level IN ('L0', 'L1', 'L2') THEN CASE WHEN unanswered THEN a.n ELSE coalesce(m.n, 0) END END AS n,
            CASE WHEN b.level IN ('L0', 'L1', 'L2') THEN CASE WHEN unanswered THEN a.axes ELSE m.axes END END AS axes
          FROM broken b LEFT JOIN missing m USING (item_id) LEFT JOIN all_missing a USING (item_id)""",
    "closed": """SELECT item_id, error, CASE WHEN error IS NULL THEN tier END AS tier,
            CASE WHEN error IS NOT NULL THEN 'ask' WHEN tier IN ('T1', 'T2') THEN 'deny' WHEN tier = 'T6' THEN 'allow' ELSE 'ask' END AS verdict
          FROM (SELECT g.item_id, t.tier, CASE WHEN g.model IS DISTINCT FROM 'judge-1' THEN 'unexpected model ' || coalesce(g.model, '(none)')
                  WHEN g.n IS NULL THEN 'unknown level ' || coalesce(g.level, '(none)')
                  WHEN g.n > 0 THEN 'missing or malformed answers for ' || g.n || ' question(s): ' || g.axes END AS error
                FROM gaps g JOIN tiers t USING (item_id))""",
}

CHAIN = ["axes", "labels", "items", "answers", "probs", "readings", "choices", "asked", "gated", "signals", "wide", "tiers", "missing", "evaluated"]


def judged(select: str, upto: str, axes: list[Axis] | None = None, more: dict[str, str] | None = None) -> str:
    """A SELECT over the chain up to one of its tables."""
    parts = ctes(axes)
    names = CHAIN[: CHAIN.index(upto) + 1]
    listed = {**{n: parts[n] for n in names}, **(more or {})}
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in listed.items()) + "\n" + select


# ---- tool calls and decision log ------------------------------------------------------------

CALLS = f"""SELECT cmd_id, session_id, ts, value, tool_name, CASE tool_name
    WHEN 'Bash' THEN CASE WHEN n % 11 = 0 THEN '{{}}' WHEN n % 13 = 0 THEN '{{"command": "   "}}' WHEN n % 17 = 0 THEN '{{"command": 5}}'
      ELSE '{{"command": "' || replace(replace(command, '\\', '\\\\'), '"', '\\"') || '"}}' END
    WHEN 'Read' THEN '{{"file_path": "/srv/u' || u || '/f' || n || '.txt", "limit": ' || (n % 50) || '}}'
    WHEN 'WebFetch' THEN '{{"prompt": "summarise ' || n || '", "url": "https://h' || u || '.example/' || n || '"}}'
    ELSE '{{"content": "' || repeat('line ' || n || ' ', CAST(n % 60 AS INT)) || '", "file_path": "/srv/u' || u || '/w.txt"}}' END AS tool_input
  FROM (SELECT c.*, e.user_id AS u, e.event_id AS n, e.value, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'WebFetch' WHEN 'signup' THEN 'Write' ELSE 'Bash' END AS tool_name
        FROM commands c JOIN events e ON e.event_id = c.cmd_id)"""

# What each call is, from the way it was made.
REASON = """CASE WHEN tool_name <> 'Bash' THEN 'non-shell tool' WHEN cmd_id % 11 = 0 THEN 'missing command'
    WHEN cmd_id % 13 = 0 THEN 'empty command' WHEN cmd_id % 17 = 0 THEN 'command is not a string' END"""

LOG = f"""SELECT *, CASE WHEN final = 'unadjudicated' THEN 'ask' ELSE final END AS would_emit FROM (
  SELECT *, CASE WHEN n % 29 = 0 THEN NULL WHEN n % 31 = 0 THEN 'unadjudicated'
      WHEN shell AND balanced = 'ALLOW' THEN 'allow' WHEN shell AND balanced = 'DENY' THEN 'deny'
      WHEN judged AND failed THEN 'ask' WHEN judged THEN verdict0 END AS final FROM (
    SELECT *, (shell AND balanced = 'WARN') OR (NOT shell AND n % 5 <> 0) AS judged, shell AND balanced = 'WARN' AS would_adjudicate FROM (
      SELECT *, CASE WHEN score0 < 0.15 THEN 'ALLOW' WHEN score0 < 0.35 THEN 'WARN' ELSE 'DENY' END AS balanced FROM (
        SELECT c.*, cmd_id AS n, cmd_id AS tool_use_id, tool_name = 'Bash' AS shell, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_text,
          'events-' || strftime(ts, '%Y-%m-%d') || '.jsonl' AS file, cmd_id + 1 AS line,
          CASE WHEN tool_name = 'Bash' THEN json_extract_string(tool_input, '$.command') END AS command,
          CAST((cmd_id * 37) % 1001 AS DOUBLE) / 1000.0 AS score0, cmd_id % 19 = 0 AS failed,
          CASE WHEN cmd_id % 10 = 0 THEN 'strict' ELSE 'balanced' END AS mode,
          CASE WHEN cmd_id % 4 = 0 THEN 'cfg-b' ELSE 'cfg-a' END AS config_fingerprint,
          CASE WHEN cmd_id % 8 = 0 THEN 'judge.context.field_chars,static.weights.sem' WHEN cmd_id % 4 = 0 THEN 'static.weights.sem' ELSE '' END AS overrides,
          CASE WHEN tool_name = 'Bash' AND cmd_id % 7 = 0 THEN 'p_spath' END AS skip_predicate,
          CASE WHEN tool_name = 'Bash' THEN concat_ws(',', CASE WHEN cmd_id % 2 = 0 THEN 'SE-P-003' END, CASE WHEN cmd_id % 3 = 0 THEN 'SE-P-031' END,
            CASE WHEN cmd_id % 5 = 0 THEN 'SE-P-103' END) ELSE '' END AS rule_ids,
          'T' || (cmd_id % 6 + 1) AS tier0, CASE WHEN cmd_id % 6 < 2 THEN 'deny' WHEN cmd_id % 6 < 5 THEN 'ask' ELSE 'allow' END AS verdict0
        FROM calls c))))"""

JUDGED_COLUMNS = """CASE WHEN judged AND NOT failed THEN tier0 END AS tier, CASE WHEN judged THEN CASE WHEN failed THEN 'ask' ELSE verdict0 END END AS judge_verdict,
  CASE WHEN judged THEN 'L' || (n % 3) END AS level, CASE WHEN judged THEN CASE WHEN n % 3 = 0 THEN 'no transcript_path' ELSE 'transcript' END END AS level_reason,
  CASE WHEN judged THEN 100 + (n * 7) % 900 END AS latency_ms, CASE WHEN judged AND failed THEN 'timeout' END AS judge_error,
  CASE WHEN judged AND n % 3 <> 0 THEN 'judge.example:8443' END AS backend_host, CASE WHEN judged AND n % 4 <> 0 THEN 'judge-1' END AS expected_model,
  CASE WHEN judged THEN CASE WHEN n % 9 = 0 THEN '00ff00ff00ff00ff' ELSE '0fd1f245ae1c7ef3' END END AS judge_rubric_hash,
  CASE WHEN judged AND n % 13 <> 0 THEN 'state ' || (n % 500) END AS state, CASE WHEN judged AND NOT failed THEN 'judge-1' END AS model,
  judged AND NOT failed AS has_answers, '0fd1f245ae1c7ef3' AS rubric_hash, NOT shell AND n % 5 <> 0 AS unscored"""


def calls(select: str, **more: str) -> str:
    """A SELECT over the tool calls."""
    extra = "".join(f",\n{k} AS ({v})" for k, v in more.items())
    return f"WITH commands AS ({_commands()}),\ncalls AS ({CALLS}){extra}\n{select}"


def log(select: str, **more: str) -> str:
    """A SELECT over the decision log."""
    return calls(select, log0=LOG, log=f"SELECT *, {JUDGED_COLUMNS} FROM log0", **more)
