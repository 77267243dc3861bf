"""Registry of tags that say which deliberate deviation a row activated."""

from __future__ import annotations

# Fixed values: (id, title, detection).
REGISTRY: list[tuple[str, str, str]] = [
    ("FIX-001", "p_rule uses catalog tiers with pi*conf >= theta_rule", "runtime"),
    ("FIX-002", "p_spath needs a write to a system or critical path, or any secret path", "runtime"),
    ("FIX-003", "p_sem uses the published high-risk class set", "runtime"),
    ("FIX-004", "text judges must answer SAFE or DANGEROUS first, anything else denies", "runtime"),
    ("FIX-005", "substitutions are seen: flags, nesting depth, inner atoms", "runtime"),
    ("FIX-006", "canonicalization yields views", "runtime"),
    ("FIX-007", "padded base64 payloads are decoded", "runtime"),
    ("FIX-008", "a judge call has a hard timeout", "runtime"),
    ("FIX-009", "git tag listing is read-only", "runtime"),
    ("FIX-010", "mkfs.<fs> heads behave like mkfs", "runtime"),
    ("FIX-011", "commands inside control-flow bodies are atoms", "runtime"),
    ("FIX-012", "a different shell grammar accepts different inputs", "static"),
    ("FIX-013", "pipe-to-interpreter compares the basename", "runtime"),
    ("EXT-001", "keychain paths are secret", "runtime"),
    ("EXT-002", "/private/{etc,var,tmp} are aliases", "runtime"),
    ("EXT-003", "macOS system directories are sensitive", "runtime"),
    ("EXT-004", "macOS system roots are sinks", "runtime"),
    ("EXT-005", "macOS whole-disk devices are critical", "runtime"),
    ("EXT-006", "base64 -D triggers payload decoding", "runtime"),
]
