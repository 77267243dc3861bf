"""DuckDB SQL of the static layers, in long tables: the independent side of the check.

The Spark side keeps arrays on the row of a command; here every view, atom,
path and hit is a row, classified by joins and grouped back.
"""

from __future__ import annotations

from shellgauge.catalogs import paths as cat
from shellgauge.catalogs.lexicon import CLASS_BASE, HEADS_BY_CLASS
from shellgauge.catalogs.rules import RULES, TIER_WEIGHT
from shellgauge.operators import semantic as sem
from shellgauge.operators.policy import OLDER_HIGH_RISK
from shellgauge.sources.adapters import HOME, TEMPLATES

# Lookahead and backreferences, which this engine does not have.
NOT_RE2 = {"SE-P-069", "SE-P-094", "SE-P-139"}


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return q(x) if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(one(x) for x in r) + ')' for r in rows)}) AS t({names})"


def rr(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


ARG = r"([A-Za-z0-9_./@:\-]+)"
COLLAPSE = [
    (rf"`\s*echo\s+{ARG}\s*`", r"\1"), (rf"`\s*printf\s+['\"]{ARG}['\"]\s*`", r"\1"),
    (rf"\$\(\s*echo\s+{ARG}\s*\)", r"\1"), (rf"\$\(\s*printf\s+[\"']{ARG}[\"']\s*\)", r"\1"),
    (rf"\$\(\s*printf\s+[\"']%s[\"']\s+{ARG}\s*\)", r"\1"),
    (r"\$\(\s*printf\s+[\"']%s[\"']\s+(\$\w+)\s*\)", r"\1"),
    (rf"\$\(\s*{ARG}(?:\"\"|''){ARG}\s*\)", r"\1\2"), (rf"{ARG}(?:\"\"|''){ARG}", r"\1\2"),
    (r"\$\(\s*\)|``", ""),
]


def ifs(x: str) -> str:
    out = rr(x, r"\$\{IFS(?:[%#][^}]*)?\}", " ")
    out = rr(out, r"\$IFS\b", " ")
    out = rr(out, r"\$IFS([A-Za-z_]\w*)", r" \1")
    return rr(out, "  +", " ")


def collapse(x: str) -> str:
    step = "a"
    for pattern, repl in COLLAPSE:
        step = rr(step, pattern, repl)
    return f"list_reduce([{x}, '', '', '', ''], lambda a, b: {step})"


ASSIGN = r"""(?:^|;|\s|&&|\|\|)\s*([A-Za-z_][A-Za-z0-9_]*)=("[^"]*"|'[^']*'|[^\s;|&]+)"""


def variables(x: str) -> str:
    """Assigned names replaced one after another; names here are no prefixes of each other."""
    pair = (f"{{'n': regexp_extract(m, {q(ASSIGN)}, 1), "
            f"'v': regexp_replace(regexp_extract(m, {q(ASSIGN)}, 2), '^[\"'']|[\"'']$', '', 'g')}}")
    pairs = f"list_transform(regexp_extract_all({x}, {q(ASSIGN)}), lambda m: {pair})"
    usable = (f"list_filter({pairs}, lambda p: length(p.v) <= 40 AND NOT "
              + has("p.v", r"[()\[\]<>|&;\\]") + ")")
    swap = "replace(replace(acc.v, '${' || p.n || '}', p.v), '$' || p.n, p.v)"
    return (f"list_reduce(list_prepend({{'n': '', 'v': {x}}}, {usable}), "
            f"lambda acc, p: {{'n': '', 'v': {swap}}}).v")


STRICT = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def _kinds(kind: str, xs: str) -> str:
    return f"list_transform({xs}, lambda d: {{'kind': '{kind}', 'text': d}})"


def py_b64(x: str) -> str:
    runs = f"regexp_extract_all({x}, {q(r'''base64\.b64decode\(['"]([A-Za-z0-9+/=]+)['"]''')}, 1)"
    return f"list_transform(list_filter({runs}, lambda t: {has('t', STRICT)}), lambda t: decode(from_base64(t)))"


def b64_dec(x: str) -> str:
    runs = f"regexp_extract_all({x}, {q('[A-Za-z0-9+/]{10,}={0,2}')})"
    ok = f"list_filter({runs}, lambda t: length(t) >= 12 AND length(t) % 4 = 0 AND {has('t', STRICT)})"
    near = has(x, r"\bbase64\s+(-d|--decode|-D)\b")
    return f"CASE WHEN {near} THEN list_transform({ok}, lambda t: decode(from_base64(t))) ELSE [] END"


def hex_dec(x: str) -> str:
    runs = f"regexp_extract_all({x}, {q(r'''printf\s+['"]((?:\\x[0-9a-fA-F]{2})+)['"]''')}, 1)"
    return f"list_transform({runs}, lambda t: decode(unhex(replace(t, '\\x', ''))))"


SHELL_BODY = r"""(?:^|[\s;|&])(?:(?:sh|bash|dash|zsh|ash|ksh|bas\\h|"s"h)|busybox(?: +sh)?)\s+\\?-\w*c\w*\s+(?:'([^']+)'|"([^"\\]+)")"""


def shell_c(x: str) -> str:
    found = f"regexp_extract_all({x}, {q(SHELL_BODY)})"
    return (f"list_transform({found}, lambda m: regexp_extract(m, {q(SHELL_BODY)}, 1) || "
            f"regexp_extract(m, {q(SHELL_BODY)}, 2))")


def decoders(x: str) -> str:
    return (f"list_concat(list_concat({_kinds('py_b64', py_b64(x))}, {_kinds('b64_dec', b64_dec(x))}), "
            f"list_concat({_kinds('hex_dec', hex_dec(x))}, {_kinds('shell_c', shell_c(x))}))")


# ---- long tables ----------------------------------------------------------------------------

def _commands() -> str:
    payload = "encode('rm -rf /srv/u' || user_id || '/logs')"
    hexed = f"regexp_replace(hex({payload}), '(..)', '\\\\x\\1', 'g')"
    filled = f"replace(replace(t.template, '{{b64}}', to_base64({payload})), '{{hex}}', {hexed})"
    filled = f"replace(replace({filled}, '{{u}}', CAST(user_id AS VARCHAR)), '{{n}}', CAST(event_id AS VARCHAR))"
    rows = values([(i, t) for i, t in enumerate(TEMPLATES)], "tid, template")
    return (f"SELECT event_id AS cmd_id, 's' || user_id AS session_id, ts, {filled} AS command "
            f"FROM events JOIN {rows} ON event_id % {len(TEMPLATES)} = t.tid")


_Q = r"""\\.|'[^']*'|"(?:[^"\\]|\\.)*" """.strip()
_PARENS = "[^()]*"
for _ in range(9):
    _PARENS = rf"(?:[^()]|\({_PARENS}\))*"
_UNIT = rf"{_Q}|[$<>]\({_PARENS}\)|`[^`]*`"
SEGMENT = rf"(?s)(?:[^;|&\n'\"\\`$()<>]|{_UNIT}|[0-9]*[<>]&[-0-9]*|&>>?|[$<>])+"
REDIRECTS = rf"(?s)({_UNIT})|(?:&>>|&>|>>|>|<)\s*(?:[^ \t\r\n'\"\\$`<>|&;()]|{_UNIT}|\$)*|([^\\'\"$`<>&\s]+|.)"
ATOM_WORD = rf"(?s)(?:[^ \t\r\n'\"\\$`<>]|{_UNIT}|[$<>])+"
ATOM_PIECE = rf"(?s)[^ \t\r\n'\"\\$`<>]+|{_UNIT}|[$<>]"
WELL_QUOTED = r"""(?s)^(?:[^'"\\]|\\.|'[^']*'|"(?:[^"\\]|\\.)*")*$"""
CONTROL = r"^\s*(?:(?:if|then|elif|else|while|until|do|time|!|\{)(?:\s+|$))+"
CONTROL_ONLY = r"^\s*(?:(?:fi|done|esac|\}|else|then|do|;)|(?:for|select|case)\s.*|function\s+\w+\s*\{?)?\s*$"
INTERP = "bash|sh|zsh|dash|ksh|csh|tcsh|eval|python|python2|python3|perl|ruby|node|lua|php"


def _atom(seg: str) -> str:
    piece = ("CASE WHEN p[1] = '''' THEN p[2:length(p) - 1] "
             f"WHEN p[1] = '\"' THEN regexp_replace(p[2:length(p) - 1], {q(r'''\\(["\\])''')}, {q(chr(92) + '1')}, 'g') "
             "WHEN p[1] = '\\' THEN p[2] ELSE p END")
    word = (f"CASE WHEN {has('w', r'^(?:[$<>]\(|`)')} THEN w ELSE "
            f"array_to_string(list_transform(regexp_extract_all(w, {q(ATOM_PIECE)}), lambda p: {piece}), '') END")
    bare = rr(rr(seg, CONTROL, ""), REDIRECTS, r"\1\2")
    words = f"list_transform(regexp_extract_all({bare}, {q(ATOM_WORD)}), lambda w: {word})"
    return f"CASE WHEN {has(seg, CONTROL_ONLY)} THEN '' ELSE array_to_string({words}, ' ') END"


def _masked(x: str) -> str:
    return rr(x, r"""(?s)\\.|'[^']*'|"(?:[^"\\$`]|\\.)*(?:\$(?:[^("\\]|\\.)(?:[^"\\$`]|\\.)*)*" """.strip(), "Q")


def _structure(x: str) -> str:
    m = f"replace({_masked(x)}, '||', ' ; ')"
    tail = r"(?:[^\w.|;&\n)`-][^|;&\n)`]*)?(?:$|[;&\n)`])"
    return f"""
      SELECT *, CASE WHEN has_pipe_to_exec THEN 1.0 WHEN has_eval THEN 0.9 WHEN depth_sub >= 2 THEN 0.6
                     WHEN has_command_sub THEN 0.3 WHEN has_pipe THEN 0.05 ELSE 0.0 END::DOUBLE AS risk
      FROM (SELECT cmd_id, view_idx, {has('m', r'[|]')} AS has_pipe,
              {has('m', r'[<>](?:[^(]|$)')} AS has_redirect,
              {has('m', r'\$\((?:[^(]|$)|`|[<>]\(')} AS has_command_sub,
              {has('m', rf'[|]&?\s*(?:[^\s|;&()]*/)?(?:{INTERP}){tail}')} AS has_pipe_to_exec,
              EXISTS (SELECT 1 FROM atoms a WHERE a.cmd_id = s.cmd_id AND a.view_idx = s.view_idx
                      AND {has('a.atom', r'^(?:eval|source|\.)(?:\s|$)')}) AS has_eval,
              CASE {' '.join(f"WHEN {has('m', rf'(?:{chr(92)}$[(][^()]*){{{d}}}')} THEN {d}" for d in range(9, 2, -1))}
                   WHEN {has('m', r'\$\([^()]*(?:\$\(|`)')} THEN 2 WHEN {has('m', r'\$\(|`')} THEN 1 ELSE 0 END AS depth_sub
            FROM (SELECT *, {m} AS m FROM views) s)"""


def _class_case() -> str:
    """Class, score and reason as one list of CASE branches over the words ``w``."""
    lit = lambda xs: "[" + ", ".join(q(x) for x in xs) + "]"
    rest = "w[2:]"
    opts = f"array_to_string(list_filter({rest}, lambda x: starts_with(x, '-')), ' ')"
    rec = " OR ".join(f"contains({opts}, '{o}')" for o in ("-r", "-R", "--recursive"))
    force = f"(contains({opts}, '-f') OR contains({opts}, '--force'))"
    rf = f"((({rec}) AND {force}) OR contains({opts}, '-rf') OR contains({opts}, '-fr'))"
    crit = f"list_filter({rest}, lambda x: list_contains({lit(sem.RM_CRITICAL)}, x))[1]"
    mode = f"coalesce(list_filter({rest}, lambda x: NOT starts_with(x, '-'))[1], '')"
    octal = has(mode, "^[0-7]{3,4}$")
    sens = "len(list_filter(w[3:], lambda x: NOT starts_with(x, '-') AND (" + " OR ".join(
        f"starts_with(x, {q(p)})" for p in sem.CHMOD_SENSITIVE) + "))) > 0"
    joined, args = "array_to_string(w, ' ')", "array_to_string(w[2:], ' ')"
    secret = "(" + " OR ".join(f"contains({args}, {q(s)})" for s in sem.SECRET_MARKS) + ")"
    base = CLASS_BASE

    def s(cond: str, cls: str, score: object, reason: str) -> tuple[str, str, str, str]:
        return cond, cls if cls.startswith("(") else q(cls), str(score), reason if reason.startswith("(") else q(reason)

    listing = f"(w[2] = 'tag' AND (len(w) = 2 OR list_has_any(w, ['-l', '--list'])))"
    git_cls = f"(CASE WHEN list_contains({lit(sem.GIT_READ_ONLY)}, w[2]) OR {listing} THEN 'READ_ONLY' ELSE 'WRITE_LOCAL' END)"
    git_score = f"(CASE WHEN list_contains({lit(sem.GIT_READ_ONLY)}, w[2]) OR {listing} THEN 0.0 ELSE 0.15 END)"
    git = "prog = 'git' AND len(w) > 1"
    branches = [
        s("len(w) = 0", "READ_ONLY", 0.0, "empty"),
        s(f"{git} AND w[2] = 'push' AND list_has_any(w, ['-f', '--force', '--force-with-lease'])", "DESTRUCTIVE", 0.85, "git_push_force"),
        s(f"{git} AND w[2] = 'reset' AND list_contains(w, '--hard')", "DESTRUCTIVE", 0.8, "git_reset_hard"),
        s(f"{git} AND w[2] = 'clean' AND len(list_filter(w, lambda x: starts_with(x, '-f') OR starts_with(x, '-d'))) > 0", "DESTRUCTIVE", 0.7, "git_clean_force"),
        s(git, git_cls, git_score, "('git_' || w[2])"),
        s(f"prog = 'rm' AND {rf} AND {crit} IS NOT NULL", "DESTRUCTIVE", 1.0, f"('rm_rf_critical:' || {crit})"),
        s(f"prog = 'rm' AND {rf}", "DESTRUCTIVE", 0.9, "rm_rf"),
        s(f"prog = 'rm' AND ({rec})", "DESTRUCTIVE", 0.7, "rm_recursive"),
        s("prog = 'rm'", "WRITE_LOCAL", 0.3, "rm_files"),
        s(f"prog = 'chmod' AND {octal} AND right({mode}, 3) = '777' AND {sens}", "PRIVILEGE_OR_PERMISSION", 0.95, "chmod_777_sensitive"),
        s(f"prog = 'chmod' AND {octal} AND right({mode}, 3) = '777'", "PRIVILEGE_OR_PERMISSION", 0.8, "chmod_777"),
        s(f"prog = 'chmod' AND {octal} AND {has(mode, '^[42]')}", "PRIVILEGE_OR_PERMISSION", 0.85, f"('chmod_suid:' || {mode})"),
        s(f"prog = 'chmod' AND contains({mode}, '+s')", "PRIVILEGE_OR_PERMISSION", 0.85, "chmod_setuid_sym"),
        s("prog = 'chmod'", "PRIVILEGE_OR_PERMISSION", 0.35, "chmod_normal"),
        s(f"prog = 'dd' AND {has(joined, sem.DD_BLOCK)}", "DESTRUCTIVE", 1.0, "dd_block_device"),
        s(f"prog = 'dd' AND {has(joined, sem.DD_NULL)}", "READ_ONLY", 0.1, "dd_to_null"),
        s("prog = 'dd'", "DESTRUCTIVE", 0.6, "dd_generic"),
        s("prog = 'sed' AND len(list_filter(w, lambda x: starts_with(x, '-i'))) > 0", "WRITE_LOCAL", base["WRITE_LOCAL"], "sed_inplace"),
        s("prog IN ('docker', 'podman') AND list_contains(w, 'run') AND list_contains(w, '--privileged')", "PRIVILEGE_OR_PERMISSION", 0.9, "docker_privileged"),
        s(f"prog IN ('docker', 'podman') AND list_has_any(w, {lit(sem.DOCKER_READ)})", "READ_ONLY", 0.0, "docker_read"),
        s("prog IN ('docker', 'podman')", "WRITE_LOCAL", base["WRITE_LOCAL"], "docker_other"),
        s(f"prog IN ('kill', 'pkill', 'killall') AND {has(joined, sem.KILL_INIT)}", "RESOURCE_ABUSE", 0.95, "kill_init"),
        s(f"prog IN ('kill', 'pkill', 'killall') AND {has(joined, sem.KILLALL_CRITICAL)}", "RESOURCE_ABUSE", 0.9, "killall_critical"),
        s(f"prog IN ('kill', 'pkill', 'killall') AND {has(joined, sem.PKILL_ROOT)}", "RESOURCE_ABUSE", 0.9, "pkill_root"),
        s("prog IN ('kill', 'pkill', 'killall')", "RESOURCE_ABUSE", base["RESOURCE_ABUSE"], "kill_generic"),
        s(f"{secret} AND cls IN ('WRITE_LOCAL', 'READ_ONLY')", "WRITE_SENSITIVE", base["WRITE_SENSITIVE"], "(prog || ':secret_path')"),
        s(f"prog IN ('rsync', 'scp', 'sftp') AND NOT {has(args, sem.REMOTE_HOST)}", "WRITE_LOCAL", base["WRITE_LOCAL"], "(prog || ':local_no_remote_host')"),
    ]
    case = lambda i, other: "CASE " + " ".join(f"WHEN {b[0]} THEN {b[i]}" for b in branches) + f" ELSE {other} END"
    return (f"{case(1, 'cls')} AS class, CAST({case(2, 'base')} AS DOUBLE) AS score, "
            f"{case(3, chr(40) + chr(39) + 'db_lookup:' + chr(39) + ' || prog)')} AS reason")


def _lexicon() -> str:
    rows = [(h, c) for c, hs in HEADS_BY_CLASS.items() for h in hs.split()]
    return f"SELECT * FROM {values(rows, 'head, class')}"


def _in(x: str, xs: list[str]) -> str:
    return f"{x} IN ({', '.join(q(v) for v in xs)})"


def _starts(x: str, xs: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(v)})" for v in xs) + ")"


def _anchored(x: str) -> str:
    return f"({_starts(x, ['/', '~', './'])} OR contains({x}, '../'))"


def _expand(x: str) -> str:
    return f"CASE WHEN {x} = '~' OR starts_with({x}, '~/') THEN {q(HOME)} || {x}[2:] ELSE {x} END"


def _paths() -> str:
    toks = f"""list_transform(regexp_extract_all(text, {q(r'''"[^"]+"|'[^']+'|[^\s]+''')}), lambda t: trim(t, '"'''))"""
    value = "t[strpos(t, '=') + 1:]"
    pick = (f"CASE WHEN starts_with(t, '-') THEN CASE WHEN contains(t, '=') AND {_anchored(value)} THEN {value} END "
            f"WHEN {_anchored('t')} THEN t END")
    redirects = f"""list_transform(regexp_extract_all(text, {q(r'>{1,2}\s*([^\s;&|]+)')}, 1), lambda t: trim(t, '"'''))"""
    return f"""
      SELECT cmd_id, view_idx, i AS path_idx, all_paths[i] AS path FROM (
        SELECT cmd_id, view_idx, list_concat(
          list_filter(list_transform({toks}, lambda t: {pick}), lambda t: t IS NOT NULL),
          list_filter({redirects}, lambda t: {_anchored('t')})) AS all_paths FROM views),
        LATERAL (SELECT unnest(range(1, len(all_paths) + 1)) AS i)"""


def _access() -> str:
    word = lambda i: f"split_part(coalesce(w[{i}], ''), '/', -1)"
    acts = lambda heads: (f"({_in('head', heads)} OR starts_with(head, 'mkfs.') OR (head = 'sudo' AND "  # noqa: E731
                          f"({_in('second', heads)} OR starts_with(second, 'mkfs.'))))")
    redirects = f"""list_transform(regexp_extract_all(text, {q(r'>{1,2}\s*([^\s;&|]+)')}, 1), lambda t: trim(t, '"'''))"""
    sed_seg = f"regexp_extract(text, {q(r'\bsed\s+[^|;]+')})"
    sed = (f"CASE WHEN {has('text', r'\bsed\s+[^|;]*-i\b')} THEN list_filter(list_transform("
           f"regexp_split_to_array({sed_seg}, '\\s+'), lambda t: trim(t, '\"''')), "
           f"lambda t: {_starts('t', ['/', '~'])}) ELSE [] END")
    tee = (f"list_filter(list_transform(regexp_extract_all(text, {q(r'\btee\b\s+(?:-a\s+)?([^\s|&;]+)')}, 1), "
           f"lambda t: trim(t, '\"''')), lambda t: {_starts('t', ['/', '~', './'])})")
    return f"""
      SELECT cmd_id, view_idx, head, {_in('head', cat.READ_HEADS)} AS is_read,
        ({acts(cat.WRITE_HEADS)} OR {has('text', r'(?:^|[^0-9&])>{1,2}\s*\S')}
          OR (head = 'sed' AND {has('text', r'\bsed\s+[^|;]*-i\b')}) OR {has('text', r'\btee\b\s+(-a\s+)?\S')}) AS writing,
        ({acts(cat.DESTRUCTIVE_HEADS)} OR (head <> 'sudo' AND {has('text', r'>\s*/dev/(sd|hd|nvme|vd)')})) AS destructive,
        list_transform(list_concat(list_concat({redirects}, {sed}), {tee}), lambda t: {_expand('t')}) AS targets
      FROM (SELECT *, {word(1)} AS head, {word(2)} AS second FROM (
        SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM views))"""


def _hits() -> str:
    alias = lambda x: f"CASE WHEN {has(x, '^/private/(?:etc|var|tmp)(?:/|$)')} THEN {x}[9:] END"
    secret = values([(p, p.lstrip("~"), e) for p, e in cat.SECRET], "prefix, tail, ext")
    sensitive = values(
        [(p, p.replace("~", HOME) if p.startswith("~") else p, e) for p, e in cat.SENSITIVE], "prefix, full_prefix, ext")
    crit_no = "CASE " + " ".join(
        f"WHEN {has('expanded', p)} OR {has('seen', p)} THEN {i}" for i, (p, _, _) in enumerate(cat.CRITICAL)) + " END"
    crit = values([(i, s, e) for i, (_, s, e) in enumerate(cat.CRITICAL)], "no, secret, ext")
    roots = cat.SYSTEM_ROOTS + cat.SYSTEM_ROOTS_EXT004
    root_ext = f"CASE WHEN {_in('seen', cat.SYSTEM_ROOTS_EXT004)} OR {_in('expanded', cat.SYSTEM_ROOTS_EXT004)} THEN 'EXT-004' END"
    benign = f"({_starts('expanded', cat.BENIGN_DEVICES)} OR {_starts('seen', cat.BENIGN_DEVICES)})"
    return f"""
      WITH placed AS (
        SELECT *, CASE WHEN list_contains(targets, full0) OR (writing AND NOT is_read) THEN 'write'
                       WHEN is_read AND NOT writing THEN 'read' ELSE 'ambiguous' END AS access,
          coalesce({alias('path')}, path) AS seen, coalesce({alias('full0')}, full0) AS expanded,
          CASE WHEN {alias('path')} IS NOT NULL OR {alias('full0')} IS NOT NULL THEN 'EXT-002' END AS alias_ext
        FROM (SELECT p.*, {_expand('p.path')} AS full0, c.is_read, c.writing, c.destructive, c.targets
              FROM paths p JOIN access c USING (cmd_id, view_idx))),
      kinds AS (SELECT *, destructive AND ({_in('seen', roots)} OR {_in('expanded', roots)}) AS is_root,
                  {crit_no} AS crit_no, {benign} AS benign FROM placed),
      found AS (
        SELECT k.*, 'system_root' AS tier, 'write' AS acc, FALSE AS secret_bearing, coalesce({root_ext}, alias_ext) AS ext,
          1.0 AS score, 'destructive_on_system_root' AS why, TRUE AS frozen, 0 AS ord FROM kinds k WHERE is_root
        UNION ALL SELECT k.*, 'critical', access, c.secret, coalesce(c.ext, alias_ext), 1.0, 'critical_path', TRUE, 0
          FROM kinds k JOIN {crit.replace('AS t(', 'AS c(')} ON c.no = k.crit_no WHERE NOT is_root
        UNION ALL SELECT k.*, 'secret', access, TRUE, coalesce(s.ext, alias_ext), 0.85, 'secret_path', FALSE, 1
          FROM kinds k JOIN {secret.replace('AS t(', 'AS s(')} ON starts_with(expanded, s.prefix) OR starts_with(seen, s.prefix)
            OR contains(expanded, s.tail) WHERE NOT is_root AND crit_no IS NULL
        UNION ALL SELECT k.*, 'sensitive_system', access, FALSE, coalesce(s.ext, alias_ext),
            CASE access WHEN 'write' THEN 0.7 WHEN 'read' THEN 0.1 ELSE 0.35 END, 'sensitive_' || access, FALSE, 2
          FROM kinds k JOIN {sensitive.replace('AS t(', 'AS s(')} ON starts_with(expanded, s.prefix) OR starts_with(seen, s.prefix)
            OR starts_with(expanded, s.full_prefix) WHERE NOT is_root AND crit_no IS NULL AND NOT benign
        UNION ALL SELECT k.*, 'traversal', access, FALSE, NULL, CASE WHEN is_read THEN 0.3 ELSE 0.5 END, 'path_traversal', FALSE, 3
          FROM kinds k WHERE contains(seen, '../') AND NOT is_root AND crit_no IS NULL AND NOT benign)
      SELECT cmd_id, view_idx, path_idx, path, tier, acc AS access, secret_bearing, ext, CAST(score AS DOUBLE) AS score,
        why || ':' || path AS reason, frozen, ord FROM found"""


def _fired() -> str:
    cases = ", ".join(
        f"CASE WHEN {has('text', '(?i)' + r[5])} THEN {i} END" for i, r in enumerate(RULES) if r[0] not in NOT_RE2)
    rows = [(i, r[0], r[1], float(r[2]), r[3], bool(r[4]), TIER_WEIGHT[r[3]]) for i, r in enumerate(RULES)]
    dim = values(rows, "ord, rule_id, family, conf, tier, has_techniques, pi").replace("AS t(", "AS b(")
    return f"""
      SELECT cmd_id, b.*, b.pi * b.conf AS strength, view_idx FROM (
        SELECT cmd_id, o AS o, min(view_idx) AS view_idx FROM (
          SELECT cmd_id, view_idx, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS o FROM views)
        GROUP BY cmd_id, o) f JOIN {dim} ON b.ord = f.o"""


def _layers() -> str:
    return """
      SELECT c.cmd_id, c.session_id, c.ts, c.command, coalesce(s.sem, 0.0) AS sem, coalesce(p.path, 0.0) AS path,
        coalesce(f.pat, 0.0) AS pat, coalesce(t.struct, 0.0) AS struct, coalesce(f.rule_ids, '') AS rule_ids,
        f.p_rule, f.p_rule_older, f.rule_strength, coalesce(h.spath, FALSE) AS spath, s.max_class
      FROM commands c
      LEFT JOIN (SELECT cmd_id, max(score) AS sem,
                   CASE WHEN max(score) > 0 THEN arg_min(class, pos) FILTER (WHERE score = top) ELSE 'READ_ONLY' END AS max_class
                 FROM (SELECT *, max(score) OVER (PARTITION BY cmd_id) AS top FROM classes) GROUP BY cmd_id) s USING (cmd_id)
      LEFT JOIN (SELECT cmd_id, max(score) AS path FROM path_scores GROUP BY cmd_id) p USING (cmd_id)
      LEFT JOIN (SELECT cmd_id, max(strength) AS pat, string_agg(rule_id, ',' ORDER BY ord) AS rule_ids,
                   arg_min(rule_id, ord) FILTER (WHERE tier IN ('mitre', 'gtfobins') AND strength >= 0.8) AS p_rule,
                   arg_min(rule_id, ord) FILTER (WHERE (tier = 'mitre' OR has_techniques) AND conf >= 0.8) AS p_rule_older,
                   max(strength) FILTER (WHERE tier IN ('mitre', 'gtfobins')) AS rule_strength
                 FROM fired GROUP BY cmd_id) f USING (cmd_id)
      LEFT JOIN (SELECT cmd_id, max(risk) AS struct FROM structure GROUP BY cmd_id) t USING (cmd_id)
      LEFT JOIN (SELECT cmd_id, bool_or(tier IN ('secret', 'system_root')
                   OR (tier = 'critical' AND (secret_bearing OR access = 'write'))
                   OR (tier = 'sensitive_system' AND access = 'write')) AS spath FROM hits GROUP BY cmd_id) h USING (cmd_id)"""


HIGH = "'DESTRUCTIVE', 'PRIVILEGE_OR_PERMISSION', 'EXECUTION_CHAIN', 'PERSISTENCE', 'NETWORK_FETCH'"
OLDER = ", ".join(q(c) for c in OLDER_HIGH_RISK)


def _decided() -> str:
    """Decisions under the published profile, balanced mode."""
    v = lambda lo, hi: f"CASE WHEN raw < {lo} THEN 'ALLOW' WHEN raw < {hi} THEN 'WARN' ELSE 'DENY' END"
    return f"""
      SELECT *, CASE WHEN balanced = 'ALLOW' THEN 'allow' WHEN balanced = 'DENY' OR skip IS NOT NULL THEN 'deny'
                     ELSE 'unadjudicated' END AS final
      FROM (SELECT *, {v('0.10', '0.20')} AS strict, {v('0.15', '0.35')} AS balanced, {v('0.20', '0.50')} AS auto,
              coalesce('p_rule:' || p_rule, CASE WHEN spath THEN 'p_spath' END, 'p_sem:' || p_sem) AS skip,
              coalesce('p_rule:' || p_rule_older, CASE WHEN path > 0 THEN 'p_spath' END, 'p_sem:' || p_sem_older) AS skip_older
            FROM (SELECT l.*, CAST(0.3 AS DOUBLE) * sem + CAST(0.3 AS DOUBLE) * path + CAST(0.3 AS DOUBLE) * pat
                         + CAST(0.1 AS DOUBLE) * struct AS raw, c.p_sem, c.p_sem_older
                  FROM layers l LEFT JOIN (
                    SELECT cmd_id, arg_min(class, pos) FILTER (WHERE class IN ({HIGH}) AND score >= 0.7) AS p_sem,
                      arg_min(class, pos) FILTER (WHERE class IN ({OLDER}) AND score >= 0.7) AS p_sem_older
                    FROM classes GROUP BY cmd_id) c USING (cmd_id)))"""


def _views() -> str:
    rank = "list_position(['raw', 'rewritten', 'py_b64', 'b64_dec', 'hex_dec', 'shell_c'], kind)"
    return f"""
      SELECT cmd_id, kind, text, depth, row_number() OVER (PARTITION BY cmd_id ORDER BY lvl, {rank}) - 1 AS view_idx
      FROM (SELECT *, row_number() OVER (PARTITION BY cmd_id, text ORDER BY lvl) AS rn FROM walk) WHERE rn = 1"""


def _walk() -> str:
    kids = (f"CASE WHEN kind <> 'rewritten' AND rw <> text THEN [{{'kind': 'rewritten', 'text': rw, 'depth': depth}}] "
            f"WHEN depth < 3 THEN list_transform({decoders('rw')}, lambda d: {{'kind': d.kind, 'text': d.text, 'depth': depth + 1}}) "
            "ELSE [] END")
    return f"""
      SELECT cmd_id, 'raw' AS kind, command AS text, 0 AS depth, 0 AS lvl FROM commands
      UNION ALL
      SELECT cmd_id, k.kind, k.text, k.depth, lvl + 1 FROM (
        SELECT cmd_id, lvl, unnest({kids}) AS k FROM (
          SELECT *, CASE WHEN kind = 'rewritten' THEN text ELSE {collapse('var1')} END AS rw FROM (
            SELECT *, {variables('ifs1')} AS var1 FROM (SELECT *, {ifs('text')} AS ifs1 FROM walk))))"""


def _atom_walk() -> str:
    """Segments and, level by level, the bodies of their substitutions; ``pos`` sorts in reading order."""
    subs = (f"list_transform(list_filter(regexp_extract_all(seg, {q(rf'(?s){_Q.split('|' + chr(34))[0]}|[$<>]\({_PARENS}\)|`[^`]*`')}), "
            f"lambda u: {has('u', r'(?s)^(?:[$<>]\((?:[^(]|$)|`)')}), "
            "lambda u: CASE WHEN starts_with(u, '`') THEN u[2:length(u) - 1] ELSE u[3:length(u) - 1] END)")
    return f"""
      SELECT cmd_id, view_idx, segs[i] AS seg, [view_idx, i] AS pos, 0 AS lvl
      FROM (SELECT cmd_id, view_idx, CASE WHEN {has('text', WELL_QUOTED)} THEN regexp_extract_all(text, {q(SEGMENT)}) ELSE [text] END AS segs
            FROM views), LATERAL (SELECT unnest(range(1, len(segs) + 1)) AS i)
      UNION ALL
      SELECT cmd_id, view_idx, segs[i], list_concat(pos, [j, i]), lvl + 1
      FROM (SELECT cmd_id, view_idx, pos, lvl, j, regexp_extract_all(bodies[j], {q(SEGMENT)}) AS segs
            FROM (SELECT cmd_id, view_idx, pos, lvl, {subs} AS bodies FROM atom_walk WHERE lvl < 8),
              LATERAL (SELECT unnest(range(1, len(bodies) + 1)) AS j)),
        LATERAL (SELECT unnest(range(1, len(segs) + 1)) AS i)"""


def _atoms() -> str:
    return f"""
      SELECT cmd_id, atom, arg_min(view_idx, pos) AS view_idx, min(pos) AS pos FROM (
        SELECT cmd_id, view_idx, pos, {_atom('seg')} AS atom FROM atom_walk) WHERE atom <> '' GROUP BY cmd_id, atom"""


def _view_atoms() -> str:
    return f"""
      SELECT DISTINCT cmd_id, view_idx, atom FROM (
        SELECT cmd_id, view_idx, {_atom('seg')} AS atom FROM atom_walk) WHERE atom <> ''"""


def _classes() -> str:
    base = values(list(CLASS_BASE.items()), "cls, base").replace("AS t(", "AS b(")
    return f"""
      SELECT cmd_id, view_idx, pos, atom, {_class_case()} FROM (
        SELECT h.*, coalesce(l.class, 'UNKNOWN') AS cls, b.base FROM (
          SELECT *, split_part(coalesce(w[1], ''), '/', -1) AS prog FROM (
            SELECT *, list_filter(regexp_split_to_array(atom, '\\s+'), lambda x: x <> '') AS w FROM atoms)) h
        LEFT JOIN lexicon l ON l.head = h.prog
        JOIN {base} ON b.cls = coalesce(l.class, 'UNKNOWN'))"""


def _path_scores() -> str:
    return """
      SELECT cmd_id, view_idx, CASE WHEN bool_or(frozen) THEN 1.0 ELSE max(score) END AS score,
        CASE WHEN bool_or(frozen) THEN arg_min(reason, path_idx) FILTER (WHERE frozen)
             ELSE arg_min(reason, [path_idx, ord]) FILTER (WHERE score = top) END AS reason
      FROM (SELECT *, max(score) OVER (PARTITION BY cmd_id, view_idx) AS top FROM hits) GROUP BY cmd_id, view_idx"""


BUILD = {
    "commands": _commands, "walk": _walk, "views": _views, "atom_walk": _atom_walk, "atoms": _atoms,
    "view_atoms": _view_atoms, "structure": lambda: _structure("text").replace("FROM atoms a", "FROM view_atoms a"),
    "lexicon": _lexicon, "classes": _classes, "paths": _paths, "access": _access, "hits": _hits,
    "path_scores": _path_scores, "fired": _fired, "layers": _layers, "decided": _decided,
}
NEEDS = {
    "commands": [], "walk": ["commands"], "views": ["walk"], "atom_walk": ["views"], "atoms": ["atom_walk"],
    "view_atoms": ["atom_walk"], "structure": ["views", "view_atoms"], "lexicon": [], "classes": ["atoms", "lexicon"],
    "paths": ["views"], "access": ["views"], "hits": ["paths", "access"], "path_scores": ["hits"], "fired": ["views"],
    "layers": ["commands", "classes", "path_scores", "fired", "structure", "hits"], "decided": ["layers", "classes"],
}


def query(select: str, *tables: str) -> str:
    """A SELECT over the named long tables, with everything they are built from."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({BUILD[n]()})" if n not in ("walk", "atom_walk") else f"{n} AS ({BUILD[n]()})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{select}"
