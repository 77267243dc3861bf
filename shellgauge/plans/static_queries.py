"""Registered queries of the static layers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellgauge.catalogs.lexicon import HEADS_BY_CLASS
from shellgauge.catalogs.profiles import PAPER
from shellgauge.catalogs.rules import RULES, TIER_WEIGHT
from shellgauge.functions.text import basename, build_once, split_words
from shellgauge.operators import canon, paths, patterns, policy, rule_index, semantic, structure
from shellgauge.operators.context import decode_payloads
from shellgauge.plans import analyze as plan
from shellgauge.plans import static_sql as sql
from shellgauge.session import keep, scratch
from shellgauge.sources import adapters, logs
from shellgauge.sources.adapters import HOME

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):  # noqa: ANN201
    def add(fn):  # noqa: ANN001, ANN202
        Q[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- frames ---------------------------------------------------------------------------------

def _with_views(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.commands(spark, sf).withColumn("views", plan._views("command"))


def _views(spark: SparkSession, sf: str) -> DataFrame:
    return canon.explode_views(_with_views(spark, sf)).select("cmd_id", big("view_idx").alias("view_idx"), "kind", "text", big("depth").alias("depth"))


@build_once
def _structure_of_text() -> Column:
    return structure.structure(F.col("text"), PAPER.static.structure)


def _structured(spark: SparkSession, sf: str) -> DataFrame:
    return _views(spark, sf).withColumn("s", _structure_of_text())


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    s = PAPER.static
    with_atoms = _with_views(spark, sf).withColumn("l1", plan._structure(s.structure)).withColumn("atoms", plan._atoms(s.class_base))
    return with_atoms.select("cmd_id", F.explode_outer("atoms").alias("a")).select(
        "cmd_id", "a.atom", "a.class", "a.score", "a.reason",
        basename(F.element_at(split_words(F.concat(F.col("a.atom"), F.lit(" -"))), 1)).alias("prog"))


@build_once
def _path_result_of_text() -> Column:
    return paths.path_result(F.col("text"), F.lit(HOME), PAPER.static.path)


def _path_results(spark: SparkSession, sf: str) -> DataFrame:
    return _views(spark, sf).withColumn("r", _path_result_of_text())


def _rules_on(texts: DataFrame, overrides: dict | None = None) -> DataFrame:
    return patterns.rule_match(texts, patterns.rule_bank(overrides))


def _rule_table(spark: SparkSession, bank: list | None = None) -> DataFrame:
    rows = [(r.ord, r.rule_id, r.family, r.tier, r.confidence, TIER_WEIGHT[r.tier]) for r in bank or patterns.rule_bank()]
    return spark.createDataFrame(rows, "ord int, rule_id string, family string, tier string, conf double, pi double")


def _fired(spark: SparkSession, sf: str, overrides: dict | None = None) -> DataFrame:
    hits = _rules_on(_views(spark, sf), overrides).groupBy("cmd_id", "ord").agg(F.min("view_idx").alias("view_idx"))
    return hits.join(F.broadcast(_rule_table(spark, patterns.rule_bank(overrides))), "ord")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return plan.layer_scores(plan.layer_evidence(adapters.commands(spark, sf), PAPER, "command", HOME))


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return plan.decide(_scored(spark, sf), PAPER)


# ---- canonicalization -----------------------------------------------------------------------

def _text_query(name: str, fn, expr: str) -> None:  # noqa: ANN001
    @query(name, f"WITH commands AS ({sql._commands()}) SELECT cmd_id, {expr} AS text FROM commands")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return adapters.commands(spark, sf).select("cmd_id", fn(F.col("command")).alias("text"))


_text_query("expand_ifs", canon.expand_ifs, sql.ifs("command"))
_text_query("expand_variables", canon.expand_variables, sql.variables("command"))
_text_query("collapse_substitution", canon.collapse_substitution, sql.collapse("command"))


@query("rewrite_view", f"""WITH commands AS ({sql._commands()}),
  a AS (SELECT cmd_id, command, {sql.ifs('command')} AS t FROM commands),
  b AS (SELECT cmd_id, command, {sql.variables('t')} AS t FROM a),
  c AS (SELECT cmd_id, command, {sql.collapse('t')} AS t FROM b)
  SELECT cmd_id, t AS text FROM c WHERE t <> command""")
def rewrite_view(spark: SparkSession, sf: str) -> DataFrame:
    out = adapters.commands(spark, sf).withColumn("text", canon.rewrite(F.col("command")))
    return keep(out, F.col("text") != F.col("command")).select("cmd_id", "text")


def _decoder_query(name: str, fn, exprs: str) -> None:  # noqa: ANN001
    @query(name, f"""WITH commands AS ({sql._commands()})
      SELECT cmd_id, d.kind AS kind, d.text AS text FROM (SELECT cmd_id, unnest({exprs}) AS d FROM commands)""")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return adapters.commands(spark, sf).select("cmd_id", F.explode_outer(fn(F.col("command"))).alias("d")).filter("d is not null").select("cmd_id", "d.kind", "d.text")


_decoder_query("decode_base64", canon.decode_base64,
               f"list_concat({sql._kinds('py_b64', sql.py_b64('command'))}, {sql._kinds('b64_dec', sql.b64_dec('command'))})")
_decoder_query("decode_hex_octal", canon.decode_hex_octal, sql._kinds("hex_dec", sql.hex_dec("command")))
_decoder_query("unwrap_shell_c", canon.unwrap_shell_c, sql._kinds("shell_c", sql.shell_c("command")))


@query("views", sql.query("SELECT cmd_id, kind, text, CAST(depth AS BIGINT) AS depth FROM views", "views"))
def views(spark: SparkSession, sf: str) -> DataFrame:
    return _views(spark, sf).drop("view_idx")


_PRINT = r"^(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0D)$"
_BLOB = r"\b(?:0x)?[0-9a-fA-F]{32,}\b"


@query("decode_payloads", f"""
  WITH runs AS (
    SELECT doc_id, 'hex_blobs' AS form, unhex(b[1:length(b) - length(b) % 2]) AS data, 8 AS least FROM (
      SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, {sql.q(_BLOB)})), '^0x', '') AS b FROM documents)
    UNION ALL
    SELECT doc_id, 'base64', from_base64(p), 8 FROM (
      SELECT doc_id, t || repeat('=', CAST((4 - length(t) % 4) % 4 AS INT)) AS p FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{{12,}}={{0,2}}')) AS t FROM documents))
      WHERE {sql.has('p', sql.STRICT)}),
  graded AS (SELECT *, octet_length(data) AS size, len(list_filter(regexp_extract_all(hex(data), '..'),
      lambda h: {sql.has('h', _PRINT)})) AS good FROM runs)
  SELECT doc_id, form, CAST(count(DISTINCT data) AS BIGINT) AS n FROM graded
  WHERE size >= least AND good > size * CAST(0.85 AS DOUBLE) GROUP BY doc_id, form""")
def payloads_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded forms per document, over whole texts."""
    docs = adapters.table(spark, sf, "documents").select("doc_id", decode_payloads(F.col("text")).alias("d"))
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.size(F.col("d")[k]).cast("bigint").alias("n")) for k in ("base64", "hex_blobs")])
    return docs.select("doc_id", F.explode_outer(forms).alias("f")).select("doc_id", "f.form", "f.n").filter("n > 0")


@query("strip_words", """SELECT doc_id, CAST(len(w) AS BIGINT) AS words, coalesce(split_part(w[1], '/', -1), '') AS head FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'),
    lambda x: x <> '') AS w FROM documents)""")
def strip_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.table(spark, sf, "documents").select("doc_id", split_words(F.col("text")).alias("w"))
    return docs.select("doc_id", big(F.size("w")).alias("words"), F.coalesce(basename(F.try_element_at("w", F.lit(1))), F.lit("")).alias("head"))


# ---- structure ------------------------------------------------------------------------------

_FLAGS = "has_pipe, has_redirect, has_command_sub, has_eval, has_pipe_to_exec"


@query("structure_flags", sql.query(f"SELECT cmd_id, view_idx, {_FLAGS} FROM structure", "structure"))
def structure_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _structured(spark, sf).select("cmd_id", "view_idx", *[f"s.{c}" for c in _FLAGS.split(", ")])


@query("substitution_depth", sql.query("SELECT cmd_id, view_idx, CAST(depth_sub AS BIGINT) AS depth FROM structure", "structure"))
def depth_of_views(spark: SparkSession, sf: str) -> DataFrame:
    return _structured(spark, sf).select("cmd_id", "view_idx", big("s.nested_sub_depth").alias("depth"))


@query("structure_risk", sql.query("SELECT cmd_id, max(risk) AS risk FROM structure GROUP BY cmd_id", "structure"))
def structure_risk(spark: SparkSession, sf: str) -> DataFrame:
    risk = _with_views(spark, sf).withColumn("l1", plan._structure(PAPER.static.structure))
    return risk.select("cmd_id", F.array_max(F.transform("l1", lambda x: x["risk"])).alias("risk"))


@query("atoms", sql.query("SELECT cmd_id, atom FROM atoms", "atoms"))
def atoms(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("cmd_id", "atom")


# ---- semantic classes -----------------------------------------------------------------------

@query("head_class_lookup", sql.query("""SELECT head, coalesce(l.class, 'UNKNOWN') AS class, count(*) AS n FROM (
    SELECT split_part(split_part(atom, ' ', 1), '/', -1) AS head FROM atoms) a LEFT JOIN lexicon l USING (head) GROUP BY 1, 2""", "atoms", "lexicon"))
def head_class_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of all heads by an outer join to the lexicon, counted before the join."""
    heads = _classified(spark, sf).groupBy(F.col("prog").alias("head")).agg(F.count("*").alias("n"))
    lexicon = spark.createDataFrame([(h, c) for c, hs in HEADS_BY_CLASS.items() for h in hs.split()], "head string, class string")
    return semantic.head_class_lookup(heads, lexicon)


_HEAD = "split_part(split_part(atom, ' ', 1), '/', -1)"


def _class_query(name: str, progs: list[str]) -> None:
    among = ", ".join(sql.q(p) for p in progs)

    @query(name, sql.query(f"SELECT cmd_id, atom, class, score, reason FROM classes WHERE {_HEAD} IN ({among})", "classes"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _classified(spark, sf).filter(F.col("prog").isin(progs)).drop("prog")


for _name, _progs in {
    "class_git": ["git"], "class_rm": ["rm"], "class_chmod": ["chmod"], "class_dd": ["dd"],
    "class_docker": ["docker", "podman"], "class_kill": ["kill", "pkill", "killall"], "class_sed": ["sed"],
    "local_rsync_downgrade": ["rsync", "scp", "sftp"],
}.items():
    _class_query(_name, _progs)


@query("secret_path_upgrade", sql.query("SELECT cmd_id, atom, class, score FROM classes WHERE reason LIKE '%:secret_path'", "classes"))
def secret_path_upgrade(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).filter(F.col("reason").endswith(":secret_path")).select("cmd_id", "atom", "class", "score")


@query("semantic_score", sql.query("SELECT cmd_id, sem AS score, max_class FROM layers", "layers"))
def semantic_score(spark: SparkSession, sf: str) -> DataFrame:
    s = PAPER.static
    with_atoms = _with_views(spark, sf).withColumn("l1", plan._structure(s.structure)).withColumn("atoms", plan._atoms(s.class_base))
    return with_atoms.select("cmd_id", semantic.semantic_score(F.col("atoms")).alias("x")).select("cmd_id", "x.score", "x.max_class")


# ---- paths ----------------------------------------------------------------------------------

@query("extract_paths", sql.query("SELECT cmd_id, view_idx, CAST(path_idx AS BIGINT) AS path_idx, path FROM paths", "paths"))
def extract_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _views(spark, sf).select("cmd_id", "view_idx", F.posexplode_outer(paths.extract_paths(F.col("text"))).alias("i", "path")).filter("path is not null").select(
        "cmd_id", "view_idx", big(F.col("i") + 1).alias("path_idx"), "path")


@query("write_targets", sql.query("SELECT DISTINCT cmd_id, view_idx, target FROM (SELECT cmd_id, view_idx, unnest(targets) AS target FROM access)", "access"))
def write_targets(spark: SparkSession, sf: str) -> DataFrame:
    home = F.lit(HOME)
    targets = F.array_distinct(F.transform(paths.write_targets(F.col("text"), home), lambda t: paths.expand_home(t, home)))
    return _views(spark, sf).select("cmd_id", "view_idx", F.explode_outer(targets).alias("target")).filter("target is not null")


@query("access_context", sql.query("SELECT cmd_id, view_idx, head, is_read, writing, destructive FROM access", "access"))
def access_context(spark: SparkSession, sf: str) -> DataFrame:
    return _views(spark, sf).select("cmd_id", "view_idx", paths.access_context(F.col("text")).alias("c")).select(
        "cmd_id", "view_idx", "c.head", "c.is_read", "c.writing", "c.destructive")


@query("expand_home", sql.query(f"""SELECT cmd_id, view_idx, CAST(path_idx AS BIGINT) AS path_idx, coalesce(CASE WHEN {sql.has('e', '^/private/(?:etc|var|tmp)(?:/|$)')} THEN e[9:] END, e) AS full_path
    FROM (SELECT *, {sql._expand('path')} AS e FROM paths)""", "paths"))
def expand_home(spark: SparkSession, sf: str) -> DataFrame:
    full = paths.expand_home(F.col("path"), F.lit(HOME))
    return extract_paths(spark, sf).withColumn("e", full).select(
        "cmd_id", "view_idx", "path_idx", F.coalesce(paths.alias_private(F.col("e")), "e").alias("full_path"))


@query("path_tier_join", sql.query("SELECT cmd_id, view_idx, path, tier, access, secret_bearing, ext, score FROM hits", "hits"))
def path_tier_join(spark: SparkSession, sf: str) -> DataFrame:
    return _path_results(spark, sf).select("cmd_id", "view_idx", F.explode_outer("r.hits").alias("h")).filter("h is not null").select(
        "cmd_id", "view_idx", "h.path", "h.tier", "h.access", "h.secret_bearing", "h.ext", "h.score")


@query("path_score", sql.query("""SELECT cmd_id, view_idx, coalesce(s.score, 0.0) AS score, coalesce(s.reason, 'paths_ok') AS reason
    FROM views LEFT JOIN path_scores s USING (cmd_id, view_idx)""", "views", "path_scores"))
def path_score(spark: SparkSession, sf: str) -> DataFrame:
    return _path_results(spark, sf).select("cmd_id", "view_idx", "r.score", "r.reason")


@query("dim_path_catalog", sql.query("SELECT tier, access, ext, count(*) AS hits, count(DISTINCT path) AS paths FROM hits GROUP BY ALL", "hits"))
def dim_path_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the tables each part of the path catalogs catches."""
    return path_tier_join(spark, sf).groupBy("tier", "access", "ext").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("paths"))


@query("dim_lexicon", sql.query("SELECT class, CAST(count(DISTINCT head) AS BIGINT) AS heads, count(a.atom) AS atoms FROM lexicon LEFT JOIN (SELECT atom, " + _HEAD + " AS head FROM atoms) a USING (head) GROUP BY class", "lexicon", "atoms"))
def dim_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Heads per class and how often the tables use them."""
    used = _classified(spark, sf).groupBy(F.col("prog").alias("head")).agg(F.count("*").alias("n"))
    lexicon = spark.createDataFrame([(h, c) for c, hs in HEADS_BY_CLASS.items() for h in hs.split()], "head string, class string")
    return F.broadcast(lexicon).join(used, "head", "right").filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.sum("n").alias("n")).join(lexicon.groupBy("class").agg(F.count("*").alias("heads")), "class", "right").select(
        "class", "heads", F.coalesce("n", F.lit(0)).alias("atoms"))


# ---- rules ----------------------------------------------------------------------------------

@query("rule_match", sql.query("SELECT cmd_id, rule_id, view_idx FROM fired", "fired"))
def rule_match(spark: SparkSession, sf: str) -> DataFrame:
    return _fired(spark, sf).select("cmd_id", "rule_id", "view_idx")


_DOC_RULES = [r for r in RULES if r[0] not in sql.NOT_RE2]


@query("rule_match_documents", f"""SELECT lang, source, count(*) AS documents, CAST(sum(len(f)) AS BIGINT) AS fires FROM (
    SELECT lang, source, list_filter([{', '.join(f"CASE WHEN {sql.has('text', '(?i)' + r[5])} THEN {sql.q(r[0])} END" for r in _DOC_RULES)}], lambda x: x IS NOT NULL) AS f
    FROM documents) GROUP BY ALL""")
def rule_match_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on whole documents, counted by language and source."""
    docs = adapters.table(spark, sf, "documents").select("lang", "source", F.size(plan._ords_of_text("text")).alias("n"))
    return docs.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n").alias("fires"))


# Three words of a reference passage in a row, as a rule each; the bank is stored as a file and read back.
_THREE = "[ \\t\\r\\n]+"
_PASSAGE_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"


def stored_bank(spark: SparkSession, sf: str) -> str:
    """A rule file of the published rules and of rules made from reference passages; gives its path."""
    passages = adapters.table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    at = F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1)).alias("k")
    threes = keep(passages, F.size("w") >= 3).select("item_id", "w", at).select(
        F.format_string("PW-%d-%d", "item_id", "k").alias("rule_id"),
        F.transform(F.slice("w", F.col("k") * 3 + 1, F.lit(3)), lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|])", r"\\$1")).alias("words"))
    made = threes.select("rule_id", F.lit("made from a passage").alias("description"), F.lit("P1").alias("failure_family"), F.array().cast("array<string>").alias("mitre_techniques"),
                         F.lit(0.5).alias("confidence"), F.lit("manual").alias("provenance_tier"), F.array_join("words", _THREE).alias("pattern_regex"))
    own = spark.createDataFrame([(r[0], "published", r[1], list(r[4]), r[2], r[3], r[5]) for r in _DOC_RULES], made.schema)
    bank = own.unionByName(made)
    folder = scratch(spark, "rule-bank")
    rule = F.struct(*bank.columns)
    whole = bank.agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    meta = F.struct(F.lit("1").alias("version"), F.lit("2020-01-01").alias("date"), F.size("rules").alias("total_rules"))
    whole.select(meta.alias("_meta"), "rules").coalesce(1).write.json(folder)
    return folder


@query("scan_rule_bank", f"""WITH pieces AS (SELECT item_id, {_PASSAGE_WORDS} AS w FROM benchmark),
    made AS (SELECT 'PW-' || item_id || '-' || k AS rule_id, lower(array_to_string(w[3 * k + 1:3 * k + 3], ' ')) AS words FROM (SELECT item_id, w, unnest(range(len(w) // 3)) AS k FROM pieces)),
    texts AS (SELECT doc_id, lower(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS t, text FROM documents),
    own AS (SELECT doc_id, unnest([{', '.join(f"CASE WHEN {sql.has('text', '(?i)' + r[5])} THEN {sql.q(r[0])} END" for r in _DOC_RULES)}]) AS rule_id FROM texts)
    SELECT doc_id, rule_id FROM texts JOIN made ON contains(t, words) UNION ALL SELECT doc_id, rule_id FROM own WHERE rule_id IS NOT NULL""")
def scan_rule_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Documents matched with a stored bank through its index of grams."""
    rules = logs.scan_rule_bank(spark, stored_bank(spark, sf)).select("ord", "rule_id", "pattern_regex")
    docs = adapters.table(spark, sf, "documents").select("doc_id", "text")
    return rule_index.match_bank(docs, rules, "doc_id").join(rules.select(F.col("ord").cast("long").alias("ord"), "rule_id"), "ord").select("doc_id", "rule_id")


OVERRIDES = {"SE-P-003": {"confidence": 0.75}, "SE-P-031": {"enabled": False}, "SE-P-103": {"confidence": 0.5}}


@query("rule_overrides", sql.query("""SELECT cmd_id, rule_id, round(pi * CASE rule_id WHEN 'SE-P-003' THEN CAST(0.75 AS DOUBLE) WHEN 'SE-P-103' THEN CAST(0.5 AS DOUBLE) ELSE conf END, 6) AS strength
    FROM fired WHERE rule_id <> 'SE-P-031'""", "fired"))
def rule_overrides(spark: SparkSession, sf: str) -> DataFrame:
    return _fired(spark, sf, OVERRIDES).select("cmd_id", "rule_id", r6(F.col("pi") * F.col("conf")).alias("strength"))


@query("pattern_score", sql.query("SELECT cmd_id, round(pat, 6) AS score, rule_ids FROM layers", "layers"))
def pattern_score(spark: SparkSession, sf: str) -> DataFrame:
    rules = patterns.rule_bank()
    ords = _with_views(spark, sf).withColumn("__ords", plan._ords(rules))
    fired = ords.withColumn("fired", plan._fired(rules, PAPER.static.provenance))
    return fired.select("cmd_id", r6(patterns.pattern_score(F.col("fired"))).alias("score"),
                        F.array_join(F.transform("fired", lambda f: f["id"]), ",").alias("rule_ids"))


@query("rule_bank_profile", sql.query("""SELECT coalesce(family, 'all') AS family, coalesce(tier, 'all') AS tier, count(*) AS fires, count(DISTINCT rule_id) AS rules
    FROM fired GROUP BY CUBE (family, tier)""", "fired"))
def rule_bank_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Fires and distinct rules by family and tier, with margins."""
    per_rule = _fired(spark, sf).groupBy("rule_id", "family", "tier").agg(F.count("*").alias("n"))
    return per_rule.cube("family", "tier").agg(F.sum("n").alias("fires"), F.count("*").alias("rules")).select(
        F.coalesce("family", F.lit("all")).alias("family"), F.coalesce("tier", F.lit("all")).alias("tier"), "fires", "rules")


# ---- policy and resolution ------------------------------------------------------------------

@query("aggregate_score", sql.query("SELECT cmd_id, round(sem, 6) AS sem, round(path, 6) AS path, round(pat, 6) AS pat, struct, round(raw, 6) AS score FROM decided", "decided"))
def aggregate_score(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("cmd_id", r6("scores.sem").alias("sem"), r6("scores.path").alias("path"), r6("scores.pat").alias("pat"),
                                      F.col("scores.struct").alias("struct"), r6("raw_score").alias("score"))


@query("provisional_verdicts", sql.query("SELECT cmd_id, strict, balanced, auto FROM decided", "decided"))
def provisional_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("cmd_id", "provisional.strict", "provisional.balanced", "provisional.auto")


@query("triggered_layers", sql.query("""SELECT cmd_id, concat_ws(',', CASE WHEN struct > 0 THEN 'L1_AST' END, CASE WHEN sem > 0 THEN 'L2_Semantic' END,
    CASE WHEN path > 0 THEN 'L3_Path' END, CASE WHEN pat > 0 THEN 'L4_Pattern' END) AS layers FROM layers""", "layers"))
def triggered_layers(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("cmd_id", F.array_join(policy.triggered_layers(F.col("scores")), ",").alias("layers"))


@query("p_rule", sql.query("SELECT cmd_id, 'p_rule:' || p_rule AS p_rule FROM layers WHERE p_rule IS NOT NULL", "layers"))
def p_rule(spark: SparkSession, sf: str) -> DataFrame:
    rules = patterns.rule_bank()
    fired = _with_views(spark, sf).withColumn("__ords", plan._ords(rules)).withColumn("fired", plan._fired(rules, PAPER.static.provenance))
    return keep(fired.select("cmd_id", policy.p_rule(F.col("fired"), 0.8).alias("p_rule")), F.col("p_rule").isNotNull())


@query("p_spath", sql.query("SELECT cmd_id FROM layers WHERE spath", "layers"))
def p_spath(spark: SparkSession, sf: str) -> DataFrame:
    hits = _with_views(spark, sf).withColumn("l3", plan._paths(HOME, PAPER.static.path))
    return keep(hits, paths.p_spath(F.flatten(F.transform("l3", lambda r: r["hits"])))).select("cmd_id")


@query("p_sem", sql.query("SELECT cmd_id, 'p_sem:' || p_sem AS p_sem FROM decided WHERE p_sem IS NOT NULL", "decided"))
def p_sem(spark: SparkSession, sf: str) -> DataFrame:
    s = PAPER.static
    with_atoms = _with_views(spark, sf).withColumn("l1", plan._structure(s.structure)).withColumn("atoms", plan._atoms(s.class_base))
    found = with_atoms.select("cmd_id", policy.p_sem(F.col("atoms"), s.high_risk, s.theta_sem).alias("p_sem"))
    return keep(found, F.col("p_sem").isNotNull())


@query("skip_predicate", sql.query("SELECT cmd_id, skip AS predicate FROM decided", "decided"))
def skip_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("cmd_id", F.col("skip_predicate").alias("predicate"))


@query("repo_skip_predicate", sql.query("""SELECT cmd_id, skip_older AS older, 
    concat_ws(',', CASE WHEN p_rule IS DISTINCT FROM p_rule_older THEN 'FIX-001' END, CASE WHEN spath <> (path > 0) THEN 'FIX-002' END,
    CASE WHEN p_sem IS DISTINCT FROM p_sem_older THEN 'FIX-003' END) AS tags FROM decided""", "decided"))
def repo_skip_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("cmd_id", F.col("skip_predicate_older").alias("older"), F.array_join("skip.tags", ",").alias("tags"))


@query("final_decision", sql.query("SELECT balanced AS verdict, final, count(*) AS n FROM decided GROUP BY ALL", "decided"))
def final_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).groupBy(F.col("provisional.balanced").alias("verdict"), "final").agg(F.count("*").alias("n"))


@query("judge_prompt", sql.query(f"""SELECT cmd_id, {sql.q(policy.PROMPT[0])} || command || {sql.q(policy.PROMPT[1])} || CAST(round(raw, 4) AS VARCHAR) || {sql.q(policy.PROMPT[2])}
    || concat_ws(',', CASE WHEN struct > 0 THEN 'L1_AST' END, CASE WHEN sem > 0 THEN 'L2_Semantic' END, CASE WHEN path > 0 THEN 'L3_Path' END, CASE WHEN pat > 0 THEN 'L4_Pattern' END)
    || {sql.q(policy.PROMPT[3])} || CASE WHEN rule_ids = '' THEN 'none' ELSE rule_ids END || {sql.q(policy.PROMPT[4])} AS prompt
    FROM decided WHERE balanced = 'WARN' AND skip IS NULL""", "decided"))
def judge_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return keep(_decided(spark, sf), F.col("would_adjudicate")).select("cmd_id", F.col("judge_prompt").alias("prompt"))


_REPLY = "CASE event_type WHEN 'signup' THEN 'SAFE' WHEN 'error' THEN '  dangerous\n now' WHEN 'click' THEN 'SAFE.' WHEN 'view' THEN 'safe because' ELSE props END"


@query("parse_judge_text", f"""SELECT event_id, CASE WHEN w = 'SAFE' THEN 'safe' WHEN w = 'DANGEROUS' THEN 'dangerous' ELSE 'unparseable' END AS parsed,
    CASE WHEN w = 'SAFE' THEN 'allow' ELSE 'deny' END AS decision
    FROM (SELECT event_id, upper(regexp_extract({_REPLY}, '^\\s*(\\S+)', 1)) AS w FROM events)""")
def parse_judge_text(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.expr(_REPLY)
    return adapters.table(spark, sf, "events").select(
        "event_id", policy.parse_judge_text(reply).alias("parsed"), policy.judge_text_decision(reply).alias("decision"))


@query("divergence_tags", sql.query("""SELECT tag, count(*) AS n FROM (
    SELECT DISTINCT cmd_id, 'FIX-001' AS tag FROM decided WHERE p_rule IS DISTINCT FROM p_rule_older
    UNION ALL SELECT cmd_id, 'FIX-002' FROM decided WHERE spath <> (path > 0)
    UNION ALL SELECT cmd_id, 'FIX-003' FROM decided WHERE p_sem IS DISTINCT FROM p_sem_older
    UNION ALL SELECT DISTINCT cmd_id, 'FIX-005' FROM structure WHERE has_command_sub
    UNION ALL SELECT DISTINCT cmd_id, 'FIX-006' FROM views WHERE view_idx > 0
    UNION ALL SELECT DISTINCT cmd_id, 'FIX-007' FROM views WHERE cmd_id IN (SELECT cmd_id FROM views WHERE kind = 'b64_dec')
      AND regexp_matches(text, '\\bbase64\\s+(-d|--decode)\\b') AND len(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/]{10,}={0,2}'), lambda t: length(t) >= 12
        AND """ + sql.has("t", sql.STRICT) + """ AND NOT list_contains(list_filter(regexp_extract_all(text, '\\b[A-Za-z0-9+/]{12,}={0,2}\\b'), lambda k: """ + sql.has("k", sql.STRICT) + """), t))) > 0
    UNION ALL SELECT DISTINCT cmd_id, 'FIX-009' FROM atoms WHERE atom = 'git tag' OR atom LIKE 'git tag -l %'
    UNION ALL SELECT DISTINCT cmd_id, ext FROM hits WHERE ext IS NOT NULL
    UNION ALL SELECT DISTINCT cmd_id, 'EXT-006' FROM views WHERE kind = 'b64_dec' AND cmd_id IN (SELECT cmd_id FROM views WHERE text LIKE '%base64 -D%')
    UNION ALL SELECT cmd_id, 'FIX-010' FROM commands WHERE starts_with(command, 'mkfs.')
    UNION ALL SELECT DISTINCT cmd_id, 'FIX-013' FROM views WHERE regexp_matches(text, '[|] */bin/sh$')
    ) GROUP BY tag""", "decided", "structure", "views", "atoms", "hits", "commands"))
def divergence_tags(spark: SparkSession, sf: str) -> DataFrame:
    tagged = plan.tags(_decided(spark, sf)).select(F.explode_outer(F.concat("fixes_applied", "ext_applied")).alias("tag"))
    # rows without any tag explode to one null
    return tagged.filter(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("n"))


@query("analyze_commands", sql.query("""SELECT cmd_id, command, round(raw, 4) AS aggregate, strict, balanced, auto, skip AS skip_predicate, rule_ids, final FROM decided""", "decided"))
def analyze_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The whole static pipeline under the published profile."""
    return _decided(spark, sf).select(
        "cmd_id", "command", "aggregate", "provisional.strict", "provisional.balanced", "provisional.auto", "skip_predicate",
        F.array_join("rule_ids", ",").alias("rule_ids"), "final")


