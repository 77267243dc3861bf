"""Session context: prompts and prior calls under budgets, state text, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from shellgauge.functions.numeric import any_true
from shellgauge.functions.text import any_of, clip, let, literal, starts_with_any, strip

# Budgets and markers.
FIELD_CHARS = 4000
HISTORY_CHARS = 12000
TURN_COST = 8
SYSTEM_PREFIXES = [
    "Another Claude session sent a message:", "<task-notification>", "<local-command-caveat>",
    "<local-command-stdout>", "<local-command-stderr>", "<command-name>", "<command-message>",
    "<bash-input>", "<bash-stdout>", "<bash-stderr>", "[Request interrupted by user",
    "This session is being continued from a previous conversation",
    "Caveat: The messages below were generated by the user while running local commands",
]
SYSTEM_MARKER = "<system-reminder>"
LEVEL_NAME = {"L0": "l0_action", "L1": "l1_request", "L2": "l2_actions", "L3": "l3_results"}
B64_RUN = r"[A-Za-z0-9+/]{12,}={0,2}"
HEX_ESCAPES = r"(?:\\x[0-9a-fA-F]{2}){4,}+"
HEX_BLOB = r"(?U)\b(?:0x)?[0-9a-fA-F]{32,}\b"


def is_injected(text: Column) -> Column:
    """Text a tool put into a user turn."""
    return starts_with_any(text, SYSTEM_PREFIXES) | text.contains(SYSTEM_MARKER)


def human_prompts(rec: Column) -> Column:
    """Prompts a human typed, from one transcript record (VARIANT)."""
    flag = lambda k: F.coalesce(F.try_variant_get(rec, f"$.{k}", "boolean"), F.lit(False))
    none = F.array().cast("array<string>")
    blocks = F.try_variant_get(rec, "$.message.content", "array<struct<type:string,text:string>>")
    is_text = F.schema_of_variant(F.variant_get(rec, "$.message.content", "variant")) == "STRING"
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]),
                     lambda t: t.isNotNull())
    candidates = (
        F.when(is_text, F.array(F.try_variant_get(rec, "$.message.content", "string")))
        .when(F.exists(blocks, lambda b: b["type"] == "tool_result"), none)
        .otherwise(F.coalesce(texts, none))
    )
    kept = F.filter(F.transform(candidates, lambda t: strip(t)), lambda t: (t != "") & ~is_injected(t))
    typed = (F.try_variant_get(rec, "$.type", "string") == "user") & ~any_true(
        [flag(k) for k in ("isMeta", "isCompactSummary", "isSidechain")])
    return F.when(F.coalesce(typed, F.lit(False)), kept).otherwise(none)


def tool_uses(rec: Column) -> Column:
    """Calls of one assistant record: ``array<struct<id, name, input>>``, input as JSON."""
    blocks = F.try_variant_get(
        rec, "$.message.content", "array<struct<type:string,id:string,name:string,input:variant>>")
    calls = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(
        F.coalesce(b["id"], F.lit("")).alias("id"), F.coalesce(b["name"], F.lit("unknown")).alias("name"),
        F.to_json(b["input"]).alias("input")))
    none = F.array().cast("array<struct<id:string,name:string,input:string>>")
    return F.when(F.try_variant_get(rec, "$.type", "string") == "assistant", F.coalesce(calls, none)).otherwise(none)


def sorted_json(text: Column) -> Column:
    """A flat JSON object as text with sorted keys and spaced separators."""
    fields = F.from_json(text, "map<string,variant>")

    pairs = lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(
        F.lit('"'), k, F.lit('": '), F.to_json(F.element_at(m, k))))
    return F.concat(F.lit("{"), let(fields, lambda m: F.array_join(pairs(m), ", ")), F.lit("}"))


def call_text(name: Column, tool_input: Column, field_chars: int = FIELD_CHARS) -> Column:
    """``bash(<command>)`` or ``Name(<sorted JSON>)``, clipped."""
    command = F.get_json_object(tool_input, "$.command")
    shell = (name == "Bash") & command.isNotNull()
    return F.when(shell, F.concat(F.lit("bash("), clip(command, field_chars), F.lit(")"))).otherwise(
        F.concat(name, F.lit("("), clip(sorted_json(tool_input), field_chars), F.lit(")")))


def positions(df: DataFrame, key: list[str], order: list[str], bucket: Column, name: str = "pos",
              total: str | None = None) -> DataFrame:
    """1-based rank of each row in its group, without putting a group into one task.

    ``bucket`` must grow with ``order``. Rows are ranked inside (group, bucket);
    bucket sizes, already aggregated, give each bucket its offset, and the group
    its size when ``total`` names a column for it.
    """
    keyed = _bucketed(df, key, bucket)
    sizes = keyed.groupBy("__k").agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(_buckets_before(key)), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("__n").over(Window.partitionBy(*_group(key))))
    inside = Window.partitionBy("__k").orderBy(*order)
    return (
        keyed.join(offsets.drop("__n"), "__k")
        .withColumn(name, (F.col("__before") + F.row_number().over(inside)).cast("bigint"))
        .drop("__k", "__before")
    )


def _bucketed(df: DataFrame, key: list[str], bucket: Column) -> DataFrame:
    """Group and bucket as one struct: equal also where a part is null, so no row is lost in a join."""
    return df.withColumn("__k", F.struct(*key, bucket.alias("bucket")))


def _group(key: list[str]) -> list[Column]:
    return [F.col("__k")[c] for c in key]


def _buckets_before(key: list[str]):  # noqa: ANN202
    return Window.partitionBy(*_group(key)).orderBy(F.col("__k")["bucket"]).rowsBetween(
        Window.unboundedPreceding, -1)


def as_of(line: DataFrame, key: list[str], order: list[str], bucket: Column, values: list[str]) -> DataFrame:
    """Greatest value so far of each column in ``values``, along the time line of each group.

    Rows that carry a value and rows that look one up share the line, so no row
    meets all rows of its group: buckets are scanned apart, and each takes over
    the greatest values of the buckets before it. ``bucket`` must grow with ``order``.
    """
    keyed = _bucketed(line, key, bucket)
    tops = keyed.groupBy("__k").agg(*[F.max(v).alias(f"__top_{v}") for v in values])
    before = tops.select("__k", *[F.max(f"__top_{v}").over(_buckets_before(key)).alias(f"__top_{v}") for v in values])
    inside = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        keyed.join(before, "__k")
        .withColumns({v: F.greatest(F.max(v).over(inside), F.col(f"__top_{v}")) for v in values})
        .drop("__k", *[f"__top_{v}" for v in values])
    )


def with_halo(ranked: DataFrame, key: list[str], pos: str, chunk: int, reach: int) -> DataFrame:
    """Split groups into chunks of consecutive rows, each preceded by the rows it looks back to.

    A look-back of at most ``reach`` rows is then answered inside one chunk, so
    a session of any length is spread over many tasks. Rows with ``__halo`` are
    copies for looking back only.
    """
    own = F.floor((F.col(pos) - 1) / chunk)
    last = F.floor((F.col(pos) - 1 + reach) / chunk)
    return (
        ranked.withColumn("__own", own)
        .withColumn("__chunk", F.explode(F.sequence(own, last)))
        .withColumn("__halo", F.col("__chunk") != F.col("__own")).drop("__own")
    )


def fitted_history(calls: DataFrame, session: str, pos: str, text: str, budget: int = HISTORY_CHARS,
                   chunk: int = 10_000, after: bool = False, wanted: str | None = None) -> DataFrame:
    """Per call: the newest prior call texts that fit the budget, oldest first.

    With ``after``, the history as of just after the call, which then belongs to
    it. Only rows where the column ``wanted`` is true come out, if it is named.
    Each text costs its length plus 8 and has at least 2 characters, so at most
    ``budget / 10 + 1`` prior calls can be kept: the look-back is bounded.
    """
    reach = budget // (TURN_COST + 2) + 1
    halo = with_halo(calls, [session], pos, chunk, reach)
    spent, back = _within_budget(session, pos, text, TURN_COST, budget, 0 if after else -1)
    # rows that cost the budget at most; without any, the newest stays alone
    newest = F.lag(text).over(Window.partitionBy(session, "__chunk").orderBy(pos))
    fitting = F.reverse(F.collect_list(text).over(back))
    prior = F.when(F.size(fitting) > 0, fitting).otherwise(F.array_compact(F.array(newest)))

    def keep(acc: Column, t: Column) -> Column:
        cost = F.length(t) + TURN_COST
        fits = ~acc["full"] & ((F.size(acc["kept"]) == 0) | (acc["used"] + cost <= budget))
        return F.when(fits, F.struct(
            F.array_append(acc["kept"], t).alias("kept"), (acc["used"] + cost).alias("used"),
            F.lit(False).alias("full"))).otherwise(F.struct(
                acc["kept"].alias("kept"), acc["used"].alias("used"), F.lit(True).alias("full")))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"),
                     F.lit(False).alias("full"))
    return (
        halo.withColumn("__spent", spent).withColumn("__prior", prior)
        .filter(~F.col("__halo") & (F.col(wanted) if wanted else F.lit(True)))
        .withColumn("prior_actions", F.aggregate("__prior", start, keep, lambda a: F.reverse(a["kept"])))
        .withColumn("actions_total", (F.col(pos) - (0 if after else 1)).cast("bigint"))
        .drop("__prior", "__spent", "__chunk", "__halo")
    )


def _within_budget(session: str, pos: str, text: str, cost: int, budget: int, last: int) -> tuple[Column, WindowSpec]:
    """``__spent``, the cost of all earlier rows of a chunk, and the frame of rows at most a budget back.

    The frame is a range of costs, so a row collects what may fit and no more.
    """
    chunk = Window.partitionBy(session, "__chunk")
    each = F.coalesce(F.length(text), F.lit(0)) + cost
    spent = F.coalesce(F.sum(each).over(chunk.orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    return spent, chunk.orderBy("__spent").rangeBetween(-budget, last)


def join_user_request(prompts: DataFrame, session: str, pos: str, text: str,
                      budget: int = FIELD_CHARS, chunk: int = 10_000) -> DataFrame:
    """Per prompt: the user request as of that prompt, under the budget.

    The newest prompt always stays; older ones stay while they fit whole, a
    separator costing 2. Empty prompts do not occur, so the look-back is bounded.
    """
    reach = budget // 3 + 1
    halo = with_halo(prompts, [session], pos, chunk, reach)
    spent, back = _within_budget(session, pos, text, 2, budget, 0)
    newest_first = F.reverse(F.collect_list(text).over(back))

    def keep(acc: Column, t: Column) -> Column:
        first = F.size(acc["kept"]) == 0
        cost = F.length(t) + F.when(first, F.lit(0)).otherwise(F.lit(2))
        fits = ~acc["full"] & (first | (acc["used"] + cost <= budget))
        return F.when(fits, F.struct(
            F.array_append(acc["kept"], t).alias("kept"), (acc["used"] + cost).alias("used"),
            F.lit(False).alias("full"))).otherwise(F.struct(
                acc["kept"].alias("kept"), acc["used"].alias("used"), F.lit(True).alias("full")))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"),
                     F.lit(False).alias("full"))
    kept = F.aggregate(newest_first, start, keep, lambda a: F.reverse(a["kept"]))
    return (
        halo.withColumn("__spent", spent).withColumn("__kept", kept).filter(~F.col("__halo"))
        .withColumns({
            "user_request": F.array_join("__kept", "\n\n"),
            "prompts_kept": F.size("__kept").cast("bigint"), "prompts_total": F.col(pos).cast("bigint"),
        }).drop("__kept", "__spent", "__chunk", "__halo")
    )


def context_level(has_transcript: Column, actions: Column, request: Column, max_level: str = "L2") -> Column:
    """Achieved level, capped; a request level without a request falls back to L0."""
    found = F.when(~has_transcript, F.lit("L0")).when(actions > 0, F.lit("L2")).otherwise(F.lit("L1"))
    capped = F.when(found > max_level, F.lit(max_level)).otherwise(found)
    return F.when((capped == "L1") & (request == ""), F.lit("L0")).otherwise(capped)


def level_reason(has_transcript: Column, found_current: Column, actions: Column, max_level: str = "L2") -> Column:
    """Why that level."""
    base = (
        F.when(~has_transcript, F.lit("no transcript_path"))
        .when(found_current, F.lit("transcript"))
        .otherwise(F.lit("transcript (current call not yet written; all recorded calls are prior)"))
    )
    reached = F.when(~has_transcript, F.lit("L0")).when(actions > 0, F.lit("L2")).otherwise(F.lit("L1"))
    note = F.lit(f"; capped at {LEVEL_NAME[max_level]} by judge.context.max_level")
    return F.concat(base, F.when(reached > max_level, note).otherwise(F.lit("")))


def _printable(data: Column, at_least: int) -> Column:
    """Bytes as text when there are enough of them and more than 85 % print."""
    digits = F.hex(data)
    pairs = F.regexp_extract_all(digits, F.lit("(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0D)|.."), F.lit(0))
    good = F.size(F.filter(pairs, lambda h: h.rlike("^(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0D)$")))
    size = F.octet_length(data)
    return F.when((size >= at_least) & (good > size * 0.85), F.make_valid_utf8(data.cast("string")))


def decode_payloads(text: Column) -> Column:
    """Base64 runs, hex escapes, hex blobs and ``$IFS`` decoded from a text."""
    strict = r"\A(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"

    def b64(run: Column) -> Column:
        padded = F.concat(run, F.repeat(F.lit("="), F.pmod(4 - F.length(run) % 4, F.lit(4)).cast("int")))
        return F.when(padded.rlike(strict), _printable(F.unbase64(padded), 8))

    def blob(run: Column) -> Column:
        bare = F.regexp_replace(run, r"\A0x", "")
        even = F.substring(bare, F.lit(1), F.length(bare) - F.length(bare) % 2)
        return _printable(F.unhex(even), 8)

    def found(pattern: str, decode) -> Column:  # noqa: ANN001
        runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.filter(F.array_distinct(F.array_compact(F.transform(runs, decode))), lambda d: d != "")

    ifs = F.replace(F.replace(text, F.lit("${IFS}"), F.lit(" ")), F.lit("$IFS"), F.lit(" "))
    none = F.array().cast("array<string>")
    return F.struct(
        found(B64_RUN, b64).alias("base64"),
        F.when(text.contains("\\x"), found(HEX_ESCAPES, lambda r: _printable(
            F.unhex(F.replace(r, F.lit("\\x"), F.lit(""))), 4))).otherwise(none).alias("hex"),
        found(HEX_BLOB, blob).alias("hex_blobs"),
        F.when(any_of(text, ["${IFS}", "$IFS"]), ifs).alias("ifs_expanded"),
    )


def render_state(level: Column, tool: Column, args: Column, request: Column, prior: Column,
                 decoded: Column) -> Column:
    """The text a judge sees: action, request, prior actions, decoded forms."""
    line = lambda k, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{k}: "), x))
    none = F.array().cast("array<string>")
    forms = F.concat(
        line("base64", decoded["base64"]), line("hex", decoded["hex"]), line("hex_blobs", decoded["hex_blobs"]),
        F.when(F.coalesce(decoded["ifs_expanded"], F.lit("")) != "", F.array(
            F.concat(F.lit("ifs_expanded: "), decoded["ifs_expanded"]))).otherwise(none))
    actions = F.transform(prior, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t))
    section = lambda title, xs: F.concat(F.array(F.lit(""), F.lit(title)), xs)
    lines = F.concat(
        F.array(F.lit("### PROPOSED ACTION"), F.concat(F.lit("tool: "), tool), F.concat(F.lit("args: "), args)),
        F.when((level != "L0") & (request != ""), section("### USER REQUEST", F.array(request))).otherwise(none),
        F.when((level >= "L2") & (F.size(actions) > 0), section(
            "### PRIOR AGENT ACTIONS (most recent last)", actions)).otherwise(none),
        F.when(F.size(forms) > 0, section("### DECODED FORMS (decoded from the action above)", forms)).otherwise(none),
    )
    return F.array_join(lines, "\n")


def state_hash(level: Column, state: Column) -> Column:
    """Content hash of a state: its level and its text."""
    names = literal(LEVEL_NAME, "map<string,string>")
    return F.sha2(F.concat(F.element_at(names, level), F.lit("\n"), state), 256)


def dedupe_states(items: DataFrame, state_hash_col: str, order: str) -> DataFrame:
    """Flag all but the first item of each state; counts are combined before the shuffle."""
    first = items.groupBy(state_hash_col).agg(F.min(order).alias(order)).withColumn("__first", F.lit(True))
    return items.join(first, [state_hash_col, order], "left").withColumn(
        "duplicate", F.col("__first").isNull() & F.col(state_hash_col).isNotNull()).drop("__first")




def running_count(df: DataFrame, key: list[str], order: list[str], bucket: Column, counted: Column,
                  name: str) -> DataFrame:
    """How many counted rows of the group come up to each row; bucketed like ``positions``."""
    keyed = _bucketed(df, key, bucket).withColumn("__c", counted.cast("bigint"))
    sizes = keyed.groupBy("__k").agg(F.sum("__c").alias("__n"))
    offsets = sizes.withColumn(
        "__before", F.coalesce(F.sum("__n").over(_buckets_before(key)), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.join(offsets, "__k")
        .withColumn(name, F.col("__before") + F.sum("__c").over(inside))
        .drop("__k", "__before", "__c")
    )
