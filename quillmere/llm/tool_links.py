"""Tool-call linking and canonical JSON for conversations, in DataFrames only.

Calls and results meet in a hash join by conversation and identifier. Order is a key, not a running
number: a message's turn, then calls after their message and after all calls that they depend on (their
topological level), then a result after its call, so a conversation of any size stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, only, written


def canonical_string(text: Column) -> Column:
    """JSON string: shortest escapes, control characters as \\u00xx, all else as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_json(kind: str, value: Column) -> Column:
    """A value of the named kind as canonical JSON; null as null."""
    made = canonical_string(value.cast("string")) if kind == "string" else value.cast("string")
    return F.coalesce(made, F.lit("null"))


def canonical_object(fields: dict[str, tuple[str, Column]]) -> Column:
    """An object with sorted keys and no white space. A field's kind is string, integer, boolean or json
    (a value that is canonical already)."""
    parts = []
    for name in sorted(fields):
        kind, value = fields[name]
        body = F.coalesce(value, F.lit("null")) if kind == "json" else canonical_json(kind, value)
        parts.append(F.concat(F.lit(f'"{name}":'), body))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def problems(arguments: dict[str, Column], schema: dict[str, dict]) -> Column:
    """Array of what is wrong with a call's arguments, sorted by name: required ones that are missing,
    too short or too long strings, those that don't match a pattern, numbers out of range, values not in an
    enumeration; then, also by name, arguments that the schema doesn't know."""
    found = []
    for name in sorted(schema):
        rule, value = schema[name], arguments.get(name, F.lit(None).cast("string"))
        say = lambda what, name=name: F.lit(f"{name}: {what}")
        test = F.when(value.isNull(), say("missing") if rule.get("required") else F.lit(None))
        if "min_length" in rule:
            test = test.when(F.length(value) < rule["min_length"], say("too short"))
        if "max_length" in rule:
            test = test.when(F.length(value) > rule["max_length"], say("too long"))
        if "pattern" in rule:
            test = test.when(~value.cast("string").rlike(rule["pattern"]), say("no match"))
        if "minimum" in rule:
            test = test.when(value < rule["minimum"], say("too small"))
        if "maximum" in rule:
            test = test.when(value > rule["maximum"], say("too large"))
        if "enum" in rule:
            test = test.when(~value.isin(rule["enum"]), say("not allowed"))
        found.append(test)
    for name in sorted(set(arguments) - set(schema)):
        found.append(F.when(arguments[name].isNotNull(), F.lit(f"{name}: unknown")))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def linked_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row a call and one for each result that no call takes.

    calls: conv_id, call_id, turn and any others. results: conv_id, call_id, result_turn, result. A call
    takes the first result (by turn, then text) of its identifier that isn't before it; the identifier
    belongs to the first call that has it (by turn), later ones are status ``duplicate``. status is
    linked, pending, duplicate, surplus (a further result of a linked call; copies of one count one by one) or
    orphan (a result without a call, or before it). Null identifiers link nothing.
    Both sides are reduced to a row an identifier before they meet.
    """
    keys = ["conv_id", "call_id"]
    first = calls.where("call_id is not null").groupBy(*keys).agg(F.min("turn").alias("first_turn"))
    due = results.join(first.hint("shuffle_hash"), keys, "left")
    valid = F.col("result_turn") >= F.col("first_turn")
    # Copies of a result are one row with their number, so that all but one of the first's are surplus too.
    counted = due.where(valid).groupBy(*keys, "result_turn", "result").agg(F.count("*").alias("n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct("result_turn", "result")).alias("best"), F.sum("n").alias("n_results"))
    out = calls.join(first.hint("shuffle_hash"), keys, "left").join(best.hint("shuffle_hash"), keys, "left")
    status = F.when(F.col("call_id").isNull(), "pending").when(F.col("turn") > F.col("first_turn"), "duplicate").when(F.col("best").isNull(), "pending").otherwise("linked")
    out = out.withColumn("status", status).withColumn("best", F.when(status == "linked", F.col("best"))).withColumn("n_results", F.when(status == "linked", F.col("n_results")).otherwise(0))
    out = out.withColumns({"result_turn": F.col("best.result_turn"), "result": F.col("best.result")}).drop("best", "first_turn")
    orphans = due.where(~F.coalesce(valid, F.lit(False))).select(*keys, "result_turn", "result", F.lit("orphan").alias("status"))
    spare = F.col("n") - F.struct("result_turn", "result").eqNullSafe(F.col("best")).cast("int")
    further = counted.join(best.where("n_results > 1").select(*keys, "best").hint("shuffle_hash"), keys).withColumn("spare", spare).where("spare > 0")
    surplus = further.select(*keys, "result_turn", "result", F.lit("surplus").alias("status"), F.explode(F.sequence(F.lit(1), F.col("spare").cast("int"))).alias("copy")).drop("copy")
    return out.unionByName(orphans, allowMissingColumns=True).unionByName(surplus, allowMissingColumns=True)


def _jumped(edges: DataFrame) -> DataFrame:
    """Written table (conv_id, call_id, top, steps, after_turn): for calls that need one call, the first call
    up that chain that needs none or several, how many steps it is away, and the highest turn on the way
    without top's. Calls whose chain is a ring have no row. Each round doubles the steps, so there are as many as the
    logarithm of the longest chain."""
    keys = ["conv_id", "call_id"]
    single = edges.groupBy(*keys, "turn").agg(F.count("*").alias("n"), F.min("needs_id").alias("top")).where("n = 1")
    now = written(single.select(*keys, "top", F.lit(1).cast("long").alias("steps"), F.col("turn").alias("after_turn")), "jumps", edges.count())
    rows, open_before = now.count(), None
    while True:
        ahead = now.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("top2"), F.col("steps").alias("steps2"), F.col("after_turn").alias("turn2"))
        left = now.join(ahead.select("conv_id", "top"), ["conv_id", "top"], "left_semi").count()
        if not left:
            return now
        if left == open_before:  # nothing ended in a whole round: the rest goes round in rings
            ends = written(now.join(ahead.select("conv_id", "top"), ["conv_id", "top"], "left_anti"), "jumps", rows)
            dropped(now)
            return ends
        open_before = left
        after = now.join(ahead, ["conv_id", "top"], "left").select(
            *keys, F.coalesce("top2", "top").alias("top"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.greatest("after_turn", "turn2").alias("after_turn")
        )
        after = written(after, "jumps", rows)
        dropped(now)
        now = after


def call_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without needs, else one more than the highest level among the calls
    that it needs; null for calls on a cycle or behind one. Where calls have a turn, also after_turn: the
    highest turn among the call and all that it depends on.

    needs: conv_id, call_id, needs_id. Needs of unknown calls count as met; repeats count once. Chains of calls that
    need one call each are climbed by doubling jumps first, so a chain of n takes log2(n) rounds; calls
    that need several then settle as a topological sort does, a round for each layer of such calls, until
    none is left to settle. Tables stay distributed and are written between rounds.
    """
    keys = ["conv_id", "call_id"]
    turn = F.col("turn").cast("long").alias("turn") if "turn" in calls.columns else F.lit(None).cast("long").alias("turn")
    known = calls.select(*keys, turn).where("call_id is not null and conv_id is not null").groupBy(*keys).agg(F.min("turn").alias("turn"))
    known = written(known, "calls", calls.count())
    size = known.count()
    edges = needs.select(*keys, "needs_id").join(known.select("conv_id", F.col("call_id").alias("needs_id")), ["conv_id", "needs_id"], "left_semi")
    edges = written(edges.distinct().join(known, keys), "needs", 2 * size)
    settled = written(known.join(edges, keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("level"), F.col("turn").alias("after_turn")), "levels", size)
    jumps = _jumped(edges)
    several = edges.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    merges = written(edges.join(several, keys, "left_semi"), "merges", 2 * size)
    top = lambda df: df.select("conv_id", F.col("call_id").alias("top"), F.col("level").alias("base"), F.col("after_turn").alias("base_turn"))

    def with_chains(roots: DataFrame) -> DataFrame:
        """roots and the calls whose chains end at one of them."""
        on = jumps.join(top(roots), ["conv_id", "top"])
        return roots.unionByName(on.select(*keys, (F.col("base") + F.col("steps")).alias("level"), F.greatest("after_turn", "base_turn").alias("after_turn")))

    def replaced(new: DataFrame, *old: DataFrame) -> DataFrame:
        made = written(new, "levels", 2 * size)
        for x in old:
            dropped(x)
        return made

    settled = replaced(with_chains(settled), settled)
    while not merges.isEmpty():
        got = merges.join(settled.select("conv_id", F.col("call_id").alias("needs_id"), "level", "after_turn"), ["conv_id", "needs_id"], "left")
        ready = got.groupBy(*keys).agg(F.max("level").alias("level"), F.max(F.greatest("after_turn", "turn")).alias("after_turn"), F.count("*").alias("n"), F.count("level").alias("met")).where("n = met")
        ready = written(ready.select(*keys, (F.col("level") + 1).alias("level"), "after_turn"), "ready", size)
        if ready.isEmpty():  # what is left depends on a cycle
            dropped(ready)
            break
        settled = replaced(settled.unionByName(with_chains(ready)), settled)
        merges = replaced(merges.join(ready, keys, "left_anti"), merges, ready)
    out = known.select(*keys).join(settled, keys, "left")
    return out if "turn" in calls.columns else out.drop("after_turn")


def conversation_needs(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, needs_id): a call depends on the call whose result is the turn just before it, as
    it is asked in that answer's light.

    calls: conv_id, call_id, turn; results: conv_id, call_id, result_turn, with the identifier that they answer.
    One hash join by conversation and turn."""
    answered = results.where("call_id is not null").select("conv_id", (F.col("result_turn") + 1).alias("turn"), F.col("call_id").alias("needs_id")).distinct()
    return calls.where("call_id is not null").select("conv_id", "call_id", "turn").distinct().join(answered.hint("shuffle_hash"), ["conv_id", "turn"]).select("conv_id", "call_id", "needs_id")


#: What a turn of the ``conversations`` table must have as a call of "respond".
RESPOND = {"prompt": {"required": True, "min_length": 1, "max_length": 100_000}, "turn": {"required": True, "minimum": 0}}


def formatted_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", needs: DataFrame | None = None, schema: dict[str, dict] = RESPOND) -> DataFrame:
    """A row for each user turn as a call of "respond", for each result that no call takes and for each other turn.

    A user turn's identifier is "conv:turn"; an assistant turn answers the identifier of the turn before it.
    conv_id, call_id, turn, result_turn, status, n_results, level, order_key, valid, problems (against schema) and json, the
    canonical record. A turn of any other role (system, null, ...) has status message, no identifier and a
    record with its role, text and turn under "message". A null conversation, turn or role takes no part in links: a user turn with a null
    turn or conversation is a pending call without an identifier, an assistant's an orphan. Turns of one number
    and role in a conversation: the first by text links, as ``linked_calls`` says. Repeated rows stay repeated calls
    (status linked each, as they are the identifier's first). Empty and very long texts are as any other; an
    empty table gives none. Extra columns play no part.

    needs (conv_id, call_id, needs_id): calls that a call depends on; by default ``conversation_needs``. level is
    a call's topological level, as ``call_levels`` says; 0 for rows without an identifier, null on or behind a cycle. order_key sorts a
    conversation: the highest turn among the call's own and those that it depends on (19 digits), then twice its level
    (19 digits), 1 more for a result alone, which so follows its call. Calls on a cycle, or behind one, keep their own turn.
    """
    rows = only(messages, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long")).withColumn("text", F.col("text").cast("string"))
    named = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    calls = rows.where("role = 'user'").select("conv_id", named(F.col("turn")).alias("call_id"), "turn", F.col("text").alias("prompt"))
    results = rows.where("role = 'assistant'").select("conv_id", named(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("result_turn"), F.col("text").alias("result"))
    others = rows.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
    others = others.select("conv_id", "turn", "role", F.col("text").alias("message"), F.lit("message").alias("status"))
    out = linked_calls(calls, results).unionByName(others, allowMissingColumns=True)
    levels = call_levels(calls, conversation_needs(calls, results) if needs is None else needs)
    out = out.join(levels.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    is_call, is_message = ~F.col("status").isin("orphan", "surplus", "message"), F.col("status") == "message"
    found = F.when(is_call, problems({"prompt": F.col("prompt"), "turn": F.col("turn")}, schema)).otherwise(F.array().cast("array<string>"))
    call = canonical_object({"arguments": ("json", canonical_object({"prompt": ("string", F.col("prompt")), "turn": ("integer", F.col("turn"))})), "id": ("string", F.col("call_id")), "name": ("string", F.lit("respond"))})
    message = canonical_object({"role": ("string", F.col("role")), "text": ("string", F.col("message")), "turn": ("integer", F.col("turn"))})
    fields = {"call": ("json", F.when(is_call, call)), "conversation": ("integer", F.col("conv_id")), "result": ("string", F.col("result")), "status": ("string", F.col("status"))}
    record = F.when(is_message, canonical_object(fields | {"message": ("json", message)})).otherwise(canonical_object(fields))
    level = F.when(F.col("call_id").isNull() | (F.col("status") == "orphan"), F.lit(0).cast("long")).otherwise(F.col("level"))
    step = F.coalesce(level, F.lit(0)) * 2 + F.when(is_call | is_message, 0).otherwise(1)
    at = F.greatest(F.coalesce("turn", "result_turn"), F.when(F.col("status") != "orphan", F.col("after_turn")))
    return out.select(
        "conv_id",
        "call_id",
        "turn",
        "result_turn",
        "status",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        level.alias("level"),
        F.format_string("%019d.%019d", F.coalesce(at, F.lit(0)), step).alias("order_key"),
        (F.size(found) == 0).alias("valid"),
        F.array_join(found, "; ").alias("problems"),
        record.alias("json"),
    )
