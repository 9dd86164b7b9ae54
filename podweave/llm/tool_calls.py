"""Chat formatting: tool calls linked to their results, ordered, checked and written as canonical JSON.

Native expressions only. Calls and results are joined by identifier, both sides narrow to one row for each identifier
first. The order follows references from call to call: the number of calls before each is found by pointer doubling,
whose rounds grow with the logarithm of the longest chain, and no conversation is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podweave.llm.landing import dropped, landed

#: Columns that the three inputs need; others are not looked at.
CALLS = ["conv_id", "call_id", "position", "name", "arguments", "after"]
RESULTS = ["call_id", "position", "content"]
SCHEMAS = ["name", "parameter", "type", "required"]


def depths(calls: DataFrame) -> DataFrame:
    """call_id, depth: the number of calls that must come before; null in a circle of references, or after one.

    `calls`: call_id (unique) and after, the call that it refers to; an unknown one counts as none. In each round every
    call looks twice as far ahead, so a chain of n calls takes log2(n) rounds; what is still open when a round ends no
    call's search is in or behind a circle.
    """
    ids = calls.select(F.col("call_id").alias("known"))
    now = landed(calls.join(ids, F.col("after") == F.col("known"), "left").select(
        "call_id", F.col("known").alias("next"), F.col("known").isNotNull().cast("long").alias("steps")))
    open_, before = now.where("next IS NOT NULL").count(), -1
    while open_ and open_ != before:
        ahead = now.select(F.col("call_id").alias("at"), F.col("next").alias("further"), F.col("steps").alias("more"))
        later = landed(now.join(ahead, F.col("next") == F.col("at"), "left").select(
            "call_id", F.col("further").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), now)
        dropped(now)
        now, before = later, open_
        open_ = now.where("next IS NOT NULL").count()
    return now.select("call_id", F.when(F.col("next").isNull(), F.col("steps")).alias("depth"))


def json_type(value: Column) -> Column:
    """string, integer, number, boolean, array, object or null: the JSON type of a variant."""
    kind = F.schema_of_variant(value)
    return (F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
            .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
            .when(kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$"), "integer").otherwise("number"))


def _argument_problems(value: Column, fields: Column, parameters: Column) -> Column:
    """What is wrong with parsed arguments: `fields` is their map, `parameters` the tool's array of structs."""
    wrong = F.transform(parameters, lambda p: F.when(
        ~F.map_contains_key(fields, p["parameter"]), F.when(p["required"], F.concat(F.lit("missing "), p["parameter"]))).when(
        ~((p["type"] == json_type(fields[p["parameter"]])) | (
            (p["type"] == "number") & (json_type(fields[p["parameter"]]) == "integer"))), F.concat(F.lit("wrong type "), p["parameter"])))
    names = F.transform(parameters, lambda p: p["parameter"])
    other = F.transform(F.filter(F.map_keys(fields), lambda k: ~F.array_contains(names, k)), lambda k: F.concat(F.lit("unexpected "), k))
    return (F.when(value.isNull(), F.array(F.lit("no JSON"))).when(fields.isNull(), F.array(F.lit("no object")))
            .when(parameters.isNull(), F.array(F.lit("unknown tool"))).otherwise(F.concat(wrong, F.sort_array(other))))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per row of `calls`: conv_id, call_id, position, depth, n_results, valid, problems, json; then one per
    result that answers no call, which has no position, depth or json and the problem "no call".

    depth: calls to go before it; ordered by depth and position, every call follows the one it refers to. json: the call
    with its first result (by position, then content), keys in order and no white space; its arguments are null if they
    are no JSON. problems, in this order: duplicate id, unknown reference, circle, no result, several results, and what
    the tool's schema says of the arguments (no JSON, no object, unknown tool, missing, wrong type, unexpected).
    valid: there are none.

    Calls without id are linked with nothing. Rows that repeat an id are duplicates, each with the same links; the
    reference of the first by position counts. Null or empty arguments are no JSON. Of repeated parameters of a tool each
    counts. Needs the shared folder.
    """
    calls, results = calls.select(*CALLS), results.select(*RESULTS)
    ids = landed(calls.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.count(F.lit(1)).alias("same"), F.min(F.struct("position", "after"))["after"].alias("after")))
    answers = landed(results.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.min(F.struct("position", "content"))["content"].alias("content")))
    known = ids.select(F.col("call_id").alias("known"))
    order = depths(ids.select("call_id", "after"))
    linked = ids.join(order, "call_id").join(known, F.col("after") == F.col("known"), "left").withColumn(
        "unknown", F.col("after").isNotNull() & F.col("known").isNull()).drop("known", "after")
    linked = landed(linked.join(answers, "call_id", "left"))
    tools = landed(schemas.select(*SCHEMAS).groupBy(F.col("name").alias("tool")).agg(F.sort_array(F.collect_list(F.struct(
        "parameter", F.lower("type").alias("type"), F.coalesce("required", F.lit(False)).alias("required")))).alias("parameters")))
    joined = calls.drop("after").join(linked, "call_id", "left").join(tools, F.col("name") == F.col("tool"), "left")
    joined = joined.withColumn("value", F.try_parse_json("arguments")).withColumn(
        "fields", F.expr("try_cast(value AS map<string, variant>)")).withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    found = F.concat(
        F.array(F.when(F.col("same") > 1, "duplicate id"), F.when(F.col("unknown"), "unknown reference"),
                F.when(F.col("same").isNotNull() & F.col("depth").isNull(), "circle"),
                F.when(F.col("n_results") == 0, "no result"), F.when(F.col("n_results") > 1, "several results")),
        _argument_problems(F.col("value"), F.col("fields"), F.col("parameters")))
    shown = F.struct(F.col("value").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))
    told = joined.withColumn("problems", F.array_compact(found)).select(
        "conv_id", "call_id", "position", "depth", "n_results", (F.size("problems") == 0).alias("valid"), "problems",
        F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))
    orphans = answers.join(known, F.col("call_id") == F.col("known"), "left_anti").select(
        F.lit(None).alias("conv_id"), "call_id", F.lit(None).alias("position"), F.lit(None).cast("long").alias("depth"), "n_results",
        F.lit(False).alias("valid"), F.array(F.lit("no call")).alias("problems"), F.lit(None).cast("string").alias("json"))
    dropped(order)
    return told.union(orphans)


def transcript(linked: DataFrame) -> DataFrame:
    """conv_id and json of the calls, sorted by conversation, depth and position; a conversation may span partitions."""
    return linked.where("json IS NOT NULL").orderBy("conv_id", F.col("depth").asc_nulls_last(), "position", "call_id").select("conv_id", "json")


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas out of a table of turns (conv_id, turn, role, text).

    What a user says calls a tool: translate if it has a character beyond ASCII, else reply. The arguments are the text,
    its number of words, and the first line as title if there are several. It refers to the user's turn before. What the
    assistant says is the result of the call in the turn before it. Turns of other roles, or of none, neither call nor answer and have
    no row, but they count as turns. Without conv_id or turn a call has no id, and is linked with nothing.
    """
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    earlier = lambda n: F.when(F.col("turn") >= n, F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - n).cast("string")))
    title = F.when(F.instr("text", "\n") > 0, F.substring_index("text", "\n", 1))
    arguments = F.to_json(F.struct("text", title.alias("title"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    calls = conversations.where("role = 'user'").select(
        "conv_id", name.alias("call_id"), F.col("turn").alias("position"),
        F.when(F.col("text").rlike(r"[^\x00-\x7F]"), "translate").otherwise("reply").alias("name"),
        arguments.alias("arguments"), earlier(2).alias("after"))
    results = conversations.where("role = 'assistant'").select(
        earlier(1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    schemas = conversations.sparkSession.sql("""
        SELECT * FROM VALUES ('reply', 'text', 'string', true), ('reply', 'words', 'integer', true), ('reply', 'title', 'string', false),
        ('translate', 'text', 'string', true), ('translate', 'title', 'string', true), ('translate', 'words', 'number', false)
        AS schemas(name, parameter, type, required)""")
    return calls, results, schemas
