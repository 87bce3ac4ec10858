"""Tool-call linking, in DataFrame functions only.

Calls and results are joined on their identifier, calls are put in topological order of what they follow,
arguments are validated against the tools' schemas, and each call with its result becomes canonical JSON: keys
in order, no white space, one form for each number (a Variant object keeps its keys sorted).

A call may follow several others. Its level is one more than the highest level among them, 0 if it follows none.
Chains, in which each call follows one other, are climbed by pointer doubling, in as many rounds as the logarithm of
the longest; what remains is a graph of the calls that follow several, solved in as many rounds as such calls lie
behind one another. Each round is one join on unique identifiers; no conversation is gathered into one task.

Defined cases: a call without a result is unanswered and a result without a call an orphan; of calls or results with
one identifier the least by (place, content) counts and each other one is a row of its own, repeated; rows without an
identifier are unidentified and link to nothing; what a call follows counts once, and not if there is no such call;
calls on a cycle, or behind one, have a null level; null arguments are null in the message and invalid; arguments that
are not JSON are invalid and kept as a JSON string; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: For each tool: field, JSON type (string, integer, number, boolean, object or array), whether it must be there.
SCHEMAS = {
    "answer": (("text", "string", True), ("turn", "integer", True), ("limit", "integer", False)),
    "instruct": (("text", "string", True), ("turn", "integer", True)),
}
#: What schema_of_variant calls each JSON type.
_KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def valid(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """Whether arguments (a JSON string) fit the schema of the tool: all required fields, right types, no other fields."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).rlike("^OBJECT"), F.lit(False))
    out = F.lit(False)
    for tool, fields in schemas.items():
        fits = F.size(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f, _, _ in fields]))) == 0
        for field, kind, required in fields:
            own = F.try_variant_get(value, f"$.{field}", "variant")
            right = F.schema_of_variant(own).rlike(_KINDS[kind])
            fits = fits & (F.coalesce(right, F.lit(False)) if required else F.coalesce(right, F.lit(True)))
        out = F.when(name == tool, fits).otherwise(out)
    return is_object & F.coalesce(out, F.lit(False))


def _number(token: Column) -> Column:
    """A number with a fraction or an exponent in plain digits without trailing zeros, if 38 digits hold it; all else as it is."""
    plain = token.try_cast("decimal(38,18)")
    digits = F.regexp_replace(F.regexp_replace(plain.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    exact = token.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$") & token.rlike("[.eE]") & (plain.cast("double") == token.try_cast("double"))
    # a plain form of zero stands for zero only
    exact = exact & ((plain != 0) | (token.try_cast("double") == 0))
    return F.when(F.coalesce(exact, F.lit(False)), F.regexp_replace(digits, "^-0$", "0")).otherwise(token)


def canonical(arguments: Column) -> Column:
    """Canonical JSON of a JSON string: keys sorted, no white space, numbers in one form; null if it is not JSON.

    The text is cut at quotes (escaped ones are put out of the way first, as control characters are never bare in
    JSON), so that only what lies outside strings is looked at, in time that grows with its length.
    """
    text = F.to_json(F.try_parse_json(arguments))
    text = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    outside = lambda part: F.array_join(F.transform(F.split(part, r"(?<=[,:\[{])|(?=[,\]}])"), _number), "")
    parts = F.transform(F.split(text, '"'), lambda part, i: F.when((i % 2 == 0) & part.rlike("[0-9][.eE]"), outside(part)).otherwise(part))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def _climbed(at: DataFrame) -> DataFrame:
    """id, root, level and open of chains: doubles the pointers of open rows until none is open or all left run in circles."""
    at, before = common.stored(at, "levels"), None
    while (still := at.where("open").count()) and still != before:
        before = still
        above = at.select(F.col("id").alias("a_id"), F.col("root").alias("a_root"), F.col("level").alias("a_level"), F.col("open").alias("a_open"))
        done = at.join(above, F.col("open") & (F.col("root") == F.col("a_id")), "left")
        moved = lambda new, old: F.when(F.col("open"), F.col(new)).otherwise(F.col(old)).alias(old)
        level = F.when(F.col("open"), F.col("level") + F.col("a_level")).otherwise(F.col("level")).alias("level")
        after = common.stored(done.select("id", moved("a_root", "root"), level, moved("a_open", "open")), "levels")
        common.forget(at)
        at = after
    return at


def levels(calls: DataFrame) -> DataFrame:
    """id and level (null on or behind a cycle) of calls (id unique and not null, after: a string or an array of them)."""
    after = F.col("after") if isinstance(calls.schema["after"].dataType, T.ArrayType) else F.array("after")
    ids = calls.select(F.col("id").alias("up"))
    links = calls.select("id", F.explode(after).alias("up")).distinct().join(ids, "up", "left_semi")
    ups = links.groupBy("id").agg(F.count("*").alias("n"), F.min("up").alias("up"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    start = calls.select("id").join(ups, "id", "left")
    at = _climbed(start.select("id", F.when(one, F.col("up")).otherwise(F.col("id")).alias("root"), one.cast("long").alias("level"), one.alias("open"), F.coalesce("n", F.lit(0)).alias("n")).drop("n"))
    joint = common.stored(links.join(ups.where("n > 1").select("id"), "id", "left_semi"), "joints")
    # roots of chains: calls that follow none have level 0, those that follow several wait for what they follow
    waiting = joint.select("id").distinct()
    known = common.stored(at.where("NOT open AND id = root").select("id").join(waiting, "id", "left_anti").select("id", F.lit(0).cast("long").alias("level")), "known")
    while not joint.isEmpty():
        reached = at.where("NOT open").select(F.col("id").alias("up"), "root", F.col("level").alias("far")).join(known.select(F.col("id").alias("root"), F.col("level").alias("base")), "root")
        met = joint.join(reached, "up", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("base").alias("m"), (F.max(F.col("base") + F.col("far")) + 1).alias("level"))
        done = common.stored(met.where("n = m").select("id", "level"), "done")
        if done.isEmpty():
            break
        left = common.stored(joint.join(done.select("id"), "id", "left_anti"), "joints")
        more = common.stored(known.unionAll(done), "known")
        for df in (joint, known, done):
            common.forget(df)
        joint, known = left, more
    base = known.select(F.col("id").alias("root"), F.col("level").alias("base"))
    return at.join(base, "root", "left").select("id", F.when(~F.col("open"), F.col("level") + F.col("base")).alias("level"))


def _first(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The row of each id that is least by the named columns, and all other rows with how they stand (repeated or unidentified)."""
    columns = ["id", *order, *[c for c in rows.columns if c not in ("id", *order)]]
    counted = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    key = F.struct(*columns[1:])
    least = counted.where("id IS NOT NULL").groupBy("id").agg(F.min(key).alias("least"))
    first = least.select("id", *[F.col(f"least.{c}").alias(c) for c in columns[1:]])
    mark = least.select(F.col("id").alias("l_id"), "least")
    is_first = key.eqNullSafe(F.col("least"))
    others = counted.join(mark, F.col("id") == F.col("l_id"), "left").withColumn("n", F.col("n") - F.coalesce(is_first & F.col("id").isNotNull(), F.lit(False)).cast("long")).where("n > 0")
    others = others.select(*columns, F.when(F.col("id").isNull(), "unidentified").otherwise("repeated").alias("status"), F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")
    return first, others


def _message(ident: Column, name: Column, arguments: Column | None, result: Column) -> Column:
    """Canonical JSON; struct fields are written in the order given, which is the keys' order, and arguments come first."""
    text = F.to_json(F.struct(ident.alias("id"), name.alias("name"), result.alias("result")), {"ignoreNullFields": "true"})
    if arguments is None:
        return text
    quoted = F.to_json(F.struct(arguments.alias("a")))
    own = F.when(arguments.isNull(), F.lit("null")).otherwise(F.coalesce(canonical(arguments), quoted.substr(F.lit(6), F.length(quoted) - 6)))
    return F.concat(F.lit('{"arguments":'), own, F.when(text == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), text.substr(F.lit(2), F.length(text)))))


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """Calls (id, place, name, arguments, after) and results (id, place, content), linked; every row of both is in one row.

    Returns id, name, place, result_place, status (linked, unanswered, orphan, repeated or unidentified), level, valid
    and message, the canonical JSON of the call and its result (an orphan's arguments are null).
    """
    calls, more_calls = _first(calls.select("id", "place", "name", "arguments", "after"), "place", "arguments")
    answers, more_answers = _first(results.select("id", "place", "content"), "place", "content")
    calls = common.stored(calls, "calls")
    answers = answers.select(F.col("id").alias("result_id"), F.col("place").alias("result_place"), "content")
    joined = calls.join(levels(calls.select("id", "after")), "id", "left").join(answers, F.col("id") == F.col("result_id"), "full_outer")
    status = F.when(F.col("id").isNull(), "orphan").when(F.col("result_id").isNull(), "unanswered").otherwise("linked")
    name, arguments = F.col("name"), F.col("arguments")
    none = lambda kind, alias: F.lit(None).cast(kind).alias(alias)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    linked = joined.select(
        F.coalesce("id", "result_id").alias("id"),
        "name",
        "place",
        "result_place",
        status.alias("status"),
        "level",
        F.when(F.col("id").isNotNull(), valid(name, arguments, schemas)).alias("valid"),
        _message(F.coalesce("id", "result_id"), name, arguments, F.col("content")).alias("message"),
    )
    apart = more_calls.select(
        "id", "name", "place", none(kind(answers, "result_place"), "result_place"), "status", none("long", "level"), valid(name, arguments, schemas).alias("valid"), _message(F.col("id"), name, arguments, F.lit(None).cast("string")).alias("message")
    )
    lost = more_answers.select(
        "id", none("string", "name"), none(kind(calls, "place"), "place"), F.col("place").alias("result_place"), "status", none("long", "level"), none("boolean", "valid"), _message(F.col("id"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("content")).alias("message")
    )
    return linked.unionByName(apart).unionByName(lost)


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's or system's turn calls, the assistant's turn after it answers.

    Each call follows the turn two before it, the last one of the same side in an alternating conversation; a user's
    first call follows the system's turn, too. As plain turns always fit the schemas, some are written so that they do
    not: by their number, a turn lacks its text, has its number as text, or has a field that no schema has.
    """
    name = F.when(F.col("role") == "system", "instruct").when(F.col("role").isNotNull(), "answer")
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    fields = lambda *f: F.to_json(F.struct(*f))
    arguments = (
        F.when(turn % 7 == 5, fields("turn"))
        .when(turn % 5 == 4, fields(turn.cast("string").alias("turn"), text.alias("text")))
        .when(turn % 11 == 6, fields(F.lit(1.5).alias("extra"), "turn", text.alias("text")))
        .otherwise(fields((turn * 10).alias("limit"), "turn", text.alias("text")))
    )
    is_answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = turns.where(~is_answer).select(ident(turn).alias("id"), turn.alias("place"), name.alias("name"), arguments.alias("arguments"), F.array(ident(turn - 2), ident(F.when(turn <= 2, turn - 1))).alias("after"))
    results = turns.where(is_answer).select(ident(turn - 1).alias("id"), turn.alias("place"), F.col("text").alias("content"))
    return calls, results


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of conversations as linked calls and results."""
    return link(*from_conversations(common.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, text AS raw FROM conversations),
c0 AS (
  SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id, turn AS place,
         CASE WHEN role = 'system' THEN 'instruct' WHEN role IS NOT NULL THEN 'answer' END AS name,
         CASE WHEN turn % 7 = 5 THEN '{"turn":' || turn::VARCHAR || '}'
              WHEN turn % 5 = 4 THEN '{"text":' || to_json(text)::VARCHAR || ',"turn":"' || turn::VARCHAR || '"}'
              WHEN turn % 11 = 6 THEN '{"extra":1.5,"text":' || to_json(text)::VARCHAR || ',"turn":' || turn::VARCHAR || '}'
              ELSE '{"limit":' || (turn * 10)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || ',"turn":' || turn::VARCHAR || '}' END AS arguments,
         conv_id::VARCHAR || ':' || (turn - 2)::VARCHAR AS after1, CASE WHEN turn <= 2 THEN conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR END AS after2
  FROM t WHERE role IS DISTINCT FROM 'assistant'),
c1 AS (SELECT *, CASE WHEN id IS NULL THEN 'unidentified' WHEN row_number() OVER (PARTITION BY id ORDER BY place, arguments, name) > 1 THEN 'repeated' END AS apart FROM c0),
v AS (
  SELECT *, CASE WHEN NOT coalesce(json_type(arguments, '$.text') = 'VARCHAR' AND json_type(arguments, '$.turn') IN ('BIGINT', 'UBIGINT'), false) THEN false
    WHEN name = 'answer' THEN coalesce(json_type(arguments, '$.limit') IN ('BIGINT', 'UBIGINT'), true) AND len(list_filter(json_keys(arguments), lambda k: k NOT IN ('text', 'turn', 'limit'))) = 0
    WHEN name = 'instruct' THEN len(list_filter(json_keys(arguments), lambda k: k NOT IN ('text', 'turn'))) = 0 ELSE false END AS valid FROM c1),
c AS (SELECT * FROM v WHERE apart IS NULL),
r0 AS (SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS id, turn AS place, raw AS content FROM t WHERE role = 'assistant'),
r1 AS (SELECT *, CASE WHEN id IS NULL THEN 'unidentified' WHEN row_number() OVER (PARTITION BY id ORDER BY place, content) > 1 THEN 'repeated' END AS apart FROM r0),
r AS (SELECT * FROM r1 WHERE apart IS NULL),
e AS (SELECT DISTINCT c.id, p.id AS up FROM c JOIN c p ON p.id IN (c.after1, c.after2)),
l AS (
  SELECT id, 0::BIGINT AS level FROM c WHERE id NOT IN (SELECT id FROM e)
  UNION
  SELECT e.id, l.level + 1 FROM e JOIN l ON e.up = l.id),
h AS (SELECT id, max(level) AS level FROM l GROUP BY id)
SELECT coalesce(c.id, r.id) AS id, c.name, c.place, r.place AS result_place,
       CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       h.level, c.valid,
       '{"arguments":' || coalesce(c.arguments, 'null') || ',"id":' || to_json(coalesce(c.id, r.id))::VARCHAR
         || coalesce(',"name":' || to_json(c.name)::VARCHAR, '') || coalesce(',"result":' || to_json(r.content)::VARCHAR, '') || '}' AS message
FROM c FULL JOIN r ON c.id = r.id LEFT JOIN h ON c.id = h.id
UNION ALL
SELECT id, name, place, NULL, apart, NULL, valid,
       '{"arguments":' || arguments || coalesce(',"id":' || to_json(id)::VARCHAR, '') || coalesce(',"name":' || to_json(name)::VARCHAR, '') || '}'
FROM v WHERE apart IS NOT NULL
UNION ALL
SELECT id, NULL, NULL, place, apart, NULL, NULL,
       '{"arguments":null' || coalesce(',"id":' || to_json(id)::VARCHAR, '') || coalesce(',"result":' || to_json(content)::VARCHAR, '') || '}'
FROM r1 WHERE apart IS NOT NULL
"""
