"""Conversation structure repair: a fold over sorted turns by Spark SQL's higher-order functions.

Windows derive a fault flag for each turn. The turns of a conversation are collected as sorted structs, a segment of
bounded length at a time, and ``aggregate()`` folds them into the cheapest edits: it carries four structs of cost and
audit (the initials of the edits so far), one for each place that the repaired roles can have come to, and native
``least`` picks the cheaper and then the ASCII-least. A segment is folded from each of the four places, and the
segments' tables are folded in turn, so that the turns of a long conversation are never collected at once.

Audits of one cost over the same turns are never a beginning of one another (what follows could only be inserts, which
cost), so that the least of two stays the least whatever is appended.

The text itself takes no part in the fold. Edits are joined back to the turns and the repaired conversation is read off
in order, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.llm import workspace

BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
RETOUCH, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns that one fold collects.
SEGMENT = 512

#: Where the repaired roles can have come to: nothing yet, after the system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
#: Dearer than any edits.
_FAR = 1 << 60


def _say(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def turns(conversations: DataFrame) -> DataFrame:
    """``key, conv_id, turn, role, text``: null ids, roles and texts are one space; ``key`` is the id as text."""
    return conversations.select(_say("conv_id").alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _say("role").alias("role"), _say("text").alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Of :func:`turns`: a twentieth each goes, is emptied, loses its ends of sentences, is doubled, becomes the user's."""
    lot = F.pmod(F.crc32(F.concat_ws(":", "key", _say("turn"))), F.lit(20))
    copies = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        rows.withColumn("lot", lot).filter("lot <> 0").withColumn("copy", F.explode(copies))
        .withColumn("text", F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")))
        .drop("lot", "copy")
    )


def flagged(rows: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 1; by turn, nulls first, then role and text), ``initial``, ``fault``, ``illegal``, ``new_turn``."""
    order = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text")
    places = rows.withColumn("initial", F.substring("role", 1, 1)).select(
        "*", F.row_number().over(order).alias("pos"), F.lag("initial").over(order).alias("before"), F.lag("turn").over(order).alias("turn_before")
    )
    seen = F.row_number().over(Window.partitionBy("key", "role", "text").orderBy("pos")) > 1
    solid = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(solid == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(solid, F.lit(1)).isin(*ENDS), "truncated")
    return places.withColumn("seen", seen).select(
        "key", "pos", "turn", "role", "text", "initial", fault.alias("fault"),
        F.coalesce(~F.concat("before", "initial").isin(*LEGAL), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
    )


def facts(rows: DataFrame) -> DataFrame:
    """Of :func:`flagged`: ``key, gaps, blank, duplicate, truncated, illegal``."""
    count = lambda c: F.count_if(c).cast("long")
    gaps = F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn"))
    return rows.groupBy("key").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
    )


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _path(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(path: Column, cost: Column | int, initials: str) -> Column:
    return _path(path["cost"] + cost, F.concat(path["audit"], F.lit(initials)))


def _four(paths: list[Column]) -> Column:
    return F.struct(*(p.alias(f"p{k}") for k, p in enumerate(paths)))


def _started(at: int) -> Column:
    return _four([_path(F.lit(0 if k == at else _FAR), F.lit("")) for k in STATES])


def _with_inserts(four: Column) -> Column:
    """The same paths, and those that insert a user turn, an assistant turn or both next."""
    p = [four[f"p{k}"] for k in STATES]
    one, two = (lambda x: _then(x, INSERT, "I")), (lambda x: _then(x, 2 * INSERT, "II"))
    user = F.least(p[USER], one(p[NOTHING]), one(p[SYSTEM]), one(p[ASSISTANT]))
    assistant = F.least(p[ASSISTANT], one(p[USER]), two(p[NOTHING]), two(p[SYSTEM]))
    return _four([p[NOTHING], p[SYSTEM], user, assistant])


def _with_turn(four: Column, turn: Column) -> Column:
    """Paths after one more turn: kept, with another role, or deleted."""
    p = [four[f"p{k}"] for k in STATES]
    must_go = F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    dearer = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    gone = [_then(x, DELETE, "D") for x in p]

    def stays(role: str, *places: int) -> Column:
        own = turn["initial"] == role
        return F.least(*(F.when(own, _then(p[k], dearer, "K")).otherwise(_then(p[k], dearer + RETOUCH, "R")) for k in places), F.lit(None))

    system = F.when(turn["initial"] == "s", _then(p[NOTHING], dearer, "K"))
    allowed = lambda path: F.when(~must_go, path)
    return _four([
        gone[NOTHING], F.least(gone[SYSTEM], allowed(system)), F.least(gone[USER], allowed(stays("u", NOTHING, SYSTEM, ASSISTANT))),
        F.least(gone[ASSISTANT], allowed(stays("a", USER))),
    ])


def edits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Of :func:`flagged`: ``key, cost, audit``, the cheapest edits in order and of those the ASCII-least."""
    part = F.floor((F.col("pos") - 1) / segment).alias("part")
    parts = rows.groupBy("key", part).agg(F.array_sort(F.collect_list(F.struct("pos", "initial", "fault"))).alias("turns"))
    step = lambda four, turn: _held(_with_inserts(four), lambda x: _with_turn(x, turn))
    table = F.array(*(F.aggregate("turns", _started(k), step) for k in STATES))
    tables = parts.select("key", "part", table.alias("table")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "table"))).alias("parts"))

    def joined(four: Column, part: Column) -> Column:
        ways = lambda to: [(four[f"p{k}"], F.get(part["table"], F.lit(k))[f"p{to}"]) for k in STATES]
        return _four([F.least(*(_path(a["cost"] + b["cost"], F.concat(a["audit"], b["audit"])) for a, b in ways(to))) for to in STATES])

    whole = F.aggregate("parts", _started(NOTHING), joined, lambda four: _held(_with_inserts(four), lambda x: F.least(x[f"p{NOTHING}"], x[f"p{ASSISTANT}"])))
    return tables.select("key", whole.alias("best")).select("key", "best.cost", "best.audit")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``key, pos, lines``: the repaired conversation's lines ``role:text`` at each turn (null: none), in order of ``pos``.

    ``rows`` is of :func:`flagged`, ``found`` of :func:`edits`. Inserted lines stand before the turn that follows them;
    those after the last turn have a place of their own.
    """
    each = F.concat(F.regexp_extract_all("audit", F.lit("I*[KRD]"), 0), F.array(F.concat(F.regexp_extract("audit", "I*$", 0), F.lit("D"))))
    ops = found.select("key", F.posexplode(each).alias("at", "op")).select("key", (F.col("at") + 1).alias("pos"), (F.length("op") - 1).alias("inserts"), F.right("op", F.lit(1)).alias("edit"))
    done = ops.join(rows.select("key", "pos", "role", "text", "initial"), ["key", "pos"], "left")
    stays, system = F.col("edit") != "D", F.coalesce((F.col("edit") == "K") & (F.col("initial") == "s"), F.lit(False))
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    # lines so far but for a system turn: users and assistants take turns
    nth = sums(F.col("inserts") + stays.cast("int") - system.cast("int"))
    role = lambda n: F.when(n % 2 == 0, "user").otherwise("assistant")
    inserted = F.transform(F.filter(F.sequence(F.lit(0), F.col("inserts")), lambda k: k < F.col("inserts")), lambda k: F.concat(role(F.col("nth") + k), F.lit(":")))
    own = F.concat_ws(":", F.when(F.col("edit") == "K", F.col("role")).otherwise(role(F.col("nth") + F.col("inserts"))), "text")
    lines = F.when(stays, F.array_append(inserted, own)).otherwise(inserted)
    return done.withColumn("nth", nth).select("key", "pos", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("lines"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; holds one digest, whatever the conversation's length."""
    key, digest, begun = None, None, False
    out = lambda k, d: pa.RecordBatch.from_arrays([pa.array([k]), pa.array([d.hexdigest()])], ["key", "repaired_sha256"])
    for batch in batches:
        for k, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or digest is None:
                if digest is not None:
                    yield out(key, digest)
                key, digest, begun = k, hashlib.sha256(), False
            if lines is not None:
                digest.update(f"\n{lines}".encode() if begun else lines.encode())
                begun = True
    if digest is not None:
        yield out(key, digest)


def digests(lines: DataFrame) -> DataFrame:
    """``key, repaired_sha256`` of :func:`repaired`."""
    workspace.bounded_batches(lines.sparkSession)
    ordered = lines.repartition(workspace.shuffle_width(lines.sparkSession), "key").sortWithinPartitions("key", "pos").select("key", "lines")
    return workspace.arrow_map(ordered, _digests, "key string, repaired_sha256 string")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: what is wrong with its turns after damage, the cheapest edits that mend it, and the result's hash.

    A null id is a conversation of its own. Null roles and texts are one space (so the text is blank), and a role
    without a character matches nothing. Turns of one number follow by role and text; repeated rows are duplicates.
    Empty texts are blank; texts of any length are read whole, outside the fold. A conversation of which nothing is
    left has zeros, an empty audit and the hash of nothing. Columns other than the four are not read. An empty table
    gives an empty result.
    """
    rows = turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    left = workspace.materialise(flagged(damaged(rows)), "turns")
    found = workspace.materialise(edits(left), "edits")
    every = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    parts = (facts(left), found, digests(repaired(left, found)))
    whole = reduce(lambda a, b: a.join(b, "key", "left"), parts, every)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return whole.select(
        "conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _oracle() -> str:
    """Recursion over the turns; a state is a struct of cost, audit and the text so far."""
    start = lambda c: f"{{'c': {c}::BIGINT, 'a': '', 't': ''}}"
    then = lambda s, c, a, line="''": f"{{'c': ({s}.c + {c})::BIGINT, 'a': {s}.a || '{a}', 't': {s}.t || {line}}}"
    user, other = "('user:' || chr(10))", "('assistant:' || chr(10))"
    closed = (
        f"least(s2, {then('s0', 3, 'I', user)}, {then('s1', 3, 'I', user)}, {then('s3', 3, 'I', user)}) AS i2, "
        f"least(s3, {then('s2', 3, 'I', other)}, {then('s0', 6, 'II', f'{user} || {other}')}, {then('s1', 6, 'II', f'{user} || {other}')}) AS i3"
    )
    kept, retouched = "(role || ':' || text || chr(10))", lambda r: f"('{r}:' || text || chr(10))"
    stays = lambda r, s: f"CASE WHEN gone THEN NULL WHEN left(role, 1) = '{r[0]}' THEN {then(s, 'more', 'K', kept)} ELSE {then(s, 'more + 3', 'R', retouched(r))} END"
    system = f"CASE WHEN NOT gone AND left(role, 1) = 's' THEN {then('s0', 'more', 'K', kept)} END"
    least = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda z: z.c IS NOT NULL))"
    return rf"""
WITH RECURSIVE c AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295]::UBIGINT[] || list_transform(string_split(key || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT),
        lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS lot FROM c),
d AS (SELECT key, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE lot WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE lot <> 0),
o AS (SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS role_before FROM d WINDOW w AS (PARTITION BY key ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 AS seen FROM o),
f AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM e),
t AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM f),
m AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY key),
p AS (SELECT key, 0::BIGINT AS pos, {start(0)} AS s0, {start(1 << 60)} AS s1, {start(1 << 60)} AS s2, {start(1 << 60)} AS s3 FROM (SELECT DISTINCT key FROM t)
  UNION ALL
  SELECT key, pos, {then('s0', 4, 'D')}, {least(then('s1', 4, 'D'), system)},
    {least(then('i2', 4, 'D'), stays('user', 's0'), stays('user', 's1'), stays('user', 'i3'))}, {least(then('i3', 4, 'D'), stays('assistant', 'i2'))}
  FROM (SELECT t.key, t.pos, role, text, gone, more, s0, s1, {closed} FROM p JOIN t ON t.key = p.key AND t.pos = p.pos + 1)),
z AS (SELECT key, least(s0, i3) AS best FROM (SELECT key, s0, {closed} FROM p WHERE (key, pos) IN (SELECT (key, max(pos)) FROM t GROUP BY key)))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM c) LEFT JOIN m USING (key) LEFT JOIN z USING (key)
"""


ORACLE = _oracle()
