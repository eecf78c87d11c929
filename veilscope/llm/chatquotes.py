"""Quotation linking: conversations in reply order, without their quotes.

A line that begins with ``>`` is quoted, as deeply as it has such marks (blanks between them do not count); neighbouring
lines of one depth form a passage. A line such as "On Monday, Ann wrote:" that introduces a passage goes with it.
Passages and messages are normalised (lower case, letters and digits only, single blanks) and hashed in units: the
whole, each line and each sentence. Units join the conversation's own, unquoted ones, of which only the first message
that has them is the original; so a phrase that thousands repeat still matches one message. A passage links to the
earlier message that originates most of its characters (ties: the later message), and a message replies to the latest
message that one of its outermost passages, those of the smallest depth that it quotes at, links to.

Reply order: a message without a link begins a thread; a reply belongs to the thread of the message it answers, found
by replacing each parent by its own parent, so that the rounds grow with the logarithm of the depth. Threads follow one
another by their first message, and the messages of a thread by turn; a reply comes after what it answers, always.

Only DataFrame functions are used. No step gathers a conversation: joins are on (conversation, hash) or on message ids,
positions are counted by levels.

Cases: a null text is empty; a null turn comes last and is never linked to or from; a null conversation is one of its
own; rows that are equal in conversation, turn, role and text are one message, with ``copies`` of them; different
messages of one turn are ordered by an MD5 digest; an empty table gives an empty result; only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, stored

#: Marks at the beginning of a quoted line, and a line that introduces a quote (fixed values).
MARKS = r"^[ \t]*(?:>[ \t]?)+"
INTRODUCES = r"(?i)^[ \t]*(?:on [^\n]*|[^\n]* )?(?:wrote|writes|said)[^\n]{0,40}:[ \t]*$"
#: Lines and sentences shorter than this are too common to tell whose they are; the whole counts at any length.
LEAST_CHARS = 12
#: Turns of a slot, the unit in which positions are counted.
POSITION_SLOT = 10_000


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(text: Column) -> Column:
    """Lines as (depth, body, quoted-after): the depth of each, its text without marks."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    marked = lambda x: F.regexp_extract(x, MARKS, 0)
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(marked(x), "[ \t]", "")).alias("depth"), F.regexp_replace(x, MARKS, "").alias("body")))


def without_introductions(lines: Column) -> Column:
    """Drops an unquoted introducing line whose next line is quoted."""
    return F.filter(lines, lambda x, i: ~((x["depth"] == 0) & x["body"].rlike(INTRODUCES) & (F.coalesce(F.get(lines, i + 1)["depth"], F.lit(0)) > 0)))


def passages(lines: Column) -> Column:
    """Runs of quoted lines of one depth: (depth, lines)."""
    start = F.array().cast("array<struct<depth:int,lines:array<string>>>")
    one = lambda x: F.struct(x["depth"].alias("depth"), F.array(x["body"]).alias("lines"))

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["depth"].alias("depth"), F.concat(last["lines"], F.array(x["body"])).alias("lines"))
        same = last["depth"] == x["depth"]
        return F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(one(x))))

    return F.filter(F.aggregate(lines, start, add), lambda p: p["depth"] > 0)


def _units(lines: Column) -> Column:
    """Distinct normalised units of some lines: the whole, each line and each sentence of LEAST_CHARS or more."""
    whole = F.array_join(lines, " ")
    parts = F.filter(F.transform(F.concat(lines, F.split(whole, r"(?<=[.!?])\s+")), normalised), lambda u: F.length(u) >= LEAST_CHARS)
    return F.array_distinct(F.filter(F.concat(F.array(normalised(whole)), parts), lambda u: u != ""))


def messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct messages with an id, their own text, passages and number of copies."""
    plain = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    marked = plain.withColumn("id", F.md5(F.concat_ws("\x1f", part("conv"), part("turn"), part("role"), part("text"))))
    counted = marked.groupBy("id").agg(*(F.first(c).alias(c) for c in ("conv", "turn", "role", "text")), F.count(F.lit(1)).alias("copies"))
    lined = counted.withColumn("_lines", without_introductions(parsed(F.col("text"))))
    own = F.transform(F.filter("_lines", lambda x: x["depth"] == 0), lambda x: x["body"])
    return (
        lined.withColumn("_own", own).withColumn("passages", passages(F.col("_lines")))
        .withColumn("body", F.regexp_replace(F.regexp_replace(F.array_join("_own", "\n"), r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", ""))
        .withColumn("units", _units(F.filter("_own", lambda x: F.trim(x) != ""))).withColumn("conv_key", part("conv")).drop("_lines", "_own", "text")
    )


def links(parsed_messages: DataFrame) -> DataFrame:
    """``id``, ``passage``, whether it is an ``outer`` one, of the message's smallest depth, and the ``original`` that it
    links to, with its turn."""
    m = parsed_messages
    # Of all messages of a conversation that have a unit, the first is its original.
    origin = m.where("turn is not null").select("conv_key", "turn", "id", F.explode("units").alias("unit")).groupBy("conv_key", F.md5("unit").alias("hash")).agg(F.min(F.struct("turn", "id")).alias("first"))
    outermost = F.array_min(F.transform("passages", lambda p: p["depth"]))
    quoted = m.where("turn is not null").select("conv_key", "turn", "id", outermost.alias("outermost"), F.posexplode("passages").alias("passage", "p"))
    probes = quoted.select("conv_key", "turn", "id", "passage", (F.col("p.depth") == F.col("outermost")).alias("outer"), F.explode(_units(F.filter("p.lines", lambda x: F.trim(x) != ""))).alias("unit"))
    hits = probes.withColumn("hash", F.md5("unit")).join(origin, ["conv_key", "hash"]).where(F.col("first.turn") < F.col("turn"))
    weighed = hits.groupBy("id", "passage", "outer", "first").agg(F.sum(F.length("unit")).alias("chars"))
    best = weighed.groupBy("id", "passage", "outer").agg(F.max(F.struct("chars", "first")).alias("best"))
    return best.select("id", "passage", "outer", F.col("best.first.id").alias("original"), F.col("best.first.turn").alias("original_turn"))


def roots(edges: DataFrame) -> DataFrame:
    """(id, parent) of replies -> (id, root, steps): parents are replaced by their own parents until all are roots."""
    now = checkpointed(edges.select("id", F.col("parent").alias("root"), F.lit(1).cast("long").alias("steps")))
    while True:
        above = now.select(F.col("id").alias("root"), F.col("root").alias("_up"), F.col("steps").alias("_more"))
        now = checkpointed(now.join(above, "root", "left").select("id", F.coalesce("_up", "root").alias("root"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.col("_up").isNotNull().alias("_moved")))
        if now.where("_moved").isEmpty():
            return now.drop("_moved")
        now = now.drop("_moved")


def threaded(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each message: conversation, turn, role, ``body`` without quotes, numbers of passages and links, the
    turn it replies to, its thread's first turn and its depth there, its ``position`` in reply order, and ``copies``."""
    m = stored(messages(df, conv, turn, role, text), "messages")
    linked = checkpointed(links(m))
    parents = linked.where("outer").groupBy("id").agg(F.max(F.struct("original_turn", F.col("original").alias("parent"))).alias("p")).select("id", "p.parent", F.col("p.original_turn").alias("reply_to"))
    tree = roots(parents)
    counts = linked.groupBy("id").agg(F.count(F.lit(1)).alias("linked"))
    full = (
        m.select("id", "conv_key", "conv", "turn", "role", "body", F.size("passages").cast("long").alias("quotes"), "copies")
        .join(parents, "id", "left").join(counts, "id", "left").join(tree, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    first = m.select(F.col("id").alias("root"), F.col("turn").alias("thread_turn"))
    return _positioned(full.join(first, "root")).select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "body", "quotes", F.coalesce("linked", F.lit(0)).alias("linked"),
        "reply_to", "thread_turn", F.coalesce("steps", F.lit(0)).alias("depth"), "position", "copies",
    )


def _positioned(df: DataFrame) -> DataFrame:
    """Position from 0 in reply order, by levels: a conversation's slots of turns, a slot's thread beginnings with the
    first digits of their ids, these threads with their own slots of turns, and the messages there. Each level adds what
    comes before within the level above, so that no window holds a whole conversation or thread."""
    last, slot = F.lit(2**62), lambda c: F.floor(F.col(c) / POSITION_SLOT)
    cut = df.withColumns({"_begin": F.coalesce("thread_turn", last), "_turn": F.coalesce("turn", last)}).withColumns({"_slot": slot("_begin"), "_mark": F.substring("root", 1, 2), "_part": slot("_turn")})
    levels, above = (["_slot"], ["_begin", "_mark"], ["root", "_part"]), ["conv_key"]
    position = F.lit(0)
    for number, level in enumerate(levels):
        sizes = cut.groupBy(*above, *level).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*above).orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.withColumn(f"_offset{number}", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        above = [*above, *level]
        cut, position = cut.join(offsets, above), position + F.col(f"_offset{number}")
    rank = F.row_number().over(Window.partitionBy(*above).orderBy("_turn", "id")) - 1
    return cut.withColumn("_rank", rank).withColumn("position", (F.col("_rank") + position).cast("long"))


def formatted(threads: DataFrame, role: str = "role", opening: str = "<|", closing: str = "|>") -> DataFrame:
    """``threads`` with ``chat``: each message between its role's mark and an end mark, ready to be joined in order."""
    return threads.withColumn("chat", F.concat(F.lit(opening), F.coalesce(F.col(role), F.lit("unknown")), F.lit(closing + "\n"), "body", F.lit(f"\n{opening}end{closing}\n")))


_NORMALISED = "trim(regexp_replace(lower(%s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_UNITS = f"""SELECT DISTINCT {{keys}}, u AS unit FROM (
    SELECT {{keys}}, {_NORMALISED % "unnest(list_concat(lines, string_split(regexp_replace(whole, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))))"} AS u, 12 AS least FROM (
      SELECT {{keys}}, list(body ORDER BY n) AS lines, string_agg(body, ' ' ORDER BY n) AS whole FROM {{lines}} WHERE trim(body, ' ') <> '' GROUP BY ALL)
    UNION ALL
    SELECT {{keys}}, {_NORMALISED % "string_agg(body, ' ' ORDER BY n)"} AS u, 1 AS least FROM {{lines}} WHERE trim(body, ' ') <> '' GROUP BY {{keys}}
  ) WHERE length(u) >= least"""
THREADS_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, role, text, coalesce('=' || CAST(conv_id AS VARCHAR), 'null') AS conv_key,
         md5(concat_ws(chr(31), coalesce('=' || CAST(conv_id AS VARCHAR), 'null'), coalesce('=' || CAST(turn AS VARCHAR), 'null'), coalesce('=' || role, 'null'), coalesce('=' || text, 'null'))) AS id FROM conversations
), m AS (
  SELECT id, any_value(conv_key) AS conv_key, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role, any_value(text) AS text, count(*) AS copies FROM raw GROUP BY id
), line0 AS (
  SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT id, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS ls FROM m)
), line1 AS (
  SELECT id, n, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+', 0), '[ \t]', '', 'g')) AS depth, regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS body FROM line0
), line2 AS (
  SELECT *, lead(depth) OVER (PARTITION BY id ORDER BY n) AS next FROM line1
), line3 AS (
  SELECT id, n, depth, body, lag(depth) OVER (PARTITION BY id ORDER BY n) AS last FROM line2
  WHERE NOT (depth = 0 AND regexp_matches(body, '(?i)^[ \t]*(?:on [^\n]*|[^\n]* )?(?:wrote|writes|said)[^\n]{{0,40}}:[ \t]*$') AND coalesce(next, 0) > 0)
), runs AS (
  SELECT *, sum(CASE WHEN depth = last THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS run FROM line3
), own AS (
  SELECT id, n, body FROM runs WHERE depth = 0
), quoted AS (
  SELECT id, n, depth, body, dense_rank() OVER (PARTITION BY id ORDER BY run) AS passage FROM runs WHERE depth > 0
), bodies AS (
  SELECT id, regexp_replace(regexp_replace(string_agg(body, chr(10) ORDER BY n), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM own GROUP BY id
), own_units AS (
  {_UNITS.format(keys="id", lines="own")}
), quoted_units AS (
  {_UNITS.format(keys="id, passage, depth", lines="quoted")}
), origin AS (
  SELECT conv_key, unit, min({{'turn': turn, 'id': id}}) AS first FROM own_units JOIN m USING (id) WHERE turn IS NOT NULL GROUP BY ALL
), weighed AS (
  SELECT q.id, q.passage, q.depth, o.first, sum(length(q.unit)) AS chars FROM quoted_units q JOIN m USING (id) JOIN origin o ON o.conv_key = m.conv_key AND o.unit = q.unit WHERE o.first.turn < m.turn GROUP BY ALL
), linked AS (
  SELECT id, passage, depth, max({{'chars': chars, 'first': first}}) AS best FROM weighed GROUP BY ALL
), parents AS (
  SELECT id, max({{'turn': best.first.turn, 'id': best.first.id}}) AS p FROM linked JOIN (SELECT id, min(depth) AS depth FROM quoted GROUP BY id) USING (id, depth) GROUP BY id
), up AS (
  SELECT id, p.id AS root, 1 AS steps FROM parents UNION ALL SELECT up.id, parents.p.id, steps + 1 FROM up JOIN parents ON parents.id = up.root
), top AS (
  SELECT id, arg_max(root, steps) AS root, max(steps) AS steps FROM up GROUP BY id
), j AS (
  SELECT m.*, coalesce(bodies.body, '') AS body, coalesce(top.root, m.id) AS root, coalesce(top.steps, 0) AS depth, parents.p.turn AS reply_to
  FROM m LEFT JOIN bodies USING (id) LEFT JOIN top USING (id) LEFT JOIN parents USING (id)
)
SELECT j.conv_id, j.turn, j.role, j.body, CAST((SELECT count(DISTINCT passage) FROM quoted q WHERE q.id = j.id) AS BIGINT) AS quotes, CAST((SELECT count(*) FROM linked l WHERE l.id = j.id) AS BIGINT) AS linked,
       j.reply_to, r.turn AS thread_turn, CAST(j.depth AS BIGINT) AS depth,
       row_number() OVER (PARTITION BY j.conv_key ORDER BY r.turn NULLS LAST, j.root, j.turn NULLS LAST, j.id) - 1 AS position, j.copies
FROM j JOIN m r ON r.id = j.root
"""
