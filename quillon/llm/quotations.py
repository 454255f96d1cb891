"""Chat formatting by quotation linking, in DataFrame functions only.

Each message is cut into lines; the ">" marks before a line are its quote level
(spaces between them don't count), and a passage is one line, since that is how mail
and chat programs quote.  Quoted passages are normalised (lower case; everything but
letters and digits is one space), hashed, and joined to the messages of the conversation
that hold them unquoted; each goes to the latest earlier one.  A message answers
the one that most of its passages of the lowest linked level come from (of several the
latest).  Following the answers upwards gives its thread's first turn (``root_turn``); a
conversation in reply order is sorted by root_turn and turn, so threads stay together and
answers stand behind what they answer.  ``content`` is the message without quotes and the
lines that announce them ("... wrote:").

Scale: only passages that somebody quotes in the same conversation take part in the join; a
running maximum in turn order replaces a join of all pairs.  Threads are followed by
pointer doubling, with tables in the shared folder.  Places are sums over distinct turns.  Running
values are taken within even ranges of the order, and a conversation or passage that
spans several ranges gets what stands before each range from a table of one row per range at
most, so one that holds most rows is dealt over all tasks.

Edge cases: null texts count as empty; messages with the same conv_id and turn stand
at one place and share links; null conv_id or turn: the message links to nothing and is its own
root; a quote of nothing earlier stays unlinked; roles may be null; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.llm.shared import cut, drop

#: Quote marks, and what ends a line that announces a quote.
MARKS = r"^(?:[ \t]*>)+"
ANNOUNCES = r"(?i)(?:wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def _normal(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, quoted (level and hash of quoted passages), own (hashes of the others' lines)."""
    lines = messages.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines")
    ).withColumn("lines", F.transform("lines", lambda x: F.struct(x.alias("line"), _level(x).alias("level"))))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["line"].rlike(ANNOUNCES) & (F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)) > 0)))
    hashed = lambda xs: F.transform(xs, lambda x: F.struct(x["level"].alias("level"), _normal(x["line"]).alias("passage")))
    filled = lambda xs: F.filter(xs, lambda x: x["passage"] != "")
    coded = lambda xs: F.transform(xs, lambda x: F.struct(x["level"].alias("level"), F.md5(x["passage"].cast("binary")).alias("passage")))
    return lines.select(
        "conv_id",
        "turn",
        "role",
        F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("content"),
        coded(filled(hashed(F.filter("lines", lambda x: x["level"] > 0)))).alias("quoted"),
        F.array_distinct(F.transform(coded(filled(hashed(own))), lambda x: x["passage"])).alias("own"),
    )


def _running(rows: DataFrame, keys: list[str], order: list[str], window: WindowSpec, column: str, f: Callable[[str], Column], both: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """rows with column replaced by its f over the rows of the same keys that stand before, by order; window says the order and frame, both joins two values of f.

    Rows are dealt as even ranges of keys and order.  A key goes on from an earlier range
    only as the first key of a range, so ``carried`` has at most one row a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(rows.repartitionByRange(n, *keys, *(F.col(c).asc_nulls_last() for c in order)).withColumn("range", F.spark_partition_id()), name)
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.groupBy(*keys, "range").agg(f(column).alias("x")).select(F.struct(*keys, "range").alias("place"), f("x").over(earlier).alias("carried")).filter("carried is not null")
    within = ranges.withColumn("within", f(column).over(window.partitionBy("range", *keys))).withColumn("here", F.struct(*keys, "range"))
    return within.join(F.broadcast(carried), F.col("here").eqNullSafe(F.col("place")), "left").withColumn(column, both(F.col("within"), F.col("carried"))).select(*rows.columns)


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, n_linked (different passages found) and parent_turn of the messages that quote an earlier one."""
    quoted = rows.select("conv_id", "turn", F.inline("quoted")).groupBy("conv_id", "turn", "passage").agg(F.min("level").alias("level"))
    sought = quoted.select("conv_id", "passage").distinct()
    held = rows.select("conv_id", "turn", F.explode("own").alias("passage")).distinct().join(sought, ["conv_id", "passage"], "left_semi")
    both = quoted.select("conv_id", "passage", "turn", "level", F.lit(None).cast("long").alias("source")).unionByName(held.select("conv_id", "passage", "turn", F.lit(None).cast("int").alias("level"), F.col("turn").alias("source")))
    earlier = Window.orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    latest = _running(both.filter("conv_id is not null and turn is not null"), ["conv_id", "passage"], ["turn"], earlier, "source", F.max, F.greatest, "passages")
    found = latest.filter("level is not null and source is not null")
    votes = found.groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"), F.max(F.struct(-F.col("level"), F.col("n"), F.col("source").alias("parent_turn")))["parent_turn"].alias("parent_turn"))


def roots(parents: DataFrame) -> DataFrame:
    """parents (conv_id, turn, parent_turn, n_linked) with root_turn, where the parents' parents end."""
    now = cut(parents.withColumn("root_turn", F.col("parent_turn")), "threads")
    while True:
        above = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"))
        after = cut(now.join(above, ["conv_id", "root_turn"], "left").select("conv_id", "turn", "parent_turn", "n_linked", F.coalesce("above", "root_turn").alias("root_turn"), F.col("above").isNotNull().alias("moved")), "threads")
        done = not after.filter("moved").take(1)
        drop(now)
        now = after.drop("moved")
        if done:
            return now


def quotation_linking(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, place (messages before its turn in reply order), root_turn, turn, parent_turn, role, content, n_quoted, n_linked, chat."""
    rows = parsed(messages)
    threads = roots(links(rows.filter(F.size("quoted") > 0).select("conv_id", "turn", "quoted", F.array().cast("array<string>").alias("own")).unionByName(rows.select("conv_id", "turn", F.array().cast(rows.schema["quoted"].dataType).alias("quoted"), "own"))))
    known = rows.select("conv_id", "turn", "role", "content", F.size("quoted").cast("long").alias("n_quoted")).join(threads, ["conv_id", "turn"], "left")
    known = known.withColumn("root_turn", F.coalesce("root_turn", "turn"))
    turns = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long")).groupBy("conv_id", "turn").agg(F.count("*").alias("n")).join(threads.select("conv_id", "turn", "root_turn"), ["conv_id", "turn"], "left")
    before = Window.orderBy(F.col("root_turn").asc_nulls_last(), F.col("turn").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    places = _running(turns.withColumn("root_turn", F.coalesce("root_turn", "turn")), ["conv_id"], ["root_turn", "turn"], before, "n", F.sum, total, "places")
    places = places.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("n").alias("place"))
    out = known.join(places, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")))
    return out.select(
        "conv_id",
        "place",
        "root_turn",
        "turn",
        "parent_turn",
        "role",
        "content",
        "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("content"), F.lit("<|end|>\n")).alias("chat"),
    )


def segments(linked: DataFrame, turns: int = 64) -> DataFrame:
    """Conversations as texts: (conv_id, segment, part, n_messages, chat), in reply order when sorted by conv_id, segment and part.

    A segment holds the threads that begin within so many turns, a part so many turns of them, so a text is bounded where turns aren't repeated.
    """
    keyed = linked.withColumn("segment", F.floor(F.col("root_turn") / turns)).withColumn("part", F.floor(F.col("turn") / turns))
    texts = keyed.groupBy("conv_id", "segment", "part").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("root_turn", "turn", "role", "chat"))).alias("x"))
    return texts.select("conv_id", "segment", "part", "n_messages", F.array_join(F.transform("x", lambda m: m["chat"]), "").alias("chat"))


#: The same in one statement, for comparison.
SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM m),
v AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
      trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS passage FROM l),
w AS (SELECT *, level = 0 AND NOT (regexp_matches(line, '(?i)(?:wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$') AND coalesce(lead(level) OVER (PARTITION BY id ORDER BY i), 0) > 0) AS own FROM v),
c AS (SELECT id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (own), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS content,
      count(*) FILTER (level > 0 AND passage <> '') AS n_quoted FROM w GROUP BY id),
q AS (SELECT conv_id, turn, passage, min(level) AS level FROM w WHERE level > 0 AND passage <> '' GROUP BY ALL),
o AS (SELECT DISTINCT conv_id, turn, passage FROM w WHERE own AND passage <> ''),
f AS (SELECT q.conv_id, q.turn, q.passage, q.level, max(o.turn) AS source FROM q JOIN o ON q.conv_id = o.conv_id AND q.passage = o.passage AND o.turn < q.turn GROUP BY ALL),
n AS (SELECT conv_id, turn, level, source, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT conv_id, turn, sum(n)::BIGINT AS n_linked, arg_max(source, (-level, n, source)) AS parent_turn FROM n GROUP BY ALL),
r AS (SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM p
      UNION ALL SELECT r.conv_id, r.turn, p.parent_turn, r.depth + 1 FROM r JOIN p ON r.conv_id = p.conv_id AND r.root_turn = p.turn),
t AS (SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn FROM r GROUP BY ALL),
k AS (SELECT m.conv_id, coalesce(t.root_turn, m.turn) AS root_turn, m.turn, p.parent_turn, m.role, c.content, c.n_quoted, coalesce(p.n_linked, 0) AS n_linked
      FROM m JOIN c USING (id) LEFT JOIN p ON m.conv_id = p.conv_id AND m.turn = p.turn LEFT JOIN t ON m.conv_id = t.conv_id AND m.turn = t.turn)
SELECT conv_id, rank() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS LAST, turn NULLS LAST) - 1 AS place, root_turn, turn, parent_turn, role, content, n_quoted, n_linked,
       '<|' || coalesce(role, '') || '|>' || chr(10) || content || '<|end|>' || chr(10) AS chat FROM k
"""
