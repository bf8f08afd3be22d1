"""Quotation linking for chat formatting, with DataFrame functions only.

Lines that begin with ``>`` marks are quoted, as deep as they have marks. Passages (runs of one
level, their paragraphs and lines) are normalised, hashed and linked, inside their
conversation, to the last message before that said the same as a whole, a paragraph or a line. The best
link (shallowest level, most characters, latest original) makes a message a reply; pointer
doubling finds each reply's thread and depth. Ordered by conversation, thread and turn, the rows
are the conversations in reply order, every message after what it answers, without quotes.

The nearest earlier original is found by windows over originals and passages in order of turn, first
inside a block of turns, then over the blocks, so a sentence that thousands say and quote in one
conversation gives one row a passage, not pairs; no conversation is gathered in one place.

Defined results: a null text is an empty message; a null conversation or turn can't be linked and
starts a thread of its own; rows of one conversation and turn are one message with several
texts and share its links; text that is nothing but quotes leaves an empty message; passages without
a letter or digit are none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled

#: Marks before a quoted line, and the line that announces a quotation ("... wrote:").
QUOTED = r"^[ \t]*>"
MARKS = r"^((?:[ \t]*>)+)"
ANNOUNCES = r"(?i)\b(?:wrote|writes|said|a écrit|schrieb|escribió)[ \t]*:[ \t]*$"
#: Turns that one window holds.
BLOCK = 64


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def without_quotes(text: Column) -> Column:
    """The lines that are not quoted, nor announce a quotation that the next line begins."""
    lines = _lines(text)
    after = lambda i: F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))
    kept = F.filter(lines, lambda line, i: ~line.rlike(QUOTED) & ~(line.rlike(ANNOUNCES) & after(i).rlike(QUOTED)))
    cleaned = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(F.coalesce(text, F.lit("")).rlike("(?m)" + QUOTED), cleaned).otherwise(F.coalesce(text, F.lit("")))


def _passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, key, chars): quoted runs of one level, their paragraphs and lines."""
    quoting = messages.where(F.col("text").rlike("(?m)" + QUOTED)).distinct()
    lines = quoting.select("conv", "turn", F.xxhash64("text").alias("body"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), "[^>]", ""))
    lines = lines.withColumn("level", level).withColumn("said", F.regexp_replace("line", MARKS, ""))
    message = Window.partitionBy("conv", "turn", "body").orderBy("at")
    changed = F.coalesce(F.lag("level").over(message) != F.col("level"), F.lit(True))
    blank = F.trim("said") == ""
    lines = lines.withColumn("run", F.sum(changed.cast("int")).over(message))
    lines = lines.withColumn("paragraph", F.sum((changed | blank).cast("int")).over(message)).where("level > 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), " ")
    whole = ["conv", "turn", "body", "level"]
    parts = [lines.groupBy(*whole, part).agg(said.alias("said")).select("conv", "turn", "level", "said") for part in ("run", "paragraph")]
    parts.append(lines.select("conv", "turn", "level", "said"))
    out = parts[0].union(parts[1]).union(parts[2]).select("conv", "turn", "level", _normal(F.col("said")).alias("said"))
    out = out.withColumn("chars", F.length("said")).where("chars > 0")
    return out.select("conv", "turn", "level", F.md5("said").alias("key"), "chars").distinct()


def _originals(messages: DataFrame) -> DataFrame:
    """(conv, key, said_at): the turns whose own text says a passage."""
    own = without_quotes(F.col("text"))
    texts = messages.select("conv", "turn", own.alias("own"))
    parts = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    said = texts.select("conv", "turn", F.explode(F.array_distinct(F.transform(parts, _normal))).alias("said"))
    return said.where(F.length("said") > 0).select("conv", F.md5("said").alias("key"), F.col("turn").alias("said_at")).distinct()


def _nearest(passages: DataFrame, originals: DataFrame) -> DataFrame:
    """The passages, each with the last turn before its own that says it (``said_at``, null: none)."""
    kinds = {f.name: f.dataType for f in passages.schema}
    asked = passages.withColumn("said_at", F.lit(None).cast(kinds["turn"]))
    told = originals.select("conv", F.col("said_at").alias("turn"), F.lit(None).cast(kinds["level"]).alias("level"), "key", F.lit(None).cast(kinds["chars"]).alias("chars"), "said_at")
    rows = asked.unionByName(told).withColumn("block", F.floor(F.col("turn") / BLOCK))
    here = Window.partitionBy("conv", "key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "key", "block").agg(F.max("said_at").alias("last"))
    blocks = blocks.select("conv", "key", "block", F.last("last", ignorenulls=True).over(before).alias("earlier")).where("earlier is not null")
    near = rows.withColumn("near", F.last("said_at", ignorenulls=True).over(here)).where("level is not null")
    return near.join(blocks, ["conv", "key", "block"], "left").select("conv", "turn", "level", "key", "chars", F.coalesce("near", "earlier").alias("said_at"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, thread, depth) for (conv, turn, parent), by pointer doubling."""
    now, rows = settled(links.select("conv", "turn", "parent", F.col("parent").alias("thread"), F.lit(1).alias("depth")))
    moving = rows
    while moving:
        up = now.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        joined = now.join(up, ["conv", "thread"], "left")
        now, rows = settled(joined.select("conv", "turn", "parent", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        moving = now.where("moved").limit(1).count()
        now = now.drop("moved")
    return now


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: its conversation, turn and role, parent_turn (null: no reply), thread_turn, depth,
    n_passages (quoted passages), n_linked (those found in earlier messages) and the text without quotes."""
    all_rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    linkable = all_rows.where("conv is not null and turn is not null and text is not null").select("conv", "turn", "text")
    passages, some = settled(_passages(linkable))
    if some:
        quoted = passages.select("conv").distinct()
        originals = _originals(linkable.join(quoted, "conv", "left_semi"))
        found = _nearest(passages, originals).withColumn("linked", F.col("said_at").isNotNull())
        best = F.max_by("said_at", F.when(F.col("linked"), F.struct(-F.col("level"), "chars", "said_at")))
        found, _ = settled(found.groupBy("conv", "turn").agg(best.alias("parent"), F.count(F.lit(1)).alias("n_passages"), F.count_if("linked").alias("n_linked")))
        ordered = threads(found.where("parent is not null").select("conv", "turn", "parent"))
        counts = found.select("conv", "turn", "n_passages", "n_linked").join(ordered, ["conv", "turn"], "left")
        out = all_rows.join(counts, ["conv", "turn"], "left")
    else:
        none = F.lit(None).cast(all_rows.schema["turn"].dataType)
        out = all_rows.withColumns({"parent": none, "thread": none, "depth": F.lit(None).cast("int"), "n_passages": F.lit(0), "n_linked": F.lit(0)})
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("parent").alias("parent_turn"), F.coalesce("thread", "turn").alias("thread_turn"),
        zero("depth", "int"), zero("n_passages", "long"), zero("n_linked", "long"), without_quotes(F.col("text")).alias("text"),
    )


#: DuckDB SQL for link() over conversations.
SQL = r"""
WITH RECURSIVE msgs AS (
  SELECT conv_id AS conv, turn, role, text FROM conversations
), bodies AS (
  SELECT DISTINCT text, md5(text) AS body FROM msgs WHERE text IS NOT NULL
), split AS (
  SELECT DISTINCT conv, turn, md5(text) AS body FROM msgs WHERE conv IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL
), numbered AS (
  SELECT body, i AS pos, regexp_replace(string_split(text, chr(10))[i], '\r$', '') AS line
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM bodies)
), marked AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^((?:[ \t]*>)+)', '') AS said,
         coalesce(lead(line) OVER (PARTITION BY body ORDER BY pos), '') AS nxt
  FROM numbered
), unquoted AS (
  SELECT body, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT (regexp_matches(line, '(?i)\b(?:wrote|writes|said|a écrit|schrieb|escribió)[ \t]*:[ \t]*$') AND regexp_matches(nxt, '^[ \t]*>'))) AS own,
         max(level) AS deepest
  FROM marked GROUP BY body
), own AS (
  SELECT b.body, CASE WHEN u.deepest = 0 THEN b.text
         ELSE regexp_replace(regexp_replace(coalesce(u.own, ''), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') END AS own
  FROM bodies b JOIN unquoted u USING (body)
), runs AS (
  SELECT *, sum(changed) OVER (PARTITION BY body ORDER BY pos) AS run,
         sum(CASE WHEN changed = 1 OR trim(said) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY body ORDER BY pos) AS paragraph
  FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY body ORDER BY pos) THEN 1 ELSE 0 END AS changed FROM marked)
), spoken AS (
  SELECT body, level, string_agg(said, ' ' ORDER BY pos) AS said FROM runs WHERE level > 0 GROUP BY body, level, run
  UNION ALL SELECT body, level, string_agg(said, ' ' ORDER BY pos) FROM runs WHERE level > 0 GROUP BY body, level, paragraph
  UNION ALL SELECT body, level, said FROM runs WHERE level > 0
), passages AS (
  SELECT DISTINCT conv, turn, level, key, length(key) AS chars
  FROM (SELECT conv, turn, level, trim(regexp_replace(lower(said), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM spoken JOIN split USING (body)) WHERE length(key) > 0
), originals AS (
  SELECT DISTINCT conv, key, turn AS said_at
  FROM (SELECT conv, turn, trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
        FROM (SELECT conv, turn, own AS part FROM split JOIN own USING (body)
              UNION ALL SELECT conv, turn, unnest(regexp_split_to_array(own, '\n[ \t]*\n')) FROM split JOIN own USING (body)
              UNION ALL SELECT conv, turn, unnest(string_split(own, chr(10))) FROM split JOIN own USING (body)))
  WHERE length(key) > 0
), linked AS (
  SELECT p.conv, p.turn, p.level, p.key, p.chars, max(o.said_at) AS said_at
  FROM passages p LEFT JOIN originals o ON o.conv = p.conv AND o.key = p.key AND o.said_at < p.turn GROUP BY ALL
), found AS (
  SELECT conv, turn, max_by(said_at, CASE WHEN said_at IS NOT NULL THEN (-level, chars, said_at) END) AS parent, count(*) AS n_passages, count(said_at) AS n_linked
  FROM linked GROUP BY conv, turn
), climbed AS (
  SELECT conv, turn, parent AS thread, 1 AS depth FROM found WHERE parent IS NOT NULL
  UNION ALL
  SELECT c.conv, c.turn, f.parent, c.depth + 1 FROM climbed c JOIN found f ON f.conv = c.conv AND f.turn = c.thread AND f.parent IS NOT NULL
), placed AS (
  SELECT conv, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM climbed GROUP BY conv, turn
)
SELECT m.conv AS conv_id, m.turn, m.role, f.parent AS parent_turn, coalesce(p.thread, m.turn) AS thread_turn, CAST(coalesce(p.depth, 0) AS INTEGER) AS depth,
       CAST(coalesce(f.n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(f.n_linked, 0) AS BIGINT) AS n_linked,
       coalesce(o.own, m.text, '') AS text
FROM msgs m LEFT JOIN found f ON f.conv = m.conv AND f.turn = m.turn LEFT JOIN placed p ON p.conv = m.conv AND p.turn = m.turn
LEFT JOIN own o ON o.body = md5(m.text)
"""
