r"""Chat formatting by a grammar round trip, with DataFrame functions only.

A turn is rendered as ``### Role: text</turn>`` and a line end. The parser is deterministic: ``</turn>`` ends a turn wherever
it stands, a turn begins with a header, and in a role or text ``\x`` is the character x, while ``###`` or a backslash without one
is an error. Each turn is first rendered as it is, parsed and compared with its source; one that does not come back (it
holds a control string or a backslash) is rendered with escapes. The whole conversation is then parsed and compared.
Escaped text holds no ``###`` and no ``</turn>``, so it always comes back, and no text can forge a turn; anything else raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import table

NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
END = "</turn>\n"


def _escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _name(role: Column, escaped: bool) -> Column:
    """Known roles by their names, any other after ``=``, so that ``User`` and ``user`` stay apart."""
    other = F.replace(_escape(role), F.lit(":"), F.lit("\\:")) if escaped else role
    name = F.concat(F.lit("="), other)
    for known, shown in NAMES.items():
        name = F.when(role == known, F.lit(shown)).otherwise(name)
    return name


def _turn(t: Column, escaped: bool) -> Column:
    """A rendered turn."""
    return F.concat(F.lit("### "), _name(t["role"], escaped), F.lit(": "), _escape(t["text"]) if escaped else t["text"], F.lit(END))


#: The possessive group is matched in a loop: a role may be long.
HEADER = r"(?s)^### (User|Assistant|System|Tool|=(?:[^\\:]|\\.)*+): "


def _parse(rendered: Column) -> Column:
    """Turns that the grammar reads from a rendered conversation, with the place of each text; ok is false where it does not hold."""
    cut = F.split(rendered, "</turn>")

    def legal(raw: Column) -> Column:
        left = F.regexp_replace(raw, r"(?s)\\.", " ")
        return ~F.contains(left, F.lit("\\")) & ~F.contains(left, F.lit("###"))

    def turn(piece: Column, i: Column) -> Column:
        # after the first, a piece begins with the line end of the turn before
        lead = F.when(i == 0, 0).otherwise(1)
        body = F.substr(piece, lead + 1)
        head = F.regexp_extract(body, HEADER, 0)
        name = F.regexp_extract(body, HEADER, 1)
        raw = F.substr(body, F.length(head) + 1)
        role = _unescape(F.substr(name, F.lit(2)))
        for known, shown in NAMES.items():
            role = F.when(name == shown, F.lit(known)).otherwise(role)
        ok = (head != "") & ((i == 0) | F.startswith(piece, F.lit("\n"))) & legal(name) & legal(raw)
        return F.struct(role.alias("role"), _unescape(raw).alias("text"), ok.alias("ok"), (F.length(piece) - lead).alias("length"), F.length(raw).alias("raw"))

    # what follows the last end mark is a line end
    return F.transform(F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0))), turn)


def _same(parsed: Column, source: Column) -> Column:
    """Whether parsed turns are those of source."""
    bare = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.forall(parsed, lambda t: t["ok"]) & (bare(parsed) == bare(source))


def format_chats(turns: DataFrame) -> DataFrame:
    """Renders each conversation and proves by parsing that nothing is lost.

    turns: conv_id, turn, role, text; other columns are ignored. Rows of a conversation go by turn (null first), then
    role and text, so that ties and repeated rows have one defined order; every row is a turn. A null role or text
    counts as empty. Rows whose conv_id is null are one conversation. An empty table gives an empty table.

    Returns conv_id, formatted (the rendered text), escaped (boolean: any turn is), turns (array of role, text, start, end
    and loss, as parsed from formatted; start and end are the place of the text in it, loss marks assistant texts).
    """
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = F.struct("turn", "role", "text")
    plain = filled.withColumn("plain", _same(_parse(_turn(t, False)), F.array(t)))
    shown = plain.withColumn("shown", F.when(F.col("plain"), _turn(t, False)).otherwise(_turn(t, True)))
    # a turn begins where those before it end
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("at", F.coalesce(F.sum(F.length("shown")).over(before), F.lit(0)).cast("int"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at", "shown", "plain"))).alias("source"))
    again = grouped.withColumn("formatted", F.array_join("source.shown", "")).withColumn("escaped", F.exists("source", lambda t: ~t["plain"])).withColumn("parsed", _parse(F.col("formatted")))
    sure = F.when(_same(F.col("parsed"), F.col("source")), F.col("parsed")).otherwise(F.raise_error(F.lit("a rendered conversation does not come back")))
    spans = F.zip_with(
        "parsed",
        "source.at",
        lambda t, at: F.struct(t["role"].alias("role"), t["text"].alias("text"), (at + t["length"] - t["raw"]).alias("start"), (at + t["length"]).alias("end"), (t["role"] == "assistant").alias("loss")),
    )
    return again.withColumn("parsed", sure).select("conv_id", "formatted", "escaped", spans.alias("turns"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, CAST(:t AS string) AS text UNION ALL SELECT -7L, 1L, 'assistant', :t", args={"t": hard})
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    # the loss text as the parser read it; cutting it out by spans would take time with the square of a conversation's turns
    masked = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("masked", masked).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"replace(replace(replace({0}, '\', '\\'), '#', '\#'), '</', '<\/')"
_HARD = r"(strpos({0}, '\') > 0 OR strpos({0}, '###') > 0 OR strpos({0}, '</turn>') > 0)"

ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, role IN ('user', 'assistant', 'system', 'tool') AS known,
    {_HARD.format("text")} OR (role NOT IN ('user', 'assistant', 'system', 'tool') AND ({_HARD.format("role")} OR strpos(role, ':') > 0)) AS hard
  FROM t
), f AS (
  SELECT conv_id, turn, role, text,
    length(CASE WHEN known THEN role WHEN NOT hard THEN '=' || role ELSE '=' || replace({_ESC.format("role")}, ':', '\:') END)
    + length(CASE WHEN hard THEN {_ESC.format("text")} ELSE text END) + 14 AS chars
  FROM s
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
