"""Chat formatting with typed content parts, loss masks and a reader.

A conversation is one string. Turns stand between ``<turn role="...">`` and ``</turn>``; parts of a
turn after the first begin with ``<part/>``; an image, audio or document part is a placeholder such
as ``<image/>``, and the attachments, in the order of the placeholders, are listed beside the string
with the tokens each will take. In texts ``&`` and ``<`` are escaped, so that ``<`` only ever begins
a control string and what was written can be read back.

The loss mask is a list of runs (length in code points, loss or not) that cover the string; text
parts of the trained roles have loss, and nothing else has.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ATTACHMENTS = ("image", "audio", "document")
#: Tokens for one unit of an attachment: an image tile, a second of audio, a page.
TOKENS_OF_UNIT = {"image": 256, "audio": 25, "document": 600}
LOSS_ROLES = ("assistant",)
TURN_END, PART = "</turn>\n", "<part/>"
_CONTROL = r'<turn role="[^"]*">\n|</turn>\n|<part/>|<(?:image|audio|document)/>|[^<]+'
#: Kind of a part: text, or an attachment with a reference and a number of units.
PARTS = "array<struct<type: string, text: string, ref: string, units: int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """The parts of a turn that is only text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _visit(role: Column):
    """Segments of one part: its marker, then its text or placeholder. Unknown types count as text."""
    trained = F.coalesce(role.isin(*LOSS_ROLES), F.lit(False))

    def visit(p: Column, k: Column) -> Column:
        text = _segment(escape(F.coalesce(p["text"], F.lit(""))), trained)
        body = F.when(p["type"].isin(*ATTACHMENTS), _segment(F.concat(F.lit("<"), p["type"], F.lit("/>")), F.lit(False))).otherwise(text)
        return F.array(_segment(F.when(k > 0, PART).otherwise(""), F.lit(False)), body)

    return visit


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row for each conversation: ``conv``, ``formatted``, ``loss_runs``, ``attachments`` and ``attachment_tokens``.

    Turns are ordered by ``turn``, equal ones by role and parts; nulls first; repeated rows are repeated
    turns. A null text or role is empty, null or empty parts make an empty turn, and rows with a null
    ``conv`` are one conversation. Other columns are not read. A conversation is one value by its nature,
    and so is held whole by one task.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("parts"))))
    chats = turns.groupBy(F.col(conv)).agg(ordered.alias("__turns"))

    def segments(t: Column) -> Column:
        name = F.replace(escape(t["role"]), F.lit('"'), F.lit("&quot;"))
        head = _segment(F.concat(F.lit('<turn role="'), name, F.lit('">\n')), F.lit(False))
        return F.concat(F.array(head), F.flatten(F.transform(t["parts"], _visit(t["role"]))), F.array(_segment(F.lit(TURN_END), F.lit(False))))

    units = F.create_map(*(F.lit(x) for kv in TOKENS_OF_UNIT.items() for x in kv))

    def attached(t: Column, k: Column) -> Column:
        own = F.filter(t["parts"], lambda p: p["type"].isin(*ATTACHMENTS))
        return F.transform(own, lambda p: F.struct(k.alias("turn_index"), p["type"].alias("type"), p["ref"].alias("ref"), (units[p["type"]] * F.coalesce(p["units"], F.lit(1))).alias("tokens")))

    chats = chats.withColumn("__segments", F.filter(F.flatten(F.transform("__turns", segments)), lambda s: s["text"] != ""))
    return chats.select(
        F.col(conv),
        F.array_join(F.transform("__segments", lambda s: s["text"]), "").alias("formatted"),
        F.transform("__segments", lambda s: F.struct(F.length(s["text"]).alias("length"), s["loss"].alias("loss"))).alias("loss_runs"),
        F.flatten(F.transform("__turns", attached)).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_chats(chats: DataFrame) -> DataFrame:
    """Adds what the output says: ``turns`` (array of struct(role, parts: array of struct(type, text))) and ``loss_texts`` (array).

    Columns of the two names are replaced, all others stay. Fails on a string that isn't of this format, and on runs that don't fit it.
    """
    tokens = F.regexp_extract_all("formatted", F.lit(_CONTROL), F.lit(0))
    at = common.free_name(chats, "__tokens")
    df = chats.withColumn(at, tokens)
    whole = F.array_join(at, "") == F.col("formatted")
    paired = F.arrays_zip(F.col(at).alias("token"), F.col("loss_runs").alias("run"))
    fits = (F.size(at) == F.size("loss_runs")) & F.forall(paired, lambda x: F.length(x["token"]) == x["run"]["length"])
    checked = F.when(whole & fits, F.col(at)).otherwise(F.raise_error(F.lit("not a formatted conversation, or its mask doesn't fit")).cast("array<string>"))
    df = df.withColumn(at, checked).withColumn("loss_texts", F.transform(F.filter(paired, lambda x: x["run"]["loss"]), lambda x: unescape(x["token"])))
    bodies = F.slice(F.split("formatted", TURN_END, -1), 1, F.greatest(F.size(F.split("formatted", TURN_END, -1)) - 1, F.lit(0)))

    def part(p: Column) -> Column:
        kind = F.regexp_extract(p, r"^<(image|audio|document)/>$", 1)
        return F.when(kind != "", F.struct(kind.alias("type"), F.lit(None).cast("string").alias("text"))).otherwise(F.struct(F.lit("text").alias("type"), unescape(p).alias("text")))

    def parsed(body: Column) -> Column:
        name = F.regexp_extract(body, r'^<turn role="([^"]*)">\n', 1)
        rest = F.regexp_replace(body, r'^<turn role="[^"]*">\n', "")
        return F.struct(unescape(F.replace(name, F.lit("&quot;"), F.lit('"'))).alias("role"), F.transform(F.split(rest, PART, -1), part).alias("parts"))

    return df.withColumn("turns", F.transform(bodies, parsed)).drop(at)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(common.literal_rows(spark, own, ["conv_id", "turn", "role", "text"]).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    chats = format_chats(rows.withColumn("parts", text_parts(F.col("text"))))
    back = read_chats(chats)
    said = lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(F.transform(F.filter(t["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), ""), F.lit("\n"))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", said), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = {
    "op9_chat_format": r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn role="">') + 1 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
                + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
}
QUERIES = {"op9_chat_format": op9_chat_format}
