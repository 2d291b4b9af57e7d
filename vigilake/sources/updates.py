"""SRC01, CT01: raw updates, one JSON text a row, from a table or a stream, to typed rows; what can't be read is set apart.

A stream of files, or of a queue's values, has Spark's own offsets, partitions and checkpoint; ``update_stream`` reads a
folder of text files so. An update holds one of ``KINDS``; texts that are no JSON object, have no number or none of these are
``malformed`` with a reason, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.operators import intake

_USER = "struct<id: bigint, is_bot: boolean, username: string>"
_CHAT = "struct<id: bigint, type: string, title: string>"
_MEMBER = f"struct<chat: {_CHAT}, `from`: {_USER}, date: bigint, old_chat_member: struct<status: string>, new_chat_member: struct<status: string>>"
SCHEMA = (
    f"update_id bigint, message struct<message_id: bigint, chat: {_CHAT}, `from`: {_USER}, date: bigint, text: string, caption: string>, "
    f"callback_query struct<id: string, `from`: {_USER}, data: string, message: struct<message_id: bigint, chat: {_CHAT}, date: bigint>>, "
    f"my_chat_member {_MEMBER}, chat_member {_MEMBER}, "
    f"message_reaction struct<chat: {_CHAT}, user: {_USER}, message_id: bigint, date: bigint, new_reaction: array<string>>, broken string"
)
#: The member of an update that says its kind, and the kind's name; the commands.
KINDS = {"message": "message", "callback_query": "callback", "my_chat_member": "own_member", "chat_member": "member", "message_reaction": "reaction"}
COMMANDS = ["start", "help", "nsfw", "unban", "info", "broadcast"]


def update_stream(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """Lines of a folder's text files as a stream of (value)."""
    stream = spark.readStream.format("text")
    return (stream.option("maxFilesPerTrigger", files_at_once) if files_at_once else stream).load(folder)


def command_of(words: Column, own_name: str) -> Column:
    """CT01: struct<name, args> of a message that begins with one of the commands, alone or addressed to ``own_name``; else null."""
    head = F.regexp_extract(words, r"^/([a-z]+)(@\w+)?(?:\s|$)", 1)
    to = F.regexp_extract(words, r"^/[a-z]+@(\w+)", 1)
    args = F.regexp_extract(words, r"(?s)^/\S+\s+(.*)$", 1)
    mine = head.isin(*COMMANDS) & ((to == "") | (F.lower(to) == own_name.lower()))
    return F.when(mine, F.struct(head.alias("name"), args.alias("args")))


def parsed(lines: DataFrame, own_name: str, column: str = "value") -> DataFrame:
    """Typed rows of updates with their route; ``malformed`` says why a text is none, and ``raw`` holds it."""
    u = F.from_json(F.col(column), SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.select(F.col(column).alias("raw"), u.alias("u"))
    there = [F.when(F.col(f"u.{member}").isNotNull(), name) for member, name in KINDS.items()]
    kind = F.coalesce(*there)
    first = lambda *paths: F.coalesce(*[F.col(f"u.{p}") for p in paths])
    chat = [f"{m}.chat" for m in ("message", "my_chat_member", "chat_member", "message_reaction")] + ["callback_query.message.chat"]
    user = [f"{m}.`from`" for m in ("message", "callback_query", "my_chat_member", "chat_member")] + ["message_reaction.user"]
    date = [f"{m}.date" for m in ("message", "my_chat_member", "chat_member", "message_reaction")] + ["callback_query.message.date"]
    words = intake.message_text(F.col("u.message.text"), F.col("u.message.caption"))
    bad = F.when(F.col("u").isNull() | F.col("u.broken").isNotNull(), "no JSON object").when(F.col("u.update_id").isNull(), "no number").when(kind.isNull(), "unknown kind")
    rows = rows.withColumns({"malformed": bad, "kind": kind, "chat": first(*chat), "sender": first(*user), "words": words, "sent": first(*date)})
    rows = rows.withColumn("command", F.when(F.col("kind") == "message", command_of(F.col("words"), own_name)))
    route = intake.route(F.col("kind"), F.col("chat.type"), F.col("command").isNotNull())
    return rows.select(
        F.col("u.update_id").alias("update_id"), "kind", F.when(F.col("malformed").isNull(), route).alias("route"),
        F.col("command.name").alias("command"), F.col("command.args").alias("args"),
        F.col("chat.id").alias("chat_id"), F.col("chat.type").alias("chat_type"), F.col("sender.id").alias("user_id"), F.col("sender.is_bot").alias("is_bot"),
        "words", F.timestamp_seconds("sent").alias("sent_at"), F.col("u.callback_query.data").alias("data"),
        first("my_chat_member.old_chat_member.status", "chat_member.old_chat_member.status").alias("old_status"),
        first("my_chat_member.new_chat_member.status", "chat_member.new_chat_member.status").alias("new_status"),
        F.col("u.message_reaction.new_reaction").alias("new_reaction"), "malformed", "raw",
    )
