"""Event intake: routes of updates, scope and senders, which passes a message wants, membership, bot guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions import text

GROUP_TYPES = ["group", "supergroup"]
PRESENT = ["creator", "administrator", "member", "restricted"]


def route(kind: Column, chat_type: Column, is_command: Column) -> Column:
    """SRC01: handler of an update; of messages, commands come first, then private chats, then all others."""
    message = F.when(is_command, "command").when(chat_type == "private", "private").otherwise("group")
    return F.when(kind == "message", message).when(kind.isin("callback", "own_member", "member", "reaction"), kind)


def in_scope(chat_type: Column) -> Column:
    """P01."""
    return F.coalesce(chat_type.isin(*GROUP_TYPES), F.lit(False))


def has_profile(user_id: Column, is_bot: Column) -> Column:
    """Neither an anonymous sender nor a bot."""
    return user_id.isNotNull() & ~F.coalesce(is_bot, F.lit(False))


def message_text(own: Column, caption: Column) -> Column:
    """SRC02: a message's words, or those beside its medium."""
    return F.coalesce(own, caption, F.lit(""))


def scans_text(text_scan: Column, topics: Column, ad_scan: Column) -> Column:
    """Whether settings ask anything of a text."""
    return (text_scan & (F.size(topics) > 0)) | ad_scan


def wants_text(enabled: Column, scans: Column, words: Column) -> Column:
    """Model there, settings ask, and the words aren't blank."""
    return F.coalesce(enabled & scans & (text.trim_space(words) != ""), F.lit(False))


def wants_anything(*passes: Column) -> Column:
    """At least one pass; an unknown one counts as none."""
    out = F.lit(False)
    for p in passes:
        out = out | F.coalesce(p, F.lit(False))
    return out


def reactions(updates: DataFrame, groups: DataFrame) -> DataFrame:
    """SRC03, J04, W03: additions by people, in known groups that scan reactions; ``prior`` messages within grace."""
    mine = updates.filter((F.col("kind") == "reaction") & in_scope(F.col("chat_type")) & has_profile(F.col("user_id"), F.col("is_bot")))
    mine = mine.filter(F.size("new_reaction") > 0)
    known = mine.join(groups.filter("reaction_scan"), "chat_id")
    return known.filter(~((F.col("grace") > 0) & (F.col("prior") > F.col("grace"))))


def own_membership(updates: DataFrame) -> DataFrame:
    """SRC04: changes of the engine's own membership: left, welcome (a first arrival) or changed; each voids the admin snapshot (ST06)."""
    mine = updates.filter((F.col("kind") == "own_member") & in_scope(F.col("chat_type")))
    now, before = F.col("new_status").isin(*PRESENT), F.col("old_status").isin(*PRESENT)
    outcome = F.when(~now, "left").when(before, "changed").otherwise("welcome")
    return mine.withColumns({"outcome": outcome, "is_active": now, "audit": F.when(outcome == "left", "bot_removed").when(outcome == "welcome", "bot_added")})


def arrived(old_status: Column, new_status: Column) -> Column:
    """SRC05: absent before, present now."""
    return ~F.coalesce(old_status.isin(*PRESENT), F.lit(False)) & F.coalesce(new_status.isin(*PRESENT), F.lit(False))


def arriving_bots(messages: DataFrame, members: str = "new_members") -> DataFrame:
    """One row for each bot that a service message names, with its id."""
    out = messages.withColumn("member", F.explode(F.expr(f"filter({members}, x -> x.is_bot)")))
    return out.withColumn("bot_id", F.col("member.id")).drop("member", members)


def culprit(author: Column, author_is_bot: Column, via_bot: Column) -> Column:
    """The bot that wrote a message, or that it was sent through."""
    return F.when(F.coalesce(author_is_bot, F.lit(False)), author).otherwise(via_bot)


def guarded(messages: DataFrame, groups: DataFrame, admins: DataFrame, own_id: int) -> DataFrame:
    """Verdict on each message by or through a bot, in known groups with the guard on.

    Left out: the engine's own, and what an admin sent through a bot. ``admins`` are (chat_id, admin_id).
    """
    rows = messages.withColumn("culprit", culprit(F.col("user_id"), F.col("is_bot"), F.col("via_bot"))).filter(F.col("culprit") != own_id)
    rows = rows.join(groups.filter("ban_foreign_bots").select("chat_id", "can_restrict"), "chat_id")
    flag = lambda name, key: admins.select("chat_id", F.col("admin_id").alias(key), F.lit(True).alias(name))
    rows = rows.join(flag("sender_admin", "user_id"), ["chat_id", "user_id"], "left").join(flag("culprit_admin", "culprit"), ["chat_id", "culprit"], "left")
    rows = rows.filter(F.coalesce(F.col("is_bot"), F.lit(False)) | F.col("sender_admin").isNull())
    verdict = F.when(F.col("culprit_admin"), "leave").when(~F.col("can_restrict"), "powerless").otherwise("ban")
    return rows.withColumn("verdict", verdict).drop("sender_admin", "culprit_admin")


def admin_snapshot(members: DataFrame) -> DataFrame:
    """SRC15 from (chat_id, user_id, status, is_bot, is_self, can_restrict, can_delete): people and bots among the admins, and own rights."""
    admin = F.col("status").isin("creator", "administrator")
    sorted_ids = lambda cond: F.array_sort(F.collect_set(F.when(admin & cond, F.col("user_id"))))
    own = F.col("is_self") & admin
    return members.groupBy("chat_id").agg(
        sorted_ids(~F.col("is_bot")).alias("admins"), sorted_ids(F.col("is_bot") & ~F.col("is_self")).alias("bots"),
        F.bool_or(own).alias("bot_is_admin"), F.bool_or(own & F.col("can_restrict")).alias("bot_can_restrict"), F.bool_or(own & F.col("can_delete")).alias("bot_can_delete"),
    )


def with_snapshot(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """SRC15: events with their chat's snapshot; one that couldn't be had is empty, without rights."""
    none = F.array().cast("array<bigint>")
    fill = {"admins": none, "bots": none, "bot_is_admin": F.lit(False), "bot_can_restrict": F.lit(False), "bot_can_delete": F.lit(False)}
    return events.join(snapshots, "chat_id", "left").withColumns({k: F.coalesce(F.col(k), v) for k, v in fill.items()})
