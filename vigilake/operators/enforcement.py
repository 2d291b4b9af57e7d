"""What follows from a verdict: what is done, and the rows of detections, bans, audit, reports and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions import reports, scores, text

MUTE_HOURS = 24

#: Shares that a chat's notices are dealt to, and tasks for each core.
SHARES, TASKS = 64, 8


def execute(action: Column, has_message: Column, is_admin: Column, can_delete: Column, can_restrict: Column, delete_ok: Column, ban_ok: Column, mute_ok: Column) -> Column:
    """SNK04, D11: struct <deleted, banned, muted, problems>; delete first, then ban or mute.

    Reports and warnings do nothing. Without admin rights there is that one problem only. ``*_ok`` are the
    calls' results; a missing right and a failed call give the same problem, and each is named once (SE04).
    """
    acts = ~action.isin("report", "warn")
    live = acts & is_admin
    deleted = live & has_message & can_delete & delete_ok
    banned = live & (action == "ban") & can_restrict & ban_ok
    muted = live & (action == "mute") & can_restrict & mute_ok
    restricted = live & action.isin("ban", "mute")
    problems = F.array(
        F.when(acts & ~is_admin, F.lit("missing_admin")), F.when(live & has_message & ~deleted, F.lit("missing_delete_perm")),
        F.when(restricted & ~banned & ~muted, F.lit("missing_ban_perm")),
    )
    return F.struct(deleted.alias("deleted"), banned.alias("banned"), muted.alias("muted"), F.filter(problems, lambda p: p.isNotNull()).alias("problems"))


def detection_id(*keys: Column) -> Column:
    """SNK01: an id of 128 bits that follows from the row's keys, so that a repeated job gives the same; rows of equal keys are one detection."""
    return F.md5(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])))


def detections(verdicts: DataFrame) -> DataFrame:
    """SNK01, X16: one row for each verdict that matched; ``done`` is the struct of ``execute``."""
    d = verdicts.filter("matched")
    return d.select(
        detection_id(F.col("chat_id"), F.col("user_id"), F.col("message_id"), F.col("ts")).alias("detection_id"),
        "chat_id", "user_id", "message_id", "score", F.col("action").alias("verdict"), "done.banned", "done.deleted", "done.muted", "dry_run", "reasons", "ts",
    )


def ban_rows(verdicts: DataFrame) -> DataFrame:
    """SNK03, X16: what goes into the fold of bans."""
    return verdicts.filter("matched AND done.banned").select("chat_id", "user_id", "score", "reasons", F.col("ts").alias("banned_at"))


def mutes(verdicts: DataFrame) -> DataFrame:
    """muted accounts and until when."""
    return verdicts.filter("matched AND done.muted").select("chat_id", "user_id", (F.col("ts") + F.expr(f"INTERVAL {MUTE_HOURS} HOURS")).alias("until"))


def audit_rows(verdicts: DataFrame) -> DataFrame:
    """SNK02: the audit log's row of each detection, its payload as JSON."""
    payload = F.to_json(
        F.struct(
            "user_id", F.round("score", 6).alias("score"), "action", F.col("done.banned").alias("banned"), F.col("done.deleted").alias("deleted"), "dry_run", "reasons"
        )
    )
    return verdicts.filter("matched").select("chat_id", F.lit("detection").alias("event"), payload.alias("payload"), "ts")


def reason_list(reasons: Column, names: Column) -> Column:
    """Names of the reasons in the group's language; one without a name in brackets, as any missing text."""
    return F.array_join(F.transform(reasons, lambda r: F.coalesce(F.try_element_at(names, F.concat(F.lit("reason_"), r)), F.concat(F.lit("⟦reason_"), r, F.lit("⟧")))), " · ")


def _template(texts: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(texts, key), F.concat(F.lit("⟦"), key, F.lit("⟧")))


def user_label(name: Column) -> Column:
    return text.escape_html(text.truncate(name, 48))


def report_text(texts: Column, dry_run: Column, action: Column, done: Column, score: Column, reasons: Column, name: Column) -> Column:
    """SNK05: headline, score line, reasons, and a line for each problem, from the group's texts (a map of templates)."""
    head = text.fill(_template(texts, reports.headline(dry_run, action, done["banned"], done["muted"], done["deleted"])), user=user_label(name))
    line = text.fill(_template(texts, reports.score_line(reasons)), score=scores.percent(score).cast("string"))
    why = text.fill(_template(texts, F.lit("report_reasons")), reasons=reason_list(reasons, texts))
    failed = F.transform(done["problems"], lambda p: text.fill(_template(texts, F.lit("report_failed")), problem=_template(texts, p)))
    return F.concat(head, F.lit("\n"), line, F.lit("\n"), why, F.array_join(failed, ""))


def admin_notices(verdicts: DataFrame, targets: DataFrame) -> DataFrame:
    """SNK06, P17, F52: a notice for each admin who asked for them, where something was done outside test mode.

    There are as many rows as verdicts times admins of their chat. Each chat's verdicts are dealt to ``SHARES``, which meet the chat's admins one by
    one, so that neither a chat nor a file lands in one task.
    """
    done = verdicts.filter("matched AND NOT dry_run AND (done.deleted OR done.banned OR done.muted)")
    words = reports.score_line(F.col("reasons")) == "report_score_text"
    key = F.concat(F.when(words, "dm_notify_text").otherwise("dm_notify"), F.when(F.col("done.deleted"), "").otherwise("_kept"))
    notices = done.select("chat_id", "user_id", "message_id", key.alias("key"), scores.percent(F.col("score")).alias("percent"))
    notices = notices.withColumn("_share", F.pmod(F.xxhash64("user_id", "message_id", "key", "percent"), F.lit(SHARES)))
    admins = targets.select("chat_id", "admin_id", F.explode(F.expr(f"sequence(0L, {SHARES - 1}L)")).alias("_share"))
    tasks = done.sparkSession.sparkContext.defaultParallelism * TASKS  # a given number, as few bytes that become many rows would be put in few tasks
    met = notices.repartition(tasks, "chat_id", "_share").join(admins.repartition(tasks, "chat_id", "_share"), ["chat_id", "_share"])
    return met.select("chat_id", "admin_id", "user_id", "message_id", "key", "percent")


def offender_notices(verdicts: DataFrame) -> DataFrame:
    """SNK07, F52: to accounts that were banned outside test mode, by what the verdict rests on."""
    r = F.col("reasons")
    key = (
        F.when((F.size(r) == 1) & (r[0] == "message_media"), "banned_notice_media")
        .when(reports.score_line(r) == "report_score_text", "banned_notice_text").otherwise("banned_notice")
    )
    return verdicts.filter("matched AND done.banned AND NOT dry_run").select("chat_id", "user_id", "message_id", key.alias("key"), scores.percent(F.col("score")).alias("percent"))


def notice_language(stored: Column, locked: Column, group: Column, default: str = "en") -> Column:
    """F53 for notices about a group: the account's own language, else the group's."""
    return F.coalesce(F.when(locked, stored), stored, group, F.lit(default))


def self_delete(reports_sent: DataFrame) -> DataFrame:
    """SNK08, ST12: when the engine's own messages go, in groups that want it; after 5 seconds to a day."""
    ttl = F.greatest(F.lit(5), F.least(F.lit(86400), F.col("ttl")))
    return reports_sent.filter("delete_bot_messages").withColumn("delete_at", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ttl))


def details(detections: DataFrame) -> DataFrame:
    """CT05: one row for each reason of each detection, in order."""
    rows = detections.select("detection_id", "chat_id", F.posexplode("reasons").alias("position", "reason"))
    return rows.withColumn("position", F.col("position") + 1)


def false_positives(marks: DataFrame, bans: DataFrame) -> DataFrame:
    """CT04, J12: of marked detections, those whose ban is still open are pardoned; every mark is audited."""
    open_ = bans.filter("unbanned_at IS NULL").select("chat_id", "user_id", F.lit(True).alias("was_banned"))
    rows = marks.join(open_, ["chat_id", "user_id"], "left")
    return rows.withColumns({"is_correct": F.lit(False), "unban": F.coalesce("was_banned", F.lit(False)), "audit": F.lit("false_positive")}).drop("was_banned")


def score_of_private_test(score: Column, threshold: Column) -> Column:
    """ML17: what a private test of one picture answers: its percent against the default threshold."""
    return F.when(score.isNull(), "unavailable").when(scores.percent(score) >= threshold, "over").otherwise("under")
