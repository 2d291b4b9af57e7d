"""Registered queries of intake, settings, enforcement, media and caches; their SQL follows the rules of each, row by row where order counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.operators import enforcement, intake, media, settings, state, text_pass
from vigilake.plans.registry import ORACLES, query
from vigilake.sources import bindings as b

_TYPES = "['group', 'supergroup', 'private', 'channel']"
_KINDS = "CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'reaction' WHEN 'error' THEN 'message' WHEN 'signup' THEN 'member' ELSE 'own_member' END"
_STATES = "['left', 'member', 'administrator', 'kicked', 'restricted']"
_UPDATES = f"""(SELECT id, chat_id, created_at, event_type, {_KINDS} AS kind, {_TYPES}[CAST(id % 4 AS INT) + 1] AS chat_type, CASE WHEN id % 17 <> 0 THEN user_id END AS user_id,
    id % 13 = 0 AS is_bot, id % 19 = 0 AS is_command, CASE WHEN id % 3 = 0 THEN 'text ' || id END AS own, CASE WHEN id % 5 = 0 THEN '  ' END AS caption,
    CAST(id % 4 AS INT) AS n_reactions, {_STATES}[CAST(id % 5 AS INT) + 1] AS old_status, {_STATES}[CAST(id // 5 % 5 AS INT) + 1] AS new_status FROM detections)"""


def _updates(spark, sf):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), F.expr(f"int({k}) + 1"))
    d = b.detections(spark, sf).select("id", "chat_id", "user_id", "created_at", "event_type")
    states = ["left", "member", "administrator", "kicked", "restricted"]
    return d.withColumns({
        "kind": F.expr(_KINDS), "chat_type": pick(["group", "supergroup", "private", "channel"], "id % 4"), "user_id": F.expr("CASE WHEN id % 17 <> 0 THEN user_id END"),
        "is_bot": F.expr("id % 13 = 0"), "is_command": F.expr("id % 19 = 0"), "own": F.expr("CASE WHEN id % 3 = 0 THEN 'text ' || id END"),
        "caption": F.expr("CASE WHEN id % 5 = 0 THEN '  ' END"), "n_reactions": F.expr("int(id % 4)"),
        "old_status": pick(states, "id % 5"), "new_status": pick(states, "id div 5 % 5"),
    })


@query(
    f"""SELECT u.id, CASE kind WHEN 'message' THEN CASE WHEN is_command THEN 'command' WHEN chat_type = 'private' THEN 'private' ELSE 'group' END ELSE kind END AS route,
    chat_type IN ('group', 'supergroup') AND user_id IS NOT NULL AND NOT is_bot AS in_scope, coalesce(own, caption, '') AS words,
    text_on AND trim(coalesce(own, caption, '')) <> '' AS text_pass, (g.grace = 0 OR id % 8 <= g.grace) OR (text_on AND trim(coalesce(own, caption, '')) <> '') AS anything
    FROM {_UPDATES} u JOIN (SELECT chat_id, grace, (chat_id % 2 = 0 AND chat_id % 3 <> 0) OR chat_id % 5 = 0 AS text_on FROM groups) g USING (chat_id)""",
    "detections groups",
)
def event_intake(spark, sf):
    """SRC01, SRC02, P01, P02, P06, P07, J03."""
    g = b.groups(spark, sf).selectExpr("chat_id", "grace", "chat_id % 2 = 0 AS text_scan", "IF(chat_id % 3 <> 0, array('sexual'), array()) AS topics", "chat_id % 5 = 0 AS ad_scan")
    rows = settings.attach(_updates(spark, sf), g, {"grace": 5, "text_scan": False, "ad_scan": False})
    words = intake.message_text(F.col("own"), F.col("caption"))
    wants = intake.wants_text(F.lit(True), intake.scans_text(F.col("text_scan"), F.col("topics"), F.col("ad_scan")), words)
    profile = state.in_grace(F.col("grace"), F.col("id") % 8)
    return rows.select(
        "id", intake.route(F.col("kind"), F.col("chat_type"), F.col("is_command")).alias("route"), (intake.in_scope(F.col("chat_type")) & intake.has_profile(F.col("user_id"), F.col("is_bot"))).alias("in_scope"),
        words.alias("words"), wants.alias("text_pass"), intake.wants_anything(profile, wants).alias("anything"),
    )


@query(
    f"""SELECT id, chat_id, user_id, prior FROM (SELECT *, CAST(coalesce(sum(CAST(kind = 'message' AS INT)) OVER (PARTITION BY chat_id, user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM {_UPDATES})
    JOIN groups USING (chat_id) WHERE kind = 'reaction' AND chat_type IN ('group', 'supergroup') AND user_id IS NOT NULL AND NOT is_bot AND n_reactions > 0 AND chat_id % 4 <> 0 AND (grace = 0 OR prior <= grace)""",
    "detections groups",
)
def reaction_intake(spark, sf):
    """SRC03, J04, W03."""
    u = _updates(spark, sf).withColumn("new_reaction", F.expr("array_repeat('x', n_reactions)"))
    u = state.prior_messages(u, F.col("kind") == "message", order=("created_at", "id"))
    g = b.groups(spark, sf).withColumn("reaction_scan", F.expr("chat_id % 4 <> 0")).select("chat_id", "grace", "reaction_scan")
    return intake.reactions(u, g).select("id", "chat_id", "user_id", "prior")


_IN = lambda c: f"{c} IN ('administrator', 'member', 'restricted')"


@query(
    f"""SELECT id, chat_id, kind, CASE WHEN kind = 'member' THEN 'arrived' WHEN NOT ({_IN('new_status')}) THEN 'left' WHEN {_IN('old_status')} THEN 'changed' ELSE 'welcome' END AS outcome FROM {_UPDATES}
    WHERE (kind = 'own_member' AND chat_type IN ('group', 'supergroup')) OR (kind = 'member' AND NOT ({_IN('old_status')}) AND {_IN('new_status')})""",
    "detections",
)
def membership_changes(spark, sf):
    """SRC04, SRC05."""
    u = _updates(spark, sf)
    own = intake.own_membership(u).select("id", "chat_id", "kind", "outcome")
    others = u.filter((F.col("kind") == "member") & intake.arrived(F.col("old_status"), F.col("new_status")))
    return own.unionByName(others.select("id", "chat_id", "kind", F.lit("arrived").alias("outcome")))


@query(
    """SELECT id, chat_id, culprit, CASE WHEN EXISTS (SELECT 1 FROM prefs p WHERE p.chat_id = m.chat_id AND p.admin_id = culprit) THEN 'leave' WHEN chat_id % 7 = 0 THEN 'powerless' ELSE 'ban' END AS verdict
    FROM (SELECT *, id % 13 = 0 AS is_bot, CASE WHEN id % 13 = 0 THEN user_id WHEN id % 3 = 0 THEN id % 50 END AS culprit FROM detections) m
    WHERE culprit <> 7 AND chat_id % 3 <> 0 AND (is_bot OR NOT EXISTS (SELECT 1 FROM prefs p WHERE p.chat_id = m.chat_id AND p.admin_id = user_id))""",
    "detections prefs",
)
def bot_messages(spark, sf):
    """P13, P14."""
    m = b.detections(spark, sf).withColumns({"is_bot": F.expr("id % 13 = 0"), "via_bot": F.expr("CASE WHEN id % 3 = 0 THEN id % 50 END")})
    g = b.groups(spark, sf).withColumns({"ban_foreign_bots": F.expr("chat_id % 3 <> 0"), "can_restrict": F.expr("chat_id % 7 <> 0")})
    return intake.guarded(m, g, b.prefs(spark, sf), 7).select("id", "chat_id", "culprit", "verdict")


@query(
    "SELECT id, chat_id, bot_id FROM (SELECT id, chat_id, unnest(list_filter([id, id + 1, id + 2], lambda x: x % 3 = 0)) AS bot_id FROM detections WHERE event_type = 'signup')",
    "detections",
)
def bot_arrivals(spark, sf):
    """X18."""
    rows = b.detections(spark, sf).filter("event_type = 'signup'")
    members = F.expr("transform(array(id, id + 1, id + 2), x -> named_struct('id', x, 'is_bot', x % 3 = 0))")
    return intake.arriving_bots(rows.select("id", "chat_id", members.alias("new_members"))).select("id", "chat_id", "bot_id")


@query(
    """SELECT chat_id, coalesce(array_to_string(list_sort(list(admin_id) FILTER (WHERE admin_id % 5 <> 0)), ','), '') AS admins, coalesce(array_to_string(list_sort(list(admin_id) FILTER (WHERE admin_id % 5 = 0 AND admin_id % 35 <> 0)), ','), '') AS bots,
    bool_or(admin_id % 35 = 0) AS bot_is_admin FROM prefs WHERE admin_id % 4 <> 3 GROUP BY chat_id UNION ALL
    SELECT DISTINCT chat_id, '', '', false FROM groups WHERE chat_id NOT IN (SELECT chat_id FROM prefs WHERE admin_id % 4 <> 3)""",
    "prefs groups",
)
def admin_snapshots(spark, sf):
    """SRC15, J06: chats without a snapshot have an empty one."""
    p = b.prefs(spark, sf).filter("admin_id % 4 <> 3").selectExpr("chat_id", "admin_id AS user_id", "'administrator' AS status", "admin_id % 5 = 0 AS is_bot", "admin_id % 35 = 0 AS is_self", "true AS can_restrict", "true AS can_delete")
    rows = intake.with_snapshot(b.groups(spark, sf).select("chat_id"), intake.admin_snapshot(p))
    return rows.select("chat_id", F.array_join(F.col("admins").cast("array<string>"), ",").alias("admins"), F.array_join(F.col("bots").cast("array<string>"), ",").alias("bots"), "bot_is_admin")


# ---- settings, groups, users, appeals ---------------------------------------------------------

_CHANGE = """CASE CAST(id % 10 AS INT) WHEN 0 THEN 'adjust_threshold' WHEN 1 THEN 'set_policy' WHEN 2 THEN 'toggle_dry_run' WHEN 3 THEN 'set_grace' WHEN 4 THEN 'set_lang'
    WHEN 5 THEN 'toggle_category' WHEN 6 THEN 'toggle_auto_delete' WHEN 7 THEN 'set_media_frames' WHEN 8 THEN 'set_media_action' ELSE CASE WHEN id % 70 = 69 THEN 'reset' ELSE 'toggle_notify' END END"""
_LISTED = {4: settings.LANGUAGES, 1: [*b.POLICIES, "nonsense"], 5: ["porn", "Sexy", "drawings"], 8: b.ACTIONS}


def _value(array: str, cast: str) -> str:
    pick = lambda k: f"{array.format(', '.join(repr(x) for x in _LISTED[k]))}[{cast.format(f'(id // 10) % {len(_LISTED[k])}' if array[0] == '[' else f'(id div 10) % {len(_LISTED[k])}')}]"
    return f"CASE id % 10 WHEN 0 THEN CAST(id % 410 // 10 - 20 AS VARCHAR) WHEN 1 THEN {pick(1)} WHEN 3 THEN CAST(id % 300 // 10 - 5 AS VARCHAR) WHEN 4 THEN {pick(4)} WHEN 5 THEN {pick(5)} WHEN 7 THEN CAST(id % 400 // 10 - 5 AS VARCHAR) WHEN 8 THEN {pick(8)} END"


_VALUE_SQL = _value("[{}]", "CAST({} AS INT) + 1")
_VALUE_SPARK = _value("array({})", "int({})").replace(" // ", " div ").replace("VARCHAR", "STRING")


@query(
    f""", e AS (SELECT chat_id, {_CHANGE} AS c, {_VALUE_SQL} AS v, row_number() OVER (PARTITION BY chat_id ORDER BY id) AS n FROM detections),
    r AS (SELECT chat_id, 0::BIGINT AS n, threshold, policy, dry_run, grace, 'en' AS lang, false AS locked, ['porn', 'hentai', 'sexy'] AS cats, false AS auto_delete, 5 AS frames, 'delete' AS media_action, 0::BIGINT AS epoch FROM groups
      UNION ALL SELECT r.chat_id, e.n,
        CASE c WHEN 'adjust_threshold' THEN greatest(0, least(100, r.threshold + CAST(v AS INT))) WHEN 'reset' THEN 40 ELSE r.threshold END,
        CASE WHEN c = 'set_policy' AND v <> 'nonsense' THEN v WHEN c = 'reset' THEN 'nsfw_and_contact' ELSE r.policy END,
        CASE c WHEN 'toggle_dry_run' THEN NOT r.dry_run WHEN 'reset' THEN false ELSE r.dry_run END,
        CASE c WHEN 'set_grace' THEN greatest(0, CAST(v AS INT)) WHEN 'reset' THEN 5 ELSE r.grace END,
        CASE c WHEN 'set_lang' THEN v ELSE r.lang END, r.locked OR c = 'set_lang',
        CASE c WHEN 'toggle_category' THEN CASE WHEN len(list_filter(cats, lambda x: lower(x) = lower(v))) > 0 THEN list_filter(cats, lambda x: lower(x) <> lower(v)) ELSE list_append(cats, v) END WHEN 'reset' THEN ['porn', 'hentai', 'sexy'] ELSE cats END,
        CASE c WHEN 'toggle_auto_delete' THEN NOT r.auto_delete WHEN 'reset' THEN false ELSE r.auto_delete END,
        CASE c WHEN 'set_media_frames' THEN greatest(1, least(12, CAST(v AS INT))) WHEN 'reset' THEN 5 ELSE r.frames END,
        CASE c WHEN 'set_media_action' THEN v WHEN 'reset' THEN 'delete' ELSE r.media_action END,
        r.epoch + CAST(c NOT IN ('set_lang', 'toggle_auto_delete', 'toggle_notify') AS INT)
      FROM r JOIN e ON e.chat_id = r.chat_id AND e.n = r.n + 1)
    SELECT chat_id, threshold, policy, dry_run, grace, lang, locked AS lang_locked, array_to_string(cats, ',') AS categories, auto_delete AS delete_bot_messages, frames AS media_frames, media_action, epoch
    FROM r QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY n DESC) = 1""",
    "detections groups",
)
def settings_changes(spark, sf):
    """CT03, DML13, DML14, DML15, P16, X19: every event as a change of its group's settings."""
    changes = b.detections(spark, sf).selectExpr("chat_id", "id AS seq", f"{_CHANGE} AS change", f"{_VALUE_SPARK} AS value")
    out = settings.fold_changes(b.groups(spark, sf).select("chat_id", "threshold", "policy", "dry_run", "grace"), changes)
    return out.select("chat_id", "threshold", "policy", "dry_run", "grace", "lang", "lang_locked", F.array_join("nsfw_categories", ",").alias("categories"), "delete_bot_messages", "media_frames", "media_action", "epoch")


@query(
    """SELECT chat_id, coalesce(seen, title) AS title, CASE WHEN any_seen THEN true ELSE is_active END AS is_active, threshold, policy, CASE WHEN known THEN 'ru' ELSE l END AS lang FROM (
    SELECT coalesce(g.chat_id, s.chat_id) AS chat_id, title, seen, l, g.chat_id IS NOT NULL AS known, coalesce(any_seen, false) AS any_seen, is_active, coalesce(threshold, 40) AS threshold, coalesce(policy, 'nsfw_and_contact') AS policy
    FROM (SELECT * FROM groups WHERE chat_id < 20) g FULL JOIN (SELECT chat_id, true AS any_seen, arg_max(t, id) FILTER (WHERE t IS NOT NULL) AS seen, arg_min(CASE WHEN t LIKE 'چت%' THEN 'fa' ELSE 'en' END, id) AS l
      FROM (SELECT chat_id, id, CASE WHEN chat_id = 24 OR id % 3 = 0 AND chat_id % 2 = 0 THEN CASE WHEN chat_id % 4 = 0 THEN 'چت' ELSE 't' END || id END AS t FROM detections WHERE chat_id % 4 <> 1) GROUP BY chat_id) s ON g.chat_id = s.chat_id)""",
    "detections groups",
)
def group_sightings(spark, sf):
    """DML01: chats from 20 on are new; their language is that of the title they were first seen with."""
    old = b.groups(spark, sf).filter("chat_id < 20").select("chat_id", "title", "is_active", "threshold", "policy", F.lit("ru").alias("lang"))
    title = "CASE WHEN chat_id = 24 OR id % 3 = 0 AND chat_id % 2 = 0 THEN concat(IF(chat_id % 4 = 0, 'چت', 't'), id) END AS title"
    seen = b.detections(spark, sf).filter("chat_id % 4 <> 1").selectExpr("chat_id", "id AS seq", title)
    return settings.fold_sightings(old, seen)


@query(
    """SELECT chat_id, coalesce((SELECT arg_max(d.event_type <> 'error', d.id) FROM detections d WHERE d.chat_id = g.chat_id AND d.event_type IN ('error', 'signup')), is_active) AS is_active,
    CASE WHEN threshold = 40 THEN 45 ELSE threshold END AS threshold FROM groups g""",
    "detections groups",
)
def group_updates(spark, sf):
    """DML12, DML16, X17: an error ends a group's activity, a signup begins it; an old default is replaced."""
    changes = b.detections(spark, sf).filter("event_type IN ('error', 'signup')").selectExpr("chat_id", "id AS seq", "event_type <> 'error' AS is_active")
    out = state.overlay(b.groups(spark, sf).select("chat_id", "is_active", "threshold"), changes, ["chat_id"], "is_active")
    return settings.migrate_default(out, "threshold", F.lit(40), F.lit(45))


_USER_EVENT = "CASE event_type WHEN 'view' THEN 'touch' WHEN 'signup' THEN 'start' WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'lang' ELSE 'touch' END"


@query(
    f""", e AS (SELECT user_id, id AS seq, {_USER_EVENT} AS c, 'n' || id % 9 AS name, ['en', 'fa', 'ru', 'ar'][CAST(id % 4 AS INT) + 1] AS l, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM detections),
    r AS (SELECT user_id, n, c <> 'blocked' AS there, name AS username, l AS lang, c = 'lang' AS locked, c = 'start' AS started, false AS blocked, seq AS first_seq, seq AS last_seq FROM e WHERE n = 1
      UNION ALL SELECT r.user_id, e.n, there OR c <> 'blocked', CASE WHEN c IN ('touch', 'start') OR (c = 'lang' AND NOT there) THEN name ELSE username END,
        CASE WHEN c = 'lang' OR (c = 'start' AND NOT locked) OR (c = 'touch' AND NOT there) THEN l ELSE lang END, (there AND locked) OR c = 'lang', (there AND started) OR c = 'start',
        CASE c WHEN 'start' THEN false WHEN 'blocked' THEN there ELSE there AND blocked END, CASE WHEN there THEN first_seq ELSE e.seq END, CASE WHEN c IN ('touch', 'start') OR NOT there THEN e.seq ELSE last_seq END
      FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, username, lang, locked AS lang_locked, started AS started_bot, blocked AS is_blocked, first_seq, last_seq FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1) WHERE there""",
    "detections",
)
def user_folds(spark, sf):
    """DML02, DML03, DML12, DML18."""
    lang = F.element_at(F.array(*map(F.lit, settings.LANGUAGES)), F.expr("int(id % 4) + 1"))
    return state.fold_users(b.detections(spark, sf).select("user_id", F.col("id").alias("seq"), F.expr(_USER_EVENT).alias("event"), F.expr("'n' || id % 9").alias("username"), lang.alias("lang")))


@query(
    """, e AS (SELECT chat_id, user_id, id AS seq, CASE event_type WHEN 'signup' THEN CASE WHEN id % 2 = 0 THEN 'approve' ELSE 'reject' END ELSE 'open' END AS c, row_number() OVER (PARTITION BY chat_id, user_id ORDER BY id) AS n FROM detections WHERE event_type IN ('error', 'click', 'signup')),
    r AS (SELECT chat_id, user_id, n, c = 'open' AS is_open, CAST(c = 'open' AS BIGINT) AS number, CASE WHEN c = 'open' THEN seq END AS opened, CAST(c = 'open' AS BIGINT) AS requests, false AS done, CAST(NULL AS BIGINT) AS resolved, CAST(NULL AS VARCHAR) AS status FROM e WHERE n = 1
      UNION ALL SELECT r.chat_id, r.user_id, e.n, c = 'open', number + CAST(c = 'open' AND NOT is_open AS BIGINT), CASE WHEN c = 'open' AND NOT is_open THEN e.seq ELSE opened END,
        CASE WHEN c = 'open' THEN CASE WHEN is_open THEN requests + 1 ELSE 1 END ELSE requests END, c <> 'open' AND is_open, CASE WHEN c <> 'open' THEN e.seq END, CASE c WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' END
      FROM r JOIN e ON e.chat_id = r.chat_id AND e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT chat_id, user_id, number, opened, resolved, status, requests FROM r WHERE done
    UNION ALL SELECT chat_id, user_id, number, opened, NULL, 'open', requests FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY chat_id, user_id ORDER BY n DESC) = 1) WHERE is_open""",
    "detections",
)
def appeals(spark, sf):
    """DML08, DML09, CT06: one open appeal at most; a signup resolves the open one only, after which another may be opened."""
    event = F.expr("CASE event_type WHEN 'signup' THEN IF(id % 2 = 0, 'approve', 'reject') ELSE 'open' END")
    return state.fold_appeals(b.detections(spark, sf).filter("event_type IN ('error', 'click', 'signup')").select("chat_id", "user_id", F.col("id").alias("seq"), event.alias("event")))


# ---- enforcement ------------------------------------------------------------------------------

_REASONS = "CASE CAST(id % 4 AS INT) WHEN 0 THEN ['message_media'] WHEN 1 THEN ['text_topic', 'text_ad'] WHEN 2 THEN ['bio_link', 'profile_nsfw'] ELSE ['text_ad'] END"
_DONE = f"""(SELECT *, live AND message_id IS NOT NULL AND d.id % 5 <> 0 AND d.id % 11 <> 0 AS del, live AND act = 'ban' AND d.id % 3 <> 0 AND d.id % 13 <> 0 AS ban, live AND act = 'mute' AND d.id % 3 <> 0 AS mut
    FROM (SELECT x.*, act NOT IN ('report', 'warn') AND chat_id % 6 <> 0 AS live FROM (SELECT d.id, chat_id, user_id, created_at, score, dry_run, title, CASE WHEN dry_run THEN 'report' ELSE action END AS act, CASE WHEN d.id % 4 <> 0 THEN d.id END AS message_id, {_REASONS.replace('id %', 'd.id %')} AS reasons
      FROM detections d JOIN groups USING (chat_id) WHERE score >= 0.2) x) d)"""
_PROBLEMS = """list_filter([CASE WHEN act NOT IN ('report', 'warn') AND chat_id % 6 = 0 THEN 'missing_admin' END, CASE WHEN live AND message_id IS NOT NULL AND NOT del THEN 'missing_delete_perm' END,
    CASE WHEN live AND act IN ('ban', 'mute') AND NOT ban AND NOT mut THEN 'missing_ban_perm' END], lambda p: p IS NOT NULL)"""


def _verdicts(spark, sf):
    d = b.detections(spark, sf).join(b.groups(spark, sf).select("chat_id", "action", "dry_run", "title"), "chat_id")
    d = d.withColumns({
        "matched": F.expr("score >= 0.2"), "action": F.expr("IF(dry_run, 'report', action)"), "message_id": F.expr("IF(id % 4 <> 0, id, NULL)"), "ts": F.col("created_at"),
        "reasons": F.expr(_REASONS.replace("[", "array(").replace("]", ")")),
    })
    e = lambda s: F.expr(s)
    done = enforcement.execute(F.col("action"), F.col("message_id").isNotNull(), e("chat_id % 6 <> 0"), e("id % 5 <> 0"), e("id % 3 <> 0"), e("id % 11 <> 0"), e("id % 13 <> 0"), F.lit(True))
    return d.withColumn("done", done)


@query(f"SELECT id, act AS verdict, del AS deleted, ban AS banned, mut AS muted, array_to_string({_PROBLEMS}, ',') AS problems FROM {_DONE}", "detections groups")
def enforcement_results(spark, sf):
    """SNK04, SNK01, X16, SE04, D11."""
    v = _verdicts(spark, sf).filter("matched")
    return v.select("id", F.col("action").alias("verdict"), "done.deleted", "done.banned", "done.muted", F.array_join("done.problems", ",").alias("problems"))


@query(
    f"""SELECT chat_id, user_id, message_id, act AS verdict, del AS deleted, ban AS banned, mut AS muted, dry_run, array_to_string(reasons, ',') AS reasons, true AS positive,
    CAST('{{"user_id":' || user_id || ',"action":"' || act || '","banned":' || ban || ',"deleted":' || del || ',"dry_run":' || dry_run || ',"reasons":["' || array_to_string(reasons, '","') || '"]}}' AS VARCHAR) AS payload FROM {_DONE}""",
    "detections groups",
)
def detection_rows(spark, sf):
    """SNK01, SNK02: detections with ids that don't repeat, and the audit row of each."""
    v = _verdicts(spark, sf)
    rows = enforcement.detections(v).withColumn("positive", F.count(F.lit(1)).over(_by_id()) == 1)
    audit = enforcement.audit_rows(v.withColumn("key", F.col("id")))
    payload = F.regexp_replace("payload", r'"score":[^,]*,', "")
    both = rows.join(audit.select("chat_id", "ts", payload.alias("payload"), F.get_json_object("payload", "$.user_id").cast("long").alias("user_id")), ["chat_id", "user_id", "ts"])
    return both.select("chat_id", "user_id", "message_id", "verdict", "deleted", "banned", "muted", "dry_run", F.array_join("reasons", ",").alias("reasons"), "positive", "payload")


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("detection_id")


_TEXTS = {
    "report_dry_run": "Test: {user}", "report_warned": "Warned {user}", "report_banned": "{user} banned, message gone", "report_banned_kept": "{user} banned", "report_muted": "{user} muted, message gone",
    "report_muted_kept": "{user} muted", "report_deleted_only": "Message of {user} gone", "report_no_action": "Could not act on {user}", "report_score": "Image {score}%", "report_score_text": "Text {score}%",
    "report_reasons": "Why: {reasons}", "report_failed": "\n! {problem}", "missing_admin": "no admin", "missing_delete_perm": "cannot delete", "reason_message_media": "media", "reason_text_topic": "topic", "reason_bio_link": "link",
    "reason_profile_nsfw": "avatar",
}
_TEXT = lambda key: f"coalesce(texts[{key}], '⟦' || {key} || '⟧')"
_TEXTS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _TEXTS.items()) + "}"
_HEAD = "CASE WHEN dry_run THEN 'report_dry_run' WHEN act = 'warn' THEN 'report_warned' WHEN ban AND del THEN 'report_banned' WHEN ban THEN 'report_banned_kept' WHEN mut AND del THEN 'report_muted' WHEN mut THEN 'report_muted_kept' WHEN del THEN 'report_deleted_only' ELSE 'report_no_action' END"
_WORDS = "len(list_filter(reasons, lambda r: r NOT IN ('text_topic', 'text_ad'))) = 0"


@query(
    f"""SELECT id, replace({_TEXT('head')}, '{{user}}', 'user &lt;' || user_id || '&gt;') || chr(10) || replace({_TEXT("CASE WHEN words THEN 'report_score_text' ELSE 'report_score' END")}, '{{score}}', CAST(CAST(round(least(score, 1) * 100) AS INT) AS VARCHAR)) || chr(10) ||
    replace({_TEXT("'report_reasons'")}, '{{reasons}}', array_to_string(list_transform(reasons, lambda r: coalesce(texts['reason_' || r], '⟦reason_' || r || '⟧')), ' · ')) ||
    array_to_string(list_transform(problems, lambda p: replace(texts['report_failed'], '{{problem}}', coalesce(texts[p], '⟦' || p || '⟧'))), '') AS report
    FROM (SELECT *, {_HEAD} AS head, {_WORDS} AS words, {_PROBLEMS} AS problems, {_TEXTS_SQL} AS texts FROM {_DONE})""",
    "detections groups",
)
def report_texts(spark, sf):
    """SNK05, F50, F51, X20, F18: the composed report."""
    v = _verdicts(spark, sf).filter("matched")
    texts = F.create_map(*[F.lit(x) for pair in _TEXTS.items() for x in pair])
    name = F.concat(F.lit("user <"), "user_id", F.lit(">"))
    return v.select("id", enforcement.report_text(texts, F.col("dry_run"), F.col("action"), F.col("done"), F.col("score"), F.col("reasons"), name).alias("report"))


@query(
    f"""SELECT chat_id, admin_id, user_id, message_id, CASE WHEN words AND del THEN 'dm_notify_text' WHEN words THEN 'dm_notify_text_kept' WHEN del THEN 'dm_notify' ELSE 'dm_notify_kept' END AS key, CAST(round(least(score, 1) * 100) AS INT) AS percent
    FROM (SELECT *, {_WORDS} AS words FROM {_DONE}) JOIN (SELECT chat_id, admin_id FROM prefs JOIN users ON admin_id = users.user_id WHERE dm_notify AND started_bot AND NOT is_blocked) t USING (chat_id) WHERE NOT dry_run AND (del OR ban OR mut)""",
    "detections groups prefs users",
)
def admin_notices(spark, sf):
    """SNK06, P17, F52, J02."""
    from vigilake.operators import stats

    return enforcement.admin_notices(_verdicts(spark, sf), stats.notify_targets(b.prefs(spark, sf), b.users(spark, sf)))


@query(
    f"SELECT chat_id, user_id, message_id, CASE WHEN reasons = ['message_media'] THEN 'banned_notice_media' WHEN {_WORDS} THEN 'banned_notice_text' ELSE 'banned_notice' END AS key, CAST(round(least(score, 1) * 100) AS INT) AS percent FROM {_DONE} WHERE ban AND NOT dry_run",
    "detections groups",
)
def offender_notices(spark, sf):
    """SNK07, F52."""
    return enforcement.offender_notices(_verdicts(spark, sf))


@query(f"SELECT id, chat_id, unnest(reasons) AS reason, unnest(range(1, len(reasons) + 1))::INT AS position FROM {_DONE}", "detections groups")
def detection_details(spark, sf):
    """CT05."""
    v = _verdicts(spark, sf).filter("matched").withColumn("detection_id", F.col("id"))
    return enforcement.details(v).select(F.col("detection_id").alias("id"), "chat_id", "reason", "position")


@query(f"SELECT chat_id, user_id, created_at + INTERVAL 24 HOUR AS until FROM {_DONE} WHERE mut", "detections groups")
def mute_rows(spark, sf):
    """F40, SNK04."""
    return enforcement.mutes(_verdicts(spark, sf))


@query("SELECT d.id, d.chat_id, d.user_id, unbanned_at IS NULL AND b.id IS NOT NULL AS unban FROM detections d LEFT JOIN bans b ON d.chat_id = b.chat_id AND d.user_id = b.user_id WHERE d.id % 10 = 0", "detections bans")
def false_positive_marks(spark, sf):
    """CT04, J12, CT02."""
    marks = b.detections(spark, sf).filter("id % 10 = 0").select("id", "chat_id", "user_id")
    return enforcement.false_positives(marks, state.fold_bans(*b.bans(spark, sf))).select("id", "chat_id", "user_id", "unban")


# ---- media, text pass, caches -----------------------------------------------------------------

_MESSAGES = """(SELECT id, CASE WHEN id % 6 = 0 THEN [{id: 'p' || id, w: id % 7, h: id % 5}, {id: 'q' || id, w: id % 4, h: id % 9}] ELSE [] END AS photo, CASE WHEN id % 5 = 0 THEN 'a' || id END AS anim, CASE WHEN id % 4 = 1 THEN 'v' || id END AS vid, CASE WHEN id % 7 = 2 THEN 's' || id END AS stick,
    CASE WHEN id % 3 = 1 THEN 'd' || id END AS doc, ['image/gif', 'image/png', 'video/mp4', 'text/plain', 'image/gifx'][CAST(id % 5 AS INT) + 1] AS mime, id % 4 <> 3 AS small, CASE WHEN id % 8 <> 5 THEN 't' || id END AS thumb, id % 2 = 0 AS animated, id % 3 = 0 AS static FROM detections)"""
_KIND = """CASE WHEN len(photo) > 0 THEN 'photo' WHEN anim IS NOT NULL THEN 'animation' WHEN vid IS NOT NULL THEN 'video' WHEN stick IS NOT NULL THEN 'sticker' WHEN doc IS NULL THEN NULL
    WHEN mime IN ('image/gif', 'video/mp4') THEN 'animation' WHEN mime LIKE 'image/%' THEN 'photo' END"""
_LARGEST = "CASE WHEN photo[1].w * photo[1].h > photo[2].w * photo[2].h THEN photo[1].id WHEN photo[1].w * photo[1].h < photo[2].w * photo[2].h THEN photo[2].id ELSE greatest(photo[1].id, photo[2].id) END"


@query(
    f"""SELECT id, kind, clip, still, coalesce(clip, still) AS key, profile_still FROM (SELECT *, CASE WHEN len(photo) > 0 THEN NULL WHEN kind IS NULL OR NOT small THEN NULL WHEN anim IS NOT NULL THEN anim WHEN vid IS NOT NULL THEN vid WHEN stick IS NOT NULL THEN CASE WHEN NOT animated THEN stick END ELSE doc END AS clip,
    CASE WHEN kind IS NULL THEN NULL WHEN len(photo) > 0 THEN {_LARGEST} WHEN anim IS NOT NULL OR vid IS NOT NULL THEN thumb WHEN stick IS NOT NULL THEN CASE WHEN static THEN stick ELSE thumb END ELSE thumb END AS still,
    CASE WHEN len(photo) > 0 THEN {_LARGEST} WHEN stick IS NOT NULL OR anim IS NOT NULL OR vid IS NOT NULL THEN thumb END AS profile_still FROM (SELECT *, {_KIND} AS kind FROM {_MESSAGES})) WHERE coalesce(clip, still) IS NOT NULL""",
    "detections",
)
def media_attachments(spark, sf):
    """P09, P10, X11, SO07."""
    size = f"IF(id % 4 <> 3, 100, {media.MAX_CLIP + 1})"
    thumb = "IF(id % 8 <> 5, 't' || id, NULL)"
    part = lambda cond, letter, more="": f"IF({cond}, named_struct('id', '{letter}' || id, 'size', {size}, 'thumb', {thumb}{more}), NULL)"
    mime = "element_at(array('image/gif', 'image/png', 'video/mp4', 'text/plain', 'image/gifx'), int(id % 5) + 1)"
    m = F.expr(
        f"""named_struct('photo', IF(id % 6 = 0, array(named_struct('id', 'p' || id, 'w', id % 7, 'h', id % 5), named_struct('id', 'q' || id, 'w', id % 4, 'h', id % 9)), array()),
        'animation', {part('id % 5 = 0', 'a')}, 'video', {part('id % 4 = 1', 'v')}, 'sticker', {part('id % 7 = 2', 's', ", 'animated', id % 2 = 0, 'static', id % 3 = 0")}, 'document', {part('id % 3 = 1', 'd', f", 'mime', {mime}")})"""
    )
    rows = b.detections(spark, sf).select("id", m.alias("m")).select("id", media.attachment(F.col("m")).alias("a"), media.profile_still(F.col("m")).alias("profile_still"))
    return rows.filter("a IS NOT NULL").select("id", "a.kind", "a.clip", "a.still", "a.key", "profile_still")


_GROUP_SCORE = "coalesce(list_sum(list_transform(list_filter([1, 2, 3, 4, 5], lambda i: names[i] IN ('hentai', 'porn', 'sexy')), lambda i: p[i])), 0)"


@query(
    f"""SELECT media_id, CASE WHEN n > 1 THEN image_id % 10 + 1 END::INT AS frame, CASE WHEN n > 1 THEN n END::INT AS "of",
    CAST(round(least(1, fast) * 100) AS INT) || '% → ' || CAST(round(least(1, g) * 100) AS INT) || '% · ' || top || ' ' || CAST(round(least(1, ptop) * 100) AS INT) || '%' || CASE WHEN n > 1 THEN ' · frame ' || (image_id % 10 + 1) || '/' || n ELSE '' END AS detail
    FROM (SELECT media_id, image_id, max(fast) OVER w AS fast, count(*) OVER w AS n, g, names[list_position(p, list_max(p))] AS top, list_max(p) AS ptop FROM (SELECT *, {_GROUP_SCORE} AS g FROM image_labels WHERE image_id % 4 <> 0) WINDOW w AS (PARTITION BY media_id)
      QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY g DESC, image_id) = 1)""",
    "image_labels",
)
def frame_scores(spark, sf):
    """ML08, P18, ML04, X10, F12, SO04: every fourth frame failed."""
    from vigilake.functions import scores

    images = media.labelled(b.image_scores(spark, sf), b.LABELS).withColumns({"error": F.expr("IF(image_id % 4 = 0, 'bad image', NULL)"), "position": F.expr("image_id % 10 + 1")})
    worst = media.worst_frame(images, scores.category_score(F.col("labels"), F.array(*map(F.lit, ["hentai", "porn", "sexy"]))))
    detail = media.scoring_detail(F.col("fast"), F.col("score"), F.lit(True), scores.sorted_labels(F.col("labels")), F.col("frame"), F.col("of"))
    return worst.select("media_id", "frame", "of", detail.alias("detail"))


@query(
    """SELECT conv_id, turn, asked, CASE WHEN asked = 0 THEN 'nothing' WHEN length(trim(text)) < 8 THEN 'short' WHEN asked >= 3 AND gate < 0.3 THEN 'ordinary' ELSE 'full' END AS route,
    CASE WHEN ts AND scam >= 0.7 AND scam >= hate THEN CASE WHEN scam = hate THEN 'hate' ELSE 'scam' END WHEN ts AND hate >= 0.7 THEN 'hate' END AS topic, CASE WHEN ad AND adv >= 0.75 THEN adv END AS ad_score
    FROM (SELECT *, (CASE WHEN ts THEN conv_id % 4 ELSE 0 END + CAST(ad AS INT))::INT AS asked FROM (SELECT conv_id, turn, coalesce(text, '') AS text, conv_id % 3 <> 0 AS ts, conv_id % 2 = 0 AS ad, CASE WHEN turn % 5 <> 4 THEN (conv_id * 7 + turn) % 10 / 10 END AS gate,
      (conv_id + turn) % 11 / 10 AS scam, (conv_id * 3 + turn) % 11 / 10 AS hate, (conv_id * 5 + turn) % 11 / 10 AS adv FROM conversations))"""
)
def text_pass_routes(spark, sf):
    """ML11, ML12, SG11, SG12, SO05, P06, D1: the gate asks from three questions on, an unknown answer opens the pass."""
    e, c = F.expr, F.col
    rows = b.read(spark, sf, "conversations").withColumns({"topics": e("slice(array('scam', 'hate', 'sexual'), 1, int(conv_id % 4))"), "ts": e("conv_id % 3 <> 0"), "ad": e("conv_id % 2 = 0"), "gate": e("IF(turn % 5 <> 4, (conv_id * 7 + turn) % 10 / 10, NULL)")})
    answers = e("array(named_struct('id', 'is_advertising', 'certainty', (conv_id * 5 + turn) % 11 / 10), named_struct('id', 'scam', 'certainty', (conv_id + turn) % 11 / 10), named_struct('id', 'hate', 'certainty', (conv_id * 3 + turn) % 11 / 10))")
    asked = text_pass.questions(c("ts"), c("topics"), c("ad"))
    return rows.select(
        "conv_id", "turn", asked.alias("asked"), text_pass.route(F.coalesce("text", F.lit("")), asked, c("gate")).alias("route"),
        text_pass.strongest_topic(answers, c("ts"), F.lit(0.7))["id"].alias("topic"), text_pass.advertising(answers, c("ad"), F.lit(0.75)).alias("ad_score"),
    )


@query(
    """SELECT d.id, CASE WHEN hit THEN round(fast, 6) END AS fast, coalesce(hit, false) AS hit FROM detections d LEFT JOIN (SELECT id AS cid, score / 2 AS fast, user_id % 7 AS fp, true AS hit FROM detections QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id) = 1) c
    ON c.cid = (SELECT min(id) FROM detections x WHERE x.user_id = d.user_id) AND c.fp = d.id % 7 AND c.cid % 3 <> 0""",
    "detections",
)
def cache_lookup(spark, sf):
    """J05, ST07: by user, photos and pipeline."""
    d = b.detections(spark, sf)
    cache = d.groupBy("user_id").agg(F.min_by(F.struct("id", "score"), "id").alias("c")).selectExpr("user_id", "CAST(user_id % 7 AS STRING) AS fingerprint", "IF(c.id % 3 <> 0, 'v3', 'v2') AS pipeline", "c.score / 2 AS fast", "'x' AS labels")
    rows = state.with_cache(d.select("id", "user_id"), cache, (F.col("id") % 7).cast("string"), "v3")
    return rows.select("id", F.round("fast", 6).alias("fast"), F.col("labels").isNotNull().alias("hit"))


@query(
    """, e AS (SELECT user_id, epoch_us(created_at) AS t, CASE WHEN id % 5 <> 0 THEN floor(score * 100) / 100 END AS fast, id % 3 = 0 AS verified, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM detections),
    r AS (SELECT user_id, n, t, false AS hit, fast AS score, CASE WHEN fast IS NOT NULL THEN t END AS kt, fast AS kf, verified AS kv FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, t, hit, CASE WHEN hit THEN kf ELSE fast END, CASE WHEN NOT hit AND fast IS NOT NULL THEN t ELSE kt END, CASE WHEN NOT hit AND fast IS NOT NULL THEN fast ELSE kf END, CASE WHEN NOT hit AND fast IS NOT NULL THEN verified ELSE kv END
      FROM (SELECT e.*, kt, kf, kv, coalesce(e.t - kt < 259200000000 AND (kv OR kf < 0.3), false) AS hit FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, t AS ts_us, CASE WHEN hit THEN 'cache' ELSE 'scored' END AS source, round(score, 6) AS score FROM r""",
    "detections",
)
def media_cache_fold(spark, sf):
    """ST03, ST04, ST06: three days to live, so that it bites on these events."""
    d = b.detections(spark, sf).select("user_id", state.micros("created_at").alias("ts_us"), F.lit(0.3).alias("bar"), F.expr("IF(id % 5 <> 0, floor(score * 100) / 100, NULL)").alias("fast"), F.expr("id % 3 = 0").alias("verified"))
    return state.cached_answers(d, ["user_id"], 259200).withColumn("score", F.round("score", 6))


@query(
    """, e AS (SELECT chat_id, epoch_us(created_at) AS t, event_type <> 'error' AS clean, event_type = 'signup' AND id % 4 = 0 AS voids, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, event_type = 'signup' AND id % 4 = 0 DESC, event_type <> 'error') AS n FROM detections),
    r AS (SELECT chat_id, n, t, clean, NOT voids AS scanned, CASE WHEN clean AND NOT voids THEN t + 43200000000 END AS until FROM e WHERE n = 1
      UNION ALL SELECT chat_id, n, t, clean, scanned, CASE WHEN voids THEN NULL WHEN scanned AND clean THEN t + 43200000000 ELSE until END
      FROM (SELECT e.*, r.until, NOT e.voids AND (r.until IS NULL OR e.t >= r.until) AS scanned FROM r JOIN e ON e.chat_id = r.chat_id AND e.n = r.n + 1))
    SELECT chat_id, t AS ts_us, clean FROM r WHERE scanned""",
    "detections",
)
def clean_fold_voided(spark, sf):
    """ST02, P04, P16: half a day to live; a change that affects detection drops what is remembered."""
    d = b.detections(spark, sf).select("chat_id", state.micros("created_at").alias("ts_us"), F.expr("event_type <> 'error'").alias("clean"), F.expr("event_type = 'signup' AND id % 4 = 0").alias("voids"))
    return state.every_clean_interval(d, ["chat_id"], 43200)


@query(
    """SELECT user_id AS admin_id, t AS ts_us, pb AS body FROM (SELECT *, lag(c) OVER w AS pc, lag(t) OVER w AS pt, lag(body) OVER w AS pb FROM (SELECT user_id, epoch_us(created_at) AS t, CASE event_type WHEN 'view' THEN 'compose' WHEN 'error' THEN 'cancel' ELSE 'confirm' END AS c, 'b' || id AS body FROM detections) WINDOW w AS (PARTITION BY user_id ORDER BY t, c, body))
    WHERE c = 'confirm' AND pc = 'compose' AND t - pt < 172800000000""",
    "detections",
)
def broadcast_confirmed(spark, sf):
    """ST08, DML17: two days to confirm, so that some are taken here; taken once."""
    command = F.expr("CASE event_type WHEN 'view' THEN 'compose' WHEN 'error' THEN 'cancel' ELSE 'confirm' END")
    d = b.detections(spark, sf).select(F.col("user_id").alias("admin_id"), state.micros("created_at").alias("ts_us"), command.alias("command"), F.expr("'b' || id").alias("body"))
    return state.take_once(d, 172800)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND strlen(text) <= 3000 THEN strlen(text) END AS n_bytes, nullif(trim(regexp_replace(text[1:40], '[\\s\\x0b]+', ' ', 'g')), '') AS words FROM documents"""
)
def decoded_images(spark, sf):
    """SRC07, F20, P19: strict base64 (two in three rows are not), at most 3,000 bytes."""
    raw = F.base64(F.col("text").cast("binary"))
    bad = F.when(F.col("doc_id") % 3 == 0, F.replace(raw, F.lit("\r\n"), F.lit(""))).when(F.col("doc_id") % 3 == 1, F.concat(raw, F.lit("="))).otherwise(F.concat(F.lit(" "), raw))
    return b.read(spark, sf, "documents").select("doc_id", F.octet_length(media.decoded(bad, 3000)).cast("long").alias("n_bytes"), media.read_words(F.lit(None).cast("string"), F.substring("text", 1, 40)).alias("words"))


@query(
    """SELECT s_suppkey, (length(trim(bio)) >= 3) OR state = 'linked' AS substantive,
    '{"telegram_profile":{"display_name":"' || s_name || '","username":null,"bio":"' || bio || '","attached_channel":' || CASE state WHEN 'linked' THEN '{"title":"news","username":null}' WHEN 'absent' THEN 'null' ELSE '"not looked up"' END || ',"text_on_avatar":null}}' AS state
    FROM (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN ' x ' ELSE 'bio ' || s_suppkey END AS bio, ['linked', 'absent', 'unknown'][CAST(s_suppkey % 3 AS INT) + 1] AS state FROM supplier)"""
)
def profile_states(spark, sf):
    """F21, F22, ML14."""
    s = b.read(spark, sf, "supplier").withColumns({"bio": F.expr("IF(s_suppkey % 2 = 0, ' x ', 'bio ' || s_suppkey)"), "channel": F.expr("element_at(array('linked', 'absent', 'unknown'), int(s_suppkey % 3) + 1)")})
    none = F.lit(None).cast("string")
    return s.select("s_suppkey", text_pass.substantive(F.col("bio"), none, F.col("channel")).alias("substantive"), text_pass.profile_state(F.col("s_name"), none, F.col("bio"), F.col("channel"), F.lit("news"), none, none).alias("state"))


# ---- the whole judgement, with what every signal must say worked out by hand --------------------

_BIOS = ["Photographer in town", "join t.me/abc", "see www.example.com", "nude pics", "", None]
_DISPLAY = ["Maryam", "join now 👉", "watch me", "porn hub"]
_FIRES = {  # sorted: the order of reasons
    "bio_keywords": "id % 6 = 3 OR id % 4 = 3", "bio_link": "id % 6 IN (1, 2)", "bio_semantic": "id % 9 <> 0 AND id % 10 >= 7", "message_media": "id % 3 = 0 AND id % 11 * 10 >= threshold",
    "name_pattern": "id % 4 IN (1, 2)", "no_photo_link": "id % 5 = 0 AND id % 6 IN (1, 2)", "profile_channel": "id % 3 = 0", "profile_nsfw": "id % 7 <> 0 AND id % 11 * 10 >= threshold",
    "profile_ocr": "id % 8 = 0", "reputation": "chat_id % 2 = 0 AND id % 6 >= 3",
}
_ANY = lambda *ids: "(" + " OR ".join(f"list_contains(t, '{i}')" for i in ids) + ")"
_LIST = lambda *cases: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cases) + "], lambda x: x IS NOT NULL)"
_IMAGE, _CONTACT, _VOCABULARY = _ANY("profile_nsfw", "message_media"), _ANY("bio_link", "profile_ocr", "profile_channel"), _ANY("bio_keywords", "name_pattern", "bio_semantic")


@query(
    f"""SELECT id, array_to_string(t, ',') AS triggered, m OR x OR p AS matched, CASE WHEN m THEN CASE WHEN dry_run THEN 'report' ELSE 'delete' END WHEN x THEN CASE WHEN dry_run THEN 'report' WHEN id % 10 = 0 THEN 'delete' ELSE 'warn' END WHEN p AND NOT dry_run THEN action ELSE 'report' END AS action,
    CASE WHEN m THEN id % 11 / 10 WHEN x THEN CASE WHEN id % 14 = 0 THEN 0.9 ELSE 0.8 END WHEN p THEN greatest(CASE WHEN id % 7 <> 0 THEN id % 11 ELSE 0 END, CASE WHEN id % 3 = 0 THEN id % 11 ELSE 0 END) / 10 ELSE 0 END::DOUBLE AS score,
    CASE WHEN m THEN 'message_media' WHEN x THEN array_to_string({_LIST(('text_topic', 'id % 10 = 0'), ('text_ad', 'id % 14 = 0'))}, ',') WHEN p THEN array_to_string(list_filter(t, lambda r: r = 'reputation' OR list_contains(CASE policy
      WHEN 'nsfw_only' THEN ['profile_nsfw', 'message_media'] WHEN 'nsfw_and_contact' THEN ['profile_nsfw', 'message_media', 'bio_link', 'profile_ocr', 'profile_channel']
      WHEN 'nsfw_or_keywords' THEN ['profile_nsfw', 'message_media', 'bio_keywords', 'name_pattern', 'bio_semantic'] WHEN 'custom' THEN ['bio_link', 'name_pattern']
      ELSE ['profile_nsfw', 'message_media', 'bio_link', 'profile_ocr', 'profile_channel', 'bio_keywords', 'name_pattern', 'bio_semantic'] END, r)), ',') ELSE '' END AS reasons,
    CASE WHEN id % 6 = 1 THEN 't.me/abc' WHEN id % 6 = 2 THEN 'www.example.com' END AS bio_detail, id % 6 <> 5 AS bio_available
    FROM (SELECT *, id % 3 = 0 AND id % 11 >= 9 AS m, id % 10 = 0 OR id % 14 = 0 AS x, list_contains(t, 'reputation') OR CASE policy WHEN 'nsfw_only' THEN {_IMAGE} WHEN 'nsfw_and_contact' THEN {_IMAGE} AND {_CONTACT} WHEN 'nsfw_or_keywords' THEN {_IMAGE} OR {_VOCABULARY}
      WHEN 'strict' THEN {_IMAGE}::INT + {_CONTACT}::INT + {_VOCABULARY}::INT >= 2 ELSE list_contains(t, 'bio_link') AND list_contains(t, 'name_pattern') END AS p
      FROM (SELECT *, {_LIST(*_FIRES.items())} AS t FROM (SELECT c_custkey AS id, c_custkey % 30 AS chat_id, coalesce(threshold, 40) AS threshold, coalesce(policy, 'nsfw_and_contact') AS policy, coalesce(action, 'ban') AS action, coalesce(dry_run, false) AS dry_run
        FROM customer LEFT JOIN groups ON groups.chat_id = c_custkey % 30)))""",
    "groups",
)
def profile_verdicts(spark, sf):
    """SG01-SG12, J03, AG12, PL01-PL13: every signal from its column, settings or their defaults, media before text before profile."""
    from vigilake.operators import policy, signals

    pick = lambda values, n: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.expr(f"int(id % {n}) + 1"))
    e, c = F.expr, F.col
    rows = b.read(spark, sf, "customer").selectExpr("c_custkey AS id", "c_custkey % 30 AS chat_id")
    rows = settings.attach(rows, b.groups(spark, sf).select("chat_id", "threshold", "policy", "action", "dry_run"), {"threshold": 40, "policy": "nsfw_and_contact", "action": "ban", "dry_run": False})
    rows = rows.withColumns({
        "bio": pick(_BIOS, 6), "display_name": pick(_DISPLAY, 4), "username": F.lit(None).cast("string"), "channel_state": pick(["linked", "absent", "unknown"], 3), "channel_title": F.lit("news"), "channel_username": F.lit(None).cast("string"),
        "photos": pick(["absent", "unknown", "visible", "visible", "visible"], 5), "profile_nsfw": e("IF(id % 7 <> 0, id % 11 / 10.0D, NULL)"), "message_nsfw": e("IF(id % 3 = 0, id % 11 / 10.0D, NULL)"),
        "avatar_text": e("CASE id % 8 WHEN 0 THEN '@spam_me' WHEN 1 THEN 'hello' END"), "profile_ad": e("IF(id % 9 <> 0, id % 10 / 10.0D, NULL)"), "other_group_bans": e("id % 6"),
        "global_blocklist": e("chat_id % 2 = 0"), "reputation_min_bans": F.lit(3),
    })
    s = signals.with_signals(rows).withColumn("triggered", signals.triggered_ids())
    media_ = policy.media_verdict(c("message_nsfw"), F.lit(0.9), F.lit("delete"), c("dry_run"))
    words = policy.text_verdict(e("IF(id % 10 = 0, 'scam', NULL)"), F.lit(0.8), e("IF(id % 14 = 0, 0.9D, NULL)"), F.lit("delete"), F.lit("warn"), c("dry_run"))
    score = policy.headline_score(c("profile_nsfw"), c("message_nsfw"))
    own = policy.verdict(c("triggered"), score, c("policy"), c("action"), F.array(F.lit("bio_link"), F.lit("name_pattern")), c("dry_run"))
    s = s.withColumn("v", policy.first_match(media_, words, own))
    return s.select(
        "id", F.array_join("triggered", ",").alias("triggered"), "v.matched", "v.action", F.round("v.score", 6).alias("score"), F.array_join("v.reasons", ",").alias("reasons"),
        c("signals.bio_link.detail").alias("bio_detail"), c("signals.bio_link.available").alias("bio_available"),
    )


for _name in ("settings_changes", "user_folds", "appeals", "media_cache_fold", "clean_fold_voided"):  # their SQL goes on with more views
    ORACLES[_name] = ORACLES[_name].replace("\n,", ",").replace("WITH ", "WITH RECURSIVE ", 1)


# ---- callbacks and lookups --------------------------------------------------------------------

_SAID = ["p:thd:-10", "p:pos: Strict ", "p:pos:nope", "p:cut:bio_link", "p:not", "p:not:1", "p:mkt:gif", "d:fp:17", "a:ok:5:6", "a:ok:5", "b:go", "x", "", "p:grs:ten", "u:las:fa", "p:thd:1:2", "p:cat:"]
_HEARD = [("adjust_threshold", "-10"), ("set_policy", "strict"), None, ("toggle_custom", "bio_link"), ("toggle_notify", None), None, ("toggle_media_kind", "animation"), ("false_positive", "17"), ("appeal_approve", "5:6"), None, ("broadcast_confirm", None), None, None, None, ("set_user_lang", "fa"), None, ("toggle_category", "")]
_HEARD_SQL = "CASE CAST(id % 17 AS INT) " + " ".join(f"WHEN {k} THEN '{h[0]}={h[1] or ''}'" for k, h in enumerate(_HEARD) if h) + " END"


@query(f"SELECT id, {_HEARD_SQL} AS heard FROM detections", "detections")
def callback_decode(spark, sf):
    """every event says one of the strings."""
    from vigilake.functions import callbacks

    said = F.element_at(F.array(*map(F.lit, _SAID)), F.expr("int(id % 17) + 1"))
    rows = b.detections(spark, sf).select("id", callbacks.decode(said).alias("d"))
    return rows.select("id", F.when(F.col("d").isNotNull(), F.concat("d.change", F.lit("="), F.coalesce("d.value", F.lit("")))).alias("heard"))


@query(
    """SELECT id, CASE WHEN c.c_custkey IS NULL THEN 'unknown' WHEN c.c_custkey % 3 = 0 THEN 'linked' ELSE 'absent' END AS channel_state, CASE WHEN c.c_custkey % 2 = 0 THEN c.c_name END AS bio, CASE WHEN c.c_custkey % 3 = 0 THEN 'ch' || c.c_custkey END AS channel_title
    FROM detections LEFT JOIN customer c ON c.c_custkey = user_id AND c.c_custkey % 5 <> 0""",
    "detections",
)
def profile_lookup(spark, sf):
    """SRC06, SRC14: every fifth account can't be looked up."""
    from vigilake.sources import lookups

    p = b.read(spark, sf, "customer").filter("c_custkey % 5 <> 0").selectExpr("c_custkey AS user_id", "IF(c_custkey % 2 = 0, c_name, NULL) AS bio", "'ch' || c_custkey AS channel_title", "CAST(NULL AS STRING) AS channel_username", "c_custkey % 3 = 0 AS has_channel")
    return lookups.with_profile(b.detections(spark, sf).select("id", "user_id"), p).select("id", "channel_state", "bio", "channel_title")


@query(
    """SELECT id, CASE CAST(id % 4 AS INT) WHEN 0 THEN 'hello' WHEN 1 THEN 'salam' WHEN 2 THEN 'bye' ELSE '⟦none⟧' END AS text FROM detections""",
    "detections",
)
def translations(spark, sf):
    """SRC10, F18: own language, English instead, key instead."""
    from vigilake.sources import lookups

    texts = lookups.catalog(spark, {"en": 'hi = "hello"\nbye = "bye"', "fa": 'hi = "salam"'})
    lang, key = F.expr("IF(id % 2 = 0, IF(id % 4 = 0, 'en', 'fa'), 'fa')"), F.expr("element_at(array('hi', 'hi', 'bye', 'none'), int(id % 4) + 1)")
    return lookups.translated(b.detections(spark, sf).select("id"), texts, lang, key).select("id", "text")
