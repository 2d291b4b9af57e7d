"""Group settings: lenient parsing of raw rows, defaults, and folds of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions import text

# Defaults and closed lists of the settings.
DEFAULT_CATEGORIES = ["porn", "hentai", "sexy"]
MEDIA_KINDS = ["photo", "animation", "sticker", "video"]
KIND_ALIASES = {"gif": "animation"}
TOPICS = ["sexual", "violence", "hate", "insult", "drugs", "gambling", "scam", "politics", "religion"]
POLICIES = ["nsfw_only", "nsfw_and_contact", "nsfw_or_keywords", "strict", "custom"]
ACTIONS = ["ban", "mute", "delete", "warn", "report"]


def clamp(c: Column, low: int, high: int) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def enum(c: Column, values: list[str], default: str) -> Column:
    """trimmed, lower case, unknown or missing: the default."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(*values), v).otherwise(default)


def string_list(c: Column, unreadable: list[str]) -> Column:
    """A JSON list of strings only; anything else is unreadable as a whole."""
    items = F.from_json(c, "array<string>")
    shape = F.schema_of_variant(F.try_parse_json(c))
    fine = shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items, lambda x: x.isNull())
    return F.when(F.coalesce(fine, F.lit(False)), items).otherwise(F.array(*map(F.lit, unreadable)).cast("array<string>"))


def known_only(items: Column, values: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Unknown elements are dropped one by one; known ones in lower case."""
    def named(x: Column) -> Column:
        x = F.lower(F.trim(x))
        for old, new in (aliases or {}).items():
            x = F.when(x == old, F.lit(new)).otherwise(x)
        return x

    return F.filter(F.transform(items, named), lambda x: x.isin(*values))


def parse(raw: DataFrame) -> DataFrame:
    """Every column clamped, or its default."""
    return raw.select(
        "chat_id",
        enum(F.col("policy"), POLICIES, "nsfw_and_contact").alias("policy"),
        enum(F.col("action"), ACTIONS, "ban").alias("action"),
        enum(F.col("media_action"), ACTIONS, "delete").alias("media_action"),
        enum(F.col("ad_action"), ACTIONS, "warn").alias("ad_action"),
        clamp(F.col("threshold"), 0, 100).alias("threshold"),
        clamp(F.col("media_frames"), 1, 12).alias("media_frames"),
        clamp(F.col("ttl"), 5, 86400).alias("ttl"),
        F.greatest(F.lit(0), F.col("grace")).alias("grace"),
        string_list(F.col("custom_filters"), []).alias("custom_filters"),
        string_list(F.col("categories"), DEFAULT_CATEGORIES).alias("categories"),
        known_only(string_list(F.col("media_kinds"), []), MEDIA_KINDS, KIND_ALIASES).alias("media_kinds"),
        known_only(string_list(F.col("topics"), []), TOPICS).alias("topics"),
        *[clamp(F.col(c), 0, 100).alias(c) for c in ("media_threshold", "text_threshold", "ad_threshold")],
        enum(F.col("text_action"), ACTIONS, "delete").alias("text_action"),
        text.language_of_code(F.col("lang")).alias("lang"),
        *[F.coalesce(c, F.lit(DEFAULTS[c])).alias(c) for c in ("dry_run", "lang_locked", "delete_bot_messages", "global_blocklist", "media_scan", "text_scan", "ad_scan", "reaction_scan", "ban_foreign_bots")],
    )


def attach(events: DataFrame, groups: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Settings of each event's group, or the defaults; groups are small and joined as Spark sees fit."""
    joined = events.join(groups, "chat_id", "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


# What each change of the settings panel does.
LANGUAGES = ["en", "fa", "ru", "ar"]
ADJUSTED = {"adjust_threshold": "threshold", "adjust_media_threshold": "media_threshold", "adjust_text_threshold": "text_threshold", "adjust_ad_threshold": "ad_threshold"}
SET = {"set_policy": "policy", "set_action": "action", "set_media_action": "media_action", "set_text_action": "text_action", "set_ad_action": "ad_action"}
FLAGS = {
    "toggle_dry_run": "dry_run", "toggle_global": "global_blocklist", "toggle_auto_delete": "delete_bot_messages", "toggle_bot_guard": "ban_foreign_bots",
    "toggle_media_scan": "media_scan", "toggle_text_scan": "text_scan", "toggle_ad_scan": "ad_scan", "toggle_reaction_scan": "reaction_scan",
}
LISTS = {"toggle_category": "nsfw_categories", "toggle_custom": "custom_filters", "toggle_media_kind": "media_kinds", "toggle_text_topic": "text_topics"}
COSMETIC = ["set_lang", "toggle_auto_delete", "toggle_bot_guard", "toggle_notify"]
#: A group nobody has configured.
DEFAULTS = {
    "lang": "en", "lang_locked": False, "threshold": 40, "policy": "nsfw_and_contact", "action": "ban", "custom_filters": [], "nsfw_categories": DEFAULT_CATEGORIES,
    "dry_run": False, "grace": 5, "delete_bot_messages": False, "ttl": 60, "global_blocklist": True, "media_scan": False, "media_threshold": 90,
    "media_action": "delete", "media_kinds": MEDIA_KINDS, "media_frames": 5, "ban_foreign_bots": False, "text_scan": False, "text_topics": ["sexual"],
    "text_threshold": 70, "text_action": "delete", "ad_scan": False, "ad_threshold": 75, "ad_action": "warn", "reaction_scan": False,
}
_TYPES = {bool: "boolean", int: "int", str: "string", list: "array<string>"}
SCHEMA = ", ".join(f"{k} {_TYPES[type(v)]}" for k, v in DEFAULTS.items())


def affects_detection(change: Column) -> Column:
    """Whether a change alters who would be flagged; such a change voids the clean and text caches of its group."""
    return change.isin(*ADJUSTED, *SET, *FLAGS, *LISTS, "set_grace", "set_media_frames", "reset") & ~change.isin(*COSMETIC)


def change(state: dict, name: str, value: str | None) -> None:
    """CT03, DML13-DML15: one change, in place. Unknown names and values that can't be read change nothing."""
    number = int(value) if value is not None and value.lstrip("-").isdigit() else None
    if name in ADJUSTED and number is not None:
        state[ADJUSTED[name]] = max(0, min(100, state[ADJUSTED[name]] + number))
    elif name in SET and value in (POLICIES if name == "set_policy" else ACTIONS):
        state[SET[name]] = value
    elif name == "set_grace" and number is not None:
        state["grace"] = max(0, number)
    elif name == "set_media_frames" and number is not None:
        state["media_frames"] = max(1, min(12, number))
    elif name == "set_lang" and value in LANGUAGES:
        state["lang"], state["lang_locked"] = value, True
    elif name in FLAGS:
        state[FLAGS[name]] = not state[FLAGS[name]]
    elif name in LISTS and value is not None:
        same = str.lower if name == "toggle_category" else str
        items = list(state[LISTS[name]])
        at = next((k for k, x in enumerate(items) if same(x) == same(value)), None)
        items.append(value) if at is None else items.pop(at)
        state[LISTS[name]] = items
    elif name == "reset":
        state.update({k: v for k, v in DEFAULTS.items() if k not in ("lang", "lang_locked")})


def fold_changes(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """CT03: settings of each group after its (chat_id, seq, change, value), in the order of ``seq``; ``epoch`` counts those that affect detection.

    ``groups`` gives any of the settings' columns; what it lacks, and nulls, are the defaults. Changes of unknown
    groups start from the defaults. A group's changes pass one by one, so a busy group needs no more memory.
    """
    import json

    from vigilake.operators.state import fold_in_order

    given = [k for k in DEFAULTS if k in groups.columns]
    old = groups.select("chat_id", F.lit(-1).cast("long").alias("seq"), F.lit("state").alias("change"), F.to_json(F.struct(*given)).alias("value"), F.lit(0).alias("counts"))
    new = changes.select("chat_id", F.col("seq").cast("long").alias("seq"), "change", "value", affects_detection(F.col("change")).cast("int").alias("counts"))

    def make():
        state, epoch = dict(DEFAULTS), 0

        def step(seq, name, value, counts):
            nonlocal epoch
            if name == "state" and seq < 0:
                state.update({k: v for k, v in json.loads(value).items() if v is not None})
            else:
                change(state, name, value)
                epoch += counts or 0

        return step, lambda: (json.dumps(state), epoch)

    out = fold_in_order(old.unionByName(new), ["chat_id"], [F.col("seq")], "chat_id long, state string, epoch long", make)
    return out.select("chat_id", F.from_json("state", SCHEMA).alias("s"), "epoch").select("chat_id", "s.*", "epoch")


def fold_sightings(groups: DataFrame, sightings: DataFrame) -> DataFrame:
    """DML01: groups that were seen: new ones with the defaults, known ones active again, with the last title that wasn't null.

    A new group's language is the one detected when it was first seen (column ``detected`` of the sightings, else the script of that title).
    """
    first = F.col("detected") if "detected" in sightings.columns else text.detect_language(F.col("title"))
    seen = sightings.withColumn("_lang", first).groupBy("chat_id").agg(
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("seen_title"), F.min_by("_lang", "seq").alias("seen_lang"), F.lit(True).alias("seen")
    )
    both = groups.withColumn("_known", F.lit(True)).join(seen, "chat_id", "full_outer")
    fill = {k: F.coalesce(F.col(k), F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>")) for k, v in DEFAULTS.items() if k in groups.columns}
    if "lang" in groups.columns:
        fill["lang"] = F.when(F.col("_known"), fill["lang"]).otherwise(F.coalesce("seen_lang", F.lit(DEFAULTS["lang"])))
    changed = {"title": F.coalesce("seen_title", "title"), "is_active": F.coalesce("seen", "is_active")}
    return both.withColumns(fill | changed).select(*groups.columns)


def migrate_default(groups: DataFrame, column: str, old: Column, new: Column) -> DataFrame:
    """DML16: rows that still hold the old default get the new one."""
    return groups.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))
