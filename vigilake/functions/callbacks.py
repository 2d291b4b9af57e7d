"""the terse callback strings of panel buttons as change rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilake.operators.settings import ACTIONS, KIND_ALIASES, LANGUAGES, MEDIA_KINDS, POLICIES, TOPICS

# The code of each change, and what its value must be (none: no value).
CODES = {
    "adjust_threshold": ("p:thd", "number"), "set_policy": ("p:pos", "policy"), "toggle_custom": ("p:cut", "text"), "toggle_category": ("p:cat", "text"),
    "set_action": ("p:acs", "action"), "set_lang": ("p:las", "lang"), "toggle_notify": ("p:not", ""), "toggle_dry_run": ("p:drt", ""), "toggle_global": ("p:glt", ""),
    "toggle_auto_delete": ("p:adt", ""), "toggle_bot_guard": ("p:bgt", ""), "set_grace": ("p:grs", "number"), "toggle_media_scan": ("p:met", ""),
    "adjust_media_threshold": ("p:mtd", "number"), "set_media_action": ("p:mas", "action"), "toggle_media_kind": ("p:mkt", "kind"), "set_media_frames": ("p:mfs", "number"),
    "toggle_text_scan": ("p:txt", ""), "toggle_text_topic": ("p:tkt", "topic"), "adjust_text_threshold": ("p:ttd", "number"), "set_text_action": ("p:tas", "action"),
    "toggle_ad_scan": ("p:agt", ""), "adjust_ad_threshold": ("p:ahd", "number"), "set_ad_action": ("p:ais", "action"), "toggle_reaction_scan": ("p:rxt", ""),
    "reset": ("p:rst", ""), "close": ("p:x", ""), "false_positive": ("d:fp", "number"), "details": ("d:dt", "number"), "appeal": ("a:new", "number"),
    "appeal_approve": ("a:ok", "numbers"), "appeal_reject": ("a:no", "numbers"), "set_user_lang": ("u:las", "lang"), "broadcast_confirm": ("b:go", ""), "broadcast_cancel": ("b:no", ""),
}
NAMES = {"policy": POLICIES, "action": ACTIONS, "lang": LANGUAGES, "topic": TOPICS, "kind": MEDIA_KINDS + list(KIND_ALIASES)}


def decode(data: Column) -> Column:
    """Struct <change, value> of a callback; null for what isn't one, has a value too many or one that can't be read."""
    code = F.concat_ws(":", F.slice(F.split(data, ":"), 1, 2))
    value = F.when(F.instr(F.substring(data, F.length(code) + 1, F.length(data)), ":") == 1, F.substring(data, F.length(code) + 2, F.length(data)))
    known = F.create_map(*[F.lit(x) for name, (c, _) in CODES.items() for x in (c, name)])
    kinds = F.create_map(*[F.lit(x) for c, kind in CODES.values() for x in (c, kind)])
    kind, clean = F.try_element_at(kinds, code), F.lower(F.trim(value))
    fits = F.when(kind == "", value.isNull()).when(kind == "number", value.rlike(r"^[+-]?\d{1,18}$")).when(kind == "numbers", value.rlike(r"^[+-]?\d{1,18}:[+-]?\d{1,18}$"))
    fits = fits.when(kind == "text", value.isNotNull() & ~F.contains(value, F.lit(":")))
    for k, names in NAMES.items():
        fits = fits.when(kind == k, clean.isin(*names))
    named = F.when(kind.isin(*NAMES), clean).otherwise(value)
    for old, new in KIND_ALIASES.items():
        named = F.when((kind == "kind") & (named == old), F.lit(new)).otherwise(named)
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(F.try_element_at(known, code).alias("change"), named.alias("value")))


def encode(change: Column, value: Column) -> Column:
    """The callback of a change."""
    codes = F.create_map(*[F.lit(x) for name, (c, _) in CODES.items() for x in (name, c)])
    code = F.try_element_at(codes, change)
    return F.when(value.isNull(), code).otherwise(F.concat(code, F.lit(":"), value))


def unban_target(reply_user: Column, args: Column) -> Column:
    """CT02: the author of the message replied to, else a number with or without #."""
    number = F.regexp_extract(F.trim(args), r"^#*([+-]?\d{1,18})$", 1)
    return F.coalesce(reply_user, F.when(number != "", number.cast("long")))
