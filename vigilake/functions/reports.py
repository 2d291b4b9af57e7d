"""Text keys of reports: headline, score line, notices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TEXT_REASONS = ["text_topic", "text_ad"]


def headline(dry_run: Column, action: Column, banned: Column, muted: Column, deleted: Column) -> Column:
    """test mode and warnings first, then what was done."""
    return (
        F.when(dry_run, "report_dry_run").when(action == "warn", "report_warned")
        .when(banned & deleted, "report_banned").when(banned, "report_banned_kept")
        .when(muted & deleted, "report_muted").when(muted, "report_muted_kept")
        .when(deleted, "report_deleted_only").otherwise("report_no_action")
    )


def score_line(reasons: Column) -> Column:
    """a message judged by its words alone gets another label for its number."""
    text_only = (F.size(reasons) > 0) & F.forall(reasons, lambda r: r.isin(*TEXT_REASONS))
    return F.when(text_only, "report_score_text").otherwise("report_score")


def language(locked: Column, stored: Column, client_code_language: Column, default: str = "en") -> Column:
    """a locked choice, else the client's, else the stored one."""
    return F.coalesce(F.when(locked, stored), client_code_language, stored, F.lit(default))
