"""Media: what a message holds, which passes want it, and what images score for a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions import scores

MAX_CLIP = 20 * 1024 * 1024


def kind_of(photo: Column, animation: Column, video: Column, sticker: Column, mime: Column) -> Column:
    """Kind of a message's medium, by the first of its parts that is there; a document by its type: moving pictures are animations."""
    gif = F.lower(F.split(F.trim(F.split(mime, ";")[0]), "/")[1]) == "gif"
    by_type = F.when(F.startswith(mime, F.lit("video/")) | (F.startswith(mime, F.lit("image/")) & gif), "animation").when(F.startswith(mime, F.lit("image/")), "photo")
    return (
        F.when(photo.isNotNull(), "photo").when(animation.isNotNull(), "animation").when(video.isNotNull(), "video").when(sticker.isNotNull(), "sticker")
        .otherwise(by_type)
    )


def attachment(m: Column, most: int = MAX_CLIP) -> Column:
    """Struct <kind, clip, still, key> of a message's medium; null without one.

    ``m`` is a struct of photo (array of id, w, h), animation, video, document (id, size, thumb; document also mime) and
    sticker (id, size, thumb, animated, static). A clip over the cap is judged by its still; an animated sticker has no
    frames; a static one is its own still. The key is what will be scanned.
    """
    clip = lambda part: F.when(part["size"] <= most, part["id"])
    sticker = m["sticker"]
    kind = kind_of(F.when(F.size(m["photo"]) > 0, m["photo"]), m["animation"], m["video"], sticker, m["document"]["mime"])
    at = lambda *cases: F.coalesce(*cases)
    from_document = m["animation"].isNull() & m["video"].isNull() & sticker.isNull()
    clip_id = F.when(kind.isNull() | (F.size(m["photo"]) > 0), F.lit(None).cast("string")).otherwise(
        F.when(m["animation"].isNotNull(), clip(m["animation"])).when(m["video"].isNotNull(), clip(m["video"]))
        .when(sticker.isNotNull(), F.when(~sticker["animated"], clip(sticker))).when(from_document, clip(m["document"]))
    )
    still = (
        F.when(kind.isNull(), F.lit(None).cast("string")).when(F.size(m["photo"]) > 0, largest(m["photo"]))
        .when(m["animation"].isNotNull(), m["animation"]["thumb"]).when(m["video"].isNotNull(), m["video"]["thumb"])
        .when(sticker.isNotNull(), F.when(sticker["static"], sticker["id"]).otherwise(sticker["thumb"])).otherwise(m["document"]["thumb"])
    )
    out = F.struct(kind.alias("kind"), clip_id.alias("clip"), still.alias("still"), at(clip_id, still).alias("key"))
    return F.when(at(clip_id, still).isNotNull(), out)


def profile_still(m: Column) -> Column:
    """The one picture of a message for the profile pass: photo, else the thumbnail of a sticker, animation or video."""
    return (
        F.when(F.size(m["photo"]) > 0, largest(m["photo"])).when(m["sticker"].isNotNull(), m["sticker"]["thumb"])
        .when(m["animation"].isNotNull(), m["animation"]["thumb"]).when(m["video"].isNotNull(), m["video"]["thumb"])
    )


def scoring_detail(fast: Column, score: Column, verified: Column, labels: Column, frame: Column, of: Column) -> Column:
    """percent, or screening to verified percent with the first label, and the frame of a clip; in no language."""
    pct = lambda c: F.concat(scores.percent(c).cast("string"), F.lit("%"))
    first = F.try_element_at(labels, F.lit(1))
    top = F.when(first.isNotNull(), F.concat(F.lit(" · "), first["label"], F.lit(" "), pct(first["value"]))).otherwise("")
    text = F.when(verified, F.concat(pct(fast), F.lit(" → "), pct(score), top)).otherwise(pct(score))
    return F.concat(text, F.when(frame.isNotNull(), F.concat(F.lit(" · frame "), frame.cast("string"), F.lit("/"), of.cast("string"))).otherwise(""))


def without_errors(results: DataFrame) -> DataFrame:
    """P18, ML04: failed images are absent, never zero; before any maximum."""
    return results.filter(F.col("error").isNull() & F.col("fast").isNotNull() & ~F.isnan("fast"))


def worst_frame(frames: DataFrame, group_score: Column) -> DataFrame:
    """ML08, X10: score of a medium by its worst frame, which frame k of n it was (none for a still), its labels.

    Frames that failed count for nothing; a medium of which all failed has no row.
    """
    good = without_errors(frames).withColumn("group_score", group_score)
    best = good.groupBy("media_id").agg(
        F.max_by(F.struct("position", "group_score", "labels"), F.struct("group_score", -F.col("position"))).alias("best"), F.max("fast").alias("fast"), F.count(F.lit(1)).alias("of")
    )
    frame = lambda c: F.when(F.col("of") > 1, c).cast("int")
    return best.select("media_id", "fast", F.col("best.group_score").alias("score"), F.col("best.labels").alias("labels"), frame(F.col("best.position")).alias("frame"), frame(F.col("of")).alias("of"))


def decoded(content: Column, most: int) -> Column:
    """SRC07: strict base64, at most ``most`` bytes; null otherwise."""
    strict = content.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    raw = F.when(strict, F.unbase64(content))
    return F.when(F.octet_length(raw) <= most, raw)


def read_words(error: Column, words: Column) -> Column:
    """Words read off a picture, one blank between them; null after an error or if there are none."""
    clean = F.regexp_replace(F.regexp_replace(words, r"(?U)\s+", " "), "^ | $", "")
    return F.when(error.isNull() & (clean != ""), clean)


def check_labels(labels: list[str], nsfw: list[str]) -> list[str]:
    """ML03: the model's labels that count as explicit; a model without them is refused."""
    known = {x.lower(): x for x in labels}
    missing = [x for x in nsfw if x.lower() not in known]
    if missing or not nsfw:
        raise ValueError(f"the model has no label {missing}")
    return [known[x.lower()] for x in nsfw]


def classified(results: DataFrame, nsfw: list[str]) -> DataFrame:
    """F41, AG10: nsfw and sfw of each result, six decimals; both null after an error."""
    total = F.round(scores.category_score(F.col("labels"), F.array(*map(F.lit, nsfw))), 6)
    return results.withColumn("nsfw", F.when(F.col("error").isNull(), total)).withColumn("sfw", F.round(1 - F.col("nsfw"), 6))


def enabled(media_scan: Column, kinds: Column, kind: Column) -> Column:
    """P08."""
    return F.coalesce(media_scan & F.array_contains(kinds, kind), F.lit(False))


def largest(variants: Column) -> Column:
    """SO07: id of the variant of most pixels; ties by id."""
    return F.array_max(F.transform(variants, lambda v: F.struct((v["w"] * v["h"]).alias("area"), v["id"].alias("id"))))["id"]


def fingerprint(photos: Column, newest: int = 3) -> Column:
    """SRC13, F38: ids of the newest photos' largest variants."""
    return F.array_join(F.transform(F.slice(photos, 1, newest), largest), ":")


def labelled(images: DataFrame, names: list[str]) -> DataFrame:
    """logits as labels with probabilities."""
    p = scores.softmax(F.col("logits"))
    named = F.transform(F.arrays_zip(F.array(*map(F.lit, names)).alias("label"), p.alias("value")), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))
    return images.withColumn("labels", named)


def worst_image(images: DataFrame, group_score: Column) -> DataFrame:
    """AG07, AG08 with each group's own categories: the image of the largest group score, ties by smallest id."""
    scored = images.withColumn("group_score", group_score).filter(~F.isnan("group_score"))
    best = scored.groupBy("media_id", "chat_id").agg(
        F.max_by(F.struct("image_id", "group_score"), F.struct("group_score", -F.col("image_id"))).alias("best"),
        F.max("fast").alias("fast"),
        F.count(F.lit(1)).alias("images"),
    )
    return best.select("media_id", "chat_id", "fast", "images", F.col("best.image_id").alias("image_id"), F.col("best.group_score").alias("score"))


def cascade(images: DataFrame, bar: Column, verify: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """ML06, O3: media none of whose images reach the bar are screened; all images of the others are verified.

    The split is made before ``verify``, so the costly stage sees flagged media only. Without a verifier, or where it has no answer,
    a flagged medium's score is null: unknown, neither clean nor a match.
    """
    keys = ["media_id", "chat_id"]
    flagged = images.withColumn("bar", bar).groupBy(*keys).agg(F.max("fast").alias("top"), F.first("bar").alias("bar"))
    over = flagged.filter(F.col("top") >= F.col("bar")).select(*keys)
    screened = flagged.filter(F.col("top") < F.col("bar")).select(*keys, F.col("top").alias("score"), F.lit(False).alias("verified"))
    if verify is None:
        return screened.unionByName(over.select(*keys, F.lit(None).cast("double").alias("score"), F.lit(False).alias("verified")))
    told = verify(images.join(over, keys, "left_semi")).select(*keys, "score")
    return screened.unionByName(over.join(told, keys, "left").select(*keys, "score", F.col("score").isNotNull().alias("verified")))


def clip_scores(frames: DataFrame, stills: DataFrame, group_score: Column) -> DataFrame:
    """ML08: score of each medium by the worst of its frames; one of which no frame could be had or scored goes by its still (media_id, fast, labels, error).

    A still names no frame. A medium without either has no row.
    """
    best = worst_frame(frames, group_score)
    none = F.lit(None).cast("int")
    rest = without_errors(stills).join(best.select("media_id"), "media_id", "left_anti")
    return best.unionByName(rest.select("media_id", "fast", group_score.alias("score"), "labels", none.alias("frame"), none.alias("of")))


def verify_bar(profile: Column, media: Column, shared: Column) -> Column:
    """ML09: one score for two passes is checked at the lower bar."""
    return F.when(shared, F.least(profile, media)).otherwise(media)


def bot_verdict(is_self: Column, is_admin: Column, can_restrict: Column) -> Column:
    """P13."""
    return F.when(is_self | is_admin, "leave").when(~can_restrict, "powerless").otherwise("ban")
