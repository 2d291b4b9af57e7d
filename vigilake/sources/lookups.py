"""Lookups by key, profiles, catalogs of texts, folders of images, model metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

IMAGE_PATTERN = "*.{jpg,jpeg,png,gif,webp,JPG,JPEG,PNG,GIF,WEBP}"


def by_key(events: DataFrame, rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """SRC06: each event with the row of its key (one for a key), its columns prefixed; ``<prefix>_found`` tells whether there is one."""
    renamed = rows.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c not in keys], F.lit(True).alias(f"{prefix}_found"))
    return events.join(renamed, keys, "left").withColumn(f"{prefix}_found", F.coalesce(f"{prefix}_found", F.lit(False)))


def with_profile(events: DataFrame, profiles: DataFrame, bio: bool = True, channel: bool = True) -> DataFrame:
    """SRC14: bio and channel of each event's user. No profile: unknown; one without a channel: absent; what isn't needed is unknown."""
    found = by_key(events, profiles.select("user_id", "bio", "channel_title", "channel_username", "has_channel"), ["user_id"], "p")
    seen = F.col("p_found") & F.lit(channel)
    state = F.when(~seen, "unknown").when(F.coalesce("p_has_channel", F.lit(False)), "linked").otherwise("absent")
    linked = state == "linked"
    out = found.withColumns({
        "bio": F.when(F.lit(bio), F.col("p_bio")), "channel_state": state,
        "channel_title": F.when(linked, F.col("p_channel_title")), "channel_username": F.when(linked, F.col("p_channel_username")),
    })
    return out.drop("p_bio", "p_channel_title", "p_channel_username", "p_has_channel", "p_found")


def media_only(events: DataFrame) -> DataFrame:
    """A context in which nothing of the profile was looked up: every profile signal is unavailable."""
    nulls = {"bio": "string", "channel_title": "string", "channel_username": "string", "profile_nsfw": "double", "avatar_text": "string", "profile_ad": "double", "other_group_bans": "long"}
    return events.withColumns({k: F.lit(None).cast(t) for k, t in nulls.items()} | {"channel_state": F.lit("unknown"), "photos": F.lit("unknown")})


def catalog(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """SRC10: (lang, key, template) of TOML catalogs, given as lang -> text of the file."""
    import tomllib

    rows = [(lang, key, value) for lang, text in texts.items() for key, value in tomllib.loads(text).items() if isinstance(value, str)]
    return spark.createDataFrame(rows, "lang string, key string, template string")


def translated(rows: DataFrame, texts: DataFrame, lang: Column, key: Column, name: str = "text") -> DataFrame:
    """the template of each row's language and key, else the English one, else the key in brackets."""
    from vigilake.functions.text import translate_key

    given = rows.withColumns({"_lang": lang, "_key": key})
    own = texts.select(F.col("lang").alias("_lang"), F.col("key").alias("_key"), F.col("template").alias("_own"))
    english = texts.filter("lang = 'en'").select(F.col("key").alias("_key"), F.col("template").alias("_english"))
    joined = given.join(own, ["_lang", "_key"], "left").join(english, "_key", "left")
    return joined.withColumn(name, translate_key(F.col("_own"), F.col("_english"), F.col("_key"))).drop("_lang", "_key", "_own", "_english")


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC08: (id, content) of the images of a folder; the id is the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_PATTERN).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("id"), "content")


def model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: labels, labels that count as explicit, size, mean and std of a model."""
    return spark.read.schema("labels array<string>, nsfw_labels array<string>, size int, mean array<double>, std array<double>").json(path, multiLine=True)
