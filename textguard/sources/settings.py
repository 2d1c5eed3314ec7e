"""Protection settings, one row per profile, with the declared defaults filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import fixed

SETTINGS_SCHEMA = (
    "profile_id string, global_protection_enabled boolean, security_profile string, "
    "active_modules struct<indirect_injection: boolean, jailbreaks: boolean, "
    "destructive_commands: boolean, pii_leak_prevention: boolean>, "
    "local_llm_verification struct<use_ollama_evaluator: boolean, selected_model: string>, "
    "custom_user_patterns array<string>"
)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.schema(SETTINGS_SCHEMA).json(path))


def with_defaults(settings: DataFrame) -> DataFrame:
    """Flat settings: switches, ``use_model``, ``model_name``, ``blocklist``.

    The strict profile uses the model whatever its own switch says.
    """
    profile = F.coalesce("security_profile", F.lit(fixed.DEFAULT_PROFILE))
    asked = F.coalesce("local_llm_verification.use_ollama_evaluator", F.lit(False))
    return settings.select(
        "profile_id",
        F.coalesce("global_protection_enabled", F.lit(True)).alias("protected"),
        profile.alias("security_profile"),
        *(
            F.coalesce(f"active_modules.{name}", F.lit(default)).alias(name)
            for name, default in fixed.MODULE_DEFAULTS.items()
        ),
        (asked | (profile == "strict")).alias("use_model"),
        F.coalesce("local_llm_verification.selected_model", F.lit(fixed.DEFAULT_MODEL)).alias(
            "model_name"
        ),
        F.coalesce("custom_user_patterns", F.array().cast("array<string>")).alias("blocklist"),
    )


def invalid_settings(settings: DataFrame) -> DataFrame:
    """Rows of ``with_defaults`` with a profile or model that the schema does not list."""
    return settings.filter(
        ~F.col("security_profile").isin(*fixed.PROFILES)
        | ~F.col("model_name").isin(*fixed.MODELS)
    )


def unlisted() -> Column:
    """What a row of ``with_defaults`` names that the schema does not list; NULL for nothing."""
    profile = F.when(~F.col("security_profile").isin(*fixed.PROFILES), "profile not listed")
    model = F.when(
        F.col("use_model") & ~F.col("model_name").isin(*fixed.MODELS), "model not listed"
    )
    return F.nullif(F.concat_ws(", ", profile, model), F.lit(""))
