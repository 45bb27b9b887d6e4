"""Bronze to clean messages: status duplicates removed, entities found, personal data masked."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosa import params as P
from prosa.functions.columns import (
    all_matches, first_match, hash16, lookup, replace_all, strip,
)
from prosa.operators.ordering import latest_per_key
from prosa.params import CANONICAL, Profile

PII_FLAGS = ("pii_cpf_found", "pii_email_found", "pii_cep_found", "pii_phone_found")


# --- cleaning -----------------------------------------------------------------------------

def status_rank(profile: Profile = CANONICAL) -> Column:
    return lookup(profile.status_column, profile.status_rank, 0)


def deduplicate(df: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """One row per logical message: the most advanced status, then the smallest message id.

    Partitioned by the full key, so a long conversation spreads over many tasks, and a group of
    many copies shrinks to one row per map task before the shuffle.
    """
    order = [status_rank(profile).desc()]
    if "message_id" not in profile.dedup_keys:
        order.append(F.col("message_id").asc())
    else:
        order.append(F.col("timestamp").asc())
    # Time first: the sort then decides most pairs on eight bytes instead of on texts.
    keys = sorted(profile.dedup_keys, key=lambda name: name != "timestamp")
    return latest_per_key(df, keys, order)


def content_flags(df: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """Transcription mark and normalised body."""
    body = F.col("message_body")
    if profile.name == "notebook":
        return df.withColumns({
            "sender_name_normalized": F.lower(F.trim("sender_name")),
            "is_audio_transcription": F.coalesce(body.rlike(P.NOTEBOOK_AUDIO), F.lit(False)),
            "message_body_normalized": F.trim(F.coalesce(body, F.lit(""))),
        })
    spoken = body.startswith(P.AUDIO_PREFIX)
    rest = strip(F.substring(body, len(P.AUDIO_PREFIX) + 1, 2_147_483_647))
    return df.withColumns({
        "is_audio_transcription": spoken,
        "message_body_normalized": F.when(spoken, rest).otherwise(body),
    })


def clean(bronze: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    return content_flags(deduplicate(bronze, profile), profile).withColumn(
        "_silver_version", F.lit(profile.silver_version))


def cleaning_stats(bronze: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: counts before and after."""
    before = bronze.agg(F.count(F.lit(1))).scalar()
    return cleaned.agg(
        F.count(F.lit(1)).alias("rows_after_dedup"),
        F.count_if("is_audio_transcription").alias("audio_transcriptions"),
    ).select(
        before.alias("rows_before"),
        "rows_after_dedup",
        (before - F.col("rows_after_dedup")).alias("duplicates_removed"),
        "audio_transcriptions",
        F.col("rows_after_dedup").alias("rows_written"),
    )


# --- first entity per message ---------------------------------------------------------------

_HINTS = ("_digits", "_at", "_name")


def _with_hints(df: DataFrame, body: str) -> DataFrame:
    """Cheap necessary conditions, found once per row and shared by search and masking."""
    text = F.col(body)
    return df.withColumns({
        "_digits": F.coalesce(text.rlike(P.SOME_DIGITS), F.lit(False)),
        "_at": F.coalesce(text.contains("@"), F.lit(False)),
        "_name": F.coalesce(text.rlike(P.SOME_NAME), F.lit(False)),
    })


def _extract(df: DataFrame, body: str) -> DataFrame:
    digits = F.col("_digits")
    found = df.withColumns({
        "_cpf": first_match(body, P.CPF, digits),
        "_email": first_match(body, P.EMAIL, F.col("_at")),
        "_cep": first_match(body, P.CEP, digits),
        "_plate": first_match(body, P.PLATE, digits),
        "_competitor": first_match(body, P.COMPETITOR, F.col("_name")),
    })
    return found.withColumns({
        "extracted_cpf_hash": hash16("_cpf"),
        "extracted_email_hash": hash16(F.lower("_email")),
        "extracted_cep": F.regexp_replace("_cep", r"\P{Nd}", ""),
        "extracted_plate": F.upper("_plate"),
        "extracted_competitor": F.lower("_competitor"),
        "pii_cpf_found": F.col("_cpf").isNotNull(),
        "pii_email_found": F.col("_email").isNotNull(),
        "pii_cep_found": F.col("_cep").isNotNull(),
        "pii_phone_found": F.when(digits, F.col(body).rlike(P.PHONE)).otherwise(F.lit(False)),
    }).drop("_cpf", "_email", "_cep", "_plate", "_competitor")


def _mask(df: DataFrame, body: str, alias: str) -> DataFrame:
    # One step per tag: each result is used twice and must not be computed twice.
    digits = F.col("_digits")
    steps = ((P.CPF, "[CPF_MASKED]", digits), (P.EMAIL, "[EMAIL_MASKED]", F.col("_at")),
             (P.CEP, "[CEP_MASKED]", digits), (P.PHONE, "[PHONE_MASKED]", digits))
    df = df.withColumn(alias, F.col(body))
    for pattern, tag, where in steps:
        df = df.withColumn(alias, replace_all(F.col(alias), pattern, tag, where))
    return df


def extract(df: DataFrame, body: str = "message_body_normalized") -> DataFrame:
    """First CPF, e-mail, CEP, plate and competitor of the text, hashed or normalised, and flags.

    Each pattern runs at most once per row: flags come from the match. Null and empty text give
    nulls and false.
    """
    return _extract(_with_hints(df, body), body).drop(*_HINTS)


def with_mask(df: DataFrame, body: str = "message_body_normalized",
              alias: str = "message_body_masked") -> DataFrame:
    """Tags in place of personal data, in the order CPF, e-mail, CEP, phone: it decides what an
    11-digit number becomes."""
    return _mask(_with_hints(df, body), body, alias).drop(*_HINTS)


def extraction_stats(messages: DataFrame) -> DataFrame:
    """One row: messages with each entity."""
    return messages.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if("pii_cpf_found").alias("messages_with_cpf"),
        F.count_if("pii_email_found").alias("messages_with_email"),
        F.count_if("pii_cep_found").alias("messages_with_cep"),
        F.count_if("pii_phone_found").alias("messages_with_phone"),
        F.count("extracted_plate").alias("messages_with_plate"),
        F.count("extracted_competitor").alias("messages_with_competitor"),
    ).withColumn("rows_written", F.col("total_messages"))


def leaks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per column that still hold text shaped like a CPF or an e-mail. Gold must give zeros."""
    names = columns or [name for name, kind in df.dtypes if kind == "string"]
    counts = df.agg(*[
        F.count_if(F.coalesce(F.col(name).rlike(P.CPF) | F.col(name).rlike(P.EMAIL), F.lit(False)))
        .alias(name) for name in names])
    return counts.unpivot([], names, "column", "leaks")


#: Kinds of personal data that the leak check looks for.
LEAKS = {"cpf": P.CPF, "email": P.EMAIL, "telefone": P.PHONE, "cep": P.CEP, "placa": P.PLATE}


def leak_rules(df: DataFrame, kinds: Sequence[str] = tuple(LEAKS), leave: Sequence[str] = ()) -> dict[str, Column]:
    """For each kind, whether any text column but those in ``leave`` has it."""
    texts = [F.coalesce(F.col(f"`{name}`"), F.lit("")) for name, kind in df.dtypes if kind == "string" and name not in leave]
    whole = F.concat_ws("\n", *texts) if texts else F.lit("")
    return {kind: whole.rlike(LEAKS[kind]) for kind in kinds}


def leak_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and kind of personal data in any of its text columns. Gold must give zeros."""
    parts = []
    for table, df in tables.items():
        counts = df.agg(*[F.count_if(rule).alias(kind) for kind, rule in leak_rules(df).items()])
        parts.append(counts.unpivot([], list(LEAKS), "tipo", "linhas").withColumn("tabela", F.lit(table)))
    return reduce(DataFrame.unionByName, parts).select("tabela", "tipo", "linhas")


# --- all entities per message -----------------------------------------------------------------

def extract_all(df: DataFrame, body: str = "message_body_normalized") -> DataFrame:
    """Every distinct entity as a sorted array; CPFs, e-mails and phones hashed; flags by size."""
    lowered = F.lower(F.coalesce(F.col(body), F.lit("")))
    names = F.array(*[F.lit(name) for name in P.NOTEBOOK_COMPETITORS])
    found = df.withColumns({
        "_cpfs": all_matches(body, P.CPF),
        "_emails": all_matches(body, P.ANY_EMAIL),
        "_phones": all_matches(body, P.ANY_PHONE),
        "extracted_ceps": all_matches(body, P.CEP),
        "extracted_plates": all_matches(F.upper(body), P.ANY_PLATE),
        "extracted_competitors": F.filter(names, lambda name: F.contains(lowered, name)),
    })
    return found.withColumns({
        "extracted_cpfs": F.transform("_cpfs", hash16),
        "extracted_emails": F.transform("_emails", hash16),
        "extracted_phones": F.transform("_phones", hash16),
        "pii_cpf_found": F.size("_cpfs") > 0,
        "pii_email_found": F.size("_emails") > 0,
        "pii_phone_found": F.size("_phones") > 0,
        "pii_cep_found": F.size("extracted_ceps") > 0,
    }).drop("_cpfs", "_emails", "_phones")


def silver_messages(bronze: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """Clean, find and mask in one plan with one shuffle; nothing is written in between."""
    cleaned = clean(bronze, profile)
    if profile.name == "notebook":
        return extract_all(cleaned)
    body = "message_body_normalized"
    hinted = _with_hints(cleaned, body)
    return _extract(_mask(hinted, body, "message_body_masked"), body).drop(*_HINTS)
