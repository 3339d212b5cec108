"""Prompts, conversation threads and encrypted notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions.text import is_prompt_suspicious, redact


def prompt_gate(prompts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(redacted prompts that may pass, rejected ones)."""
    bad = F.coalesce(is_prompt_suspicious(F.col(text)), F.lit(False))
    return prompts.where(~bad).withColumn(text, redact(F.col(text))), prompts.where(bad)


def list_threads(threads: DataFrame, user_id: int, limit: int = 20) -> DataFrame:
    rows = threads.where(F.col("user_id") == user_id)
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def thread_messages(threads: DataFrame, messages: DataFrame, user_id: int,
                    thread_id: int | None = None) -> DataFrame:
    """Messages of the user's own threads in order; other threads give no rows."""
    own = threads.where(F.col("user_id") == user_id)
    if thread_id is not None:
        own = own.where(F.col("id") == thread_id)
        messages = messages.where(F.col("thread_id") == thread_id)
    return (messages.join(own.select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
            .orderBy("thread_id", "created_at", "id"))


def delete_threads(threads: DataFrame, messages: DataFrame, doomed: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """Both tables without ``doomed`` threads (id, user_id); only owners can delete."""
    gone = threads.join(doomed.select("id", "user_id"), ["id", "user_id"], "left_semi").select("id")
    return (threads.join(gone, "id", "left_anti"),
            messages.join(gone.withColumnRenamed("id", "thread_id"), "thread_id", "left_anti"))


def encrypt_text(plain: Column, key: Column) -> Column:
    """AES-256-GCM, base64 of nonce, cipher text and tag."""
    return F.base64(F.aes_encrypt(plain, key, F.lit("GCM")))


def decrypt_text(cipher: Column, key: Column) -> Column:
    """Plain text, or null when the data or the key is wrong."""
    return F.try_aes_decrypt(F.try_to_binary(cipher, F.lit("base64")), key, F.lit("GCM")).cast("string")


def unwrap_key(wrapped: Column, master_key: Column) -> Column:
    """A user's data key (binary) from its wrapped form."""
    return F.try_aes_decrypt(F.try_to_binary(wrapped, F.lit("base64")), master_key, F.lit("GCM"))


def encrypt_notes(notes: DataFrame, users: DataFrame, master_key: Column) -> DataFrame:
    """Notes with ``content`` encrypted under the key of their user (user_id, wrapped_key)."""
    keyed = notes.join(users.select("user_id", "wrapped_key"), "user_id")
    return keyed.withColumn("content", encrypt_text(
        F.col("content"), unwrap_key(F.col("wrapped_key"), master_key))).drop("wrapped_key")


def list_notes(notes: DataFrame, users: DataFrame, master_key: Column, user_id: int | None = None
               ) -> DataFrame:
    """Decrypted notes, newest first; unreadable ones show ``[decryption_error]``."""
    rows = notes if user_id is None else notes.where(F.col("user_id") == user_id)
    keyed = rows.join(users.select("user_id", "wrapped_key"), "user_id", "left")
    plain = decrypt_text(F.col("content"), unwrap_key(F.col("wrapped_key"), master_key))
    return (keyed.withColumn("content", F.coalesce(plain, F.lit("[decryption_error]")))
            .drop("wrapped_key").orderBy(F.desc("created_at"), F.desc("id")))


def delete_note(notes: DataFrame, note_id: int, user_id: int) -> DataFrame:
    return notes.where(~((F.col("id") == note_id) & (F.col("user_id") == user_id)))
