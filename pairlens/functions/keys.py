"""Canonical keys of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def patch_number(patch_id: Column) -> Column:
    """The number in a patch id as BIGINT, whatever the spelling; null where there is none."""
    return F.regexp_extract(patch_id, r"(\d+)", 1).try_cast("bigint")


def canonical_patch(number: Column) -> Column:
    """``p`` and nine digits; null stays null."""
    return F.when(number.isNotNull(), F.format_string("p%09d", number))


def known_block(block_id: Column) -> Column:
    """The block, or null where none is known (null or -1)."""
    return F.when(block_id != -1, block_id)


def clean_word(word: Column) -> Column:
    """A category word without case and surrounding white space of any kind; null for null and for a blank word."""
    return F.nullif(F.lower(F.regexp_replace(word, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))
