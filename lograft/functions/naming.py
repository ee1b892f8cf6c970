"""Archive names derived from paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lograft.constants import (
    DESCRIPTION_PREFIX,
    FOLDER_PREFIX,
    LOG_TEXT_SUFFIX,
    PART_INFIX,
    PRIVATE_REPOSITORY,
    PUBLIC_REPOSITORY,
)
from lograft.functions.text import first_non_empty


def normalized_name(path: Column) -> Column:
    """Drop leading separators; every other separator becomes ``-``."""
    return F.translate(F.ltrim(path, F.lit("/\\")), "/\\", "--")


def _stem(path: Column) -> Column:
    """The normalized name without ``.log`` or ``.log.txt`` at its end."""
    return F.regexp_replace(normalized_name(path), r"\.log(?:\.txt)?\z", "")


def uploaded_name(path: Column) -> Column:
    """The normalized name, made to end in ``.log.txt``."""
    return F.concat(_stem(path), F.lit(LOG_TEXT_SUFFIX))


def folder_name(path: Column) -> Column:
    """Folder in a shared archive, or name of a dedicated one."""
    return F.concat(F.lit(FOLDER_PREFIX), F.regexp_replace(normalized_name(path), r"\.log\z", ""))


def description_for(path: Column, given: Column) -> Column:
    """The given description, else one from the part after the last ``/``."""
    return first_non_empty(
        given, F.concat(F.lit(DESCRIPTION_PREFIX), F.substring_index(path, "/", -1))
    )


def shared_repository(is_public: Column) -> Column:
    return F.when(is_public, PUBLIC_REPOSITORY).otherwise(PRIVATE_REPOSITORY)


def part_name(path: Column, part_no: Column, digits: Column) -> Column:
    """``a.log`` -> ``a.part-03.log.txt``."""
    number = F.lpad(part_no.cast("string"), digits, "0")
    return F.concat(_stem(path), F.lit(PART_INFIX), number, F.lit(LOG_TEXT_SUFFIX))
