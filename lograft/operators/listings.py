"""Archive and API listings: JSON text to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lograft.constants import NOT_FOUND_PHRASES
from lograft.functions.text import js_trim

_SCHEMAS = {
    "folder": "array<struct<name:string,download_url:string>>",
    "gist": "struct<files:map<string,struct<raw_url:string>>>",
    "repository": "struct<defaultBranch:string,visibility:string,_corrupt_record:string>",
}
# What shows that a text was no such listing.
_BROKEN = {
    "folder": F.isnull,
    "gist": lambda parsed: parsed["files"].isNull(),
    "repository": lambda parsed: parsed["_corrupt_record"].isNotNull(),
}


def explode_listing(df: DataFrame, json_col: str, kind: str) -> DataFrame:
    """One row per listed entry; other columns of ``df`` are kept.

    ``present`` is false for a NULL listing (nothing there). A listing that is
    there but empty gives one row with ``present`` true and NULL entry columns,
    and so does one that cannot be parsed, which is marked ``malformed``.
    """
    keep = [c for c in df.columns if c != json_col]
    text = js_trim(F.col(json_col))
    parsed = df.select(
        *keep,
        F.col(json_col).isNotNull().alias("present"),
        F.coalesce(text != "", F.lit(False)).alias("_given"),
        F.from_json(text, _SCHEMAS[kind]).alias("_parsed"),
    ).withColumn("malformed", F.col("_given") & F.coalesce(_BROKEN[kind](F.col("_parsed")), F.lit(True)))
    keep += ["present", "malformed"]
    if kind == "repository":
        return parsed.select(
            *keep,
            F.col("_parsed.defaultBranch").alias("default_branch"),
            F.col("_parsed.visibility").alias("visibility"),
        )
    if kind == "folder":
        entries = F.col("_parsed")
        columns = [F.col("_entry.name").alias("name"), F.col("_entry.download_url").alias("download_url")]
    else:
        entries = F.map_entries("_parsed.files")
        columns = [F.col("_entry.key").alias("filename"), F.col("_entry.value.raw_url").alias("raw_url")]
    return parsed.select(*keep, F.explode_outer(entries).alias("_entry")).select(*keep, *columns)


def _text_of(value: Column, path: str) -> Column:
    """A string member of a VARIANT; NULL where it is missing or something else."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(value, path, "string"))


def explode_answers(df: DataFrame, answer_col: str) -> DataFrame:
    """Raw answers of a folder lookup, of any JSON shape in one column; one row per entry, other columns are kept.

    ``shape`` says what came: ``folder`` (an array, or blank text for an empty one), ``file`` (one entry as an
    object), ``absent`` (NULL, or an error object that says so), ``failed`` (any other error object, its text in
    ``error``) or ``malformed`` (no JSON, a scalar, an object of neither kind, an object that names a member
    twice, or more than a VARIANT holds). Entries are numbered from 0 in ``entry_no``; one without a name is
    ``bad_entry`` by itself and spoils no other. An answer without entries gives one row with NULL entry columns.
    """
    keep = [c for c in df.columns if c != answer_col]
    text = js_trim(F.col(answer_col))
    parsed = df.select(*keep, F.struct(text.alias("text"), F.try_parse_json(text).alias("value")).alias("_answer"))
    value = F.col("_answer.value")
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    message = F.lower(_text_of(value, "$.message"))
    lost = F.lit(False)
    for phrase in NOT_FOUND_PHRASES:
        lost = lost | message.contains(phrase)
    lost = lost | (F.try_variant_get(value, "$.status", "string") == "404")
    shape = (
        F.when(F.col("_answer.text").isNull(), "absent")
        .when((F.col("_answer.text") == "") | kind.startswith("ARRAY<"), "folder")
        .when(~kind.startswith("OBJECT<"), "malformed")
        .when(_text_of(value, "$.name").isNotNull(), "file")
        .when(message.isNull(), "malformed")
        .when(F.coalesce(lost, F.lit(False)), "absent")
        .otherwise("failed")
    )
    shaped = parsed.withColumn("shape", shape)
    entries = F.when(F.col("shape") == "folder", F.try_variant_get(value, "$", "array<variant>")).when(
        F.col("shape") == "file", F.array(value)
    )
    error = F.when(F.col("shape") == "failed", _text_of(value, "$.message"))
    each = shaped.select(*keep, "shape", error.alias("error"), F.posexplode_outer(entries).alias("entry_no", "_entry"))
    name = _text_of(F.col("_entry"), "$.name")
    return each.select(
        *keep,
        "shape",
        "error",
        F.col("entry_no").cast("bigint").alias("entry_no"),
        F.when(F.col("entry_no").isNotNull(), name.isNull()).alias("bad_entry"),
        name.alias("name"),
        F.when(name.isNotNull(), _text_of(F.col("_entry"), "$.download_url")).alias("download_url"),
    )
