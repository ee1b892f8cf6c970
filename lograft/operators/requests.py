"""Upload requests: option layers folded into one, and rule checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from lograft.functions.text import is_true

# Layers in order of precedence; each is a STRUCT column with some of the options.
LAYERS = ("cli", "env", "settings")

# --- Fixed values: option names, short forms and defaults --------------------
FLAG_DEFAULTS = {
    "public": None,
    "private": None,
    "auto": True,
    "only_gist": None,
    "only_repository": None,
    "shared_repository": True,
    "dry_mode": False,
    "verbose": False,
    "test": False,
    "quick": False,
}
SHORT_FORMS = {
    "public": "p",
    "dry_mode": "dry",
    "description": "d",
    "verbose": "v",
    "test": "t",
    "quick": "q",
}
KNOWN_OPTIONS = (*FLAG_DEFAULTS, "description", *SHORT_FORMS.values(), "help", "h", "version")


def typed_options(raw: Column) -> Column:
    """A raw MAP<STRING,STRING> of options as the STRUCT of a layer.

    Short forms are understood. A flag whose text is no boolean counts as unset.
    """

    def text(option: str) -> Column:
        names = [option, SHORT_FORMS.get(option, option)]
        return F.coalesce(*(F.try_element_at(raw, F.lit(n)) for n in dict.fromkeys(names)))

    flags = [text(option).try_cast("boolean").alias(option) for option in FLAG_DEFAULTS]
    return F.struct(*flags, text("description").alias("description"))


def unknown_options(raw: Column) -> Column:
    """The option names of a raw map that do not exist."""
    return F.array_except(F.map_keys(raw), F.array(*map(F.lit, KNOWN_OPTIONS)))


def _layered(requests: DataFrame, option: str, default: Column) -> Column:
    """The first value among a column of that name and the layers, else the default."""
    values = [F.col(option)] if option in requests.columns else []
    for layer in LAYERS:
        if layer in requests.columns and option in requests.schema[layer].dataType.fieldNames():
            values.append(F.col(layer)[option])
    return F.coalesce(*values, default)


def resolve_requests(requests: DataFrame) -> DataFrame:
    """Fold the option layers; a narrow projection of typed columns.

    ``public``, ``private``, ``only_gist`` and ``only_repository`` stay NULL when
    no layer sets them. Options that no layer has take their default. An
    ``unknown_options`` array, if there is one, lists names that do not exist.
    """
    options = {
        name: _layered(requests, name, F.lit(default).cast("boolean"))
        for name, default in FLAG_DEFAULTS.items()
    }
    options["description"] = _layered(requests, "description", F.lit(""))
    options["has_unknown"] = (
        F.coalesce(F.size("unknown_options") > 0, F.lit(False))
        if "unknown_options" in requests.columns
        else F.lit(False)
    )
    forced = is_true(F.col("only_gist")) | is_true(F.col("only_repository"))
    public = is_true(F.col("public"))
    return (
        requests.withColumns(options)
        .withColumns(
            {
                "is_public": public | is_true(~F.col("private")),
                "auto": F.col("auto") & ~forced,
                "self_test": F.col("test") | F.col("quick"),
            }
        )
        .drop("test", "quick", "unknown_options", *LAYERS)
    )


def with_files(requests: DataFrame, files: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Resolved requests joined to their file, and the condition of each rule on them.

    ``files`` has one row per path; only ``path`` and ``size_bytes`` are read. A
    path that very many requests share is a skewed probe side, which adaptive
    execution splits; the file side is never grown for it.
    """
    joined = resolve_requests(requests).join(
        files.select("path", "size_bytes", F.lit(True).alias("found")), "path", "left"
    )
    real = ~F.col("self_test")
    no_path = F.coalesce(F.col("path") == "", F.lit(True))
    no_target = ~is_true(F.col("only_gist")) & ~is_true(F.col("only_repository"))
    return joined, {
        "public_private_conflict": F.col("public").isNotNull() & F.col("private").isNotNull(),
        "only_conflict": F.col("only_gist").isNotNull() & F.col("only_repository").isNotNull(),
        "no_auto_needs_target": real & ~F.col("auto") & no_target,
        "path_required": real & no_path,
        "file_missing": real & ~no_path & F.col("found").isNull(),
        "unknown_option": F.col("has_unknown"),
    }


def valid_requests(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests that break no rule and ask for an upload rather than a self-test."""
    joined, broken = with_files(requests, files)
    # One condition on both sides of the join: taken apart and pushed below it,
    # every option would be folded twice.
    upload = F.when(F.col("found"), ~reduce(or_, broken.values()) & ~F.col("self_test"))
    return joined.where(upload).drop("found", "has_unknown", "self_test")


def validate_requests(requests: DataFrame, files: DataFrame) -> DataFrame:
    """One row per request and broken rule; none for a valid request."""
    joined, broken = with_files(requests, files)
    codes = F.array(*(F.when(condition, F.lit(rule)) for rule, condition in broken.items()))
    return joined.select("request_id", F.explode(codes).alias("rule")).where("rule is not null")
