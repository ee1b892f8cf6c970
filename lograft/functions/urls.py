"""URLs: building them, and finding them in captured command output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lograft.constants import GIST_URL, GITHUB_URL
from lograft.functions.text import WS, js_trim

_REPOSITORY_LINE = rf"\Ahttps://github\.com/[^/{WS}]+/[^/{WS}]+\z"


def repository_url(owner: Column, name: Column) -> Column:
    return F.concat(F.lit(GITHUB_URL), owner, F.lit("/"), name)


def tree_url(owner: Column, name: Column, branch: Column, path: Column) -> Column:
    return F.concat(repository_url(owner, name), F.lit("/tree/"), branch, F.lit("/"), path)


def found_repository_url(output: Column) -> Column:
    """The first line that is a repository URL and nothing else, or NULL."""
    lines = F.transform(F.split(output, r"\r?\n", -1), js_trim)
    return F.get(F.filter(lines, lambda line: line.rlike(_REPOSITORY_LINE)), F.lit(0))


def found_gist_url(output: Column) -> Column:
    """The trimmed output if it is a gist URL with something behind the host."""
    text = js_trim(output)
    return F.when(text.startswith(GIST_URL) & (text != GIST_URL), text)


def gist_id(url: Column) -> Column:
    return F.substring_index(url, "/", -1)
