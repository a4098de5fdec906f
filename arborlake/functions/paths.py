"""Path and repository-URL functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the accepted repository URL forms
_REPO_SSH = r"^git@github\.com:([\w.-]+)/([\w.-]+)$"
_REPO_HTTPS = r"^https?://github\.com/([\w.-]+)/([\w.-]+)$"
_SUFFIX = r"(?s)^.+(\.[^.]+)$"


def suffix(name: Column) -> Column:
    """Lower-cased last extension: ``a.tar.gz`` gives ``.gz``; ``.env`` and ``a.`` give ''."""
    return F.lower(F.regexp_extract(name, _SUFFIX, 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Everything before the last slash; '' for a bare name."""
    return F.when(
        F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")
    ).otherwise(F.lit(""))


def relative_parent(path: Column, root: Column) -> Column:
    """Parent relative to ``root`` ('' at the root itself); outside of it, the parent as it is."""
    parent = parent_path(path)
    inside = F.startswith(parent, F.concat(root, F.lit("/")))
    below = F.substr(parent, F.length(root) + 2)
    return (
        F.when(parent == root, F.lit(""))
        .when(inside, F.replace(F.trim(below), F.lit("\\"), F.lit("/")))
        .otherwise(parent)
    )


def compose_path(parent: Column, filename: Column) -> Column:
    """Join parent and name; a blank or ``.`` parent and a blank name are left out."""
    head = F.trim(F.coalesce(parent, F.lit("")))
    tail = F.trim(F.coalesce(filename, F.lit("")))
    head = F.when(head.isin("", "."), F.lit(None)).otherwise(F.regexp_replace(head, "/+$", ""))
    return F.concat_ws("/", head, F.nullif(tail, F.lit("")))


def path_parts(path: Column) -> Column:
    """Non-empty components of a path."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def ancestors(path: Column) -> Column:
    """Running directory paths above ``path``, outermost first: ``a/b/f`` gives [a, a/b]."""
    parts = path_parts(path)
    depth = F.size(parts) - 1
    return F.when(depth < 1, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(depth, F.lit(1))),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        )
    )


def is_repo_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_REPO_SSH) | url.rlike(_REPO_HTTPS), F.lit(False))


def _url_group(url: Column, group: int) -> Column:
    found = F.concat(
        F.regexp_extract(url, _REPO_SSH, group), F.regexp_extract(url, _REPO_HTTPS, group)
    )
    return F.nullif(found, F.lit(""))


def repo_owner(url: Column) -> Column:
    return _url_group(url, 1)


def repo_name(url: Column) -> Column:
    """Repository name without the literal suffix ``.git``."""
    return F.regexp_replace(_url_group(url, 2), r"\.git$", "")
