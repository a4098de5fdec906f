"""Human-readable sizes, durations, numbers, and graph labels and styles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DASH = "—"

# fixed values: look of a graph node by type
NODE_STYLES = {
    "error": {"fillcolor": "#FFEBEE", "color": "#D32F2F", "shape": "box",
              "style": "filled,bold", "penwidth": "2.0"},
    "excluded": {"fillcolor": "#F5F5F5", "color": "#9E9E9E", "shape": "box",
                 "style": "filled,dashed", "penwidth": "1.0"},
    "text": {"fillcolor": "#E8F5E9", "color": "#2E7D32", "shape": "note", "style": "filled"},
    "binary": {"fillcolor": "#E3F2FD", "color": "#1976D2", "shape": "box", "style": "filled"},
    "directory": {"fillcolor": "#FFF3E0", "color": "#E65100", "shape": "folder",
                  "style": "filled"},
}


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals with half-even rounding of the exact binary value, no grouping."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits))


def human_size(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(fixed(size / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(fixed(size / (1024 * 1024), 1), F.lit(" MB")))
    )


def human_duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 60, F.format_string("%ds", whole))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(
            F.format_string("%dh %dm", F.floor(whole / 3600), F.floor((whole % 3600) / 60))
        )
    )


def thousands(value: Column) -> Column:
    """Whole number with commas; a dash for a missing or non-numeric value."""
    number = value.try_cast("double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.coalesce(F.format_number(whole, 0), F.lit(DASH))


def percent(value: Column) -> Column:
    return F.coalesce(F.concat(fixed(value, 1), F.lit("%")), F.lit(DASH))


def node_label(name: Column, size: Column) -> Column:
    """Base name with the size on a second line where there is one."""
    return F.concat_ws("\n", F.substring_index(name, "/", -1), human_size(size))


def node_tooltip(encoding: Column, created: Column, modified: Column, permissions: Column) -> Column:
    return F.concat_ws(
        "\\n",
        F.concat(F.lit("encoding: "), encoding),
        F.concat(F.lit("created: "), created),
        F.concat(F.lit("modified: "), modified),
        F.concat(F.lit("permissions: "), permissions),
    )


def node_style(node_type: Column, attribute: str) -> Column:
    """One style attribute as a CASE over the five node types: no join needed."""
    picked = None
    for kind, style in NODE_STYLES.items():
        if attribute in style:
            picked = (F if picked is None else picked).when(
                node_type == kind, F.lit(style[attribute])
            )
    return picked
