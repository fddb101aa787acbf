"""Evidence: the map of conditions that defines a scenario, and its text forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import as_column


def parse_evidence(c) -> Column:
    """``"{'A': 'x'}"`` as a map; everything unreadable becomes an empty map."""
    empty = F.create_map().cast("map<string,string>")
    text = F.trim(as_column(c))
    # bare None / True / False are no JSON, so they become text first; a JSON null is dropped
    quoted = F.regexp_replace(text, r":\s*(None|True|False)(?=\s*[,}])", ": '$1'")
    parsed = F.from_json(quoted, "map<string,string>", {"allowSingleQuotes": "true"})
    return F.coalesce(F.map_filter(parsed, lambda k, v: v.isNotNull()), empty)


def _quoted(s: Column) -> Column:
    return F.when(F.contains(s, F.lit("'")), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), s, F.lit("'"))
    )


def sorted_entries(m) -> Column:
    return F.array_sort(F.map_entries(as_column(m)))


def evidence_text(m) -> Column:
    """Canonical text of the map, keys in order: ``{'A': 'x', 'B': 'y'}``."""
    parts = F.transform(
        sorted_entries(m), lambda e: F.concat(_quoted(e["key"]), F.lit(": "), _quoted(e["value"]))
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def scenario_id(accident_type, evidence) -> Column:
    return F.concat_ws(" | ", as_column(accident_type), evidence_text(evidence))


def evidence_label(m, raw=None) -> Column:
    """One ``k: v`` line per condition; for an empty map the first 20 characters of ``raw``."""
    lines = F.array_join(
        F.transform(sorted_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"
    )
    if raw is None:
        return lines
    cut = F.concat(F.substring(as_column(raw), 1, 20), F.lit("..."))
    return F.when(F.size(as_column(m)) > 0, lines).otherwise(cut)


def matched_part(key: Column, value: Column, tier: Column, score: Column) -> Column:
    """``k=v(Score:0.0520)``, ``k(Score:0.0520)`` or ``k=v(N/A)`` by the tier that matched."""
    scored = F.format_string("(Score:%.4f)", score)
    pair = F.concat(key, F.lit("="), value)
    return (
        F.when(tier == 1, F.concat(pair, scored))
        .when(tier == 2, F.concat(key, scored))
        .otherwise(F.concat(pair, F.lit("(N/A)")))
    )


def scored_parts(details) -> Column:
    return F.filter(F.split(as_column(details), "; "), lambda p: F.contains(p, F.lit("Score")))
