"""SQL text built from the same rule tables the Spark side uses."""

from __future__ import annotations


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def string_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def any_contained(text: str, terms) -> str:
    return f"list_bool_or(list_transform({string_list(terms)}, lambda k: contains({text}, k)))"


def count_contained(text: str, terms) -> str:
    return f"len(list_filter({string_list(terms)}, lambda k: contains({text}, k)))"


def rule_case(text: str, rules, default: str) -> str:
    """CASE over keyword rules; ``default`` is an SQL expression."""
    whens = "".join(
        f" WHEN {' AND '.join(any_contained(text, g) for g in r.groups)} THEN {quote(r.label)}" for r in rules
    )
    return f"CASE{whens} ELSE {default} END"


def pattern_case(text: str, patterns, default: str) -> str:
    whens = "".join(
        " WHEN " + " OR ".join(f"regexp_matches({text}, {quote(p.replace('(?iU)', '(?i)'))})" for p in group)
        + f" THEN {quote(label)}"
        for label, group in patterns
    )
    return f"CASE{whens} ELSE {quote(default)} END"


def value_case(name: str, table, default: float) -> str:
    whens = "".join(f" WHEN {quote(k)} THEN {v}::DOUBLE" for k, v in table.items())
    return f"CASE {name}{whens} ELSE {default}::DOUBLE END"


def replace_chain(text: str, steps) -> str:
    for pattern, replacement in steps:
        back = replacement.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(back)}, 'g')"
    return text


def split_after(text: str, before: str, separator: str) -> str:
    """Split at ``separator`` where it follows ``before`` (RE2 has no look-behind)."""
    return f"string_split(regexp_replace({text}, '({before}){separator}', '\\1' || chr(1), 'g'), chr(1))"
