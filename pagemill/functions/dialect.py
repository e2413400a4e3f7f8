"""SQL text for two engines.

Every scalar rule is written once as SQL.  Spark runs it, and the same rule in
DuckDB's spelling is the check.  Only spelling differs between the dialects:
regular-expression calls, literals, array functions.
"""

from __future__ import annotations

from dataclasses import dataclass


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Dialect:
    """An engine's spelling; ``elements`` and ``pages`` name relations to read instead of the test tables' own."""

    name: str
    elements: str | None = None
    pages: str | None = None

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def text(self, s: str) -> str:
        """A string literal."""
        if not self.spark:
            return lit(s)
        return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def like(self, x: str, pattern: str) -> str:
        """Whether the pattern occurs in x."""
        return f"({x} RLIKE {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        """A group of the first match, else the empty text."""
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        """Every match replaced; <1> stands for the first group."""
        for n in "123":
            by = by.replace(f"<{n}>", ("$" if self.spark else "\\") + n)
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})" if self.spark else f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.text(by)})" if self.spark else f"string_split_regex({x}, {self.text(by)})"

    def keep(self, xs: str, cond: str) -> str:
        """Elements x of an array for which cond holds."""
        return f"filter({xs}, x -> {cond})" if self.spark else f"list_filter({xs}, lambda x: {cond})"

    def each(self, xs: str, f: str) -> str:
        return f"transform({xs}, x -> {f})" if self.spark else f"list_transform({xs}, lambda x: {f})"

    def size(self, xs: str) -> str:
        return f"size({xs})" if self.spark else f"len({xs})"

    def join(self, xs: str, by: str) -> str:
        return f"array_join({xs}, {self.text(by)})" if self.spark else f"array_to_string({xs}, {self.text(by)})"

    def distinct(self, xs: str) -> str:
        return f"array_distinct({xs})" if self.spark else f"list_distinct({xs})"

    def has(self, xs: str, x: str) -> str:
        return f"array_contains({xs}, {x})" if self.spark else f"list_contains({xs}, {x})"

    def common(self, a: str, b: str) -> str:
        """Number of distinct elements in both."""
        return self.size(f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})")

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if self.spark else f"[{', '.join(xs)}]"

    def at(self, xs: str, i: int) -> str:
        """Element i from 0; null beyond."""
        return f"get({xs}, {i})" if self.spark else f"({xs})[{i + 1}]"

    def first(self, x: str, order: str) -> str:
        return f"min_by({x}, {order})" if self.spark else f"arg_min({x}, {order})"

    def last(self, x: str, order: str) -> str:
        return f"max_by({x}, {order})" if self.spark else f"arg_max({x}, {order})"

    def joined(self, x: str, by: str, order: str) -> str:
        """Texts of a group in order."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), c -> c.v), {self.text(by)})"
        return f"string_agg({x}, {self.text(by)} ORDER BY {order})"

    def numbered(self, xs: str, alias: str, name: str) -> str:
        """A lateral table alias(seq from 1, name) of an array's elements."""
        if self.spark:
            return f"LATERAL VIEW posexplode({xs}) {alias} AS seq0, {name}"
        return f", LATERAL (SELECT unnest(range(len({xs}))) AS seq0, unnest({xs}) AS {name}) {alias}"

    def long(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def try_long(self, x: str) -> str:
        return f"TRY_CAST(nullif({x}, '') AS BIGINT)"

    def levenshtein(self, a: str, b: str) -> str:
        return f"levenshtein({a}, {b})"

    def half_up(self, x: str, digits: int = 0) -> str:
        """Rounded half up, by way of floor, alike in both engines."""
        k = 10**digits
        return f"floor(({x}) * {k} + 0.5) / {k}" if digits else f"floor(({x}) + 0.5)"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def cases(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"
