"""Element functions (E1-E3) as SQL text; ``text``, ``cls`` and ``attrs`` are lower-case columns."""

from __future__ import annotations

from pagemill.functions import rules as R
from pagemill.functions.dialect import Dialect, cases, lit


def intents(d: Dialect, source: str, text: str = "e_text", cls: str = "e_class", attrs: str = "e_attrs", kind: str = "type") -> str:
    """E1 as a SELECT: ``source`` with action and intent_confidence; the first of the best actions, under 35 unknown at 10."""
    adjust = f"CASE WHEN {kind} IN ('clickable', 'link') THEN 5 WHEN {kind} IN ('text', 'container') THEN -10 ELSE 0 END"
    scores = []
    for i, (_, base, words, classes, keys) in enumerate(R.ACTIONS):
        parts = [f"CASE WHEN {d.like(x, p)} THEN {n} ELSE 0 END" for x, p, n in ((text, words, 15), (cls, classes, 12), (attrs, keys, 8))]
        scores.append(f"least(100, greatest(0, {base} + {' + '.join(parts)} + {adjust})) AS i_{i}")
    names = [f"i_{i}" for i in range(len(R.ACTIONS))]
    a = f"SELECT *, {', '.join(scores)} FROM {source}"
    b = f"SELECT *, greatest({', '.join(names)}) AS i_best FROM ({a}) i_a"
    action = cases([("i_best < 35", "'unknown'"), *((f"i_{i} = i_best", lit(x[0])) for i, x in enumerate(R.ACTIONS))], "'unknown'")
    return f"SELECT * {'EXCEPT' if d.spark else 'EXCLUDE'} ({', '.join(names)}, i_best), {action} AS action, CASE WHEN i_best < 35 THEN 10 ELSE i_best END AS intent_confidence FROM ({b}) i_b"


def relevance(d: Dialect, source: str, n_urls: str = "n_urls", n_data: str = "n_data", text: str = "e_text", kind: str = "type", memory: str = "0") -> str:
    """E2 as a SELECT: ``source`` (with E1's columns) with score and relevance; depth is always 0 and elements count as visible."""
    total = " + ".join([
        cases([(f"action = {lit(a)}", str(n)) for a, n in R.INTENT_POINTS], "5"), cases([(f"{kind} = {lit(k)}", str(n)) for k, n in R.ELEMENT_POINTS], "0"),
        f"least(10 * {n_urls}, 30)", "8", f"CASE WHEN length({text}) BETWEEN 2 AND 40 THEN 5 ELSE 0 END", f"CASE WHEN {d.like(text, '[0-9]')} THEN 3 ELSE 0 END", f"least(5 * {n_data}, 15)", "3", memory,
    ])
    a = f"SELECT *, least(100, greatest(0, {total})) AS score FROM {source}"
    return f"SELECT *, CASE WHEN score >= 55 THEN 'high' WHEN score >= 30 THEN 'medium' WHEN score >= 10 THEN 'low' ELSE 'skip' END AS relevance FROM ({a}) r_a"


def zones(d: Dialect, source: str, text: str = "e_text", cls: str = "e_class", attrs: str = "e_attrs", tag: str = "tag", kind: str = "type") -> str:
    """E3 as a SELECT: ``source`` with zone and zone_confidence; the first of the best zones."""
    scores = []
    for i, (_, classes, tags, keys) in enumerate(R.ZONES):
        parts = [f"CASE WHEN {d.like(x, p)} THEN {n} ELSE 0 END" for x, p, n in ((cls, classes, 20), (tag, tags, 15), (attrs, keys, 10))]
        scores.append(f"{' + '.join(parts)} AS z_{i}")
    names = [f"z_{i}" for i in range(len(R.ZONES))]
    a = f"SELECT *, {', '.join(scores)} FROM {source}"
    b = f"SELECT *, greatest({', '.join(names)}) AS z_best FROM ({a}) z_a"
    nav = f"z_best = 0 AND {kind} = 'container' AND {d.like(f'concat({text}, {lit(' ')}, {cls}, {lit(' ')}, {attrs})', 'nav')}"
    zone = cases([(nav, "'nav'"), ("z_best = 0", "'unknown'"), *((f"z_{i} = z_best", lit(x[0])) for i, x in enumerate(R.ZONES))], "'unknown'")
    return f"SELECT * {'EXCEPT' if d.spark else 'EXCLUDE'} ({', '.join(names)}, z_best), {zone} AS zone, CASE WHEN {nav} THEN 60 ELSE least(100, z_best + 10) END AS zone_confidence FROM ({b}) z_b"
