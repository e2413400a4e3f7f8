"""Text functions (X1-X6, X10, X13, X14) as SQL text."""

from __future__ import annotations

from pagemill.functions import rules as R
from pagemill.functions.dialect import Dialect, cases, lit

_FROM = "áàâäãåéèêëíìîïóòôöõúùûüñçý"
_TO = "aaaaaaeeeeiiiiooooouuuuncy"


def tokens(d: Dialect, text: str) -> str:
    """Lower case, other characters than letters, digits and white space parted, tokens of two letters and more."""
    return d.keep(d.split(d.sub(f"lower({text})", r"[^a-záéíóúñ0-9\s]", " "), r"\s+"), "length(x) > 1")


def _letters(d: Dialect, text: str) -> str:
    return d.sub(f"lower({text})", "[^a-záéíóúñ0-9]")


def similarity(d: Dialect, a: str, b: str) -> str:
    """Dice, Jaccard, edit distance and word overlap, to two decimals; 0 if either has no token."""
    ta, tb = tokens(d, a), tokens(d, b)
    sa, sb = d.distinct(ta), d.distinct(tb)
    both = d.common(ta, tb)
    na, nb = d.size(sa), d.size(sb)
    la, lb = d.size(ta), d.size(tb)
    words = d.size(d.keep(ta, d.has(tb, "x")))
    ca, cb = _letters(d, a), _letters(d, b)
    lev = f"CASE WHEN length({ca}) > 2 AND length({cb}) > 2 THEN 1 - {d.levenshtein(ca, cb)} * 1e0 / greatest(length({ca}), length({cb})) ELSE 0e0 END"
    overlap = f"CASE WHEN {la} > 1 AND {lb} > 1 THEN {words} * 1e0 / ({la} + {lb} - {words}) ELSE 0e0 END"
    mix = f"2e0 * {both} / ({na} + {nb}) * 35e-2 + {both} * 1e0 / ({na} + {nb} - {both}) * 15e-2 + ({lev}) * 35e-2 + ({overlap}) * 15e-2"
    return f"CASE WHEN {la} = 0 OR {lb} = 0 THEN 0e0 ELSE {d.half_up(mix, 2)} END"


def normal_title(d: Dialect, text: str) -> str:
    """Lower case, accents off, other characters as spaces, single spaces."""
    plain = f"translate(lower({text}), {lit(_FROM)}, {lit(_TO)})"
    return f"trim({d.sub(d.sub(plain, r'[^a-z0-9\s]', ' '), r'\s+', ' ')})"


def significant(d: Dialect, text: str) -> str:
    """Words of a normal title of two letters and more, less stop words; repeats stay."""
    return d.keep(d.split(normal_title(d, text), r"\s+"), f"length(x) >= 2 AND x NOT IN ({', '.join(map(lit, R.STOP_WORDS))})")


def title_similarity(d: Dialect, a: str, b: str) -> str:
    """1 if normal titles are equal, 0.95 if one holds the other, else the better of X3 and the share of common words."""
    na, nb = normal_title(d, a), normal_title(d, b)
    wa, wb = significant(d, a), significant(d, b)
    words = f"8e-1 * {d.common(wa, wb)} / greatest({d.size(d.distinct(wa))}, {d.size(wb)}, 1)"
    return cases([(f"{na} = '' OR {nb} = ''", "0e0"), (f"{na} = {nb}", "1e0"), (f"contains({na}, {nb}) OR contains({nb}, {na})", "95e-2")], f"greatest({similarity(d, na, nb)}, {words})")


def goal(d: Dialect, text: str, has_frames: str) -> str:
    """The first matching goal of a page's lower-case texts, else video with frames, else navigation."""
    return cases([(d.like(text, p), lit(g)) for g, p in R.GOALS] + [(has_frames, "'video'")], "'navigation'")


def selector_class(d: Dialect, selector: str) -> str:
    """First class of a selector, else its id, else the tag after >, else empty."""
    parts = [d.extract(selector, r"\.([a-zA-Z_][a-zA-Z0-9_-]*)"), d.extract(selector, r"#([a-zA-Z_][a-zA-Z0-9_-]*)"), d.extract(selector, r">\s*([a-zA-Z0-9_]+)")]
    return "coalesce(" + ", ".join(f"nullif({p}, '')" for p in parts) + ", '')"


def general_classes(d: Dialect, cls: str) -> str:
    """Array of a class's general names; both halves of a two-part name, then its families."""
    low = f"lower({cls})"
    two = d.like(low, "^[^-]*-[^-]*$")
    entries = [f"CASE WHEN {two} THEN concat('*-', {d.extract(low, '-([^-]*)$')}) END", f"CASE WHEN {two} THEN concat({d.extract(low, '^([^-]*)-')}, '-*') END"]
    entries += [f"CASE WHEN {d.like(low, p)} THEN {lit(n)} END" for n, p in R.CLASS_FAMILIES]
    return d.keep(d.array(*entries), "x IS NOT NULL")
