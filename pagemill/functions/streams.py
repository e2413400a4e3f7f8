"""Media-stream functions (X7-X9, N9) as SQL text."""

from __future__ import annotations

from pagemill.functions import rules as R
from pagemill.functions.dialect import Dialect, cases, lit


def quality(d: Dialect, text: str) -> str:
    """The first entry found in the lower-case labels and URL."""
    return cases([(f"contains({text}, {lit(word)})", lit(q)) for word, q in R.QUALITIES], "'unknown'")


def language(d: Dialect, text: str, spanish: bool = True) -> str:
    """The entry of strictly highest priority, the first of equals; none: ES, or unknown without the bias."""
    ordered = sorted(R.LANGUAGES, key=lambda x: -x[2])
    return cases([(f"contains({text}, {lit(word)})", lit(lang)) for word, lang, _ in ordered], "'ES'" if spanish else "'unknown'")


def priority(d: Dialect, q: str, lang: str, kind: str, labels: str) -> str:
    """50 and the points of quality, language, type and labels, within 0 to 100."""
    points = [cases([(f"{x} = {lit(v)}", str(n)) for v, n in table], "0") for x, table in ((q, R.QUALITY_POINTS), (lang, R.LANGUAGE_POINTS), (kind, R.TYPE_POINTS))]
    points += [f"CASE WHEN {d.like(labels, p)} THEN {n} ELSE 0 END" for p, n in R.LABEL_POINTS]
    return f"greatest(0, least(100, 50 + {' + '.join(points)}))"


def normalized(d: Dialect, source: str) -> str:
    """N9 as a SELECT: ``source`` (url, labels joined by spaces, direct_url) with quality, language, type, priority, server.

    The priority comes from the type of the URL itself; a direct URL then
    replaces the type, embed becoming mp4.
    """
    from pagemill.functions import urls

    a = f"SELECT *, lower(concat(CASE WHEN labels <> '' THEN concat(labels, ' ') ELSE '' END, url)) AS n_text, lower(labels) AS n_labels, {urls.stream_type(d, 'url')} AS n_kind FROM {source}"
    b = f"SELECT *, {quality(d, 'n_text')} AS quality, {language(d, 'n_text')} AS language FROM ({a}) n_a"
    direct = urls.stream_type(d, "direct_url")
    return (
        f"SELECT * {'EXCEPT' if d.spark else 'EXCLUDE'} (n_text, n_labels, n_kind), CASE WHEN coalesce(direct_url, '') = '' THEN n_kind WHEN {direct} = 'embed' THEN 'mp4' ELSE {direct} END AS type, "
        f"{priority(d, 'quality', 'language', 'n_kind', 'n_labels')} AS priority, {urls.server_name(d, urls.domain(d, 'url'))} AS server FROM ({b}) n_b"
    )
