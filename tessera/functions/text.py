"""Name normalization and token functions as native Column expressions.

Null and NaN count as the empty string everywhere, and so does the text 'NaN', which a NaN becomes in a text column. Only NFKC needs Python, and only for text outside ASCII (see nfkc()).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rules import INSTITUTIONS, MOJIBAKE, RuleSet

_OPEN, _CLOSE = "\u0001", "\u0002"
#: The letters whose case folding is not their lower case.
_FOLD = {"ß": "ss", "ẞ": "ss", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ"}


def arr(values) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def mapped(values: dict) -> Column | None:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else None


def filled(c: Column) -> Column:
    """The value as text; null and NaN as the empty text."""
    x = c.cast("string")
    return F.when(x.isNull() | (x == "NaN"), "").otherwise(x)


def fixed(c: Column, digits: int) -> Column:
    """A number with one or two decimals; a tie (a multiple of 1/4 or 1/8) goes to the even digit."""
    parts, ties, step = (4, (1,), 0.01) if digits == 1 else (8, (1, 5), 0.001)
    return F.format_string(f"%.{digits}f", F.when(F.pmod(c * parts, F.lit(float(parts))).isin(*map(float, ties)), c - step).otherwise(c))


def nfkc(c: Column) -> Column:
    """NFKC of text; ASCII text passes unchanged."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run(c)


def _on_matches(c: Column, pattern: str, drop: str) -> Column:
    """Removes `drop` within each match of `pattern`: matches are put between two control characters, split off and cleaned."""
    marked = F.regexp_replace(c, pattern, f"{_OPEN}$0{_CLOSE}")
    pieces = F.split(marked, _OPEN)

    def clean(p: Column, i: Column) -> Column:
        inside = F.regexp_replace(F.substring_index(p, _CLOSE, 1), drop, "")
        return F.when(i == 0, p).otherwise(F.concat(inside, F.substring_index(p, _CLOSE, -1)))

    return F.array_join(F.transform(pieces, clean), "")


def tokens(c: Column) -> Column:
    """The words of a normalized text; none for the empty text."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def normalize(c: Column, rules: RuleSet = INSTITUTIONS, unicode: bool = True) -> Column:
    """Canonical lower-case words, single-spaced. unicode=False leaves NFKC out (for ASCII text: the plan then has no Python)."""
    x = filled(c)
    for wrong, right in MOJIBAKE.items():
        x = F.replace(x, F.lit(wrong), F.lit(right))
    x = F.translate(x, _OPEN + _CLOSE, "")
    if unicode:
        x = nfkc(x)
    x = F.regexp_replace(x, r"(?<=[a-z])(?=[A-Z])", " ")
    x = _on_matches(x, r"(?U)\b(?:[A-Za-z]\s*\.\s*)+[A-Za-z]\.?(?=\s|$)", r"[^A-Za-z]")
    x = _on_matches(x, r"(?U)\b(?:[A-Z]\s+){1,5}[A-Z]\b", r"(?U)\s+")
    for letter, folded in _FOLD.items():
        x = F.replace(x, F.lit(letter), F.lit(folded))
    x = F.lower(x)
    x = F.regexp_replace(x, r"(?U)(?<=s)['’]s\b", "")
    x = F.regexp_replace(x, r"(?U)(?<=\w)['’]s\b", "s")
    x = F.regexp_replace(x, r"(?U)(?<=\w)['’](?=\s|$)", "")
    x = F.replace(x, F.lit("&"), F.lit(" and "))
    x = F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))
    fixed = mapped(rules.typos)
    return x if fixed is None else F.array_join(F.transform(F.split(x, " "), lambda t: F.coalesce(F.element_at(fixed, t), t)), " ")


def canonical(c: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    """The canonical location of a normalized location."""
    names = mapped(rules.aliases)
    return c if names is None else F.coalesce(F.element_at(names, c), c)


def match_key(name: Column, location: Column, region: Column, rules: RuleSet = INSTITUTIONS, unicode: bool = True) -> Column:
    """normalized name || canonical location || normalized region."""
    return F.concat_ws("||", normalize(name, rules, unicode), canonical(normalize(location, rules, unicode), rules), normalize(region, rules, unicode))


def without_alias(c: Column, rules: RuleSet = INSTITUTIONS, unicode: bool = True) -> Column:
    """Normalized name without a [bracketed] alias and the hyphen before it."""
    return normalize(F.regexp_replace(filled(c), r"(?U)\s*-?\s*\[[^\]]+\]", " "), rules, unicode)


def match_phrase(clean: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    """A normalized text without legal and status words."""
    noise = list(rules.match_noise)
    return F.array_join(F.filter(tokens(clean), lambda t: ~t.isin(noise)), " ") if noise else clean


def distinct_tokens(clean: Column, stop) -> Column:
    """Distinct words of over one letter that are not in `stop`."""
    stop = list(stop)
    return F.array_distinct(F.filter(tokens(clean), lambda t: (F.length(t) > 1) & (~t.isin(stop) if stop else F.lit(True))))


def identity_tokens(clean: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    return distinct_tokens(clean, rules.identity_noise)


def meaningful_tokens(clean: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    return distinct_tokens(clean, rules.generic)


def fingerprint(clean: Column) -> Column:
    """The words in order, repeats kept."""
    return F.array_join(F.array_sort(tokens(clean)), " ")


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def prefix_acronyms(words: Column) -> Column:
    """Initials of the first 2, 3, ... words, as far as they have 2 to 12 letters."""
    whole, n = _initials(words), F.least(F.size(words), F.lit(12))
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.substring(whole, F.lit(1), k)))).otherwise(arr(()))


def derived_acronyms(clean: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    stop = list(rules.abbreviation_stop)
    return prefix_acronyms(F.filter(tokens(clean), lambda t: ~t.isin(stop)) if stop else tokens(clean))


def initialisms(clean: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    """All acronym evidence of an input: prefix acronyms, short words themselves, a short first word with initials after it, promoter and unit."""
    stop = [*rules.abbreviation_stop, *rules.input_acronym_stop]
    words = F.filter(tokens(clean), lambda t: ~t.isin(stop))
    derived = prefix_acronyms(F.filter(words, lambda t: ~t.isin(list(rules.abbreviation_stop))))
    short = F.filter(words, lambda t: F.length(t).between(2, 12))
    first, rest, n = F.get(words, F.lit(0)), _initials(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))), F.size(words)
    compact = F.when((n >= 2) & F.length(first).between(2, 5), F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.concat(first, F.substring(rest, F.lit(1), k))), lambda v: F.length(v) <= 12)).otherwise(arr(()))
    unit = F.lit(None).cast("string")
    for suffix, needed, before in reversed(rules.unit_suffixes):
        at = F.array_position(words, before).cast("int") - 1
        initials = _initials(F.slice(words, F.lit(1), F.greatest(at, F.lit(0))))
        has = F.size(F.array_except(arr(needed), words)) == 0
        unit = F.when(has, F.when((at > 0) & (F.length(initials) >= 3), F.substring(F.concat(initials, F.lit(suffix)), 1, 12))).otherwise(unit)
    return F.array_compact(F.array_distinct(F.concat(derived, short, compact, F.array(unit))))


def domain_markers(clean: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    """The groups of the academic-domain words of a text."""
    if not rules.domains:
        return arr(())
    own, groups = F.array_intersect(tokens(clean), arr(rules.domains)), mapped(rules.domain_groups)
    return own if groups is None else F.array_distinct(F.transform(own, lambda t: F.coalesce(F.element_at(groups, t), t)))


def intents(clean: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    """Course concepts named in a text."""
    padded = F.concat(F.lit(" "), clean, F.lit(" "))
    found = []
    for intent, phrases in rules.intents.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(padded, F.lit(p))
        found.append(F.when(hit, F.lit(intent)))
    return F.array_compact(F.array(*found)) if found else arr(())


def families(clean_name: Column, clean_short: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    """The national systems a record belongs to."""
    both, first = F.concat_ws(" ", clean_name, clean_short), F.get(tokens(clean_short), F.lit(0))
    found = []
    for name, (phrase, never) in rules.families.items():
        hit = F.contains(both, F.lit(phrase)) | F.coalesce(first == name, F.lit(False)) | F.startswith(clean_name, F.lit(name + " "))
        found.append(F.when(hit & ~F.contains(both, F.lit(never)) if never else hit, F.lit(name)))
    return F.array_compact(F.array(*found)) if found else arr(())


def structural_identity(raw: Column, rules: RuleSet = INSTITUTIONS, unicode: bool = True) -> Column:
    """The part of a comma-separated label that names the institution."""
    parts = F.filter(F.transform(F.split(filled(raw), ","), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    raws = F.array_join(parts, "\u0003")
    # segments are normalized at once: the separator survives as a word of its own
    clean = F.transform(F.split(_segments(raws, rules, unicode), "\u0003"), lambda s: F.trim(s))
    markers = arr(rules.identity_markers)
    hits = F.transform(clean, lambda s: F.arrays_overlap(tokens(s), markers)) if rules.identity_markers else F.transform(clean, lambda s: F.lit(False))
    start = F.greatest(F.array_position(hits, True).cast("int"), F.lit(1))
    first, later = F.get(clean, start - 1), F.slice(clean, start + 1, F.greatest(F.size(clean) - start, F.lit(0)))
    pair = F.split(F.get(parts, start - 1), r"(?U)\s+-\s+", 2)
    named = F.trim(_segments(F.get(pair, F.lit(1)), rules, unicode))
    words = tokens(first)
    leads = F.get(words, F.lit(0)).isin("department", "faculty", "school", "institute", "college") | F.startswith(first, F.lit("university institute "))
    parent = F.get(F.filter(later, lambda s: F.arrays_overlap(tokens(s), arr(("university", "college", "institute", "iit", "nit", "iiit")))), F.lit(0))
    college = F.get(F.filter(later, lambda s: F.contains(F.concat(F.lit(" "), s, F.lit(" ")), F.lit(" college ")) & (F.size(identity_tokens(s, rules)) > 0)), F.lit(0))
    is_parent = F.arrays_overlap(words, arr(("university", "technology")))
    return (
        F.when(F.size(parts) == 0, "")
        .when((F.size(pair) == 2) & F.contains(F.concat(F.lit(" "), named, F.lit(" ")), F.lit(" college ")), named)
        .when(F.coalesce(leads, F.lit(False)) & parent.isNotNull(), F.trim(F.concat_ws(" ", first, parent)))
        .when(F.coalesce(is_parent, F.lit(False)) & college.isNotNull(), college)
        .otherwise(first)
    )


def _segments(c: Column, rules: RuleSet, unicode: bool) -> Column:
    """normalize() of each part between separators, parts kept apart."""
    parts = F.split(F.coalesce(c, F.lit("")), "\u0003")
    if unicode:
        parts = F.split(nfkc(F.coalesce(c, F.lit(""))), "\u0003")
    return F.array_join(F.transform(parts, lambda s: normalize(s, rules, unicode=False)), "\u0003")
