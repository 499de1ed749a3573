"""Predicates and scores of (probe, record) pairs, as Columns over a joined row.

A probe has p_input (what is ranked), p_bare (without its location phrase), p_loc, p_inits, p_tokens, p_words, p_domain; a record the columns of the
index. Gates come first and are native; the lexical term is computed for the rows they leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fuzzy import lexical_score
from . import locations as L
from .rules import INSTITUTIONS, RuleSet

PARENT_REASON = "Explicit parent institution"


def unique_acronym(inits: Column, place: Column) -> Column:
    """Some shared acronym names this record alone, everywhere or in the input's location."""
    here = F.transform(inits, lambda a: F.concat_ws("|", a, place))
    return F.arrays_overlap(inits, F.col("unique_keys")) | ((place != "") & F.arrays_overlap(here, F.col("city_keys")))


def location_conflict(place: Column, inits: Column) -> Column:
    away = (place != "") & (F.size("cities") > 0) & ~F.array_contains(F.col("cities"), place)
    return F.coalesce(away & ~unique_acronym(inits, place), F.lit(False))


def delivery_conflict(bare: Column, rules: RuleSet = INSTITUTIONS) -> Column:
    own = F.array_intersect(X.tokens(bare), X.arr(rules.delivery))
    return (F.size("delivery") > 0) & (F.array_sort(own) != F.array_sort("delivery"))


def domain_conflict(domain: Column) -> Column:
    return (F.size(domain) > 0) & (F.size("domain") > 0) & ~F.arrays_overlap(domain, F.col("domain"))


def parent_score(rules: RuleSet = INSTITUTIONS) -> Column:
    """96 to 100 where the input names this record as its parent institution; else null."""
    place, words, text = F.col("p_loc"), F.col("p_words"), F.col("p_input")
    if not rules.parent_markers:
        return F.lit(None).cast("double")
    base = X.tokens(F.col("base_name"))
    subs = X.arr(rules.subunits)
    asked = F.arrays_overlap(words, X.arr(rules.parent_markers)) & ~(F.arrays_overlap(base, subs) & ~F.arrays_overlap(words, subs))
    valid = (F.size(base) >= 3) | ((F.size(base) >= 2) & F.arrays_overlap(base, X.arr(rules.institution_words)))
    mine = X.meaningful_tokens(text, rules)
    inside = lambda ts: (F.size(ts) > 0) & (F.size(F.array_except(ts, mine)) == 0)
    b, s = F.col("ident_base"), F.col("ident_short")
    only_b, only_s = F.get(b, F.lit(0)), F.get(s, F.lit(0))
    base_hit = inside(b) & ((F.size(b) >= 2) | ((F.size(b) == 1) & (F.length(only_b) >= 4) & F.contains(text, F.col("base_name"))))
    short_one = (F.size(s) == 1) & (F.length(only_s) >= 3) & F.array_contains(F.col("short_acronyms"), only_s) & (only_s != place) & (only_s != F.col("clean_city")) & (place != "") & (place == F.col("clean_city"))
    short_hit = inside(s) & ((F.size(s) >= 2) | F.coalesce(short_one, F.lit(False)))
    accepted = (place == "") | (F.size("cities") == 0) | F.array_contains(F.col("cities"), place)
    specific = F.greatest(F.when(base_hit, F.size(b)).otherwise(0), F.when(short_hit, F.size(s)).otherwise(0))
    bonus = F.when(F.array_contains(F.col("short_acronyms"), F.get(words, F.lit(0))), 0.8).otherwise(0.0)
    near = (place != "") & F.array_contains(F.col("cities"), place)
    score = F.when(near, F.least(F.lit(100.0), 98.0 + specific * 0.4 + bonus)).otherwise(F.least(F.lit(99.0), 96.0 + specific * 0.4 + bonus))
    return F.when(F.coalesce(asked & valid & (base_hit | short_hit) & accepted, F.lit(False)), score)


def _coverage(shared: Column, whole: Column) -> Column:
    return F.when(F.size(whole) > 0, F.size(shared) / F.size(whole)).otherwise(0.0)


def features(pairs: DataFrame, rules: RuleSet = INSTITUTIONS) -> DataFrame:
    """Gates, coverages and acronym evidence of each pair."""
    place, mine = F.col("p_loc"), F.col("p_tokens")
    d = pairs.withColumns({
        "shared": F.array_intersect(mine, F.col("name_tokens")), "shared_acr": F.array_intersect(F.col("p_inits"), F.col("acronym_keys")), "unique_acr": unique_acronym(F.col("p_all_inits"), place),
        "away": (place != "") & (F.size("cities") > 0) & ~F.array_contains(F.col("cities"), place), "same_city": (place != "") & F.array_contains(F.col("cities"), place),
    })
    literal = X.tokens(F.col("p_bare"))
    first = F.get(literal, F.lit(0))
    trusted = F.filter("shared_acr", lambda a: F.array_contains(literal, a) | F.coalesce(F.length(first).between(2, 5) & F.startswith(a, first), F.lit(False)) | (F.length(a) >= 5))
    ordered = F.filter(literal, lambda t: (F.length(t) > 1) & (~t.isin(list(rules.identity_noise)) if rules.identity_noise else F.lit(True)))
    two = F.when(F.size(ordered) >= 2, F.concat(F.substring(F.get(ordered, F.lit(0)), 1, 1), F.substring(F.get(ordered, F.lit(1)), 1, 1))).otherwise("")
    overlaps = [F.least(_coverage(F.array_intersect(mine, t), mine), _coverage(F.array_intersect(mine, t), t)) for t in (X.identity_tokens(F.col(c), rules) for c in ("clean_name", "base_name", "clean_short"))]
    d = d.withColumns({"trusted": trusted, "two_letter": F.col("same_city") & (two != "") & F.array_contains(F.col("shared_acr"), two), "cov_in": _coverage(F.col("shared"), mine), "cov_rec": _coverage(F.col("shared"), F.col("name_tokens")),
                       "overlap": F.greatest(F.when(F.size("shared_acr") > 0, 0.9).otherwise(0.0), *overlaps)})
    in_city = (place != "") & F.arrays_overlap(F.transform("trusted", lambda a: F.concat_ws("|", a, place)), F.col("city_keys"))
    reliable = ((F.size("trusted") > 0) | F.col("two_letter")) & (in_city | F.col("two_letter") | (F.exists("trusted", lambda a: F.length(a) >= 4) & F.col("same_city")))
    reliable = reliable & ~((F.size(mine) >= 3) & (F.col("cov_in") < 0.45))
    literal_id = ((F.size("shared") >= 2) & (F.col("cov_in") >= 0.45) & (F.col("cov_rec") >= 0.45)) | ((F.size("shared") == 1) & (F.col("cov_in") >= 0.75) & (F.col("cov_rec") >= 0.5) & (F.length(F.get("shared", F.lit(0))) >= 4))
    return d.withColumns({"reliable": F.coalesce(reliable, F.lit(False)), "literal_id": F.coalesce(literal_id, F.lit(False)), "parent": parent_score(rules),
                          "gate": (F.col("away") & ~F.col("unique_acr")) | delivery_conflict(F.col("p_bare"), rules) | domain_conflict(F.col("p_domain"))})


def _exact_city() -> Column:
    return (F.col("p_loc") != "") & (F.col("p_loc") == F.col("clean_city"))


def _three_signals() -> Column:
    """Acronym, category and city agree."""
    return (F.size("trusted") > 0) & F.arrays_overlap(F.col("p_domain"), F.col("domain")) & _exact_city()


def _unconfirmed_domain() -> Column:
    return (F.size("p_domain") > 0) & (F.size("domain") == 0)


def score_without_lexical() -> Column:
    """The score of a pair that passed the gates, given `lexical` (0 to 100)."""
    c = F.col("lexical") * 0.6 + F.least("cov_in", "cov_rec") * 30.0
    c = c - F.when(F.col("overlap") == 0, 50).when(F.col("overlap") < 0.5, 18).otherwise(0)
    c = c + F.when(_exact_city(), 15).otherwise(0)
    c = c - F.when(_unconfirmed_domain(), 25).otherwise(0)
    c = F.when(_three_signals(), F.greatest(c, F.lit(98.0))).when(F.col("reliable") & F.col("same_city"), F.greatest(c, F.lit(90.0))).otherwise(c)
    c = F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    return F.when(F.col("away") & F.col("unique_acr"), F.least(c, F.lit(75.0))).otherwise(c)


def reason() -> Column:
    """What raised and lowered the score of a pair."""
    return F.concat_ws(
        ", ",
        F.concat(F.lit("Name similarity "), X.fixed(F.col("lexical"), 1)),
        F.concat(F.lit("identity-token overlap "), X.fixed(F.col("overlap"), 2)),
        F.when(F.col("overlap") == 0, "no meaningful name-token match").when(F.col("overlap") < 0.5, "weak meaningful-token match"),
        F.when(_exact_city(), "exact city match"),
        F.when(_unconfirmed_domain(), "candidate does not confirm institution category"),
        F.when(_three_signals(), "abbreviation, institution category and city confirmed").when(F.col("reliable") & F.col("same_city"), "maintained acronym and campus confirmed"),
        F.when(F.col("away") & F.col("unique_acr"), "unique acronym match but city requires review"),
    )


def scored(pairs: DataFrame, rules: RuleSet = INSTITUTIONS, scorer: str = "difflib") -> DataFrame:
    """Pairs with a score above zero: key, master_id, confidence, overlap, reason. The lexical UDF sees only what the gates leave. Pairs marked `by_words`
    alone are candidates only if they share a posted word, or a word and the location."""
    parent, out = F.col("parent").isNotNull(), ["key", "master_id", "confidence", "overlap", "reason"]
    if "by_words" in pairs.columns:
        here = (F.col("p_loc") != "") & F.array_contains("cities", F.col("p_loc"))
        pairs = pairs.where(~F.col("by_words") | F.arrays_overlap("p_tokens", "posted") | here)
    f = features(pairs, rules).where(~F.col("gate") & (parent | F.col("literal_id") | F.col("reliable")))
    # what the gates leave is written, so that the gates are neither computed again nor mixed with the ratios
    f = L.cut(f.select("key", "master_id", "parent", "p_input", "p_bare", "p_loc", "p_domain", "values", "clean_city", "domain", "cov_in", "cov_rec", "overlap", "trusted", "reliable", "same_city", "away", "unique_acr"))
    # named parents need no ratio
    f = f.withColumn("lexical", lexical_score(F.col("p_input"), F.col("p_bare"), F.when(parent, X.arr(())).otherwise(F.col("values")), scorer))
    f = f.withColumns({"confidence": F.when(parent, F.col("parent")).otherwise(score_without_lexical()), "reason": F.when(parent, PARENT_REASON).otherwise(reason()), "overlap": F.when(parent, 1.0).otherwise(F.col("overlap"))})
    return f.where("confidence > 0").select(*out)
