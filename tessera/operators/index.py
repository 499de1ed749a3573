"""The master index: one wide record per master id and posting tables (key, master_id)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import locations as L
from .rules import INSTITUTIONS, RuleSet

REQUIRED = ("master_id", "name", "city", "state")
OPTIONAL = ("short_form", "category")


def validated(master: DataFrame) -> DataFrame:
    """Required columns are checked, optional ones default to ''; ids that are no numbers are an error where they are used."""
    missing = sorted(set(REQUIRED) - set(master.columns))
    if missing:
        raise ValueError(f"Master is missing columns: {missing}")
    for c in OPTIONAL:
        if c not in master.columns:
            master = master.withColumn(c, F.lit(""))
    text = [X.filled(F.col(c)).alias(c) for c in ("name", "city", "state", *OPTIONAL)]
    return master.select(F.col("master_id").cast("long").alias("master_id"), *text, *(c for c in ("_row_id",) if c in master.columns))


def supplemented(master: DataFrame, rules: RuleSet = INSTITUTIONS) -> DataFrame:
    """Rows of the rule set whose id the master lacks are appended."""
    if not rules.supplement:
        return master
    more = master.sparkSession.createDataFrame([tuple(r) for r in rules.supplement], "master_id long, name string, city string, state string, short_form string, category string")
    new = more.join(master.select("master_id").where("master_id is not null"), "master_id", "left_anti")
    if "_row_id" in master.columns:
        new = new.withColumn("_row_id", F.lit(1 << 62))
    return master.unionByName(new)


def kindred(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can't be told apart by the rules: records, one row per id (master_id, kin, name, city, state), kin being the smallest id of those whose
    last row has the same name, city, short form and category and whose other rows have the same texts; and the rows of each kin under that id, with how
    many ids it stands for (n) and how many of them are not null (ids)."""
    m = master if "_row_id" in master.columns else master.withColumn("_row_id", F.monotonically_increasing_id())
    text = F.struct("name", "city", "short_form")
    one = m.groupBy("master_id").agg(F.max_by(F.struct("name", "city", "state", "short_form", "category"), "_row_id").alias("r"), F.collect_set(text).alias("texts")).select("master_id", "r.*", "texts")
    one = L.cut(one.withColumn("texts", F.sort_array(F.array_except("texts", F.array(text)))))
    same = ["name", "city", "short_form", "category", "texts"]
    kin = L.cut(one.groupBy(same).agg(F.min("master_id").alias("kin"), F.count("*").alias("n"), F.count("master_id").alias("ids")))
    records = L.cut(one.join(kin.select(*same, "kin"), same).select("master_id", "kin", "name", "city", "state"))
    own = kin.select(F.col("kin").alias("master_id"), "category", "n", "ids", F.lit(1).alias("_row_id"), *same[:3])
    others = kin.select(F.col("kin").alias("master_id"), "category", "n", "ids", F.lit(0).alias("_row_id"), F.explode("texts").alias("t")).select("master_id", "category", "n", "ids", "_row_id", "t.*")
    return records, own.unionByName(others).withColumn("state", F.lit(""))


def expanded(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of kin as rows of all their records."""
    own = records.select(F.col("kin").alias("_own"), "master_id")
    rows = rows.withColumnRenamed("master_id", "_kin")
    return rows.join(own, F.col("_kin").eqNullSafe(F.col("_own"))).drop("_kin", "_own")


def last_record(rows: DataFrame) -> DataFrame:
    """Of rows with one id, the last."""
    cols = [c for c in rows.columns if c not in ("master_id", "_row_id")]
    return rows.groupBy("master_id").agg(F.max_by(F.struct(*cols), "_row_id").alias("r")).select("master_id", "r.*")


def postings(rows: DataFrame, keys: Column) -> DataFrame:
    """Distinct (key, master_id) of an array column; empty keys are never kept."""
    return rows.select(F.explode(keys).alias("key"), "master_id").where("key <> ''").distinct()


def enriched(master: DataFrame, rules: RuleSet = INSTITUTIONS, unicode: bool = True) -> DataFrame:
    """The normalized forms, tokens, acronyms and name variants of each row."""
    n = lambda c: X.normalize(c, rules, unicode)
    m = master if "_row_id" in master.columns else master.withColumn("_row_id", F.monotonically_increasing_id())
    m = m.withColumns({"clean_name": n(F.col("name")), "base_name": X.without_alias(F.col("name"), rules, unicode), "clean_short": n(F.col("short_form")), "raw_city": n(F.col("city"))})
    m = m.withColumns({"clean_city": X.canonical(F.col("raw_city"), rules), "match_name": X.match_phrase(F.col("clean_name"), rules), "match_base": X.match_phrase(F.col("base_name"), rules), "match_short": X.match_phrase(F.col("clean_short"), rules)})
    noise = list({*rules.identity_noise, *rules.match_noise})
    upper = F.transform(F.regexp_extract_all(F.col("short_form"), F.lit(r"\b([A-Z][A-Z0-9]{1,})\b"), F.lit(1)), F.lower)
    upper = F.filter(upper, lambda t: (F.length(t) <= 12) & (~t.isin(noise) if noise else F.lit(True)))
    alias = F.filter(F.transform(F.regexp_extract_all(F.col("name"), F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda t: F.replace(X.normalize(t, rules, unicode=False), F.lit(" "), F.lit(""))), lambda t: t != "")
    m = m.withColumns({"bracket": alias, "short_acronyms": F.array_distinct(F.concat(upper, alias))})
    grown = F.flatten(F.transform(F.filter(F.col("short_acronyms"), lambda a: F.length(a) >= 4), lambda a: F.transform(F.sequence(F.lit(3), F.length(a)), lambda k: F.substring(a, F.lit(1), k))))
    words = X.tokens(F.col("raw_city"))
    bare = F.array_join(F.filter(X.tokens(F.col("base_name")), lambda t: ~F.array_contains(words, t)), " ")
    short = F.replace(F.col("clean_short"), F.lit(" "), F.lit(""))
    abbreviations = F.array_distinct(F.filter(F.concat(X.derived_acronyms(F.col("clean_name"), rules), X.derived_acronyms(F.col("base_name"), rules), X.derived_acronyms(bare, rules), F.col("bracket"), F.array(short)), lambda a: a != ""))
    elsewhere = lambda ts: F.filter(ts, lambda t: X.canonical(t, rules) != F.col("clean_city"))
    m = m.withColumns({"acronym_keys": F.array_distinct(F.concat("short_acronyms", grown)), "abbreviations": abbreviations, "ident_base": elsewhere(X.identity_tokens(F.col("base_name"), rules)), "ident_short": elsewhere(X.identity_tokens(F.col("clean_short"), rules))})
    forms = F.concat(F.array("clean_name", "base_name", "clean_short", "match_base"), F.col("abbreviations"))
    placed = lambda city: F.transform(forms, lambda f: F.trim(F.concat_ws(" ", f, city)))
    variants = F.array_distinct(F.concat(forms, F.array("match_name", "match_short"), placed(F.col("raw_city")), placed(F.col("clean_city"))))
    prints = F.array_distinct(F.transform(F.array("match_name", "match_base", "match_short"), X.fingerprint))
    return m.withColumns({"variants": variants, "fingerprints": prints})


@dataclass
class Index:
    """dim: one record per id. The others are posting tables; phrases is the location dictionary. words counts the records of each name token; rare holds of
    each record the rarest tokens, of which a likely input shares one (`first`, see prefix()), and both of two for inputs with one token; heads the rarest token of each of its parent identities.

    kin is the same index with one record for all that the rules can't tell apart (see kindred()); its dim says for how many (n, and ids without null), and
    records which they are. Pairs with kin don't grow with the square of equal names."""

    dim: DataFrame
    variants: DataFrame
    fingerprints: DataFrame
    tokens: DataFrame
    acronyms: DataFrame
    locations: DataFrame
    phrases: DataFrame
    phrases_size: tuple[int, int]
    words: DataFrame
    rare: DataFrame
    heads: DataFrame
    records: DataFrame | None = None
    kin: Index | None = None


#: A literal identity needs this share of the tokens of either side, and two tokens (or one, of an input that has no other).
LEAST_SHARE = 0.45


def prefix(tokens: Column) -> Column:
    """Of tokens in order of rarity, those of which any other list with a literal identity shares one: sharing t of n, it shares one of the first n - t + 1."""
    n = F.size(tokens)
    t = F.least(n, F.greatest(F.lit(2), F.ceil(n * LEAST_SHARE - 1e-9).cast("int")))
    return F.slice(tokens, F.lit(1), F.greatest(n - t + 1, F.lit(0)))


def by_rarity(rows: DataFrame, key: str, tokens: str, words: DataFrame) -> DataFrame:
    """key and its tokens, the rarest first; unknown ones are the rarest."""
    each = rows.select(key, F.explode(tokens).alias("k")).join(words, "k", "left")
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k"))).alias("t")).select(key, F.transform("t", lambda x: x["k"]).alias(tokens))


def build(master: DataFrame, rules: RuleSet = INSTITUTIONS, unicode: bool = True) -> Index:
    """Postings hold all rows; of rows with one id the last is the record. All is derived once for the records that can't be told apart; their enriched
    rows, the phrases and the records are written once: everything else is made from them."""
    records, rows = kindred(supplemented(validated(master), rules))
    kin = _build_kin(rows, rules, unicode)
    own = records.select(F.col("kin").alias("_own"), "master_id", "name", "city", "state")
    dim = kin.dim.drop("name", "city", "state", "n", "ids").withColumnRenamed("master_id", "_kin").join(own, F.col("_kin").eqNullSafe(F.col("_own"))).drop("_kin", "_own")
    postings_of = {t: expanded(getattr(kin, t), records) for t in ("variants", "fingerprints", "tokens", "acronyms", "locations", "rare", "heads")}
    return replace(kin, dim=dim, **postings_of, records=records, kin=kin)


def _build_kin(rows: DataFrame, rules: RuleSet, unicode: bool) -> Index:
    """The index of rows that stand for n records each."""
    rows = L.cut(enriched(rows, rules, unicode))
    phrases = L.cut(L.phrase_dictionary(rows.select(F.col("raw_city").alias("raw"), F.col("clean_city").alias("clean")), rules))
    size = L.measure(phrases)
    dim = last_record(rows.drop("variants", "fingerprints"))
    dim = L.with_location(dim, "clean_name", phrases, rules, "name_city", size=size)
    dim = L.with_location(dim, "clean_short", phrases, rules, "short_city", size=size)
    dim = dim.withColumn("cities", F.array_distinct(F.filter(F.array("clean_city", "name_city", "short_city"), lambda c: c != "")))
    dim = L.cut(dim)
    acronyms = postings(rows, F.col("acronym_keys"))
    located = postings(dim, F.col("cities")).union(postings(rows, F.array("clean_city"))).distinct()
    counted = rows.select(F.explode("acronym_keys").alias("key"), "master_id", "n", "ids").where("key <> ''").distinct()
    once = counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("master_id").alias("master_id")).where("n = 1")
    once = once.groupBy("master_id").agg(F.collect_set("key").alias("unique_keys"))
    by_city = counted.join(located.withColumnRenamed("key", "place"), "master_id").groupBy("key", "place").agg(F.sum("ids").alias("n"), F.min("master_id").alias("master_id")).where("n = 1")
    by_city = by_city.groupBy("master_id").agg(F.collect_set(F.concat_ws("|", "key", "place")).alias("city_keys"))
    empty = X.arr(())
    dim = dim.join(once, "master_id", "left").join(by_city, "master_id", "left").withColumns({"unique_keys": F.coalesce("unique_keys", empty), "city_keys": F.coalesce("city_keys", empty)})
    name = F.col("clean_name")
    dim = dim.withColumns({
        "name_tokens": F.array_distinct(F.concat(X.identity_tokens(name, rules), X.identity_tokens(F.col("base_name"), rules), X.identity_tokens(F.col("clean_short"), rules))),
        "domain": X.domain_markers(F.concat_ws(" ", "clean_name", "base_name"), rules), "delivery": F.array_intersect(X.tokens(F.col("base_name")), X.arr(rules.delivery)),
        "families": X.families(name, F.col("clean_short"), rules), "values": F.array_distinct(F.concat(F.array("clean_name", "base_name", "clean_short"), F.col("abbreviations"))),
    })
    tokens = postings(rows, F.concat("ident_base", "ident_short"))
    dim = L.cut(dim.join(tokens.groupBy("master_id").agg(F.collect_set("key").alias("posted")), "master_id", "left").withColumn("posted", F.coalesce("posted", empty)))
    words = dim.select(F.explode("name_tokens").alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n"))
    ranked = by_rarity(dim, "master_id", "name_tokens", words)
    # inputs with one token match records of at most two, on either
    rare = ranked.select("master_id", prefix(F.col("name_tokens")).alias("first"), F.explode(F.when(F.size("name_tokens") <= 2, F.col("name_tokens")).otherwise(prefix(F.col("name_tokens")))).alias("k"))
    rare = rare.select("master_id", "k", F.array_contains("first", F.col("k")).alias("first"))
    heads = None
    for c in ("ident_base", "ident_short"):
        own = by_rarity(dim, "master_id", c, words).select("master_id", F.get(c, F.lit(0)).alias("k"))
        heads = own if heads is None else heads.union(own)
    return Index(dim, postings(rows, F.col("variants")), postings(rows, F.col("fingerprints")), tokens, acronyms, located, phrases, size, words, rare, heads.distinct())


def city_unique(acronyms: DataFrame, located: DataFrame) -> DataFrame:
    """(acronym, location) pairs that name one id."""
    return acronyms.join(located.withColumnRenamed("key", "place"), "master_id").withColumn("n", F.count("*").over(W.partitionBy("key", "place"))).where("n = 1").drop("n")
