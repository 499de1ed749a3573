"""The decision cascade: each distinct input is FOUND, NEEDS_REVIEW or NOT_FOUND, with an id, a confidence and a reason.

Rules are small joins that each propose decisions with a rule number; the first that applies wins. Ranking runs only for inputs that no earlier rule
has decided. Ties between candidates go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fuzzy import ratio
from ..operators import index as I
from ..operators import locations as L
from ..operators import scoring as S
from ..operators.rules import INSTITUTIONS, RuleSet

RESULT = "input_name string, normalized_name string, match_key string, input_city string, input_state string, decision string, master_id long, matched_name string, confidence double, reason string"


def with_keys(target: DataFrame, name: str, city: str | None = None, state: str | None = None, rules: RuleSet = INSTITUTIONS, unicode: bool = True) -> DataFrame:
    """Adds match_key to every row."""
    c = lambda x: X.filled(F.col(x)) if x else F.lit("")
    return target.withColumn("match_key", X.match_key(c(name), c(city), c(state), rules, unicode))


def distinct_inputs(rows: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """One input per key: that of the first row."""
    return rows.groupBy("match_key").agg(F.min_by(F.struct("name", "city", "state"), row_id).alias("r")).select("match_key", "r.*")


def probes(inputs: DataFrame, index: I.Index, rules: RuleSet, unicode: bool) -> DataFrame:
    n = lambda c: X.normalize(c, rules, unicode)
    p = inputs.select(F.col("match_key").alias("key"), *(X.filled(F.col(c)).alias(c) for c in ("name", "city", "state")))
    p = p.withColumns({"clean": n(F.col("name")), "raw_id": X.structural_identity(F.col("name"), rules, unicode), "clean_city_in": X.canonical(n(F.col("city")), rules)})
    p = p.withColumn("identity", X.match_phrase(F.col("raw_id"), rules))
    # each detection reads its input twice: written first, so that plans do not double
    p = L.with_location(L.cut(p), "clean", index.phrases, rules, "name_loc", size=index.phrases_size)
    add = (F.col("clean_city_in") != "") & (F.col("name_loc") == "")
    p = p.withColumn("context", F.when(add, n(F.concat_ws(" ", "name", "city"))).otherwise(F.col("clean")))
    p = L.with_location(L.cut(p), "context", index.phrases, rules, "loc", size=index.phrases_size)
    p = p.withColumn("ctx_inits", X.initialisms(F.col("context"), rules))
    p = p.withColumn("p_input", F.when((F.col("loc") != "") & ~F.contains(F.col("identity"), F.col("loc")), F.trim(F.concat_ws(" ", "identity", "loc"))).otherwise(F.col("identity")))
    p = L.with_location(L.cut(p), "p_input", index.phrases, rules, "p_loc", "p_phrase", index.phrases_size)
    p = p.withColumn("p_bare", L.without_phrase(F.col("p_input"), F.col("p_phrase")))
    return p.withColumns({"p_inits": X.initialisms(F.col("p_bare"), rules), "p_all_inits": X.initialisms(F.col("p_input"), rules), "p_tokens": X.identity_tokens(F.col("p_bare"), rules), "p_words": X.tokens(F.col("p_input")), "p_domain": X.domain_markers(F.col("p_bare"), rules)})


def exact_hits(p: DataFrame, index: I.Index) -> DataFrame:
    """(key, master_id) by the first tier that has any: raw identity, identity, fingerprint."""
    tiers = [p.select("key", F.col(c).alias("k")).join(t.withColumnRenamed("key", "k"), "k").select("key", "master_id", F.lit(i).alias("tier")) for i, (c, t) in enumerate((("raw_id", index.variants), ("identity", index.variants), ("print", index.fingerprints)))]
    every = tiers[0].union(tiers[1]).union(tiers[2]).where("key is not null")
    return every.withColumn("best", F.min("tier").over(W.partitionBy("key"))).where("tier = best").select("key", "master_id").distinct()


def candidates(p: DataFrame, index: I.Index, rules: RuleSet) -> DataFrame:
    """(key, master_id, only_parent, only_local) by shared identity tokens, acronyms, named parents, and records of the input's location that share a name token."""
    by = lambda keys, t: p.select("key", F.explode(keys).alias("k")).join(t.withColumnRenamed("key", "k"), "k").select("key", "master_id")
    kind = lambda df, parent, local: df.select("key", "master_id", F.lit(parent).alias("only_parent"), F.lit(local).alias("only_local"))
    out = kind(by(F.col("p_tokens"), index.tokens).union(by(F.col("p_inits"), index.acronyms)), False, False)
    if rules.parent_markers:
        marked = p.where(F.arrays_overlap("p_words", X.arr(rules.parent_markers)))
        named = marked.select("key", F.explode(X.meaningful_tokens(F.col("p_input"), rules)).alias("k")).join(index.tokens.withColumnRenamed("key", "k"), "k")
        out = out.union(kind(named, True, False))
    # a record of the location without a shared name token can only be rejected, so tokens and location are one join key
    named = index.dim.select("master_id", F.explode("cities").alias("place"), "name_tokens").select("master_id", "place", F.explode("name_tokens").alias("k"))
    local = p.where("p_loc <> ''").select("key", F.col("p_loc").alias("place"), F.explode("p_tokens").alias("k")).join(named, ["place", "k"])
    return out.union(kind(local, False, True)).groupBy("key", "master_id").agg(F.min("only_parent").alias("only_parent"), F.min("only_local").alias("only_local"))


def fallback(lone: DataFrame, index: I.Index, scorer: str = "difflib", limit: int = 100, cutoff: float = 25.0) -> DataFrame:
    """key, variant and rank: the variants that share a word with an input (key, p_input), by ratio, the best `limit` from `cutoff` up. A variant without a
    shared word leads to no record that could pass the identity gate."""
    words = index.variants.select(F.col("key").alias("variant")).distinct().select("variant", F.explode(X.tokens(F.col("variant"))).alias("k"))
    pairs = lone.select("key", "p_input", F.explode(F.array_distinct(X.tokens(F.col("p_input")))).alias("k")).join(words, "k").select("key", "p_input", "variant").distinct()
    near = pairs.withColumn("confidence", ratio(F.col("p_input"), F.col("variant"), scorer)).where(F.col("confidence") >= cutoff)
    return rank(near.withColumnRenamed("variant", "master_id"), limit).select("key", F.col("master_id").alias("variant"), "rank", "confidence")


def _weighed(dim: DataFrame) -> DataFrame:
    """Records with `ids`, how many ids each stands for: one, unless they are kin."""
    return dim if "ids" in dim.columns else dim.withColumn("ids", F.lit(1))


def _only(df: DataFrame) -> DataFrame:
    """Keys with one id. With a column `ids` a row stands for so many."""
    if "ids" in df.columns:
        each = df.where("master_id is not null").select("key", "master_id", "ids").distinct()
        return each.groupBy("key").agg(F.sum("ids").alias("n"), F.min("master_id").alias("master_id")).where("n = 1").select("key", "master_id")
    return df.groupBy("key").agg(F.count_distinct("master_id").alias("n"), F.min("master_id").alias("master_id")).where("n = 1").select("key", "master_id")


def named_parents(p: DataFrame, index: I.Index, dim: DataFrame, rules: RuleSet) -> DataFrame:
    """(key, master_id) of records that an input with a parent marker names as its parent. All words of a parent's identity are in the input, so its
    rarest one is joined."""
    if not rules.parent_markers:
        return p.select("key", F.lit(None).cast("long").alias("master_id")).limit(0)
    marked = p.where(F.arrays_overlap("p_words", X.arr(rules.parent_markers)))
    pairs = marked.select("key", F.explode(X.meaningful_tokens(F.col("p_input"), rules)).alias("k")).join(index.heads, "k").select("key", "master_id").distinct()
    return _unconflicted(pairs, marked, dim).where(~F.col("conflict") & S.parent_score(rules).isNotNull()).select("key", "master_id")


def word_pairs(p: DataFrame, index: I.Index) -> DataFrame:
    """(key, master_id) of all pairs that may share enough name tokens for a literal identity, by their rarest tokens."""
    mine = I.by_rarity(p, "key", "p_tokens", index.words)
    mine = mine.select("key", (F.size("p_tokens") == 1).alias("alone"), F.explode(I.prefix(F.col("p_tokens"))).alias("k"))
    return mine.join(index.rare, "k").where("alone or first").select("key", "master_id").distinct()


def ranking_pool(rest: DataFrame, index: I.Index, dim: DataFrame, rules: RuleSet, scorer: str) -> tuple[DataFrame, DataFrame]:
    """(key, master_id, by_words) of the candidates that can score above zero, and the keys that have any candidate by words, acronyms or parents. The
    other keys get the candidates of the fuzzy fallback."""
    parents = L.cut(named_parents(rest, index, dim, rules))
    acronyms = rest.select("key", F.explode("p_inits").alias("k")).join(index.acronyms.withColumnRenamed("key", "k"), "k").select("key", "master_id")
    known = lambda keys, t: rest.select("key", F.explode(keys).alias("k")).join(t.select(F.col("key").alias("k")).distinct(), "k", "left_semi").select("key")
    touched = L.cut(known("p_tokens", index.tokens).union(known("p_inits", index.acronyms)).union(parents.select("key")).distinct())
    lone = rest.where("p_input <> ''").join(touched, "key", "left_anti")
    near = L.cut(fallback(lone, index, scorer).join(index.variants.withColumnRenamed("key", "variant"), "variant").select("key", "master_id"))
    sure = acronyms.union(parents).union(near).withColumn("by_words", F.lit(False))
    pool = sure.union(word_pairs(rest, index).withColumn("by_words", F.lit(True))).groupBy("key", "master_id").agg(F.min("by_words").alias("by_words"))
    return pool, touched.union(near.select("key")).distinct()


def _anything_near(rest: DataFrame, touched: DataFrame, index: I.Index, dim: DataFrame, rules: RuleSet, scorer: str) -> DataFrame:
    """Keys with some candidate, be its score zero, that doesn't lie elsewhere. Only where no record lies in the input's location are pairs looked at."""
    settled = rest.where("p_loc <> ''").join(index.locations.select(F.col("key").alias("p_loc")).distinct(), "p_loc", "left_semi").select("key")
    free = rest.where("loc = ''").join(touched, "key", "left_semi").select("key")
    odd = rest.where("loc <> ''").join(settled, "key", "left_anti").join(touched, "key", "left_semi")
    pairs = candidates(odd, index, rules).select("key", "master_id")
    return settled.union(free).union(_unconflicted(pairs, odd.select("key", "loc", "ctx_inits"), dim).where("not conflict").select("key")).distinct()


def _say(df: DataFrame, rule: int, decision: str, confidence: float, reason: str) -> DataFrame:
    return df.select("key", F.lit(rule).alias("rule"), "master_id", F.lit(decision).alias("decision"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def _unconflicted(pairs: DataFrame, p: DataFrame, dim: DataFrame) -> DataFrame:
    """Joined with probe and record, `conflict` added."""
    return pairs.join(p, "key").join(dim, "master_id").withColumn("conflict", S.location_conflict(F.col("loc"), F.col("ctx_inits")))


def match(master: DataFrame, inputs: DataFrame, rules: RuleSet = INSTITUTIONS, scorer: str = "difflib", unicode: bool = True, top: int = 5, index: I.Index | None = None, progress: Callable[[int, int, str], None] = lambda done, total, what: None) -> DataFrame:
    """Decisions for distinct inputs (match_key, name, city, state): one row per key, with up to `top` candidates. `progress` is told how many of the
    stages are done.

    Equal names and cities are decided once, among kin: records that the rules can't tell apart count for as many as they are, and are listed one by one
    only where they are ranked, up to `top` of each."""
    index = index or I.build(master, rules, unicode)
    progress(1, 4, "Master index built")
    records, index = index.records, index.kin
    dim = index.dim.drop("name", "city", "state")
    given = L.cut(inputs.select("match_key", *(X.filled(F.col(c)).alias(c) for c in ("name", "city", "state"))))
    p = given.groupBy("name", "city").agg(F.min("match_key").alias("match_key"), F.lit("").alias("state"))
    p = probes(p, index, rules, unicode).withColumn("print", X.fingerprint(F.col("identity")))
    p = L.cut(p)
    progress(2, 4, "Inputs prepared")
    found = []
    if rules.verified_absent:
        gone = list(rules.verified_absent)
        found.append(p.where(F.col("clean").isin(gone) | F.col("context").isin(gone)).select("key", F.lit(1).alias("rule"), F.lit(None).cast("long").alias("master_id"), F.lit("NOT_FOUND").alias("decision"), F.lit(0.0).alias("confidence"), F.lit("Verified absent institution; related brand and other-campus IDs are blocked").alias("reason")))
    for rule, alias, decision, confidence, reason in ((2, rules.verified, "FOUND", 100.0, "Verified exact business alias"), (3, rules.verified_review, "NEEDS_REVIEW", 92.0, "Explicit parent institution suggested; exact sub-unit record is absent from the master")):
        if alias:
            ids = X.mapped(alias)
            hit = p.select("key", F.coalesce(F.element_at(ids, F.col("clean")), F.element_at(ids, F.col("context"))).cast("long").alias("master_id")).where("master_id is not null")
            hit = hit.join(records.select("kin", "master_id"), "master_id").withColumnsRenamed({"master_id": "named", "kin": "master_id"})
            found.append(_say(_unconflicted(hit, p, dim).where("not conflict").withColumn("master_id", F.col("named")), rule, decision, confidence, reason))
    for brand in rules.brands:
        found.append(_say(_brand(p, index, dim, brand), 4, "FOUND", 98.0, f"{brand[0].capitalize()} parent university and campus city confirmed"))
    if rules.families:
        found.append(_say(_systems(p, index, dim, rules), 5, "FOUND", 99.0, "National institution acronym and city confirmed"))
    hits = L.cut(_unconflicted(exact_hits(p, index), p.select("key", "identity", "loc", "ctx_inits"), dim).select("key", "master_id", "ids", "conflict", "identity", "clean_name", "base_name", "match_name", "match_base", "clean_short"))
    sized = hits.withColumn("n_all", F.sum("ids").over(W.partitionBy("key")))
    found.append(_say(sized.where("n_all = 1 and conflict"), 7, "NEEDS_REVIEW", 70.0, "Unique institution name; input city differs from the master city and requires verification"))
    by = W.partitionBy("key")
    literal = F.col("identity").isin(F.col("clean_name"), F.col("base_name"), F.col("match_name"), F.col("match_base"))
    kept = hits.where("not conflict").withColumn("literal", literal).withColumn("any_literal", F.max("literal").over(by)).where("literal or not any_literal")
    spelled = kept.withColumn("full", (F.col("clean_short") == F.col("identity")).cast("int")).withColumn("n_full", F.sum(F.col("full") * F.col("ids")).over(by)).withColumn("n", F.sum("ids").over(by))
    found.append(_say(_only(spelled.where("n = 1 or n_full <> 1 or full = 1")), 8, "FOUND", 100.0, "Unique exact master match"))
    found.append(_say(_segments(p, index, dim, rules, unicode), 9, "NEEDS_REVIEW", 92.0, "Explicit parent institution confirmed; specialised sub-unit has no unique exact master record"))
    early = found[0]
    for f in found[1:]:
        early = early.union(f)
    cols = ["rule", "master_id", "decision", "confidence", "reason"]
    early = early.groupBy("key").agg(F.min_by(F.struct(*cols), F.struct("rule", F.coalesce("master_id", F.lit(0)))).alias("r")).select("key", "r.*")
    early = L.cut(early)
    progress(3, 4, "Exact rules applied")
    rest = L.cut(p.join(early.select("key"), "key", "left_anti"))
    pool, touched = ranking_pool(rest, index, dim, rules, scorer)
    ranked = rank(S.scored(pool.join(rest, "key").join(dim, "master_id"), rules, scorer), top)
    # of kin the first ids are enough: each of them is ahead of the others
    few = records.where("master_id is not null").withColumn("nth", F.row_number().over(W.partitionBy("kin").orderBy("master_id"))).where(F.col("nth") <= top).drop("nth")
    ranked = rank(ranked.drop("rank").withColumnRenamed("master_id", "kin").join(few, "kin"), top)
    ranked = ranked.withColumnsRenamed({"master_id": "own", "kin": "master_id", "name": "r_name", "city": "r_city", "state": "r_state"})
    ranked = _unconflicted(ranked, rest.select("key", "loc", "ctx_inits"), dim).where("not conflict")
    ranked = L.cut(ranked.select("key", F.col("own").alias("master_id"), "rank", "confidence", "overlap", "reason", "loc", "r_name", "r_city", "r_state", "category"))
    late = L.cut(decide(ranked, rules))
    progress(4, 4, "Candidates ranked")
    # what is left had candidates that all score zero, unless nothing was found or all of it lies elsewhere
    left = rest.join(late.select("key"), "key", "left_anti")
    seen = _anything_near(left, touched, index, dim, rules, scorer).withColumn("some", F.lit(True))
    empty = left.join(seen, "key", "left")
    empty = empty.select("key", F.lit(13).alias("rule"), F.lit(None).cast("long").alias("master_id"), F.lit("NOT_FOUND").alias("decision"), F.lit(0.0).alias("confidence"), F.when(F.col("some") & (F.col("p_input") != ""), "No credible master match").otherwise("No master candidate found").alias("reason"), _no_candidates().alias("candidates"))
    done = early.withColumn("candidates", _no_candidates()).unionByName(late).unionByName(empty)
    done = L.cut(done.join(records.select("master_id", F.col("name").alias("r_name")), "master_id", "left").join(p.select("key", "name", "clean", "city"), "key").drop("key"))
    out = given.join(done, ["name", "city"])
    return out.select(F.col("name").alias("input_name"), F.col("clean").alias("normalized_name"), "match_key", F.col("city").alias("input_city"), F.col("state").alias("input_state"), "decision", "master_id", F.col("r_name").alias("matched_name"), F.round("confidence", 2).alias("confidence"), "reason", "candidates")


CANDIDATE = "array<struct<rank:int,master_id:bigint,name:string,city:string,state:string,category:string,confidence:double,token_overlap:double,reason:string>>"


def _no_candidates():
    return F.array().cast(CANDIDATE)


def rank(scores: DataFrame, top: int = 5) -> DataFrame:
    """The best `top` pairs of each key."""
    w = W.partitionBy("key").orderBy(F.desc("confidence"), "master_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def decide(ranked: DataFrame, rules: RuleSet = INSTITUTIONS) -> DataFrame:
    """Accept, reject or review the best candidate by its confidence, overlap and margin over the next."""
    w = W.partitionBy("key").orderBy("rank")
    item = F.struct("rank", "master_id", F.col("r_name").alias("name"), F.col("r_city").alias("city"), F.col("r_state").alias("state"), "category", "confidence", F.col("overlap").alias("token_overlap"), "reason")
    every = ranked.groupBy("key").agg(F.array_sort(F.collect_list(item)).cast(CANDIDATE).alias("candidates"))
    best = ranked.withColumn("margin", F.col("confidence") - F.lead("confidence", 1, 0.0).over(w)).withColumn("first", F.row_number().over(w)).where("first = 1")
    parent = (F.col("reason") == S.PARENT_REASON) & (F.col("confidence") >= 97) & ((F.col("loc") != "") | (F.col("margin") >= 5))
    sure = (parent | ((F.col("confidence") >= 96) & (F.col("overlap") >= 0.75) & (F.col("margin") >= 8))) & F.lit(not rules.strict)
    weak = (F.col("overlap") == 0) | (F.col("confidence") < 20)
    best = best.withColumn("decision", F.when(sure, "FOUND").when(weak, "NOT_FOUND").otherwise("NEEDS_REVIEW"))
    reason = F.when(F.col("decision") == "FOUND", F.col("reason")).when(F.col("decision") == "NOT_FOUND", "No credible master match").otherwise(F.concat(F.lit("Ambiguous match; top-two margin "), X.fixed(F.col("margin"), 1)))
    best = best.select("key", F.lit(11).alias("rule"), F.when(F.col("decision") != "NOT_FOUND", F.col("master_id")).alias("master_id"), "decision", "confidence", reason.alias("reason"))
    return best.join(every, "key")


def _brand(p: DataFrame, index: I.Index, dim: DataFrame, brand: tuple) -> DataFrame:
    """The one parent record of a brand in the input's location."""
    word, start, lacks, category = brand
    asked = p.where(F.array_contains(X.tokens(F.col("clean")), word) & (F.col("loc") != "")).select("key", F.col("loc").alias("k"))
    parent = _weighed(dim).where(F.startswith("base_name", F.lit(start)) & ~F.arrays_overlap(X.tokens(F.col("base_name")), X.arr(lacks)) & (F.lower("category") == category)).select("master_id", "ids")
    return _only(asked.join(index.locations.withColumnRenamed("key", "k").join(parent, "master_id"), "k"))


def _systems(p: DataFrame, index: I.Index, dim: DataFrame, rules: RuleSet) -> DataFrame:
    """The one record of a national system in the input's location, narrowed by course concepts where several remain."""
    words = X.tokens(F.col("clean"))
    named = [F.when(F.contains("clean", F.lit(phrase)), F.lit(a)) for phrase, a in rules.system_phrases.items()]
    asked = p.withColumn("systems", F.array_distinct(F.concat(F.array_intersect(words, X.arr(rules.system_acronyms)), F.array_compact(F.array(*named)) if named else X.arr(()))))
    subs = X.arr(rules.system_subunits)
    asked = asked.where((F.size("systems") > 0) & (F.col("loc") != "")).select("key", "systems", F.col("loc").alias("k"), F.arrays_overlap(words, subs).alias("sub"), X.intents(F.col("clean"), rules).alias("asks"))
    records = _weighed(dim).where(F.size("families") > 0).select("master_id", "ids", "families", F.arrays_overlap(X.tokens(F.col("clean_name")), subs).alias("r_sub"), X.intents(F.concat_ws(" ", "clean_name", "clean_short"), rules).alias("has"))
    own = asked.join(index.locations.withColumnRenamed("key", "k").join(records, "master_id"), "k").where(F.arrays_overlap("systems", "families") & (F.col("sub") | ~F.col("r_sub")))
    by = W.partitionBy("key")
    own = own.withColumns({"fit": F.arrays_overlap("asks", "has").cast("int"), "main": (~F.col("r_sub")).cast("int")})
    own = own.withColumns({"n": F.sum("ids").over(by), "n_fit": F.sum(F.col("fit") * F.col("ids")).over(by), "n_main": F.sum(F.col("main") * F.col("ids")).over(by)})
    narrow = (F.size("asks") > 0) & (F.col("n") > 1)
    own = own.where(~(narrow & (F.col("n_fit") == 1)) | (F.col("fit") == 1)).where(~(narrow & (F.col("n_fit") == 0) & (F.col("n_main") == 1)) | (F.col("main") == 1))
    return _only(own)


def _segments(p: DataFrame, index: I.Index, dim: DataFrame, rules: RuleSet, unicode: bool = True) -> DataFrame:
    """The one record that the comma-separated parts of the label name, without location conflict."""
    parts = p.select("key", "loc", F.explode(F.split("name", ",")).alias("raw"))
    parts = parts.withColumn("segment", X.match_phrase(X.normalize(F.col("raw"), rules, unicode), rules)).where("segment <> ''")
    acr = F.transform(F.regexp_extract_all("raw", F.lit(r"\b([A-Z][A-Z0-9]{2,})\b"), F.lit(1)), F.lower)
    hit = lambda keys, t: parts.select("key", "segment", F.explode(keys).alias("k")).join(t.withColumnRenamed("key", "k"), "k").select("key", "segment", "master_id")
    plain = hit(F.array("segment"), index.variants).union(hit(acr, index.acronyms))
    anchors = X.arr(("university", "college", "institute", "iit", "nit", "iiit"))
    open_ = parts.join(plain.select("key", "segment").distinct(), ["key", "segment"], "left_semi").union(parts.where(F.arrays_overlap(X.tokens(F.col("segment")), anchors))).where("loc <> ''")
    placed = open_.select("key", "segment", F.trim(F.concat_ws(" ", "segment", "loc")).alias("k")).join(index.variants.withColumnRenamed("key", "k"), "k").select("key", "segment", "master_id")
    return _only(_unconflicted(plain.union(placed).select("key", "master_id").distinct(), p, _weighed(dim)).where("not conflict"))


def match_all(master: DataFrame, target: DataFrame, name: str, city: str | None = None, state: str | None = None, row_id: str | None = None, rules: RuleSet = INSTITUTIONS, **how) -> tuple[DataFrame, DataFrame]:
    """The keyed target rows and the decisions of their distinct inputs. Missing columns are an error."""
    missing = sorted({c for c in (name, city, state, row_id) if c} - set(target.columns))
    if missing:
        raise ValueError(f"Target is missing columns: {missing}")
    rows = with_keys(target, name, city, state, rules, how.get("unicode", True))
    rows = rows.withColumn("_row_id", F.col(row_id) if row_id else F.monotonically_increasing_id())
    c = lambda x, to: (X.filled(F.col(x)) if x else F.lit("")).alias(to)
    inputs = distinct_inputs(rows.select("match_key", c(name, "name"), c(city, "city"), c(state, "state"), "_row_id"))
    return rows, match(master, inputs, rules, **how)
