"""The cascade as one chain of SQL tables, for DuckDB: what the registered queries over the fixture are compared with.

Written from the rules' description, not from the engine: it forms every pair of an input and a candidate, records that score zero included, and does
without any of the engine's shortcuts. Names must be ASCII but for typographic apostrophes.
"""

from __future__ import annotations

from . import fixtures
from .operators.rules import INSTITUTIONS, MOJIBAKE, RuleSet


def text(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def lst(values) -> str:
    values = list(values)
    return f"[{', '.join(map(text, values))}]" if values else "[]::VARCHAR[]"


def values(rows: list[tuple], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns}))"


def looked_up(table: dict, x: str) -> str:
    return f"coalesce({lst(table.values())}[list_position({lst(table)}, {x})], {x})" if table else x


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def firsts(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda w: substr(w, 1, 1)), '')"


def overlap(a: str, b: str) -> str:
    return f"list_has_any({a}, {b})"


def padded(x: str) -> str:
    return f"(' ' || {x} || ' ')"


def fold(x: str, pattern: str, clean: str) -> str:
    """x with each match m of the pattern replaced by `clean`, an expression of m."""
    return f"list_reduce([{x}] || regexp_extract_all({x}, {text(pattern)}), lambda s, m: replace(s, m, {clean}))"


def norm(x: str, rules: RuleSet) -> str:
    x = f"coalesce({x}, '')"
    for wrong, right in MOJIBAKE.items():
        x = f"replace({x}, {text(wrong)}, {text(right)})"
    x = f"regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    x = fold(x, r"\b(?:[A-Za-z]\s*\.\s*)+[A-Za-z]\.?(?:\s|$)", "regexp_replace(m, '[^A-Za-z]', '', 'g') || ' '")
    x = fold(x, r"\b(?:[A-Z]\s+){1,5}[A-Z]\b", "regexp_replace(m, '\\s+', '', 'g')")
    x = f"lower({x})"
    for pattern, by in (("(s)[''’]s\\b", "\\1"), ("(\\w)[''’]s\\b", "\\1s"), ("(\\w)[''’](\\s|$)", "\\1\\2")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    x = f"trim(regexp_replace(replace({x}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {looked_up(rules.typos, 'w')}), ' ')" if rules.typos else x


def without(x: str, stop) -> str:
    """Words of x that are not in stop."""
    return f"list_filter({toks(x)}, lambda w: NOT list_contains({lst(stop)}, w))"


def distinct_words(x: str, stop) -> str:
    return f"list_distinct(list_filter({without(x, stop)}, lambda w: length(w) > 1))"


def prefixes(words: str) -> str:
    """Initials of the first 2 to 12 words."""
    return f"list_transform(range(2, least(len({words}), 12) + 1), lambda k: substr({firsts(words)}, 1, k::INT))"


def initialisms(x: str, rules: RuleSet) -> str:
    w = without(x, [*rules.abbreviation_stop, *rules.input_acronym_stop])
    short = f"list_filter({w}, lambda v: length(v) BETWEEN 2 AND 12)"
    compact = f"CASE WHEN length({w}[1]) BETWEEN 2 AND 5 THEN list_filter(list_transform(range(1, len({w})), lambda k: {w}[1] || substr({firsts(f'{w}[2:]')}, 1, k::INT)), lambda v: length(v) <= 12) ELSE [] END"
    unit = "CASE"
    for suffix, needed, before in rules.unit_suffixes:
        start = firsts(f"{w}[1:list_position({w}, {text(before)})::INT - 1]")
        unit += f" WHEN list_has_all({w}, {lst(needed)}) THEN CASE WHEN list_position({w}, {text(before)}) > 1 AND length({start}) >= 3 THEN [substr({start} || '{suffix}', 1, 12)] ELSE [] END"
    unit += " ELSE [] END"
    return f"list_distinct(list_concat({prefixes(w)}, {short}, {compact}, {unit if rules.unit_suffixes else '[]'}))"


def domains(x: str, rules: RuleSet) -> str:
    return f"list_distinct(list_transform(list_filter({toks(x)}, lambda w: list_contains({lst(rules.domains)}, w)), lambda w: {looked_up(rules.domain_groups, 'w')}))"


def intents(x: str, rules: RuleSet) -> str:
    found = [f"CASE WHEN {' OR '.join(f'contains({padded(x)}, {text(p)})' for p in phrases)} THEN {text(name)} END" for name, phrases in rules.intents.items()]
    return f"list_filter([{', '.join(found)}], lambda i: i IS NOT NULL)" if found else "[]::VARCHAR[]"


def families(name: str, short: str, rules: RuleSet) -> str:
    both, found = f"({name} || ' ' || {short})", []
    for family, (phrase, never) in rules.families.items():
        own = f"(contains({both}, {text(phrase)}) OR coalesce({toks(short)}[1] = '{family}', false) OR starts_with({name}, '{family} '))"
        found.append(f"CASE WHEN {own}{f' AND NOT contains({both}, {text(never)})' if never else ''} THEN '{family}' END")
    return f"list_filter([{', '.join(found)}], lambda i: i IS NOT NULL)" if found else "[]::VARCHAR[]"


def detected(name: str, source: str) -> str:
    """A table name(text, location, phrase): of the phrases in a text the one that starts last, then the longest."""
    last = f"length({padded('text')}) - strpos(reverse({padded('text')}), reverse({padded('phrase')})) - length(phrase)"
    return f"{name} AS MATERIALIZED (SELECT text, arg_max(canonical, [{last}, length(phrase)]) AS location, arg_max(phrase, [{last}, length(phrase)]) AS phrase FROM (SELECT DISTINCT text FROM ({source})) JOIN phrases ON contains({padded('text')}, {padded('phrase')}) GROUP BY text)"


def stripped(x: str, phrase: str) -> str:
    return f"CASE WHEN coalesce({phrase}, '') = '' THEN {x} ELSE trim(regexp_replace(replace({padded(x)}, {padded(phrase)}, ' '), ' +', ' ', 'g')) END"


def covered(shared: str, whole: str) -> str:
    return f"CASE WHEN len({whole}) = 0 THEN 0.0::DOUBLE ELSE len({shared})::DOUBLE / len({whole}) END"


def ratios(name: str, pairs: str) -> str:
    """Tables up to name(a, b, r): 200 times the longest common subsequence over both lengths, of all pairs (a, b); texts of up to 120 characters."""
    ab = f"{name}_pairs"
    return f"""{ab} AS MATERIALIZED (SELECT DISTINCT a, b FROM ({pairs})),
 {ab}1 AS MATERIALIZED (SELECT a, b, (1::HUGEINT << length(a)::INT) - 1 AS whole, list_transform(string_split(b, ''), lambda c: coalesce(list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT) AS masks FROM {ab} WHERE a <> '' AND b <> ''),
 {name} AS MATERIALIZED (SELECT a, b, 200.0::DOUBLE * (length(a) - bit_count(list_reduce([whole] || masks, lambda v, m: ((v + (v & m)) | (v - (v & m))) & whole))) / (length(a) + length(b)) AS r FROM {ab}1 UNION ALL SELECT a, b, CASE WHEN a = b THEN 100.0 ELSE 0.0 END FROM {ab} WHERE a = '' OR b = '')"""


def tables(rules: RuleSet = INSTITUTIONS, given: str = "", target: str = "") -> str:
    """The WITH clause (without the word) up to decisions(match_key, ...), of the fixture or of a master (master_id, name, city, state, short_form,
    category, rn) and a target (row_id, name, city, state) given as queries."""
    n, canon = lambda x: norm(x, rules), lambda x: looked_up(rules.aliases, x)
    ident, meaning = lambda x: distinct_words(x, rules.identity_noise), lambda x: distinct_words(x, rules.generic)
    match = lambda x: joined(without(x, rules.match_noise))
    noise = [*rules.identity_noise, *rules.match_noise]
    anchors = lst(("university", "college", "institute", "iit", "nit", "iiit"))
    parts = []
    add = parts.append
    supplement = values([(*r, 1 << 40) for r in rules.supplement], "master_id, name, city, state, short_form, category, rn") if rules.supplement else "(SELECT * FROM given LIMIT 0)"
    given = given or f"SELECT * REPLACE (master_id::BIGINT AS master_id, rn::BIGINT AS rn) FROM {values(fixtures.master_rows(), 'master_id, name, city, state, short_form, category, rn')}"
    target = target or f"SELECT * REPLACE (row_id::BIGINT AS row_id) FROM {values(fixtures.target_rows(), 'row_id, name, city, state, note')}"
    add(f"given AS ({given})")
    add(f"target AS ({target})")
    add(f"m0 AS MATERIALIZED (SELECT * FROM given UNION ALL SELECT * FROM {supplement} WHERE master_id NOT IN (SELECT master_id FROM given))")
    add(f"m1 AS MATERIALIZED (SELECT *, {n('name')} AS clean_name, {n(chr(40) + 'regexp_replace(name, ' + text(chr(92) + 's*-?' + chr(92) + 's*' + chr(92) + '[[^' + chr(92) + ']]+' + chr(92) + ']') + ', ' + text(' ') + ', ' + text('g') + '))')} AS base_name, {n('short_form')} AS clean_short, {n('city')} AS raw_city FROM m0)")
    add(f"m2 AS MATERIALIZED (SELECT *, {canon('raw_city')} AS clean_city, {match('clean_name')} AS match_name, {match('base_name')} AS match_base, {match('clean_short')} AS match_short, list_filter(list_transform(regexp_extract_all(name, '\\[([^\\]]+)\\]', 1), lambda a: replace({n('a')}, ' ', '')), lambda a: a <> '') AS bracket, list_filter(list_transform(regexp_extract_all(short_form, '\\b[A-Z][A-Z0-9]+\\b'), lambda a: lower(a)), lambda a: length(a) <= 12 AND NOT list_contains({lst(noise)}, a)) AS upper_words, array_to_string(list_filter({toks('base_name')}, lambda w: NOT list_contains({toks('raw_city')}, w)), ' ') AS bare FROM m1)")
    derived = lambda x: prefixes(without(x, rules.abbreviation_stop))
    add(f"m3 AS MATERIALIZED (SELECT *, list_distinct(list_concat(upper_words, bracket)) AS short_acronyms, list_distinct(list_filter(list_concat({derived('clean_name')}, {derived('base_name')}, {derived('bare')}, bracket, [replace(clean_short, ' ', '')]), lambda a: a <> '')) AS abbreviations, list_filter({ident('base_name')}, lambda w: {canon('w')} <> clean_city) AS ident_base, list_filter({ident('clean_short')}, lambda w: {canon('w')} <> clean_city) AS ident_short FROM m2)")
    add("m AS MATERIALIZED (SELECT *, list_distinct(list_concat(short_acronyms, flatten(list_transform(list_filter(short_acronyms, lambda a: length(a) >= 4), lambda a: list_transform(range(3, length(a) + 1), lambda k: substr(a, 1, k::INT)))))) AS acronym_keys FROM m3)")
    add(f"phrases AS MATERIALIZED (SELECT DISTINCT phrase, {canon('phrase')} AS canonical FROM (SELECT raw_city AS phrase FROM m UNION SELECT clean_city FROM m UNION SELECT unnest({lst(rules.aliases)})) WHERE phrase <> '')")
    add("last AS MATERIALIZED (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY master_id ORDER BY rn DESC) = 1)")
    add(detected("in_records", "SELECT clean_name AS text FROM last UNION SELECT clean_short FROM last"))
    add(f"rec AS MATERIALIZED (SELECT l.*, list_distinct(list_filter([l.clean_city, a.location, b.location], lambda c: coalesce(c, '') <> '')) AS cities, list_distinct(list_concat({ident('clean_name')}, {ident('base_name')}, {ident('clean_short')})) AS name_tokens, {domains(chr(40) + 'clean_name || chr(32) || base_name)', rules)} AS domain, list_distinct(list_filter({toks('base_name')}, lambda w: list_contains({lst(rules.delivery)}, w))) AS delivery, {families('clean_name', 'clean_short', rules)} AS families FROM last l LEFT JOIN in_records a ON a.text = clean_name LEFT JOIN in_records b ON b.text = clean_short)")
    add("tokens AS MATERIALIZED (SELECT DISTINCT unnest(list_concat(ident_base, ident_short)) AS key, master_id FROM m)")
    add("acronyms AS MATERIALIZED (SELECT DISTINCT unnest(acronym_keys) AS key, master_id FROM m)")
    add("places AS MATERIALIZED (SELECT DISTINCT clean_city AS key, master_id FROM m WHERE clean_city <> '' UNION SELECT DISTINCT unnest(cities), master_id FROM rec)")
    forms = "list_concat([clean_name, base_name, clean_short, match_base], abbreviations)"
    add(f"variants AS MATERIALIZED (SELECT DISTINCT key, master_id FROM (SELECT unnest(list_concat({forms}, [match_name, match_short], list_transform({forms}, lambda f: trim(f || ' ' || raw_city)), list_transform({forms}, lambda f: trim(f || ' ' || clean_city)))) AS key, master_id FROM m) WHERE key <> '')")
    add(f"fingerprints AS MATERIALIZED (SELECT DISTINCT key, master_id FROM (SELECT unnest([{', '.join(joined(f'list_sort({toks(c)})') for c in ('match_name', 'match_base', 'match_short'))}]) AS key, master_id FROM m) WHERE key <> '')")
    add("sole AS MATERIALIZED (SELECT master_id, list(key) AS unique_keys FROM (SELECT key, min(master_id) AS master_id FROM acronyms GROUP BY key HAVING count(*) = 1) GROUP BY master_id)")
    add("sole_in AS MATERIALIZED (SELECT master_id, list(k) AS city_keys FROM (SELECT a.key || '|' || p.key AS k, min(master_id) AS master_id FROM acronyms a JOIN places p USING (master_id) GROUP BY 1 HAVING count(*) = 1) GROUP BY master_id)")
    add("r AS MATERIALIZED (SELECT rec.*, coalesce(unique_keys, []) AS unique_keys, coalesce(city_keys, []) AS city_keys FROM rec LEFT JOIN sole USING (master_id) LEFT JOIN sole_in USING (master_id))")

    # inputs
    add(f"keyed AS MATERIALIZED (SELECT *, {n('name')} AS clean, {canon(n('city'))} AS city_in, {n('name')} || '||' || {canon(n('city'))} || '||' || {n('state')} AS match_key FROM target)")
    add("first AS MATERIALIZED (SELECT match_key, arg_min(name, row_id) AS name, arg_min(city, row_id) AS city, arg_min(state, row_id) AS state, arg_min(clean, row_id) AS clean, arg_min(city_in, row_id) AS city_in FROM keyed GROUP BY match_key)")
    add(f"segments AS MATERIALIZED (SELECT match_key, i, raw, {n('raw')} AS seg FROM (SELECT match_key, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS raw FROM (SELECT match_key, list_filter(list_transform(string_split(name, ','), lambda s: trim(s)), lambda s: s <> '') AS parts FROM first)))")
    add(f"started AS MATERIALIZED (SELECT match_key, coalesce(min(i) FILTER ({overlap(toks('seg'), lst(rules.identity_markers))}), 1) AS start FROM segments GROUP BY match_key)")
    add(f"""structure AS MATERIALIZED (SELECT f.match_key, s.seg AS first_seg, CASE WHEN regexp_matches(s.raw, '\\s+-\\s+') THEN {n("regexp_replace(s.raw, '^.*?" + chr(92) + "s+-" + chr(92) + "s+', '')")} END AS named,
 (SELECT arg_min(l.seg, l.i) FROM segments l WHERE l.match_key = f.match_key AND l.i > start AND {overlap(toks('l.seg'), anchors)}) AS parent,
 (SELECT arg_min(l.seg, l.i) FROM segments l WHERE l.match_key = f.match_key AND l.i > start AND contains({padded('l.seg')}, ' college ') AND len({ident('l.seg')}) > 0) AS college
 FROM started f JOIN segments s ON s.match_key = f.match_key AND s.i = start)""")
    leads = f"(list_contains(['department', 'faculty', 'school', 'institute', 'college'], {toks('first_seg')}[1]) OR starts_with(first_seg, 'university institute '))"
    add(f"""identities AS MATERIALIZED (SELECT f.*, CASE WHEN first_seg IS NULL THEN clean WHEN contains({padded('named')}, ' college ') THEN named WHEN {leads} AND parent IS NOT NULL THEN trim(first_seg || ' ' || parent)
 WHEN {overlap(toks('first_seg'), "['university', 'technology']")} AND college IS NOT NULL THEN college ELSE first_seg END AS raw_id FROM first f LEFT JOIN structure USING (match_key))""")
    add(detected("in_names", "SELECT clean AS text FROM first"))
    add(f"p0 AS MATERIALIZED (SELECT i.*, {match('raw_id')} AS identity, CASE WHEN city_in <> '' AND d.location IS NULL THEN {n(chr(40) + 'name || chr(32) || city)')} ELSE clean END AS context FROM identities i LEFT JOIN in_names d ON d.text = clean)")
    add(detected("in_contexts", "SELECT context AS text FROM p0"))
    add(f"p1 AS MATERIALIZED (SELECT p0.*, coalesce(location, '') AS loc, {initialisms('context', rules)} AS ctx_inits, CASE WHEN coalesce(location, '') <> '' AND NOT contains(identity, location) THEN trim(identity || ' ' || location) ELSE identity END AS p_input FROM p0 LEFT JOIN in_contexts d ON d.text = context)")
    add(detected("in_inputs", "SELECT p_input AS text FROM p1"))
    add(f"p2 AS MATERIALIZED (SELECT p1.*, coalesce(location, '') AS p_loc, {stripped('p_input', 'd.phrase')} AS p_bare FROM p1 LEFT JOIN in_inputs d ON d.text = p_input)")
    add(f"p AS MATERIALIZED (SELECT *, {initialisms('p_bare', rules)} AS p_inits, {initialisms('p_input', rules)} AS all_inits, {ident('p_bare')} AS mine, {meaning('p_input')} AS meaning, {domains('p_bare', rules)} AS p_domain, list_distinct(list_filter({toks('p_bare')}, lambda w: list_contains({lst(rules.delivery)}, w))) AS p_delivery FROM p2)")
    sole = lambda inits, place: f"({overlap(f'list_intersect({inits}, acronym_keys)', 'unique_keys')} OR ({place} <> '' AND {overlap(f'list_transform(list_intersect({inits}, acronym_keys), lambda a: a || chr(124) || {place})', 'city_keys')}))"
    away = lambda place: f"({place} <> '' AND len(cities) > 0 AND NOT list_contains(cities, {place}))"
    conflict = f"({away('loc')} AND NOT {sole('ctx_inits', 'loc')})"
    paired = lambda source: f"{source} JOIN p USING (match_key) JOIN r USING (master_id)"

    # rules 1 to 9
    say = lambda rule, decision, confidence, reason, source: f"SELECT match_key, {rule} AS rule, master_id, '{decision}' AS decision, {confidence}::DOUBLE AS confidence, {text(reason)} AS reason FROM ({source})"
    only = lambda source: f"SELECT match_key, min(master_id) AS master_id FROM ({source}) GROUP BY match_key HAVING count(DISTINCT master_id) = 1"
    early = [say(1, "NOT_FOUND", 0.0, "Verified absent institution; related brand and other-campus IDs are blocked", f"SELECT match_key, NULL::BIGINT AS master_id FROM p WHERE list_contains({lst(rules.verified_absent)}, clean) OR list_contains({lst(rules.verified_absent)}, context)")]
    for rule, alias, decision, confidence, reason in ((2, rules.verified, "FOUND", 100, "Verified exact business alias"), (3, rules.verified_review, "NEEDS_REVIEW", 92, "Explicit parent institution suggested; exact sub-unit record is absent from the master")):
        if alias:
            own = f"SELECT match_key, {lst(alias.values())}[coalesce(nullif(list_position({lst(alias)}, clean), 0), list_position({lst(alias)}, context))]::BIGINT AS master_id FROM p"
            early.append(say(rule, decision, confidence, reason, f"SELECT match_key, master_id FROM {paired(f'({own})')} WHERE NOT {conflict}"))
    for word, start, lacks, category in rules.brands:
        own = f"SELECT match_key, master_id FROM p JOIN places ON key = loc JOIN r USING (master_id) WHERE loc <> '' AND list_contains({toks('clean')}, '{word}') AND starts_with(base_name, '{start}') AND NOT {overlap(toks('base_name'), lst(lacks))} AND lower(category) = '{category}'"
        early.append(say(4, "FOUND", 98, f"{word.capitalize()} parent university and campus city confirmed", only(own)))
    named = [f"CASE WHEN contains(clean, {text(phrase)}) THEN '{a}' END" for phrase, a in rules.system_phrases.items()]
    add(f"asked AS MATERIALIZED (SELECT match_key, loc, list_concat(list_filter({toks('clean')}, lambda w: list_contains({lst(rules.system_acronyms)}, w)), list_filter([{', '.join(named)}]::VARCHAR[], lambda a: a IS NOT NULL)) AS systems, {overlap(toks('clean'), lst(rules.system_subunits))} AS sub, {intents('clean', rules)} AS asks FROM p WHERE loc <> '')")
    add(f"systems AS MATERIALIZED (SELECT match_key, master_id, asks, {overlap('asks', intents('(clean_name || chr(32) || clean_short)', rules))} AS fit, {overlap(toks('clean_name'), lst(rules.system_subunits))} AS r_sub FROM asked JOIN places ON key = loc JOIN r USING (master_id) WHERE {overlap('systems', 'families')} AND (sub OR NOT {overlap(toks('clean_name'), lst(rules.system_subunits))}))")
    add("""system_ids AS MATERIALIZED (SELECT match_key, master_id FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (fit) OVER w AS n_fit, count(*) FILTER (NOT r_sub) OVER w AS n_main FROM systems WINDOW w AS (PARTITION BY match_key))
 WHERE CASE WHEN len(asks) > 0 AND n > 1 AND n_fit = 1 THEN fit WHEN len(asks) > 0 AND n > 1 AND n_fit = 0 AND n_main = 1 THEN NOT r_sub ELSE true END)""")
    early.append(say(5, "FOUND", 99, "National institution acronym and city confirmed", only("SELECT * FROM system_ids")))
    add(f"""hits AS MATERIALIZED (SELECT DISTINCT match_key, master_id FROM (SELECT match_key, master_id, 1 AS tier FROM p JOIN variants ON key = raw_id UNION ALL SELECT match_key, master_id, 2 FROM p JOIN variants ON key = identity
 UNION ALL SELECT match_key, master_id, 3 FROM p JOIN fingerprints ON key = {joined(f'list_sort({toks("identity")})')} AND identity <> '') QUALIFY tier = min(tier) OVER (PARTITION BY match_key))""")
    add(f"hit_conflicts AS MATERIALIZED (SELECT match_key, master_id, {conflict} AS conflict, identity IN (clean_name, base_name, match_name, match_base) AS is_literal, clean_short = identity AS spelt FROM {paired('hits')})")
    add("lone_conflicts AS MATERIALIZED (SELECT match_key, min(master_id) AS master_id FROM hit_conflicts GROUP BY match_key HAVING count(*) = 1 AND bool_and(conflict))")
    early.append(say(7, "NEEDS_REVIEW", 70, "Unique institution name; input city differs from the master city and requires verification", "SELECT * FROM lone_conflicts"))
    add("literal AS MATERIALIZED (SELECT * FROM hit_conflicts WHERE NOT conflict)")
    add("preferred AS MATERIALIZED (SELECT * FROM literal QUALIFY is_literal OR NOT bool_or(is_literal) OVER (PARTITION BY match_key))")
    add("exact_ids AS MATERIALIZED (SELECT match_key, master_id FROM preferred QUALIFY spelt OR count(*) FILTER (spelt) OVER (PARTITION BY match_key) <> 1 OR count(*) OVER (PARTITION BY match_key) = 1)")
    early.append(say(8, "FOUND", 100, "Unique exact master match", only("SELECT * FROM exact_ids")))
    add(f"named AS MATERIALIZED (SELECT match_key, loc, raw, {match(n('raw'))} AS seg FROM (SELECT match_key, loc, unnest(string_split(name, ',')) AS raw FROM p))")
    add(f"""seg_ids AS MATERIALIZED (SELECT match_key, seg, raw, loc, master_id FROM named JOIN variants ON key = seg WHERE seg <> ''
 UNION SELECT match_key, seg, raw, loc, master_id FROM (SELECT *, unnest(list_transform(regexp_extract_all(raw, '\\b[A-Z][A-Z0-9]{{2,}}\\b'), lambda a: lower(a))) AS a FROM named WHERE seg <> '') JOIN acronyms ON key = a)""")
    add(f"""seg_all AS MATERIALIZED (SELECT match_key, master_id FROM seg_ids UNION SELECT match_key, v.master_id FROM named n JOIN variants v ON v.key = trim(seg || ' ' || loc) WHERE loc <> '' AND seg <> '' AND ({overlap(toks('seg'), anchors)} OR EXISTS (SELECT 1 FROM seg_ids s WHERE s.match_key = n.match_key AND s.raw = n.raw)))""")
    early.append(say(9, "NEEDS_REVIEW", 92, "Explicit parent institution confirmed; specialised sub-unit has no unique exact master record", only(f"SELECT match_key, master_id FROM {paired('seg_all')} WHERE NOT {conflict}")))
    add(f"proposed AS MATERIALIZED ({' UNION ALL '.join(early)})")
    add("early AS MATERIALIZED (SELECT * FROM proposed QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY rule, master_id) = 1)")
    add("rest AS MATERIALIZED (SELECT * FROM p WHERE match_key NOT IN (SELECT match_key FROM early))")

    # candidates: words, acronyms, parents; the fuzzy fallback; all of the location
    subs = lst(rules.subunits)
    base, words = toks("base_name"), toks("p_input")
    valid = f"(len({base}) >= 3 OR (len({base}) >= 2 AND {overlap(base, lst(rules.institution_words))}))"
    inside = lambda t: f"(len({t}) > 0 AND list_has_all(meaning, {t}))"
    one = f"(len(ident_short) = 1 AND length(ident_short[1]) >= 3 AND list_contains(short_acronyms, ident_short[1]) AND ident_short[1] <> p_loc AND ident_short[1] <> clean_city AND p_loc <> '' AND p_loc = clean_city)"
    by_base = f"({inside('ident_base')} AND (len(ident_base) >= 2 OR (length(ident_base[1]) >= 4 AND contains(p_input, base_name))))"
    by_short = f"({inside('ident_short')} AND (len(ident_short) >= 2 OR {one}))"
    specific = f"greatest(CASE WHEN {by_base} THEN len(ident_base) ELSE 0 END, CASE WHEN {by_short} THEN len(ident_short) ELSE 0 END)"
    bonus = f"CASE WHEN list_contains(short_acronyms, {words}[1]) THEN 0.8 ELSE 0.0 END"
    accepted = "(p_loc = '' OR len(cities) = 0 OR list_contains(cities, p_loc))"
    add(f"""parents AS MATERIALIZED (SELECT match_key, master_id, CASE WHEN p_loc <> '' AND list_contains(cities, p_loc) THEN least(100.0::DOUBLE, 98.0::DOUBLE + {specific} * 0.4::DOUBLE + {bonus}::DOUBLE) ELSE least(99.0::DOUBLE, 96.0::DOUBLE + {specific} * 0.4::DOUBLE + {bonus}::DOUBLE) END AS parent_score, {conflict} AS conflict FROM p, r
 WHERE {overlap(words, lst(rules.parent_markers))} AND NOT ({overlap(base, subs)} AND NOT {overlap(words, subs)}) AND {valid} AND ({by_base} OR {by_short}) AND {accepted})""")
    add("""pool0 AS MATERIALIZED (SELECT match_key, master_id FROM (SELECT match_key, unnest(mine) AS key FROM p) JOIN tokens USING (key) UNION SELECT match_key, master_id FROM (SELECT match_key, unnest(p_inits) AS key FROM p) JOIN acronyms USING (key)
 UNION SELECT match_key, master_id FROM parents JOIN (SELECT DISTINCT match_key, master_id FROM (SELECT match_key, unnest(meaning) AS key FROM p) JOIN tokens USING (key)) USING (match_key, master_id) WHERE NOT conflict)""")
    add(f"""lone AS MATERIALIZED (SELECT match_key, p_input FROM rest WHERE p_input <> '' AND match_key NOT IN (SELECT match_key FROM pool0))""")
    add(f"fuzzy_pairs AS MATERIALIZED (SELECT match_key, p_input, key AS variant FROM lone, (SELECT DISTINCT key FROM variants) WHERE {overlap(toks('p_input'), toks('key'))})")
    cand = "list_distinct(list_filter(list_concat([clean_name, base_name, clean_short], abbreviations), lambda v: v <> ''))"
    distinct_sorted = lambda x: joined(f"list_sort(list_distinct({toks(x)}))")
    in_order = lambda x: joined(f"list_sort({toks(x)})")
    add(ratios("near_ratio", "SELECT p_input AS a, variant AS b FROM fuzzy_pairs"))
    add("fuzzy AS MATERIALIZED (SELECT match_key, variant, r, row_number() OVER (PARTITION BY match_key ORDER BY r DESC, variant) AS rank FROM fuzzy_pairs JOIN near_ratio ON a = p_input AND b = variant WHERE r >= 25 QUALIFY rank <= 100)")
    add("pool AS MATERIALIZED (SELECT * FROM pool0 UNION SELECT match_key, master_id FROM fuzzy JOIN variants ON key = variant UNION SELECT match_key, master_id FROM p JOIN places ON key = p_loc WHERE p_loc <> '' AND p_input <> '')")
    add(f"gated AS MATERIALIZED (SELECT p.*, r.* EXCLUDE (name, city, state), r.name AS r_name, {conflict} AS conflict, {away('p_loc')} AS away, {sole('all_inits', 'p_loc')} AS sole, p_loc <> '' AND list_contains(cities, p_loc) AS same_city, list_intersect(mine, name_tokens) AS shared, list_intersect(p_inits, acronym_keys) AS shared_acr, len(delivery) > 0 AND list_sort(delivery) <> list_sort(p_delivery) AS delivery_conflict, len(p_domain) > 0 AND len(domain) > 0 AND NOT {overlap('p_domain', 'domain')} AS domain_conflict FROM {paired('pool')} WHERE p_input <> '')")
    literal = toks("p_bare")
    trusted = f"list_filter(shared_acr, lambda a: list_contains({literal}, a) OR coalesce(length({literal}[1]) BETWEEN 2 AND 5 AND starts_with(a, {literal}[1]), false) OR length(a) >= 5)"
    ordered = f"list_filter({without('p_bare', rules.identity_noise)}, lambda w: length(w) > 1)"
    shares = ", ".join(f"least({covered(f'list_intersect(mine, {ident(c)})', 'mine')}, {covered(f'list_intersect(mine, {ident(c)})', ident(c))})" for c in ("clean_name", "base_name", "clean_short"))
    add(f"measured AS MATERIALIZED (SELECT *, {trusted} AS trusted, CASE WHEN len({ordered}) >= 2 THEN substr({ordered}[1], 1, 1) || substr({ordered}[2], 1, 1) ELSE '' END AS two, {covered('shared', 'mine')} AS cov_in, {covered('shared', 'name_tokens')} AS cov_rec, greatest(CASE WHEN len(shared_acr) > 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END, {shares}) AS overlap FROM gated)")
    add(f"""weighed AS MATERIALIZED (SELECT *, same_city AND two <> '' AND list_contains(shared_acr, two) AS two_in_city, p_loc <> '' AND {overlap("list_transform(trusted, lambda a: a || '|' || p_loc)", 'city_keys')} AS acr_in_city FROM measured)""")
    add("""evident AS MATERIALIZED (SELECT *, (len(trusted) > 0 OR two_in_city) AND (acr_in_city OR two_in_city OR (len(list_filter(trusted, lambda a: length(a) >= 4)) > 0 AND same_city)) AND NOT (len(mine) >= 3 AND cov_in < 0.45) AS reliable,
 (len(shared) >= 2 AND cov_in >= 0.45 AND cov_rec >= 0.45) OR (len(shared) = 1 AND cov_in >= 0.75 AND cov_rec >= 0.5 AND length(shared[1]) >= 4) AS literal_id FROM weighed)""")
    add("""kinds AS MATERIALIZED (SELECT e.*, parent_score, CASE WHEN (away AND NOT sole) THEN 'location' WHEN delivery_conflict THEN 'delivery' WHEN domain_conflict THEN 'domain' WHEN parent_score IS NOT NULL THEN 'parent' WHEN NOT literal_id AND NOT reliable THEN 'identity' ELSE 'name' END AS kind,
 len(trusted) > 0 AND list_has_any(p_domain, domain) AND p_loc <> '' AND p_loc = clean_city AS three FROM evident e LEFT JOIN (SELECT match_key, master_id, parent_score FROM parents) USING (match_key, master_id))""")
    add(f"compared AS MATERIALIZED (SELECT match_key, master_id, p_input, p_bare, unnest({cand}) AS v FROM kinds WHERE kind = 'name')")
    add(f"four AS MATERIALIZED (SELECT match_key, master_id, p_input AS a, v AS b FROM compared UNION SELECT match_key, master_id, p_bare, v FROM compared UNION SELECT match_key, master_id, {distinct_sorted('p_bare')}, {distinct_sorted('v')} FROM compared UNION SELECT match_key, master_id, {in_order('p_bare')}, {in_order('v')} FROM compared)")
    add(ratios("ratio", "SELECT a, b FROM four"))
    add("lexical AS MATERIALIZED (SELECT match_key, master_id, max(r) AS lexical FROM four JOIN ratio USING (a, b) GROUP BY 1, 2)")
    add("judged AS MATERIALIZED (SELECT k.*, coalesce(l.lexical, 0.0) AS lexical FROM kinds k LEFT JOIN lexical l USING (match_key, master_id))")
    add("""raised AS MATERIALIZED (SELECT *, lexical * 0.6 + least(cov_in, cov_rec) * 30.0 - CASE WHEN overlap = 0 THEN 50 WHEN overlap < 0.5 THEN 18 ELSE 0 END + CASE WHEN p_loc <> '' AND p_loc = clean_city THEN 15 ELSE 0 END - CASE WHEN len(p_domain) > 0 AND len(domain) = 0 THEN 25 ELSE 0 END AS c FROM judged)""")
    add("""scored AS MATERIALIZED (SELECT *, CASE kind WHEN 'parent' THEN parent_score WHEN 'name' THEN least(CASE WHEN away AND sole THEN 75.0 ELSE 100.0 END, greatest(0.0, least(100.0, CASE WHEN three THEN greatest(c, 98.0) WHEN reliable AND same_city THEN greatest(c, 90.0) ELSE c END)))::DOUBLE ELSE 0.0 END::DOUBLE AS confidence,
 CASE kind WHEN 'parent' THEN 1.0 WHEN 'name' THEN overlap ELSE 0.0 END::DOUBLE AS token_overlap,
 CASE kind WHEN 'parent' THEN 'Explicit parent institution' ELSE 'Name similarity ' || printf('%.1f', lexical) || ', identity-token overlap ' || printf('%.2f', overlap) || CASE WHEN overlap = 0 THEN ', no meaningful name-token match' WHEN overlap < 0.5 THEN ', weak meaningful-token match' ELSE '' END
 || CASE WHEN p_loc <> '' AND p_loc = clean_city THEN ', exact city match' ELSE '' END || CASE WHEN len(p_domain) > 0 AND len(domain) = 0 THEN ', candidate does not confirm institution category' ELSE '' END
 || CASE WHEN three THEN ', abbreviation, institution category and city confirmed' WHEN reliable AND same_city THEN ', maintained acronym and campus confirmed' ELSE '' END || CASE WHEN away AND sole THEN ', unique acronym match but city requires review' ELSE '' END END AS reason FROM raised)""")
    add("""five AS MATERIALIZED (SELECT s.match_key, s.master_id, s.confidence, s.token_overlap, s.reason, s.r_name, s.loc, row_number() OVER (PARTITION BY s.match_key ORDER BY s.confidence DESC, conflict, s.master_id) AS rank, conflict
 FROM scored s WHERE s.match_key IN (SELECT match_key FROM rest) QUALIFY rank <= 5)""")
    add("""tops AS MATERIALIZED (SELECT *, confidence - lead(confidence, 1, 0.0::DOUBLE) OVER w AS margin, row_number() OVER w AS place FROM five WHERE NOT conflict WINDOW w AS (PARTITION BY match_key ORDER BY rank))""")
    sure = "false" if rules.strict else "(reason = 'Explicit parent institution' AND confidence >= 97 AND (loc <> '' OR margin >= 5)) OR (confidence >= 96 AND token_overlap >= 0.75 AND margin >= 8)"
    add(f"""late AS MATERIALIZED (SELECT match_key, CASE WHEN {sure} THEN 'FOUND' WHEN token_overlap = 0 OR confidence < 20 THEN 'NOT_FOUND' ELSE 'NEEDS_REVIEW' END AS decision, master_id, confidence, reason, margin FROM tops WHERE place = 1)""")
    add("""decisions AS MATERIALIZED (SELECT f.name AS input_name, f.clean AS normalized_name, f.match_key, f.city AS input_city, f.state AS input_state, d.decision, d.master_id, r.name AS matched_name, round(d.confidence, 2) AS confidence, d.reason FROM first f JOIN (
 SELECT match_key, decision, master_id, confidence, reason FROM early UNION ALL SELECT match_key, decision, CASE WHEN decision <> 'NOT_FOUND' THEN master_id END, confidence, CASE decision WHEN 'FOUND' THEN reason WHEN 'NOT_FOUND' THEN 'No credible master match' ELSE 'Ambiguous match; top-two margin ' || printf('%.1f', margin) END FROM late
 UNION ALL SELECT match_key, 'NOT_FOUND', NULL, 0.0, 'No master candidate found' FROM rest WHERE match_key NOT IN (SELECT match_key FROM late)) d USING (match_key) LEFT JOIN r ON r.master_id = d.master_id)""")
    return ",\n".join(parts)
