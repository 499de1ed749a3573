"""PII surrogate generation.

Entities found in whole texts are replaced by keyed surrogates of the same kind, script and format. The strings of one format are numbered; a keyed
permutation E (a Feistel network with cycle walking) puts them on one cycle, and the surrogate is the next on it, E^-1(E(x) + 1): distinct entities get
distinct surrogates, each mention of one entity the same, and none stays what it was. Letters stay letters of their script and case, digits digits,
separators stay. Where a check or a class must hold, the cycle is walked until it does: cards keep whether they pass the Luhn check, addresses their
class (private, public, ...); the check digits of an IBAN follow the rest, valid or not as before. Blanks, hyphens and brackets in numbers and the case of
an e-mail address are format only: all spellings of one entity have one surrogate, spelt alike.

Names, known by their titles, change word by word: known first names within the list of their gender, other words outside both lists, vowels to vowels
and consonants to consonants, a vowel at the end (which often marks the gender) staying. A word has one surrogate whatever its title, and stands for it in
mentions without a title in the same text too. Letters outside the alphabets below change among the letters of their script, case and category in their
block of 256 code points (Han and Hangul: in the whole of their ranges). Characters that are neither letters nor digits stay.

The collision check still compares all distinct entities of the corpus with their surrogates, and a kind that has a collision, or an entity that is its
own surrogate, gets its next key. An entity without a changeable character (none is detected by the patterns below) would stay.

The key is the caller's; whoever has it can undo the surrogates. Null texts stay null and empty texts empty. Repeated rows give repeated results; other
columns, and a null doc_id, are kept, except that entity_kinds replaces an input column of that name.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .common import cut, ship, table, without

#: The setting that holds the key, and the key of the registered query and of the pipeline where the session has none (results must be comparable there).
KEY_SETTING, OPEN_KEY = "spark.tessera.pii.key", b"surrogates"
ATTEMPTS = 8

_TITLE_F, _TITLE_M = r"Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra", r"Mr|Monsieur|Herr|Señor|Sr"
_NAME = r"[^\Wa-z\d_](?:[^\W\d_]|['’-](?=[^\Wa-z\d_]))+"
ENTITY = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[\x20.-]?\(?\d{2,4}\)?[\x20.-]?\d{3,4}[\x20.-]?\d{3,4}(?!\d)|(?<![\w(])\(\d{3}\)\x20?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}(?P<sep>[.-])\d{3}(?P=sep)\d{4}(?![\w-]|\.\d))"
    r"|(?P<card>(?<![\d.-])(?:\d{4}[\x20-]?){3}\d{1,7}(?![\d]))"
    rf"|\b(?:(?P<tf>{_TITLE_F})|(?P<tm>{_TITLE_M})|Dr|Prof)\.?\x20(?P<name>{_NAME}(?:\x20{_NAME})?)"
)
NAME = re.compile(rf"\b{_NAME}")
#: What a text must hold for any pattern to match: a digit, an at sign or a title.
LIKELY = re.compile(rf"[0-9@]|\b(?:{_TITLE_F}|{_TITLE_M}|Dr|Prof)\b")

WOMEN = ("Alice", "Amelia", "Anna", "Beatrice", "Camille", "Carmen", "Clara", "Elena", "Emma", "Eva", "Greta", "Hannah", "Ingrid", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nina", "Olga", "Paula", "Rosa", "Sarah", "Sofia")
MEN = ("Adam", "Albert", "Anton", "Bruno", "Carlos", "David", "Diego", "Emil", "Felix", "Georg", "Hugo", "Jan", "Juan", "Karl", "Louis", "Lukas", "Marc", "Martin", "Oscar", "Paul", "Peter", "Pierre", "Robert", "Thomas")
#: Letters of each script that stand for one another.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "0123456789")
_OF = {c: a for a in ALPHABETS for c in a}
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Ranges of letters that are numbered as a whole.
RANGES = ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _paired(c: str) -> bool:
    """Whether a letter has one lower and one upper form that belong together."""
    return len(c.lower()) == len(c.upper()) == 1 and c.lower().upper() == c.upper() and c.upper().lower() == c.lower()


@lru_cache(maxsize=65536)
def alphabet(c: str) -> "str | range | None":
    """The characters that may stand for the lower-case form of c, as text or as a range of code points; None where c must stay."""
    low = c.lower() if _paired(c) else c
    if low in _OF:
        return _OF[low]
    for a, b in RANGES:
        if a <= ord(c) <= b:
            return range(a, b + 1)
    if not c.isalpha():
        return None
    kind = lambda x: (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0], x.lower() != x.upper(), _paired(x))
    block, own = ord(low) & ~0xFF, kind(low)
    found = "".join(x for x in map(chr, range(block, block + 256)) if x.isalpha() and kind(x) == own and x not in _OF)
    return found if len(found) > 1 else None


def _feistel(value: int, half: int, size: int, key: bytes, tweak: str, back: bool) -> int:
    mask = (1 << half) - 1
    left, right = value >> half, value & mask
    for r in range(7, -1, -1) if back else range(8):
        if back:
            left, right = right, left
        digest = hmac.digest(key, f"{tweak}|{size}|{r}|{right}".encode(), "sha256")
        part = int.from_bytes(digest * (half // 256 + 1), "big") & mask
        if back:
            left ^= part
        else:
            left, right = right, left ^ part
    return left << half | right


@lru_cache(maxsize=20_000)
def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        value = _feistel(value, half, size, key, tweak, back)
        if value < size:
            return value


def following(value: int, size: int, key: bytes, tweak: str) -> int:
    """The next value on a keyed cycle through all of range(size): never value itself, if size is over 1."""
    return permute((permute(value, size, key, tweak) + 1) % size, size, key, tweak, True) if size > 1 else value


def reshaped(text: str, key: bytes, tweak: str, fixed: frozenset[int] = frozenset(), letters: "dict[int, str] | None" = None) -> str:
    """The surrogate among all strings of this format. Places in `fixed` stay; `letters` gives the alphabets of some places."""
    places, value, size, form = [], 0, 1, []
    for i, c in enumerate(text):
        own = None if i in fixed else (letters or {}).get(i) or alphabet(c)
        low = c.lower() if _paired(c) else c
        at = -1 if own is None else ord(low) - own.start if isinstance(own, range) else own.find(low)
        if at < 0:
            form.append(c)
            continue
        places.append((i, own))
        form.append(f"{own[0]}{len(own)}{'^' if c != low else ''}")
        value, size = value * len(own) + at, size * len(own)
    value, out = following(value, size, key, f"{tweak}|{'|'.join(form)}"), list(text)
    for i, own in reversed(places):
        value, k = divmod(value, len(own))
        new = chr(own[k]) if isinstance(own, range) else own[k]
        out[i] = new.upper() if text[i] != text[i].lower() and _paired(text[i]) else new
    return "".join(out)


def respelt(text: str, values: str, keep: "re.Pattern[str]") -> str:
    """The text with its characters that match `keep` replaced in turn by those of values."""
    new = iter(values)
    return keep.sub(lambda m: next(new), text)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


#: First and last addresses of each class: private, loopback, this network, multicast, reserved; all others are public.
ADDRESSES = [[(10 << 24, 11 << 24)], [(0xC0A80000, 0xC0A90000)], [(0xAC100000, 0xAC200000)], [(127 << 24, 128 << 24)], [(0, 1 << 24)], [(224 << 24, 240 << 24)], [(240 << 24, 1 << 32)]]
_TAKEN = sorted(r for c in ADDRESSES for r in c)
ADDRESSES.append([(b, a) for (_, b), (a, _) in zip(_TAKEN, _TAKEN[1:]) if a > b])


def ip_class(n: int) -> int:
    return next(k for k, own in enumerate(ADDRESSES) if any(a <= n < b for a, b in own))


def next_address(n: int, key: bytes) -> int:
    """The surrogate of an address among those of its class."""
    k = ip_class(n)
    own = ADDRESSES[k]
    place = sum(b - a for a, b in own if b <= n) + next(n - a for a, b in own if a <= n < b)
    place = following(place, sum(b - a for a, b in own), key, f"ip{k}")
    for a, b in own:
        if place < b - a:
            return a + place
        place -= b - a
    raise AssertionError


_DIGIT, _CODE = re.compile(r"\d", re.A), re.compile(r"[A-Z0-9]")


def iban_check(country: str, rest: str) -> int:
    """The check digits that make country and rest valid."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The surrogate of a mention, spelt as the mention is."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        new = f"{reshaped(local.lower(), key, 'local')}@{reshaped(host.lower(), key, 'host')}.{top.lower()}"
        return "".join(n.upper() if c.isupper() else n for c, n in zip(text, new))
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, text.split("."))), "big")
        return ".".join(map(str, next_address(n, key).to_bytes(4, "big")))
    if kind == "iban":
        whole = "".join(_CODE.findall(text))
        country, check, rest = whole[:2], int(whole[2:4]), whole[4:]
        new = reshaped(rest, key, f"iban|{country}")
        was, now = iban_check(country, rest), iban_check(country, new)
        if check == was:
            check = now
        else:  # one of the 99 wrong numbers for another, in order
            check = (check - (check > was)) + (check - (check > was) >= now)
        return respelt(text, f"{country}{check:02d}{new}", _CODE)
    if kind == "name" or kind.startswith("name_"):
        return " ".join(renamed(w, key) for w in text.split(" "))
    digits = "".join(_DIGIT.findall(text))
    if kind == "card":
        good, new = luhn(digits), digits
        while True:  # a cycle walked until the check agrees again is a cycle of the numbers alike
            new = reshaped(new, key, "card")
            if luhn(new) == good:
                return respelt(text, new, _DIGIT)
    if kind == "phone":  # a country's first digit stays
        return respelt(text, reshaped(digits, key, f"phone{text[0] == '+'}", frozenset((0,) if text[0] == "+" else ())), _DIGIT)
    return respelt(text, reshaped(digits, key, kind), _DIGIT)


def renamed(word: str, key: bytes) -> str:
    """The surrogate of one word of a name."""
    for pool, gender in ((WOMEN, "name_f"), (MEN, "name_m")):
        if word in pool:
            return pool[following(pool.index(word), len(pool), key, gender)]
    letters = {i: next((a for a in (VOWELS, CONSONANTS) if c.lower() in a), None) for i, c in enumerate(word)}
    ends = frozenset((len(word) - 1,) if letters[len(word) - 1] == VOWELS and any(map(alphabet, word[:-1])) else ())
    while True:  # walked past the lists, so that no other word takes the place of a first name's surrogate
        word = reshaped(word, key, "name", ends, letters)
        if word not in WOMEN and word not in MEN:
            return word


def keyring(kind: str) -> str:
    """Names share one key, whatever their titles say."""
    return kind.partition("_")[0]


def normal(kind: str, text: str) -> str:
    """What all mentions of one entity have in common: a spelling without case or separators, where those are format only."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn", "phone"):
        return "+" * (text[0] == "+") + "".join(_DIGIT.findall(text))
    return "".join(_CODE.findall(text)) if kind == "iban" else text


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order."""
    out, named = [], {}
    if not LIKELY.search(text):
        return out
    for m in ENTITY.finditer(text):
        kind = next(k for k in ("email", "iban", "ip", "ssn", "phone", "card", "name") if m[k])
        if kind == "card" and not 13 <= sum(c.isdigit() for c in m["card"]) <= 19:
            continue
        full = kind if kind != "name" else "name_f" if m["tf"] else "name_m" if m["tm"] else "name"
        out.append((*m.span(kind), full))
        if kind == "name":
            named |= {w: full for w in m["name"].split(" ") if len(w) > 2}
    if named:  # the same names where they have no title
        taken = iter([*out, (len(text) + 1, len(text) + 1, "")])
        start, end, _ = next(taken)
        for m in NAME.finditer(text):
            while end <= m.start():
                start, end, _ = next(taken)
            if m[0] in named and m.end() <= start:
                out.append((*m.span(), named[m[0]]))
        out.sort()
    return out


def keyed(key: bytes, kind: str, attempt: int) -> bytes:
    return hmac.digest(key, f"{kind}#{attempt}".encode(), "sha256")


def replaced(text: str, key: bytes, attempts: dict[str, int]) -> tuple[str, list[str]]:
    """The text with its surrogates, and the kinds of the entities replaced."""
    out, at, kinds = [], 0, []
    for a, b, kind in entities(text):
        out += [text[at:a], surrogate(kind, text[a:b], keyed(key, keyring(kind), attempts.get(keyring(kind), 0)))]
        at = b
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def attempts_without_collision(docs: DataFrame, key: bytes) -> dict[str, int]:
    """For each kind the first key number under which all distinct entities of the corpus have distinct surrogates, none its own."""
    ship(docs.sparkSession)
    fields = pa.schema([("kind", pa.string()), ("value", pa.string())])
    marked = pa.schema([*fields, ("same", pa.bool_())])

    def find(batches):
        for batch in batches:
            rows = {(keyring(k), normal(k, t[a:b])) for t in batch.column(0).to_pylist() if t for a, b, k in entities(t)}
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], schema=fields)

    own = cut(docs.select("text").mapInArrow(find, "kind string, value string").distinct())
    numbers = {r.kind: 0 for r in own.select("kind").distinct().collect()}  # as many as there are kinds
    todo = set(numbers)
    for _ in range(ATTEMPTS):
        tried = dict(numbers)

        def replace(batches):
            for batch in batches:
                kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                new = [surrogate(k, v, keyed(key, k, tried[k])) for k, v in zip(kinds, values)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array([a == b and any(map(alphabet, b)) for a, b in zip(new, values)], pa.bool_())], schema=marked)

        some = own.where(F.col("kind").isin(*todo)) if todo else own.limit(0)
        some = some.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "value")  # few bytes, but much work each
        made = some.mapInArrow(replace, "kind string, value string, same boolean")
        bad = made.groupBy("kind", "value").agg(F.count("*").alias("n"), F.max("same").alias("same")).where("n > 1 or same")
        todo = {r.kind for r in bad.select("kind").distinct().collect()}
        if not todo:
            return numbers
        for k in todo:
            numbers[k] += 1
    raise RuntimeError(f"surrogates collide under {ATTEMPTS} keys: {sorted(todo)}")


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's settings; OPEN_KEY, which protects nothing, where there is none."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else OPEN_KEY


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """All columns, text with its surrogates, and entity_kinds (one for each entity, in order)."""
    docs = without(docs, ("entity_kinds",))
    numbers = attempts_without_collision(docs, key)
    place, names = docs.columns.index("text"), docs.columns
    schema = StructType([*docs.schema.fields]).add("entity_kinds", ArrayType(StringType()))

    def run(batches):
        for batch in batches:
            got = [(t, []) if t is None else replaced(t, key, numbers) for t in batch.column(place).to_pylist()]
            columns = [*batch.columns]
            columns[place] = pa.array([t for t, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k for _, k in got], pa.list_(pa.string()))], names=[*names, "entity_kinds"])

    return docs.mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_surrogates(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), session_key(spark))
    return out.select("doc_id", F.size("entity_kinds").cast("long").alias("n_entities"), F.array_join("entity_kinds", ",").alias("kinds"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
