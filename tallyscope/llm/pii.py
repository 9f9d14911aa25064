"""Surrogates for personal data.

Entities are found by patterns over whole texts and replaced by made-up ones of
the same kind and format.  A surrogate is a keyed hash of the entity's canonical
form (letters folded, separators dropped), so every mention of an entity, in any
format and in any document, gets the same surrogate in its own format.

* digits become digits, letters letters of the same case and script, marks stay;
* card numbers keep their length, first digit and a valid check digit if they had
  one; phone numbers keep country code and groups; addresses keep four octets;
* names behind a title keep title, gender, script, number of parts and case.

Collision checks: a surrogate must differ from every original of its kind in the
corpus and from every other surrogate of its kind.  Entities whose candidate
fails are drawn again with the next attempt number, until none is left.

All of it is DataFrame functions.  Only the dictionary of distinct entities and
the mentions of documents that have any are shuffled; texts without entities
pass straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.common import free_name

MAX_ROUNDS = 200

# Titles by gender, and name stems for surrogates.
MALE_TITLES = ("Mr", "Mister", "Herr", "Sir", "Monsieur", "Señor", "Sr", "Don")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor", "Mx")
MALE_NAMES = ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oskar", "Paul")
FEMALE_NAMES = ("Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Marta", "Nora", "Olga", "Paula")
NEUTRAL_NAMES = ("Alex", "Chris", "Dominique", "Jo", "Kim", "Luca", "Robin", "Sascha")
SYLLABLES = ("ba", "be", "do", "fa", "ga", "ha", "ke", "la", "le", "ma", "mo", "na", "no", "pe", "ra", "ro", "sa", "so", "ta", "vo")
DIGITS, HEX = "0123456789", "0123456789abcdef"

# Scripts: runs of letters by code point; upper and lower case are runs of their own.
SCRIPTS = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))),
    "".join(map(chr, [*range(0x3B1, 0x3C2), *range(0x3C3, 0x3CA)])), "".join(map(chr, [*range(0x391, 0x3A2), *range(0x3A3, 0x3AA)])),
    "".join(map(chr, range(0x5D0, 0x5EB))), "".join(map(chr, range(0x621, 0x63B))), "".join(map(chr, range(0x905, 0x93A))),
    "".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30FB))), "".join(map(chr, range(0xE0, 0xF7))), "".join(map(chr, range(0xC0, 0xD7))),
    "".join(map(chr, range(0xF8, 0xFF))), "".join(map(chr, range(0xD8, 0xDF))), "".join(map(chr, range(0x450, 0x460))), "".join(map(chr, range(0x400, 0x410))),
    *("".join(c for c in map(chr, range(0x100, 0x178)) if c not in "İıĸŉ" and c.islower() == low) for low in (True, False)),
    "".join(map(chr, range(0xE01, 0xE2F))),
)
# Scripts of too many letters for a run: one of these stands for any.
MANY = ((r"\p{IsHan}", "".join(map(chr, range(0x4E00, 0x4EFB)))), (r"\p{IsHangul}", "".join(map(chr, range(0xAC00, 0xACFB)))))

_ALL_TITLES = (*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES)
_TITLES = "|".join(sorted({*_ALL_TITLES, *[t.upper() for t in _ALL_TITLES]}, key=lambda t: (-len(t), t)))
# Letters of scripts that put no blanks between words, and those of all others, which make words.
_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30FC\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_DENSE_LETTER = r"[\p{L}\p{M}\p{N}&&[" + _DENSE + "]]"
_OTHER = r"[\p{L}\p{M}\p{N}&&[^" + _DENSE + "]]"
_IN_WORD = "[A-Za-z0-9" + _OTHER + "]"
_HOST = r"@(?:[A-Za-z0-9\-\p{L}\p{M}\p{N}]+\.)+[A-Za-z]{2,}"
# kind, pattern; the first that fits at a place wins.  An address may begin where the entity before it ends; its local part is
# of word letters, so that it does not take in Chinese text it stands behind, or else of dense letters alone.
PATTERNS = (
    ("email", "(?:(?<!" + _IN_WORD + r")|\G)" + _IN_WORD + r"[A-Za-z0-9._%+\-" + _OTHER + "]*+" + _HOST),
    ("email", "(?<!" + _DENSE_LETTER + ")" + _DENSE_LETTER + "++" + _HOST),
    ("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,128}(?![A-Za-z0-9])"),
    ("ssn", r"(?<![A-Za-z0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9\-])"),
    ("ip", r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![A-Za-z0-9]|\.[0-9])"),
    ("phone", r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,5}\)[ .\-]?)?[0-9]{2,5}(?:[ .\-]?[0-9]{2,5}){1,4}(?![A-Za-z0-9])"),
    ("card", r"(?<![A-Za-z0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![A-Za-z0-9])"),
    ("phone", r"(?<![A-Za-z0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![A-Za-z0-9])"),
    ("name", "(?<!" + _IN_WORD + ")(?:" + _TITLES + r")\.? +\p{Lu}[\p{L}'\-]+(?: +\p{Lu}[\p{L}'\-]+)?"),
)
# What the guard of each pattern implies, asked once before all: no entity begins behind an ASCII letter or digit, but for an
# address behind another entity.
ENTITY = r"(?:(?<![A-Za-z0-9])|\G)(?:" + "|".join(f"(?:{p})" for _, p in PATTERNS) + ")"
# Cheap looks that every entity passes: a digit or an at sign, or else a title before a capital, for which in turn a word
# with a title's first letter is looked for first.
MARKED = "[0-9@]"
TITLE_LIKE = "[" + "".join(sorted({t[0] for t in _ALL_TITLES})) + r"]\p{L}{1,8}\.? +\p{Lu}"
TITLED = "(?<!" + _IN_WORD + ")(?:" + _TITLES + r")\.? +\p{Lu}"


def mentions_of(text: Column) -> Column:
    """The entities of a text in order, as written; none for NULL."""
    none = F.array().cast("array<string>")
    likely = text.rlike(MARKED) | (text.rlike(TITLE_LIKE) & text.rlike(TITLED))
    return F.when(likely, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


def kind_of(mention: Column) -> Column:
    """The kind of an entity as written."""
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS[:-1]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all ways to write an entity: digits alone, folded letters, a name without its title's dot and case."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    plain = F.regexp_replace(F.lower(mention), r"[.]? +", " ")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "name", F.regexp_replace(plain, r"^\S+ ", "")).when(kind.isin("key", "ip"), mention).otherwise(F.lower(mention))
    )


def gender_of(mention: Column) -> Column:
    """f, m or n by the title; empty for other kinds than names."""
    title = F.initcap(F.regexp_extract(mention, r"^(\p{L}+)", 1))
    return F.when(title.isin(*FEMALE_TITLES), "f").when(title.isin(*MALE_TITLES), "m").when(title.isin(*NEUTRAL_TITLES), "n").otherwise("")


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (from 0, round and round) pair of hex digits of a stream, as a number."""
    at = F.pmod(i, F.lit(60)).cast("int") * 2 + 1
    return F.conv(F.substring(stream, at, F.lit(4)), 16, 10).cast("int")


def _swap(char: Column, draw: Column) -> Column:
    """Another character of the same class: digit, or letter of the same script and case; marks stay."""
    out = char
    for script, letters in MANY:
        out = F.when(char.rlike(script), F.substring(F.lit(letters), F.pmod(draw, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
    for alphabet in (*SCRIPTS, DIGITS):
        n = len(alphabet)
        at = F.instr(F.lit(alphabet), char)
        out = F.when(at > 0, F.substring(F.lit(alphabet), (F.pmod(at - 1 + 1 + F.pmod(draw, F.lit(n - 1)), F.lit(n)) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _shape(value: Column, stream: Column, keep: Column | None = None) -> Column:
    """Every character swapped, but those at places (from 0) for which ``keep`` holds."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(keep(c, i), c).otherwise(_swap(c, _byte(stream, i))) if keep else _swap(c, _byte(stream, i))), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number whose last place is its check digit."""
    parts = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(parts, lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, F.floor(c.cast("int") * 2 / 10) + F.pmod(c.cast("int") * 2, F.lit(10))).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x)


def surrogate(kind: Column, value: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A candidate of the same kind for a canonical value; ``stream`` is a keyed hash in hex."""
    n = F.length(value)
    hexes = F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c, i: F.substring(F.lit(HEX), F.pmod(_byte(stream, i), F.lit(16)) + 1, F.lit(1))), "")
    card = _shape(value, stream, lambda c, i: (i == 0) | (i == n - 1))
    body = F.substring(card, F.lit(1), n - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn_sum(value), F.lit(10)) == 0, F.concat(body, check)).otherwise(_shape(value, stream, lambda c, i: i == 0))
    ip = F.array_join(F.transform(F.split(value, "\\."), lambda c, i: (F.pmod(c.cast("int") + 1 + F.pmod(_byte(stream, i), F.lit(253)), F.lit(254)) + 1).cast("string")), ".")
    ending = F.length(F.regexp_extract(value, r"(\.[a-z]+)$", 1))
    email = _shape(value, stream, lambda c, i: i >= n - ending)
    phone = F.when(n > 10, _shape(value, stream, lambda c, i: i < n - 10)).otherwise(_shape(value, stream))
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), F.pmod(_byte(stream, F.lit(i)), F.lit(len(names))) + 1)
    given = F.when(gender == "f", pick(FEMALE_NAMES, 0)).when(gender == "m", pick(MALE_NAMES, 0)).otherwise(pick(NEUTRAL_NAMES, 0))
    family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + F.floor(attempt / 8).cast("int")), lambda i: F.element_at(F.array(*[F.lit(x) for x in SYLLABLES]), F.pmod(_byte(stream, i), F.lit(len(SYLLABLES))) + 1)), ""))
    other = value.rlike(r"[^\x00-ɏ]")
    name = F.when(other, _shape(value, stream)).when(value.contains(" "), F.concat(given, F.lit(" "), family)).otherwise(family)
    return (
        F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "email", email).when(kind == "secret", hexes).when(kind == "phone", phone)
        .when(kind == "key", F.concat(F.lit("AKIA"), _shape(F.substring(value, 5, 16), stream))).when(kind == "iban", _shape(value, stream, lambda c, i: i < 2))
        .when(kind == "name", name).otherwise(_shape(value, stream))
    )


def render(kind: Column, mention: Column, made: Column) -> Column:
    """A canonical surrogate in the format of a mention."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    nth = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    placed = F.array_join(F.transform(chars(mention), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(made, nth(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.zip_with(chars(mention), chars(made), lambda a, b: F.when((a != F.lower(a)) & (a == F.upper(a)), F.upper(b)).otherwise(b)), "")
    title = F.regexp_extract(mention, r"^(\p{L}+\.? +)", 1)
    rest = F.substring(mention, F.length(title) + 1, F.length(mention))
    name = F.concat(title, F.when((rest == F.upper(rest)) & (F.length(rest) > 1), F.upper(made)).when(made == F.lower(made), F.initcap(made)).otherwise(made))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), placed).when(kind == "name", name).when(kind.isin("key", "ip"), made).otherwise(cased)


def assign_surrogates(entities: DataFrame, key: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(kind, value, gender, made) for distinct ``entities(kind, value, gender)``, with collision checks.

    Each round draws the open entities again.  A candidate stands if no original
    and no earlier surrogate of its kind equals it and no smaller open value drew
    it too.
    """
    taken = entities.select("kind", F.col("value").alias("made")).distinct()
    open_, done = entities, None
    for attempt in range(max_rounds):
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(attempt)), "kind", "value", "gender").cast("binary"), 512)
        drawn = open_.withColumn("_stream", stream)
        made = F.lower(surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("_stream"), F.lit(attempt)))
        exact = surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("_stream"), F.lit(attempt))
        drawn = checkpointed(drawn.select("kind", "value", "gender", F.when(F.col("kind").isin("key", "iban"), exact).otherwise(made).alias("made")))
        used = taken if done is None else taken.unionByName(done.select("kind", "made"))
        claims = drawn.select("kind", "made", F.struct("value", "gender").alias("by"), F.lit(0).alias("old")).unionByName(
            used.select("kind", "made", F.lit(None).cast("struct<value:string,gender:string>").alias("by"), F.lit(1).alias("old"))
        )
        winner = claims.groupBy("kind", "made").agg(F.max("old").alias("old"), F.min("by").alias("by")).where("old = 0")
        won = checkpointed(winner.select("kind", F.col("by.value").alias("value"), F.col("by.gender").alias("gender"), "made"))
        done = won if done is None else checkpointed(done.unionByName(won))
        open_ = checkpointed(open_.join(won.select("kind", "value", "gender"), ["kind", "value", "gender"], "left_anti"))
        if open_.isEmpty():
            return done
    raise RuntimeError("a kind has fewer free surrogates than entities")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text column; ``count_col`` adds the number of replaced mentions.

    Texts without entities, empty and NULL texts stay as they are.  Extra
    columns are kept.  Rows may repeat, and ids may be NULL.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    names = docs.columns
    found = docs.select(F.xxhash64(ident.cast("string"), text).alias("_row"), F.explode_outer(mentions_of(text)).alias("mention")).where("mention is not null")
    found = found.select("_row", "mention", kind_of(F.col("mention")).alias("kind"))
    is_name = F.col("kind") == "name"
    found = checkpointed(found.select(
        "_row", "mention", "kind", canonical(F.col("kind"), F.col("mention")).alias("value"),
        F.when(is_name, gender_of(F.col("mention"))).otherwise(F.lit("")).alias("gender"),
    ).distinct())
    written = found.groupBy("kind", "value", "gender", "mention").agg(F.count(F.lit(1)).alias("_n"))
    written = checkpointed(written)
    made = assign_surrogates(written.select("kind", "value", "gender").distinct(), key)
    spelled = checkpointed(written.join(made, ["kind", "value", "gender"]).select("mention", render(F.col("kind"), F.col("mention"), F.col("made")).alias("to")))
    per_row = checkpointed(
        found.select("_row", "mention").join(spelled, "mention").groupBy("_row")
        .agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("mention", "to")))).alias("_map"))
    )
    row, told_by, count = (free_name(docs, n) for n in ("_row", "_map", count_col or "_count"))
    some = F.size(mentions_of(text)) > 0
    rest = docs.where(~F.coalesce(some, F.lit(False)))
    per_row = per_row.select(F.col("_row").alias(row), F.col("_map").alias(told_by))
    held = docs.where(some).withColumn(row, F.xxhash64(ident.cast("string"), text)).join(per_row, row)
    between = F.split(text, ENTITY, -1)
    told = F.transform(mentions_of(text), lambda m: F.coalesce(F.col(told_by)[m], m))
    fresh = F.concat(F.element_at(between, 1), F.array_join(F.zip_with(told, F.slice(between, 2, F.size(between)), lambda a, b: F.concat(a, b)), ""))
    out = held.select(*[fresh.alias(n) if n == text_col else F.col(f"`{n}`") for n in names], F.size(mentions_of(text)).alias(count))
    all_ = out.unionByName(rest.select(*[F.col(f"`{n}`") for n in names], F.lit(0).alias(count)))
    return all_ if count_col else all_.drop(count)
