"""Personal data replaced by surrogates of the same type and form. DataFrame operations only.

Detected entities: e-mail addresses, IPv4 addresses, telephone, payment card and social security
numbers, keys and tokens, and names after a title, in the forms of PATTERNS; README lists what they leave. Surrogates are keyed and depend on an entity's
canonical form alone, so every mention of it, whatever its case or spacing, gets the same one:

- Strings are enciphered in place: halves take turns in shifting each other's characters, each within its
  own alphabet. That is a bijection of all strings of one shape, so distinct entities stay distinct.
- IPv4 addresses are permuted as 32-bit numbers; cards keep their first digit and their check sum's
  validity; telephone numbers keep their country code.
- Names are enciphered vowel by vowel and consonant by consonant of their script. Given names get an ending by
  the gender that the title says; Cyrillic family names keep theirs. Family and given names map apart, so
  "Dr A B" and "Dr B" still name one person. Names of other letters become Latin syllables.

A check over the distinct entities of the whole corpus looks for surrogates that coincide with each
other or with a real entity; those are drawn again. Where the real entities fill over a quarter of a shape
(one-letter mail names, say) that could go on for ever: there every character moves on by a keyed step of
at least one, so entities of such a shape stay distinct and none keeps its value, but a surrogate may be
another's real value. Surrogates of the last two kinds of names grow longer as they are drawn again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, hot_join

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TITLES_F, TITLES_M, TITLES_N = "Mrs|Ms|Miss|Frau|Mme|Mlle|Sra|Srta|Г-жа", "Mr|Herr|Sr|Г-н", "Dr|Prof"
SHOUTED_F, SHOUTED_M, SHOUTED_N = TITLES_F.upper(), TITLES_M.upper(), TITLES_N.upper()
TITLES = "|".join((TITLES_F, TITLES_M, TITLES_N, SHOUTED_F, SHOUTED_M, SHOUTED_N))
TITLE_STARTS = "".join(sorted({t[0] for t in TITLES.split("|")}))
#: Titles stand in rows: Herr Dr. Schmidt, Frau Prof. Dr. Schmidt.
TITLED = rf"(?:{TITLES})\.?(?: (?:{TITLES})(?![\p{{L}}'’-])\.?){{0,3}}"
NAME = r"\p{Lu}(?:[\p{L}-]|['’](?!s(?!\p{L}))){1,40}"  # Schmidt's is Schmidt
#: By type, most specific first. Every one starts at a position that can be told from the character
#: before it and is of bounded length but for what a single run of its characters holds.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,6}",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3\d{3}[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,128}+(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{30,80}|sk-[A-Za-z0-9-]{20,100})(?![A-Za-z0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=[{TITLE_STARTS}]){TITLED} {NAME}(?: {NAME})?",
}
#: Where any of them can start: at a digit, + or (, at an ASCII letter after none of its like (what stands in
#: scripts without blanks too), or at a letter that starts a word. Most places fail the first test.
START = r"(?!(?<=[A-Za-z])[A-Za-z])(?=[\d+(]|(?<![A-Za-z0-9])[A-Za-z]|(?<![\p{L}\p{N}])\p{L})"
KINDS = list(PATTERNS)  # numbers stand together, as they start alike
ANY = START + "(?:({email})|(?=[\\d+(])(?:({ip})|({phone})|({ssn})|({card}))|({secret})|({name}))".format(**PATTERNS)
#: What a text with any match surely holds, sought before the costly expression.
HELD = ["@", "AKIA", "gho_", "ghp_", "ghs_", "ghu_", "sk-"]
HELD_FORMS = [r"\d[\d .()-]{5}", r"[0-9a-fA-F]{32}", rf"(?=[{TITLE_STARTS}])(?:{TITLES})\.? "]
#: One pass marks all matches: MARK before and after each, FIELD between the groups, of which one is filled. A
#: text's own ESCAPE is written as OWN meanwhile. Private characters, which no pattern tells from blanks.
ESCAPE = "\ue0f0"
MARK, FIELD, OWN = (ESCAPE + c for c in "\ue0f1\ue0f2\ue0f3")
MARKED = MARK + FIELD.join(f"${i + 1}" for i in range(len(KINDS))) + MARK
#: Letters that take each other's place in names, by script, and characters that stay.
LETTERS = {
    "latin": ["bcdfghjklmnpqrstvwxz", "aeiouy", "áàâäãåāăąéèêëēėęěíìîïīįóòôöõøōőúùûüūůűųýÿ", "çćčďđğłńňñřśšşťźžż"],
    "cyrillic": ["бвгджзйклмнпрстфхцчшщ", "аеёиоуыэюя"],
}
STAYING = "'’ßьъ-"
ENDINGS = {"latin": {"f": "a", "m": "us", "n": "e"}, "cyrillic": {"f": "ия", "m": "ий", "n": "о"}}
FAMILY_END = "(?<=.)((?:ск|цк)?(?:ая|ий)|[оеё]ва?|ина?|а|я)$"
SYLLABLES = "bar ber dal den fel gar hol kor lan lin mar mer nor ral sen tor".split()
#: Country codes: of one digit, of three, else of two (fixed values of the numbering plan).
COUNTRY = r"1|7|2[1-69]\d|3[578]\d|42\d|5[09]\d|6[789]\d|8[0578]\d|9[679]\d|\d\d"


def _draw(digest: Column, at: int, n: int) -> Column:
    """A number below n from eight hex digits of a digest."""
    return F.pmod(F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), F.lit(n))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _shift(text: Column, digest: Column, alphabets: Column, always: bool = False) -> Column:
    """Every character moved on within its alphabet by a step that the digest gives its place (always: by one
    at least); characters of none of the alphabets (an array of strings without common characters) stay."""

    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        h = F.pmod(2 * i, F.lit(120)) + 1
        step = 16 * (F.call_function("instr", F.lit(HEX), F.substring(digest, h, F.lit(1))) - 1) + F.call_function("instr", F.lit(HEX), F.substring(digest, h + 1, F.lit(1))) - 1
        mine = F.get(F.filter(alphabets, lambda a: F.call_function("instr", a, c) > 0), F.lit(0))
        steps = (lambda a: 1 + F.pmod(step, F.length(a) - 1)) if always else (lambda a: step)
        moved = lambda a: F.substring(a, F.pmod(F.call_function("instr", a, c) - 1 + steps(a), F.length(a)) + 1, F.lit(1))
        return F.when(mine.isNull(), c).otherwise(_let(mine, moved))

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise(F.lit(""))


def _encipher(text: Column, tweak: Column, alphabets: Column, rounds: int = 4) -> Column:
    """A bijection of the strings of text's shape."""
    half = F.ceil(F.length(text) / 2).cast("int")
    left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    state = F.struct(left.alias("l"), right.alias("r"), F.concat(tweak, F.lit("|"), F.length(text)).alias("t"), alphabets.alias("a"))

    def turn(k: int) -> Callable[[Column], Column]:
        def step(s: Column) -> Column:
            fixed, moved = ("l", "r") if k % 2 == 0 else ("r", "l")
            shifted = _let(F.sha2(F.concat(s["t"], F.lit(f"|{k}|"), s[fixed]), 512), lambda digest: _shift(s[moved], digest, s["a"]))
            return F.struct(*((shifted if c == moved else s[c]).alias(c) for c in "lrta"))

        return step

    for k in range(rounds):
        state = _let(state, turn(k))
    return _let(state, lambda s: F.concat(s["l"], s["r"]))


def _ip(value: Column, tweak: Column, tries: Column) -> Column:
    parts = F.split(value, r"\.")
    number = lambda i: parts[i].cast("long") * 256 + parts[i + 1].cast("long")
    state = F.struct(number(0).alias("l"), number(2).alias("r"))

    def turn(k: int) -> Callable[[Column], Column]:
        def step(s: Column) -> Column:
            fixed, moved = ("l", "r") if k % 2 == 0 else ("r", "l")
            add = _draw(F.sha2(F.concat(tweak, F.lit(f"|{k}|"), s[fixed].cast("string")), 256), 1, 65536)
            add = F.when(tries < 0, F.lit(12345)).otherwise(add)
            return F.struct(*((F.pmod(s[c] + add, F.lit(65536)) if c == moved else s[c]).alias(c) for c in "lr"))

        return step

    for k in range(4):
        state = _let(state, turn(k))
    return _let(state, lambda s: F.concat_ws(".", *(F.floor(s[c] / 256).cast("string") if high else F.pmod(s[c], F.lit(256)).cast("string") for c in "lr" for high in (True, False))))


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's check, modulo 10."""
    n = F.length(digits)

    def add(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(i, F.lit(2)) == 0, twice).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), add), F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(digits: Column, body: Column) -> Column:
    """The first digit, the enciphered body, and the digit that keeps the check sum's remainder."""
    return _let(F.concat(F.substring(digits, 1, 1), body), lambda b: F.concat(b, F.pmod(_luhn(digits) - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def _lay(digits: Column, form: Column) -> Column:
    """The digits put in the places of the form's digits."""
    place = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i), r"\D", ""))
    one = lambda i: F.when(F.substring(form, i, F.lit(1)).rlike(r"\d"), F.substring(digits, place(i), F.lit(1))).otherwise(F.substring(form, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _syllables(digest: Column, n: Column) -> Column:
    parts = F.array(*map(F.lit, SYLLABLES))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(parts, (_draw(F.sha2(F.concat(digest, i.cast("string")), 256), 1, len(SYLLABLES)) + 1).cast("int"))), "")


def _script(word: Column) -> Column:
    """Of a lower-case name word: the script all of whose letters LETTERS lists, else other."""
    is_of = lambda letters: word.rlike(rf"^[{''.join(letters)}{STAYING}]*$") & word.rlike(f"[{''.join(letters)}]")
    return F.when(is_of(LETTERS["latin"]), "latin").when(is_of(LETTERS["cyrillic"]), "cyrillic").otherwise("other")


def matched(piece: Column) -> Column:
    """(kind, match) of what stands between two MARKs."""

    def one(fields: Column) -> Column:
        at = F.array_position(F.transform(fields, lambda f: f != ""), True).cast("int")
        return F.struct(F.element_at(F.array(*map(F.lit, KINDS)), at).alias("kind"), F.element_at(fields, at).alias("match"))

    return _let(F.split(piece, FIELD, -1), one)


def _units(found: Column) -> Column:
    """What a match holds: array of (kind, canonical form). Names have one for each word."""
    kind, match = found["kind"], found["match"]
    digits = F.regexp_replace(match, r"\D", "")
    told, guessed = F.regexp_extract(match, r"^\+(\d{1,3})(?=\D)", 1), F.regexp_extract(match, rf"^\+({COUNTRY})\d+$", 1)
    phone = _let(F.concat(told, guessed), lambda c: F.concat(c, F.lit("|"), F.substring(digits, F.length(c) + 1, F.length(digits))))
    secret = F.when(match.rlike("^[0-9A-Fa-f]+$"), F.lower(match)).otherwise(match)
    titles = F.regexp_extract(match, rf"^({TITLED}) {NAME}(?: {NAME})?$", 1)
    words = F.slice(F.split(match, " "), F.size(F.split(titles, " ")) + 1, F.size(F.split(match, " ")))
    among = lambda some: titles.rlike(rf"(?:^| )(?:{some})\.?(?: |$)")
    gender = F.when(among(f"{TITLES_F}|{SHOUTED_F}"), "f").when(among(f"{TITLES_M}|{SHOUTED_M}"), "m").otherwise("n")
    unit = lambda kind, form: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), form.alias("form"))
    named = lambda w, i: F.when((i == 0) & (F.size(words) > 1), F.concat(F.lit("given_"), _script(w), F.lit("_"), gender)).otherwise(F.concat(F.lit("family_"), _script(w)))
    names = F.transform(F.transform(words, F.lower), lambda w, i: unit(named(w, i), w))
    return (
        F.when(kind == "name", names)
        .when(kind == "phone", F.array(unit("phone", phone)))
        .when(kind.isin("ssn", "card"), F.array(unit(kind, digits)))
        .when(kind == "secret", F.array(unit("secret", secret)))
        .otherwise(F.array(unit(kind, F.lower(match))))
    )


def _parts(kind: Column, form: Column) -> Column:
    """before, inner, after and alphabets: what is enciphered, between what is kept, and how its characters
    group; mark tells shapes of cards apart by their check sums. One cipher serves all kinds."""
    nothing = F.lit("")
    before = F.when(kind == "phone", F.concat(F.substring_index(form, "|", 1), F.lit("|"))).when(kind == "secret", F.regexp_extract(form, r"^(AKIA|gh[opsu]_|sk-)", 1)).when(kind == "card", F.substring(form, 1, 1)).otherwise(nothing)
    after = F.when(kind == "email", F.regexp_extract(form, r"(\.[a-z0-9-]+)$", 1)).when(kind == "family_cyrillic", F.regexp_extract(form, FAMILY_END, 1)).otherwise(nothing)
    hexed = (kind == "secret") & form.rlike("^[0-9a-f]+$")
    of = lambda *a: F.array(*map(F.lit, a))
    alphabets = F.when(hexed, of(HEX)).when(kind == "secret", of(DIGITS, LOWER, UPPER)).when(kind == "email", of(DIGITS, LOWER))
    for script, letters in LETTERS.items():
        alphabets = alphabets.when(kind.endswith(f"_{script}") | kind.contains(f"_{script}_"), of(*letters))
    size = F.length(form) - F.length(before) - F.length(after) - (kind == "card").cast("int")
    mark = F.when(kind == "card", _luhn(form).cast("string")).otherwise(nothing)
    return F.struct(before.alias("before"), F.substring(form, F.length(before) + 1, size).alias("inner"), after.alias("after"), alphabets.otherwise(of(DIGITS)).alias("alphabets"), mark.alias("mark"))


def _shape(kind: Column, form: Column) -> Column:
    """shape: what a bijection keeps of a form; room: the logarithm of how many forms have it (null: no end)."""

    def of(x: Column) -> Column:
        mine = lambda i: F.get(F.filter(F.transform(x["alphabets"], lambda a, k: F.struct(k.alias("k"), F.length(a).alias("n"), (F.call_function("instr", a, F.substring(x["inner"], i, F.lit(1))) > 0).alias("has"))), lambda y: y["has"]), F.lit(0))
        places = F.when(F.length(x["inner"]) > 0, F.transform(F.sequence(F.lit(1), F.length(x["inner"])), lambda i: F.struct(F.coalesce(mine(i)["k"].cast("string"), F.substring(x["inner"], i, F.lit(1))).alias("c"), F.log(F.coalesce(mine(i)["n"], F.lit(1)).cast("double")).alias("room"))))
        return F.struct(F.concat_ws("|", x["before"], F.array_join(places["c"], ","), x["after"], x["mark"]).alias("shape"), F.aggregate(places["room"], F.lit(0.0), lambda a, b: a + b).alias("room"))

    ip, other = F.struct(F.lit("").alias("shape"), F.lit(22.18).alias("room")), F.struct(F.lit("").alias("shape"), F.lit(None).cast("double").alias("room"))
    return F.when(kind == "ip", ip).when(kind.contains("_other"), other).otherwise(_let(_parts(kind, form), of))


def _surrogate(kind: Column, form: Column, key: str, tries: Column) -> Column:
    """The surrogate of a canonical form, itself in canonical form. tries: how often it was drawn before; -1: of
    a crowded shape."""
    plain = F.regexp_replace(kind, "^(given_.*)_[fmn]$", "$1")  # genders share their stems
    tweak = F.concat(F.lit(key), F.lit("|"), plain, F.lit("|"), tries.cast("string"))

    def made(x: Column) -> Column:
        own = F.concat(tweak, F.lit("|"), x["before"], F.lit("|"), x["after"])
        crowded = lambda: _let(F.sha2(F.concat(own, F.length(x["inner"])), 512), lambda digest: _shift(x["inner"], digest, x["alphabets"], always=True))
        body = F.when(tries < 0, crowded()).otherwise(_encipher(x["inner"], own, x["alphabets"]))
        return F.when(kind == "card", _card(form, body)).otherwise(F.concat(x["before"], body, x["after"]))

    ending = F.lit("")
    for script, ends in ENDINGS.items():
        for gender, end in ends.items():
            ending = F.when(kind == f"given_{script}_{gender}", F.repeat(F.lit(end), 1 + F.greatest(F.lit(0), tries - 4))).otherwise(ending)
    return F.when(kind == "ip", _ip(form, tweak, tries)).when(kind.contains("_other"), _syllables(F.concat(tweak, F.lit("|"), kind, F.lit("|"), form), tries + 4)).otherwise(F.concat(_let(_parts(kind, form), made), ending))


def _in_form(found: Column, surrogates: Column) -> Column:
    """The surrogates written as the match was: its separators, its case."""
    kind, match = found["kind"], found["match"]
    first = surrogates[0]
    shouted = (F.upper(match) == match) & (F.lower(match) != match)
    titles = F.slice(F.split(match, " "), F.lit(1), F.greatest(F.size(F.split(match, " ")) - F.size(surrogates), F.lit(0)))
    capital = lambda w: F.replace(F.initcap(F.replace(w, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))
    words = F.array_join(F.concat(titles, F.transform(surrogates, capital)), " ")
    return (
        F.when(kind == "phone", _lay(F.replace(first, F.lit("|"), F.lit("")), match))
        .when(kind.isin("ssn", "card"), _lay(first, match))
        .when(kind == "secret", F.when(match.rlike("^[0-9A-F]+$"), F.upper(first)).otherwise(first))
        .when(kind == "email", F.when(shouted, F.upper(first)).otherwise(first))
        .when(kind == "name", F.when(shouted, F.upper(words)).otherwise(words))
        .otherwise(first)
    )


def may_match(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [*(text.contains(x) for x in HELD), *(text.rlike(x) for x in HELD_FORMS)])


def marked(text: Column) -> Column:
    """The text with its matches marked, or null where it has none."""
    made = F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(OWN)), ANY, MARKED)
    return F.when(may_match(text), _let(made, lambda m: F.when(m.contains(MARK), m)))


def entities(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, kind and form of every distinct entity of the texts."""
    pieces = docs.where(may_match(F.col(text))).select(*keys, marked(F.col(text)).alias("_marked")).where(F.col("_marked").isNotNull())
    found = F.filter(F.split("_marked", MARK, -1), lambda _, i: i % 2 == 1)
    each = pieces.select(*keys, F.explode(found).alias("m")).distinct()
    return each.select(*keys, F.explode(_units(matched(F.col("m")))).alias("u")).select(*keys, "u.kind", "u.form").distinct()


def later_draws(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(kind, form, tries) of the entities whose surrogates are not their first draws: those of crowded shapes
    (-1), and those that would coincide with another entity's surrogate or with a real entity. Of coinciding
    ones the smallest form keeps its draw."""
    shaped = cut(entities(docs, text).withColumn("_s", _shape(F.col("kind"), F.col("form"))).select("kind", "form", F.concat_ws("|", "kind", "_s.shape").alias("shape"), "_s.room"))
    crowded = shaped.groupBy("shape").agg(F.count("*").alias("n"), F.min("room").alias("room")).where(F.log(F.lit(4.0) * F.col("n")) > F.col("room")).select("shape", "n", F.lit(-1).alias("crowded"))
    drawn = hot_join(shaped, crowded, "shape", "n", shaped.count(), "left", salt="form").select("kind", "form", F.coalesce("crowded", F.lit(0)).alias("tries"))
    drawn = cut(drawn.withColumn("out", _surrogate(F.col("kind"), F.col("form"), key, F.col("tries"))))
    space = F.regexp_replace("kind", "^(given|family)_.*$", "$1")
    while True:
        placed = drawn.select(space.alias("space"), F.lower("out").alias("o"), "kind", "form", "tries")
        keep = placed.groupBy("space", "o").agg(F.min(F.struct("tries", "form", "kind")).alias("owner"), F.count("*").alias("n"))
        real = drawn.select(space.alias("space"), F.col("form").alias("o")).distinct().withColumn("real", F.lit(True))
        against = keep.join(real, ["space", "o"], "left").where((F.col("n") > 1) | F.col("real"))
        clash = placed.join(against, ["space", "o"]).where((F.col("tries") >= 0) & (F.col("real") | (F.struct("tries", "form", "kind") != F.col("owner"))))
        clash = cut(clash.select("kind", "form").withColumn("again", F.lit(1)))
        if clash.isEmpty():
            return drawn.where("tries <> 0").select("kind", "form", "tries")
        moved = drawn.join(clash, ["kind", "form"], "left").withColumn("tries", F.col("tries") + F.coalesce("again", F.lit(0)))
        now = F.when(F.col("again") == 1, _surrogate(F.col("kind"), F.col("form"), key, F.col("tries"))).otherwise(F.col("out"))
        drawn = cut(moved.select("kind", "form", "tries", now.alias("out")))


#: Later draws that are sent to all tasks; where there are more, each text gets its own.
MOST_SENT = 1000


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_entities") -> DataFrame:
    """docs with every entity in the text column replaced, and their number (long) as column `count` after its
    columns, unless that is None.

    Null texts stay null with 0 entities; texts without entities come back as they are. Rows, repeated
    ones too, and other columns are untouched, but for one called as `count` is, which it replaces.
    The texts are not shuffled unless more than MOST_SENT surrogates had to be drawn again.
    """
    kept = [c for c in docs.columns if c != count]
    columns = [f"_column{i}" for i in range(len(kept))]
    text = columns[kept.index(text)]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept)).toDF(*columns)  # clear of the names below
    again = later_draws(docs, text, key)
    work, late = docs, None
    as_map = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "form"), "tries"))).alias("_late")
    if n := again.count():
        late = F.col("_late")
        if n <= MOST_SENT:
            work = docs.withColumn("_of", F.lit(0)).join(F.broadcast(again.groupBy(F.lit(0).alias("_of")).agg(as_map)), "_of", "left")
        else:  # to each text those that it holds, by its digest
            named = docs.withColumn("_of", F.sha2(text, 256))
            work = named.join(entities(named, text, "_of").join(again, ["kind", "form"]).groupBy("_of").agg(as_map), "_of", "left")

    def replaced(piece: Column) -> Column:
        def drawn(u: Column) -> Column:
            tries = F.lit(0) if late is None else F.coalesce(F.try_element_at(late, F.concat_ws("|", u["kind"], u["form"])), F.lit(0))
            return _surrogate(u["kind"], u["form"], key, tries)

        return _let(matched(piece), lambda m: _let(F.transform(_units(m), drawn), lambda s: _in_form(m, s)))

    pieces = work.withColumn("_pieces", F.split(marked(F.col(text)), MARK, -1))
    whole = F.array_join(F.transform("_pieces", lambda p, i: F.when(i % 2 == 1, replaced(p)).otherwise(p)), "")
    out = F.when(F.col("_pieces").isNull(), F.col(text)).otherwise(F.replace(whole, F.lit(OWN), F.lit(ESCAPE)))
    counted = [F.when(F.col("_pieces").isNull(), 0).otherwise(F.floor(F.size("_pieces") / 2)).cast("long").alias("_n")] if count else []
    return pieces.select(*(out.alias(text) if c == text else F.col(c) for c in columns), *counted).toDF(*kept, *([count] if count else []))
