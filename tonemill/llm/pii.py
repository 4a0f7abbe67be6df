"""PII: detected entities get keyed, type-consistent surrogates.

`find` cuts a text into entities and the pieces between them. `surrogates`
maps each distinct entity of a corpus to a stand-in of the same kind: digits
for digits in the same layout (a phone keeps its country code, a card number
its first digit and whether its check digit fits), valid octets for an
address, hex for hex, letters of the same script for letters. A person is found
behind a courtesy title, and in the same text by the full name or surname alone
wherever a title has told it. Given names and surnames have surrogates of their
own, of the title's gender (of neither, where it tells none) and the name's script, so `Mr. John Smith`,
`Mr. Smith` and `John Smith` stay one person.

The stand-in comes from SHA-2 of a key, the kind and the entity's canonical
form, so an entity reads alike everywhere, however it is spaced or cased.
Stand-ins that two entities would share, or that are an entity of the corpus
themselves, are drawn again until all are distinct. The key is the setting
``spark.tonemill.pii.key`` (`configured_key`); without it each call draws a key
of its own, and what two runs give can't be linked.

Defined cases: null stays null; a text without entities stays as it is; an
empty table stays empty; very long texts are searched whole; rows are told
apart by doc_id and text, and repeated rows each stay; n_chars, if there is such
a column, is counted anew; other columns are kept, whatever their names, but
for one of the name that the count gets, n_entities if none is given.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh_name, materialize, small

KEY_SETTING = "spark.tonemill.pii.key"
MAX_DRAWS = 32

_FREE, _END = "(?<![\\p{L}\\p{N}])", "(?![\\p{L}\\p{N}])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
MALE, FEMALE, EITHER = "Mr|Herr|Señor|Monsieur|Господин", "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mme|Госпожа", "Dr|Prof|Professor|Доктор|Профессор"
_TITLES = f"(?:{MALE}|{FEMALE}|{EITHER})"
# Country codes of one and of two digits; all others have three.
_COUNTRY = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
PATTERNS = {
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]++@[\\p{L}\\p{N}-]++(?:\\.[\\p{L}\\p{N}-]+)+",
    "ip": f"(?<![\\p{{L}}\\p{{N}}.]){_OCTET}(?:\\.{_OCTET}){{3}}(?!\\.?[\\p{{L}}\\p{{N}}])",
    "phone": f"(?:\\+[0-9]{{1,3}}[ .-]?(?:\\([0-9]{{2,4}}\\)|[0-9]{{2,4}})(?:[ .-]?[0-9]{{2,4}}){{2,3}}|\\([0-9]{{3}}\\) ?[0-9]{{3}}[ .-][0-9]{{4}}|{_FREE}[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}){_END}",
    "ssn": f"{_FREE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "secret": f"{_FREE}(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}}|(?:AKIA|ASIA)[0-9A-Z]{{16}}|(?:ghp|gho|ghs)_[0-9A-Za-z]{{30,}}|sk-[0-9A-Za-z_-]{{20,}}|eyJ[0-9A-Za-z_-]{{10,}}(?:\\.[0-9A-Za-z_-]{{5,}}){{2}}){_END}",
    "card": f"{_FREE}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|3[47][0-9]{{2}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_END}",
    "person": f"{_FREE}{_TITLES}\\.? \\p{{Lu}}[\\p{{L}}'-]+(?: \\p{{Lu}}[\\p{{L}}'-]+)?{_END}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLE = f"{_TITLES}\\.? "
_TITLED = f"{_FREE}{_TITLE}\\p{{Lu}}"
#: What a text must hold for any pattern to fit; cheap to ask. A pattern without
#: a digit or @ that it must hold is named here by its own beginning.
_HINT = f"[0-9@]|{_TITLED}|[A-Fa-f]{{32}}|(?:AKIA|ASIA)[A-Z]{{16}}|gh[pos]_|sk-[A-Za-z_-]{{20}}|eyJ[A-Za-z_-]{{10}}"

# Given names by gender and script, syllables for surnames.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Jonas Leon Martin Noah Oscar Paul Simon Tom Victor",
    ("latin", "f"): "Ada Bella Clara Diana Emma Flora Helen Iris Julia Laura Maria Nina Olga Rosa Sara Vera",
    ("latin", "e"): "Alex Andrea Charlie Dominique Jamie Jules Kai Kim Luca Mika Noa Quinn Robin Sam Sascha Toni",
    ("cyrillic", "e"): "Валя Женя Саша Слава Шура",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Фёдор",
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Раиса Софья",
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha ka ke ko la le li lo ma me mo na ne no ra re ro sa se ta te to", "cyrillic": "ба бе бо ва ве да де до га го жа за ка ке ко ла ле ли ло ма ме мо на не но ра ре ро са се та те то"}
LETTERS = {"ascii": "abcdefghijklmnopqrstuvwxyz", "latin": "àáâäçèéêëìíîïñòóôöùúûüß", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "other": "的一是在不了有人这中大为上个国我以要他时来用们"}


def titled_persons(text: Column) -> Column:
    """The persons behind a title, as they stand in the text."""
    return F.when(text.rlike(_TITLED), F.regexp_extract_all(text, F.lit(PATTERNS["person"]), 0))


def _name(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^{_TITLE}", "")


def pattern(text: Column) -> Column:
    """What to look for in a text: all patterns, and the names of the persons
    whom it calls by a title, the longest first."""
    whole = F.transform(titled_persons(text), _name)
    names = F.array_distinct(F.concat(whole, F.transform(whole, lambda n: F.substring_index(n, " ", -1))))
    longest = F.transform(F.sort_array(F.transform(names, lambda n: F.struct(F.length(n).alias("l"), n.alias("n"))), False), lambda x: x["n"])
    return F.coalesce(F.when(F.size(names) > 0, F.concat(F.lit(f"{_ANY}|{_FREE}(?:"), F.array_join(longest, "|"), F.lit(f"){_END}"))), F.lit(_ANY))


def find(text: Column) -> tuple[Column, Column]:
    """(entities in order, pieces around them): one piece more than entities."""
    hinted = F.when(text.rlike(_HINT), F.regexp_extract_all(text, pattern(text), F.lit(0)))
    return F.coalesce(hinted, F.array().cast("array<string>")), F.split(text, pattern(text))


def kind_of(raw: Column) -> Column:
    out = F.lit("person")
    for kind in ("card", "secret", "ssn", "phone", "ip", "email"):  # the last is asked first
        out = F.when(raw.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, raw: Column) -> Column:
    """What spellings of the same entity share."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    plus = F.when(raw.startswith("+"), "+").otherwise("")
    return F.when(kind == "phone", F.concat(plus, digits)).when(kind.isin("card", "ssn"), digits).otherwise(F.lower(raw))


def parts_of(raw: Column, titled: Column) -> Column:
    """What of an entity is replaced, each with its kind, its canonical form and
    what stands before it: the whole, or the names of a person. ``titled`` are
    the text's persons behind a title, who tell the gender of a bare name."""
    kind = kind_of(raw)
    part = lambda kind, raw, before: F.struct(kind.alias("kind"), canonical(kind, raw).alias("canon"), raw.alias("raw"), before.alias("before"))
    name = _name(raw)
    title = raw.substr(F.lit(1), F.length(raw) - F.length(name))
    given, surname = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    told = F.when(title != "", raw).otherwise(F.get(F.filter(titled, lambda t: t.endswith(F.concat(F.lit(" "), name))), F.lit(0)))
    gendered = F.when(told.rlike(f"^(?:{MALE})\\.? "), F.lit("given-m")).when(told.rlike(f"^(?:{FEMALE})\\.? "), F.lit("given-f")).otherwise(F.lit("given-e"))
    alone = F.array(part(F.lit("surname"), surname, title))
    both = F.array(part(gendered, given, title), part(F.lit("surname"), surname, F.lit(" ")))
    return F.when(kind != "person", F.array(part(kind, raw, F.lit("")))).when(name.contains(" "), both).otherwise(alone)


def _number(hexes: Column, at: Column | int, width: int = 4) -> Column:
    """Number in ``width`` hex digits from position ``at``."""
    return F.conv(F.substring(hexes, at, width) if isinstance(at, int) else hexes.substr(at, F.lit(width)), 16, 10).cast("long")


def _pick(pool: str, number: Column) -> Column:
    return F.element_at(F.split(F.lit(pool), " "), (number % len(pool.split(" ")) + 1).cast("int"))


def _luhn_sum(digits: Column) -> Column:
    """Sum of the check rule over digits, the last one standing as it is."""
    n = F.length(digits)
    one = lambda i: F.substring(digits, 1, 1) if i is None else digits.substr(i, F.lit(1)).cast("int")
    doubled = lambda i: F.when((n - i) % 2 == 1, F.when(one(i) > 4, one(i) * 2 - 9).otherwise(one(i) * 2)).otherwise(one(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + doubled(i))


def _digits_like(canon: Column, hexes: Column, keep: Column) -> Column:
    """As many digits as canon has; its first ``keep`` stay."""
    stream = F.concat(*[F.lpad(F.substring(F.conv(F.substring(hexes, 1 + 15 * i, 15), 16, 10), -12, 12), 12, "0") for i in range(4)])
    return F.concat(canon.substr(F.lit(1), keep), stream.substr(F.lit(1), F.length(canon) - keep))


def _letters_like(text: Column, hexes: Column) -> Column:
    """Each letter or digit replaced by one of its script; the rest stays."""

    def swap(i: Column) -> Column:
        c = text.substr(i, F.lit(1))
        h = _number(hexes, ((i - 1) % 60) * 2 + 1, 4)
        out = c
        for name, test in (("other", "\\p{L}"), ("greek", "\\p{IsGreek}"), ("cyrillic", "\\p{IsCyrillic}"), ("latin", "\\p{IsLatin}"), ("ascii", "[a-z]")):
            out = F.when(c.rlike(test), F.lit(LETTERS[name]).substr((h % len(LETTERS[name]) + 1).cast("int"), F.lit(1))).otherwise(out)
        return F.when(c.rlike("[0-9]"), (h % 10).cast("string")).otherwise(out)

    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(text)), swap))


def _given(kind: Column, canon: Column, hexes: Column, draw: Column) -> Column:
    """A given name of the gender and script; draws from the ninth on lengthen it."""
    by = lambda script, gender: _pick(GIVEN[script, gender], _number(hexes, 1))
    pick = lambda script: F.when(kind == "given-m", by(script, "m")).when(kind == "given-f", by(script, "f")).otherwise(by(script, "e"))
    more = lambda script: F.when(draw > 7, _syllables(script, hexes, F.least(draw - 7, F.lit(6)))).otherwise("")
    return F.lower(F.when(canon.rlike("\\p{IsCyrillic}$"), F.concat(pick("cyrillic"), more("cyrillic"))).otherwise(F.concat(pick("latin"), more("latin"))))


def _syllables(script: str, hexes: Column, count: Column) -> Column:
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), count), lambda i: _pick(SYLLABLES[script], _number(hexes, i * 5, 4))))


def _surname(canon: Column, hexes: Column, draw: Column) -> Column:
    """Syllables of the script; each part of a name that a hyphen or apostrophe
    divides has its own, of one letter where it has one."""
    long = F.least(draw, F.lit(6)) + 4
    parts = F.split(canon, "(?<=[-'])|(?=[-'])")

    def named(script: str) -> Column:
        def one(part: Column, i: Column) -> Column:
            digits = F.sha2(F.concat_ws("\x1f", hexes, i.cast("string")), 512)
            made = _syllables(script, digits, F.when(F.size(parts) > 1, F.least(long, F.lit(10)) - 2).otherwise(long))
            return F.when(part.isin("-", "'"), part).when((F.length(part) == 1) & (F.size(parts) > 1), made.substr(1, 1)).otherwise(made)

        return F.concat_ws("", F.transform(parts, one))

    return F.when(canon.rlike("\\p{IsCyrillic}$"), named("cyrillic")).otherwise(named("latin"))


def stand_in(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """The draw-th surrogate of an entity, in canonical form."""
    hexes = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, draw.cast("string")), 512)
    octet = lambda at, low, span: (_number(hexes, at) % span + low).cast("string")
    ip = F.concat_ws(".", octet(1, 1, 223), octet(5, 0, 256), octet(9, 0, 256), octet(13, 1, 254))
    code = F.when(canon.rlike(f"^\\+(?:{_COUNTRY})"), F.length(F.regexp_extract(canon, f"^\\+(?:{_COUNTRY})", 0))).when(canon.startswith("+"), 4).otherwise(F.greatest(F.length(canon) - 10, F.lit(0)))
    number = _digits_like(canon, hexes, F.when(kind == "phone", code).when(kind == "card", 1).otherwise(0))
    body = F.concat(number.substr(F.lit(1), F.length(number) - 1), F.lit("0"))
    checked = F.concat(number.substr(F.lit(1), F.length(number) - 1), ((10 - _luhn_sum(body) % 10) % 10).cast("string"))
    card = F.when(_luhn_sum(canon) % 10 == 0, checked).otherwise(number)
    secret = F.when(canon.rlike("^[0-9a-f]+$"), F.rpad(F.substring(hexes, 1, 128), 128, "0").substr(F.lit(1), F.length(canon))).otherwise(F.concat(F.substring(canon, 1, 4), _letters_like(canon.substr(F.lit(5), F.length(canon)), hexes)))
    user = F.substring_index(canon, "@", 1)
    domain = F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    email = F.concat(_letters_like(user, hexes), F.lit("@"), _letters_like(domain.substr(F.lit(1), F.length(domain) - F.length(top) - 1), F.reverse(hexes)), F.lit("."), top)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind.isin("phone", "ssn"), number).when(kind == "secret", secret).when(kind == "surname", _surname(canon, hexes, draw)).otherwise(_given(kind, canon, hexes, draw))


def render(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the layout and case of this mention."""
    before = lambda i: F.length(F.regexp_replace(raw.substr(F.lit(1), i), "[^0-9]", ""))
    digits = F.regexp_replace(surrogate, "[^0-9]", "")
    laid = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(raw.substr(i, F.lit(1)).rlike("[0-9]"), digits.substr(before(i), F.lit(1))).otherwise(raw.substr(i, F.lit(1)))))
    cased = F.when(raw.rlike("[A-Z]") & (raw == F.upper(raw)), F.upper(surrogate)).otherwise(surrogate)
    named = F.when((F.length(raw) > 1) & (raw == F.upper(raw)), F.upper(surrogate)).otherwise(F.concat_ws("", F.transform(F.split(surrogate, "(?<=[-'])"), F.initcap)))
    return F.when(kind.isin("phone", "card", "ssn"), laid).when(kind.isin("given-m", "given-f", "given-e", "surname"), named).otherwise(cased)


def configured_key(spark: SparkSession) -> str:
    """The key that the session names, or a fresh one that nobody knows."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon) -> (kind, canon, surrogate), one row for each distinct
    entity, no two surrogates of a kind alike and none an entity of the table."""
    known = materialize(entities.select("kind", "canon").distinct().withColumn("draw", F.lit(0)), "entities")
    originals = known.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
    for _ in range(MAX_DRAWS):
        drawn = known.withColumn("surrogate", stand_in(F.col("kind"), F.col("canon"), F.col("draw"), key))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("draw", "canon")) == 1
        checked = drawn.withColumn("first", first).join(originals, ["kind", "surrogate"], "left")
        flagged = materialize(checked.withColumn("again", ~F.col("first") | F.col("taken").isNotNull()).drop("first", "taken"), "surrogates")
        if not flagged.filter("again").limit(1).count():
            return flagged.select("kind", "canon", "surrogate")
        known = flagged.select("kind", "canon", (F.col("draw") + F.col("again").cast("int")).alias("draw"))
    raise ValueError(f"surrogates still collide after {MAX_DRAWS} draws")


def replace(docs: DataFrame, key: str, count: str = "n_entities") -> DataFrame:
    """docs with surrogates in ``text``, and their number as a column ``count``."""
    text = F.col("text")
    digest = F.md5(text.cast("binary"))
    found = docs.filter(text.rlike(_HINT)).select(F.col("doc_id").alias("d"), digest.alias("h"), find(text)[0].alias("raws"), titled_persons(text).alias("titled")).filter(F.size("raws") > 0).distinct()
    mentions = found.select("d", "h", "titled", F.posexplode("raws").alias("at", "raw"))
    parted = mentions.select("d", "h", "at", F.posexplode(parts_of(F.col("raw"), F.col("titled"))).alias("part", "p"))
    mentions = materialize(parted.select("d", "h", "at", "part", "p.*"), "mentions")
    drawn = mentions.join(small(surrogates(mentions, key)), ["kind", "canon"]).withColumn("new", F.concat("before", render(F.col("kind"), F.col("raw"), F.col("surrogate"))))
    listed = materialize(drawn.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("at", "part", "new"))).alias("m")), "mention-lists")
    discard(mentions)

    # A text is known by doc_id and its 128-bit digest, asked only where a pattern may fit.
    hint, news, pieces = fresh_name("hint", docs), fresh_name("news", docs), fresh_name("pieces", docs)
    at_hand = docs.select(*[c for c in docs.columns if c.lower() != count.lower()], F.when(text.rlike(_HINT), digest).alias(hint))
    known = small(listed.select(F.col("d").alias(fresh_name("d", docs)), F.col("h").alias(fresh_name("h", docs)), F.col("m").alias(news)), 50_000)
    both = at_hand.join(known, at_hand["doc_id"].eqNullSafe(known[fresh_name("d", docs)]) & (at_hand[hint] == known[fresh_name("h", docs)]), "left")
    split = both.withColumn(pieces, F.when(F.col(news).isNotNull(), find(text)[1]))
    joined = F.concat(F.concat_ws("", F.transform(F.col(news), lambda m: F.concat(F.when(m["part"] == 0, F.element_at(F.col(pieces), m["at"] + 1)).otherwise(""), m["new"]))), F.element_at(F.col(pieces), -1))
    out = split.withColumn("text", F.when(F.col(news).isNotNull(), joined).otherwise(text))
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(news).isNotNull(), counted).otherwise(F.col("n_chars")))
    entities = F.size(F.filter(F.col(news), lambda m: m["part"] == 0))
    return out.select(*[c for c in docs.columns if c.lower() != count.lower()], F.when(F.col(news).isNotNull(), entities).otherwise(0).cast("long").alias(count))
