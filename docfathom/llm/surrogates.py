"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Detected are e-mail addresses, IPv4 addresses, payment cards (network prefix and
check digit have to be right), social security numbers, telephone numbers and names
after an honorific. Telephone numbers have separators, an area in brackets or a
leading plus; a bare run of digits is taken for any other number. Numbers that stand
in a row are searched by kind: cards in their usual groups first, then social security
and telephone numbers, so that a number in front of an entity does not hide it. Cards
in other groups count where nothing stands in front. Mentions of one entity (letter case and separators aside) get
one surrogate everywhere, so coreference stays; a surrogate depends on the key, the
kind and the entity alone.

A surrogate is of its entity's kind and format: letters stay letters of the same
script and case, digits stay digits, cards keep network and a right check digit,
addresses move to reserved domains, names follow the gender of the honorific and
the script of the name. Candidates are checked against each other and against all
entities found; whichever collides draws again, so different entities stay
different and nobody is given another one's data.

Null text stays null, and rows without a detected entity pass unchanged, whatever
their other columns. Rows are neither joined nor told apart by their id: equal lists
of mentions have equal replacements, so ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docfathom.session import materialize

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MALE = ["Mr", "Herr", "Señor", "Monsieur", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа"]
HONORIFIC = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(MALE + FEMALE)})\.?\x20"
ADDRESS = rf"(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)"
#: Three, three and four digits, or any two to four, three to four and three to four in
#: which no address, no mail and no number of the usual form begins later.
USUAL_PHONE = r"\d{3}[\x20.-]\d{3}[\x20.-]\d{4}(?!\w)"
MAIL_AHEAD = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]"
LATER = rf"(?!{ADDRESS}|{USUAL_PHONE}|{MAIL_AHEAD})"
ANY_PHONE = rf"\d{{2,4}}[\x20.-]{LATER}\d{{3,4}}[\x20.-]{LATER}\d{{3,4}}(?!\w)"
SSN_DIGITS = r"\d{3}-\d{2}-\d{4}(?![\w-])"
#: Numbers with single spaces or hyphens between them, up to where a mail, an address or
#: a telephone number with dots begins.
GROUP = rf"(?!{MAIL_AHEAD}|{ADDRESS}|\d{{2,4}}(?:\.\d{{3,4}}[\x20.-]|[\x20-]\d{{3,4}}\.)\d{{3,4}}(?!\w))\d++(?!\w)"
CHAIN = (
    rf"(?<![\w+])(?!(?<=-){SSN_DIGITS})(?=\d(?:[\x20-]?\d){{6}}){GROUP}(?:[\x20-]{GROUP})*+-?+"
)
#: In this order; the first kind that matches at a place takes it.
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
        rf"(?<![\w.]){ADDRESS}",
        CHAIN,
        r"(?<![\w+])\+1[\x20.-]?(?:\(\d{3}\)|\d{3})[\x20.-]?\d{3}[\x20.-]?\d{4}(?!\w)",
        r"(?<![\w+])(?:\+\d{1,3}[\x20.-]?)?\(\d{2,4}\)[\x20.-]?(?:\d{3,4}[\x20.-]\d{3,4}|\d{6,8})(?!\w)",
        rf"(?<![\w+])(?:\+\d{{1,3}}[\x20.-]?)?{ANY_PHONE}",
        r"(?<![\w+])\+\d(?:[\x20.()-]{0,2}\d){6,14}(?!\w)",
        HONORIFIC + r"\p{Lu}[\p{L}'’-]+(?:\x20\p{Lu}[\p{L}'’-]+){0,2}",
    ]
)
#: How cards are written; longer forms first.
CARD_FORMS = [
    r"\d{13,19}",
    # The last three digits may instead begin a number of another kind.
    rf"\d{{4}}(?:[\x20-]\d{{4}}){{3}}[\x20-](?!{USUAL_PHONE}|{SSN_DIGITS})\d{{3}}",
    r"\d{4}(?:[\x20-]\d{4}){3}",
    r"\d{4}[\x20-]\d{6}[\x20-]\d{5}",
    r"\d{4}[\x20-]\d{6}[\x20-]\d{4}",
]
ANY_CARD = r"(?<!\w)\d(?:[\x20-]?\d){12,18}(?!\w)"
#: What a text has to hold before it is searched.
HINT = rf"[@0-9]|{HONORIFIC}"
EMAIL, IP, CARD, SSN, PHONE, NAME = KINDS = ("email", "ip", "card", "ssn", "phone", "name")
LETTERS = [
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Erik Felix Georg Henry Ivan Jonas Karl Louis Martin Noah Oscar Paul".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Laura Maria Nina Olga Paula Rosa".split(),
    ("latin", "s"): "Abel Baker Castor Dorn Ellis Falk Garner Holm Irving Jansen Keller Lind Moreau Norden Ortega Perrin".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария".split(),
    ("cyrillic", "s"): "Белов Волков Громов Жуков Зимин Котов Лебедь Мороз Носик Орлик".split(),
}
RESERVED = ["example.com", "example.org", "example.net"]
#: Draws before the check gives up: a format would have to be as good as exhausted.
MAX_ROUNDS = 64


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def each_char(text: Column, change: Callable[[Column, Column], Column]) -> Column:
    """``text`` with every (character, place from 1) changed."""
    places = F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: i > 0)
    return F.array_join(F.transform(places, lambda i: change(F.substr(text, i, F.lit(1)), i)), "")


def luhn_sum(number: Column) -> Column:
    """The check sum of a string of digits; every second one from the right doubled."""
    places = F.filter(F.sequence(F.lit(0), F.length(number)), lambda i: i > 0)

    def add(total, i):
        digit = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(places, F.lit(0), add)


def is_card(mention: Column) -> Column:
    number = digits(mention)
    return number.rlike("^(?:3|4|5|6|2[2-7])") & (luhn_sum(number) % 10 == 0)


def kind_of(mention: Column) -> Column:
    """The kind of what PATTERN found, other than a CHAIN."""
    return (
        F.when(mention.contains("@"), EMAIL)
        .when(mention.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), IP)
        .when(mention.rlike(r"^\p{L}"), NAME)
        .otherwise(PHONE)
    )


def piece(text: Column, kind: Column) -> Column:
    return F.struct(text.alias("text"), kind.cast("string").alias("kind"))


def cut(text: Column, pattern: Column, kind: str) -> Column:
    """Pieces of ``text``: what matches is of ``kind``, the rest of none yet."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.transform(
        F.array(found),
        lambda found: F.flatten(
            F.transform(
                F.split(text, pattern, -1),
                lambda gap, i: F.filter(
                    F.array(piece(gap, F.lit(None)), piece(F.get(found, i), F.lit(kind))),
                    lambda p: p["text"] != "",
                ),
            )
        ),
    )[0]


def cut_cards(text: Column, candidates: Column) -> Column:
    """Pieces of ``text`` around those candidates whose prefix and check digit are right."""
    # Candidates are digits, spaces and hyphens, and so patterns of themselves.
    return F.transform(
        F.array(F.filter(candidates, is_card)),
        lambda cards: F.when(F.size(cards) == 0, F.array(piece(text, F.lit(None)))).otherwise(
            cut(text, F.concat(F.lit(r"(?<!\w)(?:"), F.array_join(cards, "|"), F.lit(r")(?!\w)")), CARD)
        ),
    )[0]


def usual_cards(text: Column) -> Column:
    """Everything in ``text`` written as a card, from every number on."""
    return F.concat(
        *[F.regexp_extract_all(text, F.lit(rf"(?<!\w)(?=({form})(?!\w))"), F.lit(1)) for form in CARD_FORMS]
    )


def pieces(mention: Column) -> Column:
    """(text, kind) in order: a chain taken apart, any other mention as it is."""
    failed = rf"(?<!\w)(?:{'|'.join(CARD_FORMS)})(?!\w)"
    rules = [
        lambda t: cut_cards(t, usual_cards(t)),
        lambda t: cut(t, F.lit(r"(?<![\w-])" + SSN_DIGITS), SSN),
        lambda t: cut(t, F.lit(r"(?<!\w)" + USUAL_PHONE), PHONE),
        lambda t: cut_cards(t, F.regexp_extract_all(t, F.lit(ANY_CARD), F.lit(0))),
        # Written as a card, with a wrong check digit: no part of it is a telephone number.
        lambda t: cut(t, F.lit(failed), ""),
        lambda t: cut(t, F.lit(r"(?<!\w)" + ANY_PHONE), PHONE),
    ]
    parts = F.array(piece(mention, F.lit(None)))
    for rule in rules:
        # Called at once, so that each step has its own rule.
        step = F.transform(parts, lambda p: F.when(p["kind"].isNotNull(), F.array(p)).otherwise(rule(p["text"])))
        parts = F.flatten(step)
    chain = F.transform(parts, lambda p: piece(p["text"], F.when(p["kind"] != "", p["kind"])))
    return F.when(mention.rlike(r"^\d++(?:[\x20-]\d++)*+-?$"), chain).otherwise(
        F.array(piece(mention, kind_of(mention)))
    )


def bare_name(mention: Column) -> Column:
    return F.regexp_replace(mention, "^" + HONORIFIC, "")


def entity_of(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common."""
    male = mention.rlike("^(?:" + "|".join(MALE) + ")\\b")
    number = digits(mention)
    return (
        F.when(kind == EMAIL, F.lower(mention))
        .when(kind == IP, mention)
        .when(kind == PHONE, F.right(number, F.lit(10)))
        .when(kind == NAME, F.concat(F.when(male, "m:").otherwise("f:"), F.lower(bare_name(mention))))
        .otherwise(number)
    )


def draw(seed: Column, place, n: int) -> Column:
    """A number below n, by the secret seed and a place."""
    return F.pmod(F.xxhash64(seed, place if isinstance(place, Column) else F.lit(place)), F.lit(n)).cast("int")


def picked(values: list[str], seed: Column, place: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), draw(seed, place, len(values)) + 1)


def disguised(text: Column, seed: Column) -> Column:
    """Letters and digits drawn anew within script and case, all else as it is."""

    def change(char, i):
        new = F.when(char.between("0", "9"), draw(seed, i, 10).cast("string"))
        for letters in LETTERS:
            new = new.when(
                F.contains(F.lit(letters), char),
                F.substr(F.lit(letters), draw(seed, i, len(letters)) + 1, F.lit(1)),
            )
        return new.otherwise(char)

    return each_char(text, change)


def candidate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate that an entity would get at its n-th draw, as an entity."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string")), 256)
    drawn = disguised(entity, seed)
    extra = F.when(attempt > 1, F.concat(F.lit("."), draw(seed, -1, 10**9).cast("string"))).otherwise("")
    above = F.regexp_extract(drawn, r"@(.*?)[^.]+\.[^.]+$", 1)
    email = F.concat(F.substring_index(drawn, "@", 1), extra, F.lit("@"), above, picked(RESERVED, seed, -2))
    octets = [draw(seed, -3, 256), draw(seed, -4, 256), draw(seed, -5, 254) + 1]
    first = F.when(attempt < 3, 10).otherwise(draw(seed, -6, 212) + 11)
    body = F.concat(F.substring(entity, 1, 1), F.substr(drawn, F.lit(2), F.length(drawn) - 2))
    card = F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    phone = F.concat((draw(seed, -7, 8) + 2).cast("string"), F.substr(drawn, F.lit(2), F.length(drawn)))

    def name(script):
        given = F.when(entity.startswith("m:"), picked(NAMES[script, "m"], seed, -8)).otherwise(
            picked(NAMES[script, "f"], seed, -8)
        )
        family = picked(NAMES[script, "s"], seed, -9)
        second = F.when(attempt > 0, F.concat(F.lit("-"), picked(NAMES[script, "s"], seed, -10)))
        third = F.when(attempt > 3, F.initcap(disguised(F.lit("xxxxxx" if script == "latin" else "хххххх"), seed)))
        last = F.concat(family, F.coalesce(second, F.lit("")), F.coalesce(third, F.lit("")))
        both = F.when(entity.contains(" "), F.concat_ws(" ", given, last)).otherwise(last)
        return F.concat(F.substring(entity, 1, 2), F.lower(both))

    return (
        F.when(kind == EMAIL, email)
        .when(kind == IP, F.concat_ws(".", first, *octets))
        .when(kind == CARD, card)
        .when(kind == PHONE, phone)
        .when(kind == NAME, F.when(entity.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin")))
        .otherwise(drawn)
    )


def rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one mention: separators, prefix, letter case."""
    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    skip = F.length(digits(mention)) - F.length(surrogate)

    def pour(char, i):
        nth = F.length(digits(F.substr(mention, F.lit(1), i))) - skip
        return F.when(char.between("0", "9") & (nth > 0), F.substr(surrogate, nth, F.lit(1))).otherwise(char)

    own_title = F.regexp_extract(mention, "^" + HONORIFIC, 0)
    name = F.initcap(F.regexp_replace(F.substr(surrogate, F.lit(3), F.length(surrogate)), "-", "- "))
    name = F.concat(own_title, F.regexp_replace(name, "- ", "-"))
    return (
        F.when(kind == EMAIL, F.when(upper, F.upper(surrogate)).otherwise(surrogate))
        .when(kind == IP, surrogate)
        .when(kind == NAME, F.when(F.upper(bare_name(mention)) == bare_name(mention), F.upper(name)).otherwise(name))
        .otherwise(each_char(mention, pour))
    )


def mentions(text: Column) -> Column:
    """Everything PATTERN finds in a text, in order; null without any hint of it."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate): distinct within a kind, and no entity's own value.

    Each round draws for those still without, drops what collides, and leaves the
    rest to the next round, which is smaller by orders of magnitude.
    """
    real = entities.select("kind", F.col("entity").alias("surrogate"))
    done, pending = None, entities
    for attempt in range(MAX_ROUNDS):
        drawn = pending.select(
            "kind", "entity", candidate(F.col("kind"), F.col("entity"), F.lit(attempt), key).alias("surrogate")
        )
        # Of equal draws the smallest entity wins; nothing wins a value that is in use.
        won = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        won = won.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            won = won.join(done, ["kind", "surrogate"], "left_anti")
        won = won.select("kind", "entity", "surrogate")
        done = materialize(won if done is None else done.union(won))
        pending = materialize(pending.join(done, ["kind", "entity"], "left_anti"))
        if pending.isEmpty():
            return done
    raise RuntimeError("a format has too few values for its entities")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """(row, text, n_entities, kinds): each row of ``docs`` as a struct, and its new text."""
    # The row goes along as one value, so that no name of it can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = rows.select("row", mentions(F.col("row.text")).alias("found"))
    lists = materialize(found.filter(F.size("found") > 0).select("found").distinct())
    each = lists.select("found", F.posexplode("found").alias("at", "mention"))
    each = each.select("found", "at", F.posexplode(pieces(F.col("mention"))).alias("sub", "piece"))
    each = each.select("found", "at", "sub", F.col("piece.text").alias("mention"), "piece.kind").withColumn(
        "entity", entity_of(F.col("kind"), F.col("mention"))
    )
    entities = materialize(each.filter("kind is not null").select("kind", "entity").distinct())
    named = each.join(assign(entities, key), ["kind", "entity"], "left")
    new = F.coalesce(rendered(F.col("kind"), F.col("mention"), F.col("surrogate")), F.col("mention"))
    lists = named.groupBy("found").agg(
        F.array_sort(F.collect_list(F.struct("at", "sub", new.alias("new"), "kind"))).alias("parts")
    )
    with_entities = found.filter(F.size("found") > 0).join(lists, "found")
    gaps = F.split("row.text", PATTERN, -1)

    def filled(gaps):
        before = lambda x: F.when(x["sub"] == 0, F.get(gaps, x["at"])).otherwise("")
        parts = F.transform("parts", lambda x: F.concat(before(x), x["new"]))
        return F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))

    text = F.transform(F.array(gaps), filled)[0]
    changed = with_entities.select(
        "row",
        text.alias("text"),
        F.size(F.filter("parts.kind", lambda k: k.isNotNull())).alias("n_entities"),
        F.array_join(F.array_distinct(F.array_sort(F.filter("parts.kind", lambda k: k.isNotNull()))), ",").alias("kinds"),
    )
    clean = found.filter("found is null or size(found) = 0").select(
        "row", F.col("row.text").alias("text"), F.lit(0).alias("n_entities"), F.lit("").alias("kinds")
    )
    return clean.union(changed)


def replace_text(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the new text in place of the old, columns as they were."""
    done = replace(docs, key)
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
