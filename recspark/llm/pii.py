"""PII surrogates in DataFrame operations only: every detected entity gets a keyed replacement of its own kind.

Mentions are found by one pattern. Mentions that differ only in layout or case are one entity (coreference), and an entity
gets one surrogate in all documents. A surrogate keeps the type's shape: digits stay digits, letters stay letters of their
script, separators, case, country digit, card brand and Luhn remainder, top-level domain, honorific and gender stay. It is
derived from a secret key, so it repeats between runs with that key and says nothing without it. Surrogates are checked:
two entities that would share one, or a surrogate that is itself an entity of the corpus, are drawn again (least entity
first), so distinct entities stay distinct.

A person is found behind an honorific and replaced name by name: given names and surnames are entities of their own, so `Mrs. Anna
Smith`, `Mrs. Smith` and `Dr. Anna Smith` keep their common parts. In the document that has the person, its names without an
honorific are replaced by the same parts (as written, in capitals, or with a capital initial). Given names keep the gender of
the honorific; behind a title without one they take the gender that the corpus shows for the name, if any. Not found are
persons that no honorific ever introduces in their document, initials, names in lower case and surname prefixes such as `von`.

Defined results: null and empty texts come back unchanged; documents without a mention are not touched or moved; repeated rows
get equal texts; an empty table gives no rows; all columns of the input are kept, whatever their names and types, and only
`text` changes. Texts are read whole; no pattern repeats a group without a bound but possessively, so none needs a deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import unused
from recspark.session import checkpointed

FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин"]
NEUTRAL = ["Dr", "Prof", "Professor", "Доктор", "Профессор"]
GIVEN = {
    "latin_f": "Alma Clara Edda Flora Greta Hilda Iris Laura Maria Nora Olga Petra Rosa Selma Tilda Vera".split(),
    "latin_m": "Albert Bruno Conrad David Edgar Felix Georg Hugo Karl Leo Martin Oscar Paul Robert Simon Viktor".split(),
    "cyrillic_f": "Алла Вера Галина Дарья Елена Жанна Зоя Инна Лидия Мария Нина Ольга Полина Раиса Софья Юлия".split(),
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Олег Павел Роман Семён Юрий".split(),
}
SYLLABLES = {
    "latin": "bar del fen gor hal kem lan mor nes pal rin sol tam ver win zor".split(),
    "cyrillic": "бар дел фен гор хал кем лан мор нес пал рин сол там вер вин зор".split(),
}
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"

TITLE = rf"(?:(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.? ){{1,3}}"
NAME = r"(?:\p{Lu}\p{L}++(?:['’-]\p{L}++){0,3}|\p{Lu}(?:['’-]\p{L}++){1,3})(?![\p{L}\p{N}])"
GROUP = "[0-9a-fA-F]{1,4}"
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "ipv6": rf"(?<![0-9A-Za-z:])(?=[0-9a-fA-F:]{{0,39}}[0-9])(?:(?:{GROUP}:){{7}}{GROUP}"
    rf"|{GROUP}(?::{GROUP}){{0,5}}::(?:{GROUP}(?::{GROUP}){{0,5}})?|::{GROUP}(?::{GROUP}){{0,6}})(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": rf"(?<!\p{{L}}){TITLE}{NAME}(?: {NAME}){{0,2}}",
}
PATTERN = "|".join(TYPES.values())
# What every mention holds: a digit, an at sign, a long run of hexadecimal letters or an honorific.
HINT = rf"[0-9@]|[a-fA-F]{{32}}|(?<!\p{{L}})(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.? "
ROUNDS = 50


def mentions(text: str, pattern: Column | None = None) -> Column:
    """All mentions of a text in order."""
    return F.regexp_extract_all(F.col(text), F.lit(PATTERN) if pattern is None else pattern, F.lit(0))


def mentioned(text: str = "text") -> Column:
    """Whether a text has a mention."""
    return F.coalesce(F.col(text).rlike(HINT) & F.col(text).rlike(PATTERN), F.lit(False))


def _type(mention: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES.items()):
        kind = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity share."""
    plain = F.upper(F.regexp_replace(mention, "[^0-9A-Za-z]", ""))
    phone = F.concat(F.when(mention.startswith("+"), "+").otherwise(""), plain)
    return F.when(kind.isin("card", "ssn", "iban"), plain).when(kind == "phone", phone).otherwise(F.lower(mention))


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def name_parts(persons: DataFrame) -> DataFrame:
    """mention, title, nth, word, kind (given or surname), canonical of the names in distinct `mention`s of persons."""
    title = F.regexp_extract("mention", f"^{TITLE}", 0)
    female, male = title.rlike(rf"(?:{'|'.join(FEMALE)})\.? "), title.rlike(rf"(?:{'|'.join(MALE)})\.? ")
    rows = persons.select(
        "mention", title.alias("title"), F.when(female, "f").when(male, "m").otherwise("n").alias("gender"),
        F.split(F.expr("substring(mention, length(title) + 1)"), " ").alias("words"),
    ).select("mention", "title", "gender", F.size("words").alias("size"), F.posexplode("words").alias("nth", "word"))
    rows = rows.withColumns(
        {"kind": F.when(F.col("nth") == F.col("size") - 1, "surname").otherwise("given"), "script": _script(F.col("word")), "name": F.lower("word")}
    )
    shown = rows.filter((F.col("kind") == "given") & (F.col("gender") != "n")).groupBy("script", "name").agg(F.min("gender").alias("shown"))
    rows = rows.join(shown, ["script", "name"], "left")
    gender = F.when((F.col("kind") == "given") & (F.col("gender") == "n"), F.coalesce("shown", F.lit("n"))).otherwise(F.col("gender"))
    # A Latin surname is one for all genders; a Cyrillic one is written by gender.
    group = F.when((F.col("kind") == "surname") & (F.col("script") == "latin"), F.col("script")).otherwise(F.concat("script", F.lit("_"), gender))
    return rows.select("mention", "title", "nth", "word", "kind", F.concat(group, F.lit(" "), "name").alias("canonical"))


def _byte(digest: Column, i: Column) -> Column:
    """Byte i of a hexadecimal digest, round and round."""
    return F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(text: Column, digest: Column, keep: int | Column = 0, hexadecimal: bool = False) -> Column:
    """Each digit and letter after the first `keep` characters becomes another of its class and script."""

    def one(c: Column, i: Column) -> Column:
        v = _byte(digest, i)
        small = F.substring(F.lit("abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"), v % (6 if hexadecimal else 26) + 1, F.lit(1))
        return (
            F.when((i < keep) | ~c.rlike(r"[\p{L}\p{N}]"), c)
            .when(c.rlike("[0-9]"), (v % 10).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), F.substring(F.lit(CYRILLIC), v % 32 + 1, F.lit(1)))
            .when(c.rlike(r"\p{Lu}"), F.upper(small))
            .otherwise(small)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string of even length whose last digit counts once."""
    doubled = F.transform(
        F.split(digits, ""),
        lambda c, i: F.when(
            i % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)
        ).otherwise(F.try_to_number(c, F.lit("9")).cast("int")),
    )
    return F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d)


def _pick(options: list[str], v: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), v % len(options))


def candidate(kind: Column, canonical: Column, attempt: Column, base: Column, host_base: Column) -> Column:
    """The surrogate of a canonical entity at an attempt; the bases are keyed digests of the entity and of an email's domain."""
    # Expressions inside a lambda are computed for every character, so digests start from the stored ones, which are short.
    digest = F.sha2(F.concat_ws("|", base, attempt.cast("string")), 256)
    local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    host, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    email = F.concat(_letters(local, digest), F.lit("@"), _letters(host, host_base), top)
    keep_octets = F.when(canonical.startswith("10."), 1).when(canonical.startswith("192.168."), 2).otherwise(0)
    ip = F.array_join(
        F.transform(
            F.split(canonical, r"\."), lambda o, i: F.when(i < keep_octets, o).otherwise((_byte(digest, i) % 254 + 1).cast("string"))
        ),
        ".",
    )
    body = F.substring(_letters(canonical, digest, 1), 1, 15)
    card = F.concat(body, F.pmod(_luhn(canonical) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    given = surname = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        # A later attempt has more syllables to draw from.
        drawn = F.transform(F.sequence(F.lit(1), F.lit(4) + F.least(attempt, F.lit(8))), lambda i: _pick(syllables, _byte(digest, i)))
        family = F.initcap(F.array_join(drawn, ""))
        female = canonical.startswith(f"{script}_f ")
        if script == "cyrillic":
            family = F.concat(family, F.when(female, "ова").otherwise("ов"))
        surname = F.when(canonical.startswith(script), family).otherwise(surname)
        both = GIVEN[f"{script}_f"] + GIVEN[f"{script}_m"]
        listed = F.when(female, _pick(GIVEN[f"{script}_f"], _byte(digest, F.lit(0))))
        listed = listed.when(canonical.startswith(f"{script}_m "), _pick(GIVEN[f"{script}_m"], _byte(digest, F.lit(0))))
        listed = listed.otherwise(_pick(both, _byte(digest, F.lit(0))))
        # The listed names are few; who gets none has a name of syllables.
        made = F.initcap(F.array_join(F.slice(drawn, 1, F.lit(2) + F.floor(attempt / 8).cast("int")), ""))
        made = F.concat(made, F.when(female, "a" if script == "latin" else "а").otherwise(""))
        given = F.when(canonical.startswith(script), F.when(attempt < 3, listed).otherwise(made)).otherwise(given)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "given", given)
        .when(kind == "surname", surname)
        .when(kind == "phone", _letters(canonical, digest, F.when(canonical.startswith("+"), 2).otherwise(0)))
        .when(kind == "iban", _letters(canonical, digest, 2))
        .when(kind.isin("secret", "ipv6"), _letters(canonical, digest, 0, True))
        .otherwise(_letters(canonical, digest))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical, surrogate for distinct entities (kind, canonical); no two share one, and none is an entity itself.

    For names, what may not be met again is the name as written, so they are compared without script and gender.
    """
    base = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canonical"), 256).alias("base")
    host_base = F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), F.substring_index("canonical", "@", -1)), 256).alias("host_base")
    open_rows = checkpointed(entities.select("kind", "canonical").distinct().select("kind", "canonical", base, host_base))
    plain = F.lower(F.when(F.col("kind").isin("given", "surname"), F.expr("substring(canonical, instr(canonical, ' ') + 1)")).otherwise(F.col("canonical")))
    taken = checkpointed(open_rows.select("kind", plain.alias("taken")).distinct())
    done = None
    for attempt in range(ROUNDS):
        if open_rows.isEmpty():
            break
        drawn = open_rows.withColumn("surrogate", candidate(F.col("kind"), F.col("canonical"), F.lit(attempt), F.col("base"), F.col("host_base")))
        drawn = drawn.withColumn("taken", F.lower("surrogate"))
        # The least entity of those that drew a free surrogate gets it.
        first = (
            drawn.join(taken, ["kind", "taken"], "left_anti")
            .groupBy("kind", "taken")
            .agg(F.min(F.struct("canonical", "surrogate")).alias("w"))
            .select("kind", F.col("w.canonical").alias("canonical"), F.col("w.surrogate").alias("surrogate"), "taken")
        )
        first = checkpointed(first)
        done = first if done is None else done.unionByName(first)
        open_rows = checkpointed(open_rows.join(first, ["kind", "canonical"], "left_anti"))
        if not open_rows.isEmpty():
            taken = taken.unionByName(first.select("kind", "taken"))
    else:
        raise ValueError("the surrogates of a kind are used up")
    if done is None:
        return entities.sparkSession.createDataFrame([], "kind string, canonical string, surrogate string")
    return done.select("kind", "canonical", "surrogate")


def rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the layout and case of the mention."""
    plain = F.regexp_replace(surrogate, r"\+", "")

    def laid_out(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^0-9A-Za-z]", ""))
        drawn = F.substring(plain, nth + 1, F.lit(1))
        return F.when(c.rlike("[0-9A-Za-z]"), F.when(c.rlike("[a-z]"), F.lower(drawn)).otherwise(drawn)).otherwise(c)

    def same_place(c: Column, drawn: Column) -> Column:
        return F.when(c.rlike(r"\p{Lu}"), F.upper(drawn)).otherwise(drawn)

    chars = F.split(mention, "")
    return (
        F.when(kind.isin("card", "ssn", "iban", "phone"), F.array_join(F.transform(chars, laid_out), ""))
        .when((kind == "ip") | (F.length(mention) != F.length(surrogate)), surrogate)
        .otherwise(F.array_join(F.zip_with(chars, F.split(surrogate, ""), same_place), ""))
    )


def cased(word: Column, surrogate: Column) -> Column:
    """A name in capitals if the word is."""
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(surrogate)).otherwise(surrogate)


def replacements(found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """From distinct (row, mention): (mention, replacement), and (row, word, replacement) for the bare names of a row's persons."""
    spelt = checkpointed(found.select("mention").distinct().withColumn("kind", _type(F.col("mention"))))
    others = checkpointed(spelt.filter("kind <> 'person'").withColumn("canonical", _canonical(F.col("kind"), F.col("mention"))))
    parts = checkpointed(name_parts(spelt.filter("kind = 'person'")))
    drawn = checkpointed(surrogates(others.select("kind", "canonical").unionByName(parts.select("kind", "canonical")), key))
    table = others.join(drawn, ["kind", "canonical"]).select(
        "mention", rendered(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("replacement")
    )
    named = checkpointed(parts.join(drawn, ["kind", "canonical"]))
    word = cased(F.col("word"), F.col("surrogate")).alias("word")
    persons = named.groupBy("mention", "title").agg(F.array_sort(F.collect_list(F.struct("nth", word))).alias("words"))
    persons = persons.select("mention", F.concat("title", F.array_join(F.col("words.word"), " ")).alias("replacement"))
    spellings = F.array_distinct(F.array("word", F.upper("word"), F.initcap(F.lower("word"))))
    bare = found.join(named.filter(F.length("word") > 1), "mention").select("row", F.explode(spellings).alias("word"), "kind", "surrogate")
    bare = bare.filter(~F.col("word").rlike(f"^(?:{PATTERN})$"))
    # A word that is a surname and a given name is taken for the surname.
    bare = bare.groupBy("row", "word").agg(F.max(F.struct("kind", "surrogate")).alias("best"))
    bare = bare.select("row", "word", cased(F.col("word"), F.col("best.surrogate")).alias("replacement"))
    return checkpointed(table.unionByName(persons)), checkpointed(bare)


def pseudonymise(documents: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """The documents with surrogates in `text`; with `count`, a column of that name says how many mentions were replaced."""
    columns = documents.columns
    row, names, own = unused(columns, "row", "names", "map")
    has = mentioned()
    # Only documents with a mention are written, with a number for each row, and dealt out.
    marked = checkpointed(documents.filter(has).withColumn(row, F.monotonically_increasing_id()))
    found = checkpointed(marked.select(F.col(row).alias("row"), F.explode(F.array_distinct(mentions("text"))).alias("mention")))
    table, bare = replacements(found, key)
    entries = found.join(table, "mention").select("row", F.struct("mention", "replacement").alias("entry"), F.lit(None).cast("string").alias("word"))
    entries = entries.unionByName(bare.select("row", F.struct(F.col("word").alias("mention"), "replacement").alias("entry"), "word"))
    maps = entries.groupBy(F.col("row").alias(row)).agg(
        F.map_from_entries(F.collect_list("entry")).alias(own),
        # The longest first, so that no name hides one that it begins.
        F.transform(F.sort_array(F.collect_set(F.when(F.col("word").isNotNull(), F.struct(F.length("word"), F.col("word")))), False), lambda w: w["word"]).alias(names),
    )
    bare_name = F.concat(F.lit(r"|(?<!\p{L})(?:"), F.array_join(F.col(names), "|"), F.lit(r")(?!\p{L})"))
    pattern = F.concat(F.lit(PATTERN), F.when(F.size(names) > 0, bare_name).otherwise(""))
    joined = marked.join(maps, row)
    between, inside = F.split(F.col("text"), pattern, -1), mentions("text", pattern)
    pieces = F.zip_with(between, inside, lambda s, m: F.concat(s, F.coalesce(F.element_at(F.col(own), m), m, F.lit(""))))
    rebuilt = joined.withColumn("text", F.array_join(pieces, ""))
    clean = documents.filter(~has)
    if count is not None:
        rebuilt = joined.withColumns({"text": F.array_join(pieces, ""), count: F.size(inside)})
        clean, columns = clean.withColumn(count, F.lit(0)), [*columns, count]
    return clean.unionByName(rebuilt.select(columns))
