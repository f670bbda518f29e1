"""PII: surrogates that keep the type, gender, script and format of what they replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import cut, left_on_row, texts

_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Titles that tell a gender.
MALE = ("Mr", "Sir", "Herr", "Señor", "Don", "Monsieur", "Signor", "Господин", "Г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Doña", "Madame", "Signora", "Госпожа", "Г-жа", "Κυρία")
#: Titles that tell none.
NEUTRAL = ("Dr", "Prof", "Professor", "Doktor", "Доктор", "Профессор", "Δρ")
#: Titles, one to three, and a word of a name in a script that surrogates are drawn in: whole, with inner capitals, and on over hyphens, and over apostrophes that a capital follows.
TITLE = "(?:(?:" + "|".join((*MALE, *FEMALE, *NEUTRAL)) + r")\.? ){1,3}"
#: Ruled out at most places by one look at a character, before anything else is tried.
_TITLED = "(?=[" + "".join(sorted({t[0] for t in (*MALE, *FEMALE, *NEUTRAL)})) + r"])(?<!\p{L})" + TITLE
_WORD = r"(?:\p{L}['’])?[[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]&&\p{Lu}]\p{L}++(?:-\p{L}++|['’]\p{Lu}\p{L}*+)*+"
#: Small words within family names.
PARTICLES = ("von", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "la", "le")
_NEXT = "(?: (?:(?:" + "|".join(PARTICLES) + ") ){0,2}" + _WORD + "){0,2}"
#: Letters and digits of addresses: ASCII, and by ranges the alphabets up to the Greek extensions, which is faster than a property of characters.
_LETTER = r"A-Za-z0-9\u00C0-\u024F\u0370-\u1FFF"
#: Kinds in the order of precedence where two match at one place. Runs are possessive and start at their
#: edges, so that every pattern takes time in proportion to the text.
KINDS = {
    "email": f"(?<![{_LETTER}._%+-])[{_LETTER}._%+-]++@[{_LETTER}](?:[{_LETTER}-]{{0,62}}\\.){{1,8}}[{_LETTER}]{{2,24}}",
    "phone": _EDGE + r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])",
    "card": _EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + _END,
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "name": _TITLED + _WORD + _NEXT,
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: The kinds that are led by a digit, a bracket, a plus or a capital; elsewhere one look at a character rules them out.
NUMBERS = "(?=[0-9(+A-Z])(?:" + "|".join(f"(?:{KINDS[k]})" for k in ("phone", "ssn", "ip", "card", "iban")) + ")"
#: A name or the local part of an e-mail address grows by one syllable or letter with every so many redraws.
REDRAWS = 4
#: Rounds at most. While half of a kind's surrogates are free, a round settles half of what is left or more.
ROUNDS = 64
#: Given names by gender, and syllables of family names, by script.
GIVEN = {
    ("latin", "n"): ("Alex", "Andy", "Charlie", "Chris", "Dana", "Eli", "Jamie", "Kim", "Lou", "Mika", "Noa", "Quinn", "Robin", "Sam", "Sascha", "Toni"),
    ("cyrillic", "n"): ("Валя", "Женя", "Саша", "Слава"),
    ("greek", "n"): ("Άλεξ", "Κρις"),
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Bella", "Clara", "Diana", "Elena", "Frida", "Greta", "Hanna", "Irma", "Julia", "Katia", "Lena", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"),
    ("cyrillic", "f"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Роза", "Софья"),
    ("greek", "m"): ("Αντώνης", "Βασίλης", "Γιάννης", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Λεωνίδας", "Μάρκος", "Νίκος", "Πέτρος", "Σπύρος", "Στέλιος", "Τάσος", "Φώτης", "Χρήστος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νίκη", "Όλγα", "Ρένα", "Σοφία", "Φωτεινή", "Χριστίνα"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ha", "ju", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "zu"),
    "cyrillic": ("ба", "де", "фи", "го", "ха", "жу", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "зу"),
    "greek": ("βα", "δε", "φι", "γο", "χα", "ζε", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "βι", "ξυ"),
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def kind_of(value: Column) -> Column:
    """The kind of a match of ``ANY``: the first whose whole pattern it has."""
    out = F.lit("name")
    for k, p in reversed(list(KINDS.items())):
        out = F.when(value.rlike(f"^(?:{p})$"), F.lit(k)).otherwise(out)
    return out


def bare(value: Column) -> Column:
    """A name without its title, in lower case."""
    return F.lower(F.regexp_replace(value, "^" + TITLE, ""))


def gender(value: Column) -> Column:
    """m or f by the title; where it tells none by the given name, if it is one of ``GIVEN``; else n, as without a title."""
    titles, first = F.regexp_extract(value, f"^({TITLE})", 1), F.substring_index(bare(value), " ", 1)
    has = lambda of: titles.rlike(r"(?:^| )(?:" + "|".join(of) + r")\.? ")
    named = lambda g: (titles != "") & bare(value).contains(" ") & first.isin(*(n.lower() for (_, of), names in GIVEN.items() if of == g for n in names))
    return F.when(has(FEMALE), "f").when(has(MALE), "m").when(named("f"), "f").when(named("m"), "m").otherwise("n")


def canonical(kind: Column, value: Column) -> Column:
    """What all mentions of one entity have in common, however they are written. A phone number without a
    country code is one of +1."""
    digits = _digits(value)
    return (
        F.when(kind == "phone", F.when((F.length(digits) == 11) & digits.startswith("1"), F.right(digits, F.lit(10))).otherwise(digits))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "name", F.concat_ws(":", gender(value), bare(value)))
        .otherwise(F.lower(value))
    )


def _nibble(stream: Column, i: Column) -> Column:
    """The i-th of the stream's bytes, as a number; the stream is 64 bytes in hex and starts again after them."""
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: Column, what: Column, attempt: Column) -> Column:
    text = F.concat_ws("\x1f", F.lit(key), kind, what, attempt.cast("string"))
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(text, F.lit("\x1f+")), 256))


def _like(value: Column, stream: Column, lead: tuple[int, ...] = ()) -> Column:
    """Every letter and digit replaced by one of its sort and script; a digit that leads a group, or stands at one
    of the places ``lead``, isn't 0 or 1."""
    chars = F.split(value, "")

    def one(c: Column, i: Column) -> Column:
        b, before = _nibble(stream, i), F.get(chars, i - 1)
        pick = lambda of: F.substring(F.lit(of), b % len(of) + 1, F.lit(1))
        leads = (i == 0) | i.isin(*lead) | ~F.coalesce(before.rlike("[0-9]"), F.lit(False))
        out = F.when(c.rlike("[0-9]"), F.when(leads, pick("23456789")).otherwise(pick("0123456789")))
        out = out.when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out = out.when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
        return out.when(c.rlike(r"\p{L}"), pick("àáâãäåæçèéêëìíîïñòóôõöøùúûü")).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn(body: Column) -> Column:
    """The check digit for the digits of ``body``."""
    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(s["double"], 2).otherwise(1)
        return F.struct((s["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (~s["double"]).alias("double"))

    total = F.aggregate(F.split(F.reverse(body), ""), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("double")), add, lambda s: s["sum"])
    return (F.pmod(F.lit(10) - total % 10, F.lit(10))).cast("string")


def _iban(country: Column, body: Column) -> Column:
    """With the check digits that the remainder by 97 asks for."""
    chars = F.split(F.concat(body, country, F.lit("00")), "")
    left = F.aggregate(chars, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + c.try_cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), body)


def surrogate_of(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of an entity in its canonical form, drawn by the key. Of an e-mail the domain
    depends on the domain alone and keeps its last label; a phone number keeps its country code; a card keeps its first
    digit and a right check digit, an IBAN its country and right check digits; an octet is 1 to 254; a name keeps gender,
    script and number of words. Names and local parts grow with the attempt, so that there are always enough; the other
    kinds keep their length, which leaves 8e8 surrogates or more to each."""
    stream = _stream(key, kind, canon, attempt)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host, last = F.regexp_replace(domain, r"\.[^.]+$", ""), F.substring_index(domain, ".", -1)
    grown = F.floor(attempt / REDRAWS).cast("int")
    email = F.concat(_like(F.concat(local, F.repeat(F.lit("x"), grown)), stream), F.lit("@"), _like(host, _stream(key, F.lit("domain"), domain, F.lit(0))), F.lit("."), last)
    body = F.concat(F.substring(canon, 1, 1), _like(F.expr("substring(canon, 2, length(canon) - 2)"), stream))
    phone = F.concat(F.expr("substring(canon, 1, length(canon) - 10)"), _like(F.right(canon, F.lit(10)), stream, (3,)))
    iban = _iban(F.substring(canon, 1, 2), _like(F.expr("substring(canon, 5)"), stream))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_nibble(stream, i) % 254 + 1).cast("string")), ".")
    words = F.split(F.substring_index(canon, ":", -1), " ")
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        mine = (script == s) & canon.startswith(f"{g}:")
        given = F.when(mine, F.element_at(F.array(*map(F.lit, names)), _nibble(stream, F.lit(0)) % len(names) + 1)).otherwise(given)
    for s, parts in SYLLABLES.items():
        table = F.array(*map(F.lit, parts))
        made = F.array_join(F.transform(F.sequence(F.lit(1), grown + 4), lambda i: F.element_at(table, _nibble(stream, i) % len(parts) + 1)), "")  # noqa: B023
        family = F.when(script == s, F.initcap(made)).otherwise(family)
    name = F.when(F.size(words) > 1, F.concat_ws(" ", given, family)).otherwise(family)
    return F.when(kind == "email", email).when(kind == "card", F.concat(body, _luhn(body))).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ip", octets).when(kind == "name", name).otherwise(_like(canon, stream))


def written_as(kind: Column, value: Column, surrogate: Column, part: Column) -> Column:
    """The surrogate in the format of one mention: separators, country code, title and case stay; of a name
    of which the mention has a ``part``, the given name (1) or the family name (2)."""
    keep = F.greatest(F.length(_digits(value)) - F.length(surrogate), F.lit(0))

    def put(of: str) -> Column:
        def step(s: Column, c: Column) -> Column:
            place = c.rlike(of)
            new = F.when(place & (s["k"] >= keep), F.substring(surrogate, s["k"] - keep + 1, F.lit(1))).otherwise(c)
            return F.struct(F.concat(s["out"], new).alias("out"), (s["k"] + place.cast("int")).alias("k"))

        return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda s: s["out"])

    spaced = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(surrogate, s["k"] + 1, F.lit(1)))).alias("out"), (s["k"] + (c != " ").cast("int")).alias("k")),
        lambda s: s["out"],
    )
    title = F.regexp_extract(value, f"^({TITLE})", 1)
    name = F.concat(title, F.when(part == 1, F.substring_index(surrogate, " ", 1)).when(part == 2, F.substring_index(surrogate, " ", -1)).otherwise(surrogate))
    email = F.when(value == F.upper(value), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "ssn", "card"), put("[0-9]")).when(kind == "iban", spaced).when(kind == "name", name).when(kind == "email", email).otherwise(surrogate)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for the distinct entities kind, canon. Drawn again, with the next attempt,
    are those that meet the surrogate of another entity (of which the first keeps it) or any entity of
    the corpus: so different entities stay different, and no surrogate reads as someone else's. Each round
    looks only at what the last one left. Where ROUNDS aren't enough, as a kind of a set length has nearly as many entities as
    surrogates, it raises."""
    pending = cut(entities.distinct().withColumn("attempt", F.lit(0)))
    # names are compared in lower case and without the gender
    real = pending.select("kind", F.when(F.col("kind") == "name", F.substring_index("canon", ":", -1)).otherwise(F.col("canon")).alias("form")).distinct()
    settled = pending.limit(0).select("kind", "canon", F.lit("").alias("surrogate"))
    for _ in range(ROUNDS):
        drawn = pending.withColumn("surrogate", surrogate_of(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canon"))
        drawn = drawn.withColumn("met", rank > 1).withColumn("form", F.when(F.col("kind") == "name", F.lower("surrogate")).otherwise(F.col("surrogate")))
        drawn = drawn.join(real.withColumn("taken", F.lit(True)), ["kind", "form"], "left")
        drawn = drawn.join(settled.select("kind", "surrogate", F.lit(True).alias("given")), ["kind", "surrogate"], "left")
        again = F.col("met") | F.col("taken").isNotNull() | F.col("given").isNotNull()
        drawn = cut(drawn.select("kind", "canon", "attempt", "surrogate", again.alias("again")))
        settled = settled.union(drawn.where("not again").select("kind", "canon", "surrogate"))
        pending = drawn.where("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled
    raise ValueError(f"no surrogates are left for some entities after {ROUNDS} rounds")


def _found_in(text: Column) -> Column:
    """Whether a text has a match of ``ANY``, by what costs least first: most have none."""
    return text.rlike(NUMBERS) | text.rlike(KINDS["name"]) | (text.contains("@") & text.rlike(KINDS["email"]))


def _pattern() -> Column:
    """``ANY``, and the full names that the text has after a title, whole or in part, wherever they stand without one; longer ones first."""
    names = F.transform(F.regexp_extract_all("text", F.lit(KINDS["name"]), F.lit(0)), lambda x: F.regexp_replace(x, "^" + TITLE, ""))
    names = F.filter(names, lambda x: x.contains(" "))
    parts = F.filter(F.flatten(F.transform(names, lambda x: F.split(x, " "))), lambda x: ~x.isin(*PARTICLES))
    forms = F.array_sort(F.array_distinct(F.concat(names, parts)), lambda x, y: F.length(y) - F.length(x))
    more = F.concat(F.lit(ANY + r"|(?=\p{L})(?<!\p{L}|\p{L}-)(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L}|-\p{L}|['’]\p{Lu})"))
    return F.when(F.col("text").rlike(KINDS["name"]), F.when(F.size(forms) > 0, more).otherwise(F.lit(ANY))).otherwise(F.lit(ANY))


def _resolved(names: DataFrame) -> DataFrame:
    """Mentions of names (doc_id, _th, value, canon, ...) with the canon of the name that the same text has
    after a title: where it stands without one, and where only one of its words does, if just one full name has that word (after a
    title that tells a gender, one of this gender). part: 1 for a given name, 2 for the family name, else 0."""
    row = ["doc_id", "_th"]
    titled, words = F.col("value").rlike("^" + TITLE), bare(F.col("value"))
    mine = names.where(titled).select(*row, "canon", words.alias("words"), F.substring_index("canon", ":", 1).alias("gender"))
    full = mine.where(F.col("words").contains(" "))
    links = full.select(*row, F.concat(F.lit("="), "words").alias("link"), "canon", F.lit(0).alias("part"))
    pieces = full.withColumn("p", F.split("words", " ")).select(*row, "canon", "gender", F.size("p").alias("n"), F.posexplode("p").alias("pos", "word")).where(~F.col("word").isin(*PARTICLES))
    pieces = pieces.withColumn("part", F.when(F.col("pos") == F.col("n") - 1, 2).otherwise(1))
    for told in ("gender", F.lit("")):
        link = F.concat_ws(":", told, "word").alias("link")
        one = pieces.groupBy(*row, link).agg(F.min("canon").alias("canon"), F.max("canon").alias("other"), F.max("part").alias("part"))
        links = links.unionByName(one.where("canon = other").drop("other"))
    links = links.withColumn("order", F.lit(0)).unionByName(mine.where(~F.col("words").contains(" ")).select(*row, F.concat(F.lit(":"), "words").alias("link"), "canon", F.lit(0).alias("part"), F.lit(1).alias("order")))
    links = links.groupBy(*row, "link").agg(F.min(F.struct("order", "canon", "part")).alias("m"))
    links = links.select(F.col("doc_id").alias("_of_id"), F.col("_th").alias("_of_th"), F.col("link").alias("_of_link"), F.col("m.canon").alias("of"), F.col("m.part").alias("part"))
    told = F.regexp_replace(F.substring_index("canon", ":", 1), "n", "")
    link = F.when(~words.contains(" "), F.concat_ws(":", told, words)).when(~titled, F.concat(F.lit("="), words))
    same = F.col("doc_id").eqNullSafe(F.col("_of_id")) & (F.col("_th") == F.col("_of_th")) & (link == F.col("_of_link"))
    out = names.join(links, same, "left").withColumn("part", F.coalesce("part", F.lit(0)))
    return out.withColumn("canon", F.coalesce("of", "canon")).drop("_of_id", "_of_th", "_of_link", "of")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace e-mail addresses, phone numbers, social security numbers, IPv4 addresses, card numbers (13 to 19
    digits with a right check digit), IBANs and names after a title by surrogates that a secret ``key`` draws.
    Mentions of one entity get one surrogate everywhere, in the format of each mention. A full name that stands after a
    title is also replaced where the same text has it without one, whole or one of its words, as written there; if a word is in several full names of the text, it is an
    entity of its own. Names are up to three words, with particles, hyphens, apostrophes and inner capitals; a title that tells no gender leaves it to the given name.
    Names are those in Latin, Cyrillic and Greek letters; other scripts are left alone.

    Returns one row for each row of ``docs``: doc_id, text (with surrogates), n_entities, entities (array
    of kind, start, end in code points of the original text, end exclusive, and surrogate as written). A null or empty text has
    none and becomes empty. Rows that repeat a doc_id and a text get the same result. An empty table
    gives an empty result; other columns are ignored.

    Only matches are exploded; the distinct entities are checked for collisions by sorts on the
    surrogate. The join with mentions can be split by AQE where one entity is very common.
    """
    base = texts(docs, id_col, text_col)
    some = base.where(_found_in(F.col("text"))).withColumn("_pat", _pattern())
    some = some.withColumns({"_found": F.regexp_extract_all(F.col("text"), F.col("_pat"), F.lit(0)), "_pieces": F.split(F.col("text"), F.col("_pat"), -1)})
    hits = some.select("doc_id", "_th", F.posexplode(F.transform("_found", lambda x, i: F.struct(x.alias("value"), F.length(F.get(F.col("_pieces"), i)).alias("gap")))).alias("pos", "m"))
    hits = hits.select("doc_id", "_th", "pos", "m.value", "m.gap").distinct().withColumn("kind", kind_of(F.col("value"))).withColumn("canon", canonical(F.col("kind"), F.col("value")))
    digits = _digits(F.col("value"))
    luhn = _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1))
    hits = cut(hits.withColumn("real", (F.col("kind") != "card") | luhn).withColumn("part", F.lit(0)))
    hits = hits.where("kind <> 'name'").unionByName(_resolved(hits.where("kind = 'name'").drop("part")))
    surrogates = assign_surrogates(hits.where("real").select("kind", "canon"), key)
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("doc_id", "_th").orderBy("pos")).cast("int")
    spans = hits.withColumn("end", end).join(surrogates, ["kind", "canon"], "left")
    shown = F.when(F.col("real"), written_as(F.col("kind"), F.col("value"), F.col("surrogate"), F.col("part"))).otherwise(F.col("value"))
    spans = spans.select("doc_id", "_th", "pos", "kind", (F.col("end") - F.length("value")).alias("start"), "end", shown.alias("surrogate"), "real")
    spans = spans.groupBy("doc_id", "_th").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "start", "end", "surrogate", "real"))).alias("m"))
    out = left_on_row(base, spans)
    pieces = F.split(F.col("text"), _pattern(), -1)
    text = F.array_join(F.zip_with(pieces, F.transform("m", lambda x: x["surrogate"]), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    entities = F.transform(F.filter("m", lambda x: x["real"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["surrogate"].alias("surrogate")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,surrogate:string>>")
    return out.select("doc_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce(F.size(entities), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(entities, none).alias("entities"))
