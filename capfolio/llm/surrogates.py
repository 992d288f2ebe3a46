"""Personal data replaced by keyed, type-consistent surrogates, distinct for distinct originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capfolio.llm.common import cut

MALE = ("Mr", "Herr", "Señor", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Госпожа")
TITLE = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))

# At most 64 characters before the '@' and 63 between dots, the limits of mail addresses: a long word costs time in proportion.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ADDRESS = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9])(?!\.[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?[0-9]{2,4}[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?[0-9](?:[ .-]?[0-9]{2}){4}(?![0-9])"
    r"|(?<![0-9A-Za-z.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
)
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = (
    r"(?<![0-9A-Za-z])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])"
)
KEYWORD = "(?i:password|passwd|secret|token|api_key|apikey)"
SECRET = (
    r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{12,20}(?![0-9A-Za-z])"
    rf"|(?<={KEYWORD}(?: ?[=:] ?[\"']?))[A-Za-z0-9+/_-]{{8,}}"
    r"|(?<![0-9A-Za-z])(?:ghp_|sk-)[A-Za-z0-9]{16,}"
)
NAME = rf"(?<!\p{{L}})(?:{TITLE})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}"
PATTERN = "|".join((SECRET, EMAIL, ADDRESS, SOCIAL, CARD, PHONE, NAME))
#: Every text with a match has one of these; texts without are not searched.
HINT = rf"[0-9@]|{KEYWORD}|AKIA|ghp_|sk-|(?:{TITLE})\.? "
#: The end of the text before a value that a keyword makes a secret, whatever it looks like.
AFTER_KEYWORD = rf"(?:^|{KEYWORD}) ?[=:] ?[\"']?\z"

#: Syllables of invented names by script.
SYLLABLES = {
    "latin": ("ba", "do", "fe", "ka", "lo", "mi", "na", "pe", "ro", "sa", "te", "vi", "be", "da", "fo", "gi", "ko", "le", "mo", "ri"),
    "cyrillic": ("ба", "до", "фе", "ка", "ло", "ми", "на", "пе", "ро", "са", "те", "ви", "бе", "да", "фо", "ги", "ко", "ле", "мо", "ри"),
}
ENDINGS = {
    ("latin", "f"): "na", ("latin", "m"): "n", ("latin", "s"): "rt",
    ("cyrillic", "f"): "на", ("cyrillic", "m"): "н", ("cyrillic", "s"): "рт",
}
DIGIT_KINDS = ("phone", "card", "social")


def tokens_of(entity: Column) -> Column:
    """An entity as tokens (kind, value); only a name has several: its title, given names and surname."""
    one = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), entity.alias("value")))
    words = F.split(entity, " ")
    female = entity.rlike(rf"^(?:{'|'.join(FEMALE)})\b")
    count = F.size(words)

    def part(word: Column, place: Column) -> Column:
        kind = (
            F.when(place == 0, "keep").when(place == count - 1, "surname").when(female, "given_f").otherwise("given_m")
        )
        return F.struct(kind.alias("kind"), word.alias("value"))

    return (
        F.when(entity.rlike(rf"^(?:{NAME})$"), F.transform(words, part))
        .when(entity.rlike("@"), one("email"))
        .when(entity.rlike(rf"^(?:{ADDRESS})$"), one("address"))
        .when(entity.rlike(rf"^(?:{SOCIAL})$"), one("social"))
        .when(entity.rlike(rf"^(?:{CARD})$"), one("card"))
        .when(entity.rlike(rf"^(?:{PHONE})$"), one("phone"))
        .otherwise(one("secret"))
    )


def canonical(kind: Column, value: Column) -> Column:
    """What spellings of one entity share: its digits (a phone's last ten), or the value in lower case."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits))
        .when(kind.isin("card", "social"), digits)
        .when(kind == "secret", value)
        .otherwise(F.lower(value))
    )


def keyed_bytes(key: str, *parts: Column) -> Column:
    """A function from a position (from 0) to a pseudo-random number below 65536 under the secret key."""
    message = F.concat_ws("\x1f", *[p.cast("string") for p in parts])
    inner = lambda block: F.sha2(F.concat(F.lit(key), message, F.lit("\x1f"), block.cast("string")), 256)
    outer = lambda block: F.sha2(F.concat(F.lit(key), inner(block)), 256)
    return lambda place: F.conv(F.substring(outer(F.floor(place / 16)), (F.pmod(place, F.lit(16)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def characters_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)


def pick(characters: str, number: Column) -> Column:
    return F.substring(F.lit(characters), (F.pmod(number, F.lit(len(characters))) + 1).cast("int"), F.lit(1))


def like_character(character: Column, number: Column, hexadecimal: Column) -> Column:
    """A character of the same class; signs stay."""
    return (
        F.when(hexadecimal, pick("0123456789abcdef", number))
        .when(character.rlike("[0-9]"), pick("0123456789", number))
        .when(character.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", number))
        .when(character.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", number))
        .otherwise(character)
    )


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    count = F.length(digits)
    twice = lambda n: F.when(n > 4, 2 * n - 9).otherwise(2 * n)
    value = lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))
    each = F.transform(
        characters_of(digits), lambda c, i: F.when(F.pmod(count - i, F.lit(2)) == 0, twice(value(c))).otherwise(value(c))
    )
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(10))


def ordinary_number(entity: Column, before: Column) -> Column:
    """Whether a match only looks like a card: its Luhn sum is wrong, and no keyword makes it a secret."""
    wrong = luhn(F.regexp_replace(entity, "[^0-9]", "")) != 0
    return F.when(entity.rlike(rf"^(?:{CARD})$"), wrong & ~F.coalesce(before.rlike(AFTER_KEYWORD), F.lit(False))).otherwise(False)


def surrogate(key: str, kind: Column, original: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity; another one for each attempt."""
    numbers = keyed_bytes(key, kind, original, attempt)
    characters = characters_of(original)
    hexadecimal = original.rlike("^[0-9a-f]{12,}$") & (kind == "secret")
    plain = F.array_join(F.transform(characters, lambda c, i: like_character(c, numbers(i), hexadecimal)), "")
    known = F.when(kind == "secret", F.regexp_extract(original, "^(?:AKIA|ghp_|sk-)", 0)).otherwise("")
    plain = F.concat(known, F.substring(plain, F.length(known) + 1, F.length(plain)))

    # Every four attempts, names get one more syllable, and credentials and mailboxes one more letter.
    longer = F.floor(attempt / 4).cast("int")
    letters = F.transform(F.sequence(F.lit(1), longer), lambda i: pick("abcdefghijklmnopqrstuvwxyz", numbers(F.length(original) + i)))
    extra = F.when(longer > 0, F.array_join(letters, "")).otherwise("")

    # A phone's area and exchange do not begin with 0 or 1.
    digit = lambda c, i: F.when((kind == "phone") & i.isin(0, 3), pick("23456789", numbers(i))).otherwise(pick("0123456789", numbers(i)))
    digits = F.array_join(F.transform(characters, digit), "")
    # A card keeps its first digit and its Luhn remainder.
    stem = F.concat(F.substring(original, 1, 1), F.substring(digits, F.lit(2), F.length(digits) - 2))
    card = F.concat(stem, F.pmod(luhn(original) - luhn(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string"))

    octet = lambda i, most: (F.pmod(numbers(F.lit(i)), F.lit(most)) + 1).cast("string")
    address = F.concat_ws(".", octet(0, 223), octet(1, 254), octet(2, 254), octet(3, 254))

    host = F.substring_index(original, "@", -1)
    host_numbers = keyed_bytes(key, F.lit("host"), host)
    last = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    stem_of_host = F.substring(host, F.lit(1), F.length(host) - F.length(last))
    new_host = F.array_join(F.transform(characters_of(stem_of_host), lambda c, i: like_character(c, host_numbers(i), F.lit(False))), "")
    local = F.substring(plain, F.lit(1), F.length(F.substring_index(original, "@", 1)))
    email = F.concat(local, extra, F.lit("@"), new_host, last)

    cyrillic = original.rlike(r"\p{IsCyrillic}")

    def name(script: str) -> Column:
        syllables = SYLLABLES[script]
        listed = F.array(*map(F.lit, syllables))
        chosen = F.transform(F.sequence(F.lit(0), longer + 2), lambda i: F.get(listed, F.pmod(numbers(i), F.lit(len(syllables))).cast("int")))
        ending = F.when(kind == "given_f", ENDINGS[script, "f"]).when(kind == "given_m", ENDINGS[script, "m"]).otherwise(ENDINGS[script, "s"])
        return F.concat(F.array_join(chosen, ""), ending)

    return (
        F.when(kind == "card", card)
        .when(kind.isin("phone", "social"), digits)
        .when(kind == "address", address)
        .when(kind == "email", email)
        .when(kind == "secret", F.concat(plain, extra))
        .when(cyrillic, name("cyrillic"))
        .otherwise(name("latin"))
    )


def rendered(kind: Column, value: Column, new: Column) -> Column:
    """A canonical surrogate in the layout of ``value``: its separators, prefix and letter case."""
    count = F.length(F.regexp_replace(value, "[^0-9]", ""))
    shift = count - F.length(new)

    def put(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", "")) - shift
        return F.when(c.rlike("[0-9]") & (place >= 1), F.substring(new, place, F.lit(1))).otherwise(c)

    characters = characters_of(value)
    in_layout = F.array_join(F.transform(characters, put), "")
    in_case = F.array_join(
        F.transform(characters_of(new), lambda c, i: F.when(F.get(characters, i).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), ""
    )
    named = F.when(value == F.upper(value), F.upper(new)).otherwise(F.initcap(new))
    return (
        F.when(kind == "keep", value)
        .when(kind.isin(*DIGIT_KINDS), in_layout)
        .when(kind == "email", in_case)
        .when(kind.isin("address", "secret"), new)
        .otherwise(named)
    )


def surrogate_map(entities: DataFrame, key: str, attempts: int = 64) -> DataFrame:
    """kind, original, new: a surrogate for each distinct canonical entity.

    No two entities of a kind share a surrogate and none is itself an entity of its kind. Where that fails, all
    but the least of the entities that met try again with the next attempt number; each round is one aggregate and
    runs until nothing clashes. Names, mailboxes and credentials get longer with the attempts, so there is room for any
    number of them. ValueError if ``attempts`` rounds do not suffice for numbers and addresses, which means that a kind
    has more entities than its format has values.
    """
    columns = ("kind", "original")
    assigned = cut(entities.select(*columns).distinct().withColumn("attempt", F.lit(0)))
    rounds = 0
    while True:
        tried = assigned.withColumn("new", surrogate(key, F.col("kind"), F.col("original"), F.col("attempt")))
        taken = tried.select("kind", F.col("original").alias("value"), F.lit(None).cast("string").alias("owner"))
        offers = tried.select("kind", F.col("new").alias("value"), F.col("original").alias("owner"))
        clashes = (
            offers.union(taken).groupBy("kind", "value")
            .agg(F.min("owner").alias("winner"), F.count("owner").alias("offers"), F.count_if(F.col("owner").isNull()).alias("real"))
            .where("offers > 0 AND offers + real > 1")
            .select("kind", F.col("value").alias("new"), F.when(F.col("real") == 0, F.col("winner")).alias("winner"))
        )
        losers = cut(
            tried.join(clashes, ["kind", "new"]).where("winner IS NULL OR winner <> original").select(*columns, F.lit(1).alias("again"))
        )
        if losers.isEmpty():
            return tried.select(*columns, "new")
        rounds += 1
        if rounds >= attempts and not losers.where(F.col("kind").isin("address", *DIGIT_KINDS)).isEmpty():
            raise ValueError(f"surrogates still clash after {attempts} attempts")
        assigned = cut(
            assigned.join(losers, [*columns], "left")
            .select(*columns, (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
        )


def replace_private(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text, n_entities: each text with its private data replaced, one row per row of ``docs``.

    Detected are e-mail and IPv4 addresses, phone, card and social security numbers, credentials, and names after
    a title. A number in a card's layout whose Luhn sum is wrong stays, unless a keyword before it makes it a secret.
    Replacements depend on the key, the entity and, where surrogates clash, on the entities they clash with, so an entity
    has the same surrogate everywhere in ``docs``, whatever its layout (coreference, across documents too); they keep format, script, a name's gender, a card's
    Luhn remainder, country codes and top-level domains.

    Texts are searched where they lie. Only entities are shuffled, distinct ones map-side combined, and only texts
    with an entity meet their replacements; a frequent entity is split by adaptive execution. Results for
    special input: a NULL text stays NULL, with 0 entities, as texts without entities stay as they are. NULL ids and
    repeated rows are treated like any other row; other columns of ``docs`` are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(f"({PATTERN})"), 1))
    searched = base.withColumn("matches", F.coalesce(found, F.array().cast("array<string>")))
    between = F.split("text", f"(?:{PATTERN})", -1)
    card = F.exists("matches", lambda m: m.rlike(rf"^(?:{CARD})$"))
    before = F.when(card, between).otherwise(F.array().cast("array<string>"))
    entity = lambda m, i: F.struct(m.alias("value"), ordinary_number(m, F.get("before", i)).alias("ordinary"))
    searched = searched.withColumn("before", before).withColumn("entities", F.transform("matches", entity))
    searched = searched.withColumn("n_entities", F.size(F.filter("entities", lambda e: ~e["ordinary"])).cast("long")).drop("matches", "before")
    clean = searched.where(F.col("n_entities") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    private = searched.where(F.col("n_entities") > 0).withColumn("k1", F.xxhash64("doc_id")).withColumn("k2", F.xxhash64("text"))
    occurrences = private.select("k1", "k2", "entities").dropDuplicates(["k1", "k2"]).select("k1", "k2", F.posexplode("entities").alias("place", "entity"))
    unchanged = F.array(F.struct(F.lit("keep").alias("kind"), F.col("entity.value").alias("value")))
    parts = F.when(F.col("entity.ordinary"), unchanged).otherwise(tokens_of(F.col("entity.value")))
    tokens = cut(
        occurrences.select("k1", "k2", "place", F.posexplode(parts).alias("part", "token"))
        .select("k1", "k2", "place", "part", F.col("token.kind").alias("kind"), F.col("token.value").alias("value"))
        .withColumn("original", canonical(F.col("kind"), F.col("value")))
    )
    mapping = cut(surrogate_map(tokens.where("kind <> 'keep'"), key))
    names = mapping.select(F.col("kind").alias("_kind"), F.col("original").alias("_original"), "new")
    same = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("original").eqNullSafe(F.col("_original"))
    replaced = tokens.join(names, same, "left").withColumn("put", rendered(F.col("kind"), F.col("value"), F.col("new")))
    ordered = lambda first: F.array_sort(F.collect_list(F.struct(first, "put")))
    whole = replaced.groupBy("k1", "k2", "place").agg(F.array_join(F.transform(ordered("part"), lambda e: e["put"]), " ").alias("put"))
    lists = whole.groupBy("k1", "k2").agg(F.transform(ordered("place"), lambda e: e["put"]).alias("puts"))
    pieces = F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get("puts", i), F.lit(""))))
    rewritten = private.join(lists, ["k1", "k2"]).select(
        "doc_id", F.array_join(pieces, "").alias("text"), "n_entities"
    )
    return clean.union(rewritten)
