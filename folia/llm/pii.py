"""Personal data replaced by keyed surrogates (native).

Entities are found by patterns and replaced by values of the same type and format: digits stay
digits, letters stay letters of their case and script, an address keeps its shape, a person keeps
title and number of names and gets a given name of the same gender and script.

An entity is what its spellings have in common: an address in any case, a number with any
separators, a family name behind any title, a given name and its gender. A surrogate follows from
the key, the type and the entity alone, and each spelling is rendered from it, so spellings of one
entity agree in all documents (coreference). Surrogates are checked against each other and against
the entities of the corpus; all but one of a collision draw again, and from the second new draw on
each adds a character, so the space outgrows any number of entities and the draws come to an end.

The texts are scanned twice, once for documents with entities and once for those without. Only
documents with entities are written, and only their entities are shuffled.

Defined results: a null text stays null; a text without entities comes back unchanged; repeated
rows get equal results; a null ``doc_id`` keeps its row; an empty table gives an empty result;
all columns of the input are kept (an input column ``n_entities`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

KEY = "surrogate-key-1"
#: Given names that show a person without a title, by gender; surrogates are the first ones (fixed values).
GIVEN = {
    "m": """Adam Albert Carl David Emil Felix Georg Henry Jonas Karl Leon Martin Oscar Paul Simon Victor
            Andrew Anthony Brian Charles Daniel Edward Eric Frank George Hans Jack Jacob James Jean John Jose Joseph Juan Kevin Luis Michael Peter Pierre Richard Robert Stephen Thomas Walter William""".split(),
    "f": """Alice Anna Clara Diana Elena Emma Greta Helen Ida Julia Laura Maria Nora Olga Sofia Vera
            Barbara Carmen Catherine Elizabeth Jane Jennifer Jessica Karen Linda Lucia Marie Mary Nancy Patricia Sarah Sophie Susan Teresa""".split(),
}
NAMES = {g: names[:16] for g, names in GIVEN.items()}
#: Syllables and endings of further given names (fixed values).
SYLLABLES = "bal cor dan el far gor hal jor kal lor mar nor pel ros sal tor val wen yor zel".split()
ENDINGS = {"m": "o us an en".split(), "f": "a ia ina elle".split()}
TITLES = {"m": "Mr Herr Sr".split(), "f": "Mrs Ms Miss Mme Mlle Frau Sra".split(), "": "Dr Prof".split()}
_TITLE = "(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + ")"
_NAME = r"\p{Lu}\p{Ll}+"
#: Patterns by type, tried in this order at each place (fixed values). Look-behinds start a match only
#: at the beginning of a run, which keeps the scan linear.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "phone": (r"(?<![\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\p{N})|(?<![\p{N}+])\(\d{3}\) ?\d{3}-\d{4}(?!\p{N})"
              r"|(?<![\p{N}.+-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![.-]?\p{N})"),
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\p{N}|\.\p{N})",
    "card": r"(?<!\p{N})(?:\d{16}|\d{4}(?:-\d{4}){3}|\d{4}(?: \d{4}){3})(?!\p{N})",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}\.? {_NAME}(?: {_NAME})?|(?:{'|'.join(sorted(GIVEN['m'] + GIVEN['f']))}) {_NAME})(?![\p{{L}}\p{{N}}])",
}
_NUMBERS = "(?=[0-9+(])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ("ssn", "phone", "ip", "card")) + ")"
_WORDS = rf"(?=[0-9A-Za-f])(?<![\p{{L}}\p{{N}}])(?:{PATTERNS['secret']}|(?=[A-Z]){PATTERNS['person']})"
#: All of them for texts without an at sign and for others; the first character decides what is tried at a place.
_REST = f"{_NUMBERS}|{_WORDS}"
ANY = f"(?:{PATTERNS['email']})|{_REST}"


def _letters_of(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


#: Letters by kind: a letter of a kind becomes another one of it, a letter of no kind a Latin one.
ALPHABETS = [_letters_of(*x.split("-")) for x in "0-9 a-z A-Z ß-ö À-Ö α-ω Α-Ρ а-я А-Я ա-ֆ Ա-Ֆ א-ת ب-غ क-ह ა-ჰ あ-ん ア-ン 一-丟 가-갛".split()]
DIGITS, HEX = ALPHABETS[:1], ["0123456789", "abcdef"]


def _kind(value: Column) -> Column:
    out = F.lit("secret")
    for name in ("person", "card", "ip", "phone", "ssn", "email"):
        out = F.when(value.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _drawn(value: Column, seed: Column, alphabets=ALPHABETS) -> Column:
    """Each letter or digit becomes one of its alphabet; all else stays."""

    def one(c: Column, i: Column) -> Column:
        h = F.xxhash64(seed, i)
        pick = lambda x: F.substring(F.lit(x), 1 + F.pmod(h, F.lit(len(x))).cast("int"), F.lit(1))
        out = F.when(c.rlike(r"\p{L}"), pick(ALPHABETS[1])).otherwise(c)
        for alphabet in reversed(alphabets):
            out = F.when(F.instr(F.lit(alphabet), c) > 0, pick(alphabet)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def entities(value: Column) -> Column:
    """The entities of a match: structs of slot, kind, name (what its spellings share) and spelling.
    The words of a person have slots 0 to 2, all else has slot 3."""
    part = lambda slot, kind, name, spelling: F.struct(slot.alias("slot"), kind.alias("kind"), name.alias("name"), spelling.alias("spelling"))

    def person(value: Column) -> Column:
        words = F.split(value, " ")
        title = F.regexp_replace(F.get(words, 0), r"\.$", "")
        titled = value.rlike(rf"^{_TITLE}\.? ")
        given = F.when(titled & (F.size(words) == 2), F.lit(None)).when(titled, F.get(words, 1)).otherwise(F.get(words, 0))
        female = title.isin(TITLES["f"]) | (~title.isin(TITLES["m"]) & (given.isin(GIVEN["f"]) | (~given.isin(GIVEN["m"]) & given.endswith("a"))))
        names = F.array(
            F.when(given.isNotNull(), part(F.size(words) - 2, F.when(female, F.lit("f")).otherwise(F.lit("m")), F.lower(given), given)),
            part(F.size(words) - 1, F.lit("family"), F.lower(F.element_at(words, -1)), F.element_at(words, -1)))
        return F.filter(names, lambda x: x.isNotNull())

    kind = _kind(value)
    digits = F.regexp_replace(value, r"\D", "")
    code = F.regexp_extract(value, r"^\+(\d{1,3})[ (.-]|^\+(1)(?=\d{10}$)", 0)
    code = F.regexp_replace(code, r"\D", "")  # the country code stays
    name = (F.when(kind == "phone", F.concat(code, F.lit("|"), F.substring(digits, F.length(code) + 1, F.length(digits)))).when(kind.isin("card", "ssn"), digits)
            .otherwise(F.lower(value)))
    return F.when(kind == "person", person(value)).otherwise(F.array(part(F.lit(3), kind, name, value)))


def surrogate(kind: Column, name: Column, draw: Column, key: str = KEY) -> Column:
    """A name like ``name``, from the key, the type, the name and the number of the draw."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, name, draw.cast("string")), 256)
    h = F.xxhash64(seed)
    # From the second new draw on, the last character stands once more for each draw.
    more = F.greatest(draw - 1, F.lit(0))
    wide = lambda x: F.concat(x, F.repeat(F.substring(x, -1, 1), more))
    user, host, top = F.substring_index(name, "@", 1), F.substring_index(F.substring_index(name, "@", -1), ".", 1), F.substring_index(name, ".", -1)
    # A host under a reserved domain, so that no surrogate is anyone's address.
    email = F.concat(_drawn(wide(user), seed), F.lit("@"), _drawn(host, F.concat(seed, F.lit("host"))), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise("org"))
    code, number = F.substring_index(name, "|", 1), F.substring_index(name, "|", -1)
    phone = F.concat(code, F.lit("|"), _drawn(wide(number), seed, DIGITS))

    def octet(x: Column, i: Column) -> Column:
        r = F.xxhash64(seed, i)
        return (F.when(draw > 1, F.pmod(r, F.lit(256))).when(F.length(x) == 3, F.pmod(r, F.lit(156)) + 100).when(F.length(x) == 2, F.pmod(r, F.lit(90)) + 10)
                .otherwise(F.pmod(r, F.lit(10))).cast("string"))

    port = F.when(draw > 5, F.concat(F.lit(":"), _drawn(F.repeat(F.lit("0"), draw), seed, DIGITS))).otherwise("")
    ip = F.concat(F.array_join(F.transform(F.split(name, r"\."), octet), "."), port)
    pick = lambda xs, h: F.element_at(F.array(*map(F.lit, xs)), 1 + F.pmod(h, F.lit(len(xs))).cast("int"))
    by_gender = lambda table, h: F.when(kind == "f", pick(table["f"], h)).otherwise(pick(table["m"], h))
    syllables = F.array_join(F.transform(F.sequence(F.lit(0), draw), lambda i: pick(SYLLABLES, F.xxhash64(seed, i))), "")
    given = F.when(draw == 0, F.lower(by_gender(NAMES, h))).otherwise(F.concat(syllables, by_gender(ENDINGS, h)))
    given = F.when(name.rlike(r"^[\p{IsLatin}]+$"), given).otherwise(_drawn(wide(name), seed))
    return (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind.isin("m", "f"), given)
            .when(kind == "secret", _drawn(wide(name), seed, HEX)).when(kind.isin("card", "ssn"), _drawn(wide(name), seed, DIGITS)).otherwise(_drawn(wide(name), seed)))


def rendered(kind: Column, surrogate: Column, spelling: Column) -> Column:
    """The surrogate in the format of the spelling."""
    number = F.regexp_replace(surrogate, r"\D", "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(a: Column, c: Column) -> Column:
        digit = c.rlike(r"^\d$")
        return F.struct(F.concat(a["out"], F.when(digit, F.substring(number, a["k"], F.lit(1))).otherwise(c)).alias("out"), (a["k"] + digit.cast("int")).alias("k"))

    filled = F.aggregate(F.split(spelling, ""), start, put, lambda a: F.concat(a["out"], F.substring(number, a["k"], F.length(number))))
    user = F.substring_index(spelling, "@", 1)
    cased = F.array_join(F.transform(F.split(F.substring_index(surrogate, "@", 1), ""), lambda c, i: F.when(F.substring(user, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return (F.when(kind == "email", F.concat(cased, F.lit("@"), F.substring_index(surrogate, "@", -1))).when(kind.isin("phone", "card", "ssn"), filled)
            .when(kind == "secret", F.when(spelling.rlike("[A-F]"), F.upper(surrogate)).otherwise(surrogate)).when(kind == "ip", surrogate).otherwise(F.initcap(surrogate)))


def surrogates(names: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, name, surrogate) of distinct entities (a written table): one to one within a kind, and none is an entity itself."""
    todo, done = names.withColumn("draw", F.lit(0)), None
    while True:
        drawn = materialize(todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("name"), F.col("draw"), key)), "drawn")
        # The least entity of equal surrogates has it, unless it is taken or an entity of the corpus.
        first = drawn.groupBy("kind", "surrogate").agg(F.min("name").alias("name"))
        first = first.join(names.select("kind", F.col("name").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialize(first.select("kind", "name", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        todo = materialize(drawn.join(won.select("kind", "name"), ["kind", "name"], "left_anti").select("kind", "name", (F.col("draw") + 1).alias("draw")), "again")
        discard(drawn)
        if todo.isEmpty():
            return done


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with every entity replaced, and ``n_entities``."""
    docs = docs.drop("n_entities")
    every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    found = F.when(F.contains("text", F.lit("@")), every(ANY)).otherwise(every(_REST))
    none = F.coalesce(F.size(found) <= 0, F.lit(True))
    clean = docs.where(none).withColumn("n_entities", F.lit(0).cast("long"))
    hit = materialize(docs.where(~none).withColumns({"_matches": found, "_row": F.monotonically_increasing_id()}), "hits")
    parts = hit.select("_row", F.posexplode("_matches").alias("i", "match")).select("_row", "i", F.explode(entities(F.col("match"))).alias("e")).select("_row", "i", "e.*")
    parts = materialize(parts, "entities")
    drawn = surrogates(materialize(parts.select("kind", "name").distinct(), "names"), key)
    # Both sides are written tables, so that the engine splits the entities that stand in very many texts.
    own = parts.join(drawn, ["kind", "name"]).select("_row", (4 * F.col("i") + F.col("slot")).alias("at"), rendered(F.col("kind"), F.col("surrogate"), F.col("spelling")).alias("new"))
    given = own.groupBy(F.col("_row").alias("_r")).agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("_new"))
    new = lambda i, slot: F.try_element_at(F.col("_new"), (4 * i + slot).cast("int"))
    words = lambda m, i: F.array_join(F.transform(F.split(m, " "), lambda w, j: F.coalesce(new(i, j), w)), " ")
    replaced = F.transform("_matches", lambda m, i: F.coalesce(new(i, F.lit(3)), words(m, i)))
    between = F.zip_with(F.split("text", ANY, -1), replaced, lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    rebuilt = (hit.join(given, F.col("_row") == F.col("_r")).withColumn("n_entities", F.size("_matches").cast("long"))
               .withColumn("text", F.array_join(between, "")).select(*docs.columns, "n_entities"))
    return clean.unionByName(rebuilt)


def query(docs: DataFrame) -> DataFrame:
    return pseudonymise(docs).select("doc_id", "text", "n_entities")
