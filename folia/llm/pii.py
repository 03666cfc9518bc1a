"""Replacing personal data by surrogates (native).

Detected entities are e-mail addresses, IPv4 addresses, payment card numbers, telephone numbers, long hexadecimal keys
and names after a form of address. Each gets a surrogate drawn by a keyed hash of (kind, canonical form, attempt):

- the same entity has the same surrogate wherever it occurs, in whatever notation (coreference);
- surrogates are of the same kind, and take the notation of each occurrence: separators, country code, check digit,
  address class, letter case, script and gender of names;
- two entities never share a surrogate, and no surrogate is an entity of the corpus: those that would are drawn again
  with the next attempt, round by round, until none is left (distinctness). Names grow with the attempts, and private
  addresses move to larger private blocks, so these spaces grow with the entities.

A number of 13 to 19 digits is a card only if it passes the mod-10 check. Telephone numbers of the same digits are one entity
unless the corpus has them with different country codes. Names have surrogates in Latin, Cyrillic, Greek or Armenian; those
in other scripts get Latin ones.

Scale: one scan writes the pieces of texts with entities, another passes the other texts through unmoved. Distinct
entities and their surrogates are joined by hash; an entity that very many documents share is one row of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.common import column, let, shared_path, small, written

KEY = "folia-surrogates-1"
#: Rounds of drawing in a row that may settle no entity before a kind counts as used up.
IDLE = 40

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUPED = "|".join(f"[0-9]{{4}}(?:{x}[0-9]{{4}}){{3}}|[0-9]{{4}}{x}[0-9]{{6}}{x}[0-9]{{5}}" for x in " -")
_NAME = "\\p{Lu}\\p{Ll}+(?:[ -]\\p{Lu}\\p{Ll}+){0,2}"
#: Forms of address by the gender they tell.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "Господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "Госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof")
_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + ")\\.? "

#: The kinds of entities, in the order in which they are tried at a place.
PATTERNS = {
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": f"(?<![0-9.]){_OCTET}(?:\\.{_OCTET}){{3}}(?!\\.?[0-9])",
    "phone": "(?<![\\p{L}\\p{N}+])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{2,4}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\\p{L}\\p{N}+])\\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])",
    "card": f"(?<![\\p{{L}}\\p{{N}}])(?:{_GROUPED}|[0-9]{{13,19}})(?![\\p{{L}}\\p{{N}}])",
    "key": "(?<![\\p{L}\\p{N}])[0-9a-f]{32,}+(?![\\p{L}\\p{N}])",
    "name": f"(?<![\\p{{L}}\\p{{N}}]){_TITLE}{_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity.
HINT = f"[0-9@]|{_TITLE}"

#: Surrogate names by script and gender; surnames serve both.
NAMES = {
    "latin": {
        "m": ("Adam", "Bruno", "Carl", "Daniel", "Edgar", "Felix", "Gustav", "Henry", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"),
        "f": ("Alice", "Bianca", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
        "last": ("Abbot", "Becker", "Castillo", "Dubois", "Ekman", "Fischer", "Garner", "Hansen", "Ibarra", "Jansen", "Keller", "Lambert", "Moreau", "Novak", "Olsen", "Palmer", "Quintana", "Romero", "Schuster", "Turner"),
    },
    "cyrillic": {
        "m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим", "Олег", "Павел"),
        "f": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Тамара"),
        "last": ("Белых", "Гончар", "Дубко", "Живаго", "Коваль", "Литвин", "Мороз", "Седых", "Франко", "Черных"),
    },
    "greek": {
        "m": ("Αλέξανδρος", "Βασίλης", "Γιάννης", "Δημήτρης", "Κώστας", "Μιχάλης", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"),
        "f": ("Άννα", "Βασιλική", "Δήμητρα", "Ειρήνη", "Ελένη", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία", "Χριστίνα"),
        "last": ("Αγγέλου", "Βλάχου", "Γεωργίου", "Δούκα", "Ζήση", "Ιωάννου", "Κωνσταντίνου", "Μάρκου", "Νικολάου", "Χατζή"),
    },
    "armenian": {
        "m": ("Արամ", "Գևորգ", "Դավիթ", "Կարեն", "Հայկ", "Նարեկ", "Սուրեն", "Տիգրան", "Վահան", "Ռուբեն"),
        "f": ("Անահիտ", "Արփի", "Գայանե", "Լիլիթ", "Մարիամ", "Նարինե", "Շուշան", "Սիրան", "Տաթև", "Հասմիկ"),
        "last": ("Աբրահամյան", "Գրիգորյան", "Դավթյան", "Հակոբյան", "Մարտիրոսյան", "Պետրոսյան", "Սարգսյան", "Վարդանյան", "Խաչատրյան", "Կարապետյան"),
    },
}


def _kind(value: Column) -> Column:
    """The kind of what a pattern found; null for a number that is no card."""
    out = F.lit("name")
    for kind in ("key", "card", "phone", "ip", "email"):
        is_one = value.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(is_one, F.when(_valid(_digits(value)), kind) if kind == "card" else F.lit(kind)).otherwise(out)
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


#: The country code of a telephone number, where a separator ends it.
_COUNTRY = "^(\\+[0-9]{1,3})(?=[ .(-])"


def _title(value: Column) -> Column:
    return F.regexp_extract(value, f"^({_TITLE})", 1)


def canonical(kind: Column, value: Column) -> Column:
    """What the notations of one entity share: digits without country code, the lower-case address, a name with its gender. For the country see countries()."""
    title = F.regexp_replace(_title(value), "[. ]", "")
    gender = F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")
    name = F.concat(gender, F.lit(":"), F.regexp_replace(F.substring(value, F.length(_title(value)) + 1, F.length(value)), "[ -]", " "))
    return F.when(kind == "card", _digits(value)).when(kind == "phone", _digits(F.regexp_replace(value, _COUNTRY, ""))).when(kind == "name", name).otherwise(F.lower(value))


def _hash(kind: Column, core: Column, attempt: Column, part: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(KEY), F.lit(part), kind, core, attempt.cast("string")), 256)


def _drawn_digits(kind, core, attempt, part="digits") -> Column:
    """64 keyed decimal digits."""
    return F.translate(_hash(kind, core, attempt, part), "abcdef", "283517")


def _number(digest: Column, at: int, below: Column | int) -> Column:
    return F.pmod(F.conv(F.substring(digest, at, 7), 16, 10).cast("long"), F.lit(below) if isinstance(below, int) else below)


def _letters(digest: Column, at: int, count: int) -> Column:
    return F.translate(F.substring(digest, at, count), "0123456789abcdef", "bcdfghklmnprstvz")


def _check_digit(digits: Column) -> Column:
    """The last digit that makes digits (without it) pass the mod-10 check of payment cards."""
    turned = F.reverse(F.split(digits, ""))
    total = F.aggregate(F.transform(turned, lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))), F.lit(0), lambda acc, d: acc + d)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _valid(digits: Column) -> Column:
    return F.substring(digits, F.length(digits), F.lit(1)) == _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))


def _pick(options: tuple, digest: Column, at: int) -> Column:
    return F.get(F.array(*[F.lit(x) for x in options]), _number(digest, at, len(options)).cast("int"))


def surrogate(kind: Column, core: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity."""
    digits, digest = _drawn_digits(kind, core, attempt), _hash(kind, core, attempt, "letters")
    body = F.substring(digits, F.lit(1), F.length(core) - 1)
    card = F.concat(body, _check_digit(body))
    phone = F.substring(digits, F.lit(1), F.length(_national(core)))
    octets = [(1 + _number(digest, 1 + 8 * k, 254)).cast("string") for k in range(4)]
    own = (attempt < 8) | ((attempt < 24) & (core.startswith("10.")))  # the block that an address is in, then a larger one
    block = F.when(core.startswith("192.168."), "192.168").when(core.startswith("127."), "127").when(core.startswith("10."), "10")
    wide = F.when(attempt < 24, F.lit("10"))
    at = F.when(own | block.isNull(), block).otherwise(wide)
    ip = F.concat_ws(".", at, F.when(at.isNull(), octets[0]), F.when(at.isNull() | (at != "192.168"), octets[1]), octets[2], octets[3])
    domain = _hash(kind, F.substring_index(core, "@", -1), F.lit(0), "domain")
    email = F.concat(_letters(digest, 1, 7), F.lit("."), F.substring(digits, 1, 4), F.lit("@"), _letters(domain, 1, 6), F.lit(".example."), _pick(("com", "org", "net"), domain, 20))
    key = F.rpad(F.sha2(digest, 512), F.length(core), F.sha2(digits, 512))
    return F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "email", email).when(kind == "key", key).otherwise(_name(core, digest, attempt))


def _name(core: Column, digest: Column, attempt: Column) -> Column:
    """As many words as the name has: a first name of its gender, surnames, in its script; every third attempt lengthens the surname."""
    count = F.size(F.split(core, " "))
    female = F.when(core.startswith("f:"), True).when(core.startswith("m:"), False).otherwise(_number(digest, 1, 2) == 0)

    def made(script):
        n = NAMES[script]
        first = F.when(female, _pick(n["f"], digest, 9)).otherwise(_pick(n["m"], digest, 9))
        more = F.when(attempt > 2, F.array_join(F.transform(F.sequence(F.lit(1), F.floor(attempt / 3).cast("int")), lambda k: F.concat(F.lit("-"), _pick(n["last"], F.sha2(F.concat_ws("|", digest, k.cast("string")), 256), 1))), "")).otherwise("")
        tail = F.concat(_pick(n["last"], digest, 17), more)
        return F.concat(F.when(count > 1, F.concat(first, F.lit(" "))).otherwise(""), F.when(count > 2, F.concat(_pick(n["last"], digest, 57), F.lit(" "))).otherwise(""), tail)

    out = made("latin")
    for script in ("cyrillic", "greek", "armenian"):
        out = F.when(core.rlike(f"\\p{{Is{script.capitalize()}}}+$"), made(script)).otherwise(out)
    return out


def written_as(kind: Column, value: Column, made: Column) -> Column:
    """A canonical surrogate in the notation of an occurrence: its separators and country code, form of address, or letter case."""
    skip = F.length(_digits(F.regexp_extract(value, _COUNTRY, 1)))

    def placed(skip):
        def put(acc, c):
            digit = c.rlike("[0-9]")
            own = F.when(acc["k"] < skip, c).otherwise(F.substring(made, acc["k"] - skip + 1, F.lit(1)))
            return F.struct(F.concat(acc["out"], F.when(digit, own).otherwise(c)).alias("out"), (acc["k"] + digit.cast("int")).alias("k"))

        return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), put)["out"]

    between = F.regexp_extract_all(F.substring(value, F.length(_title(value)) + 1, F.length(value)), F.lit("[ -]"), F.lit(0))
    name = F.concat(_title(value), F.array_join(F.transform(F.split(made, " "), lambda w, i: F.concat(w, F.coalesce(F.get(between, i), F.lit("")))), ""))
    upper = (value == F.upper(value)) & (value != F.lower(value))
    return F.when(kind == "card", placed(F.lit(0))).when(kind == "phone", let(skip, placed)).when(kind == "name", name).when(upper & (kind == "email"), F.upper(made)).otherwise(made)


def _national(core: Column) -> Column:
    """A telephone number's digits, without the country that countries() may have put before them."""
    return F.substring_index(core, "|", -1)


def countries(entities: DataFrame) -> DataFrame:
    """distinct (kind, core, country) to (kind, core, country, whole): whole is core, with the country before it where telephone numbers of these digits have several countries."""
    several = written(entities.where("kind = 'phone' and country <> ''").groupBy("core").agg(F.countDistinct("country").alias("n")).where("n > 1").select(F.col("core").alias("_several")), "pii-countries")
    joined = entities.join(small(several), (F.col("kind") == "phone") & (F.col("core") == F.col("_several")), "left")
    return joined.select("kind", "core", "country", F.when(F.col("_several").isNotNull(), F.concat_ws("|", "country", "core")).otherwise(F.col("core")).alias("whole"))


def surrogates(entities: DataFrame) -> DataFrame:
    """(kind, core, made) for distinct entities (kind, core). Each round settles those without a rival and draws the others anew.

    What is settled is appended to one table, which each round reads once. A kind is used up, which is an error, when IDLE
    rounds in a row settle nothing.
    """
    spark = entities.sparkSession
    known = entities.select(F.col("kind").alias("_k"), _national(F.col("core")).alias("_c"))
    todo, done, idle = entities.withColumn("attempt", F.lit(0)), None, 0
    place = shared_path(spark, "pii-done")
    while idle < IDLE:
        drawn = written(todo.withColumn("made", surrogate(F.col("kind"), F.col("core"), F.col("attempt"))), "pii-drawn")
        first = drawn.groupBy("kind", "made").agg(F.min("core").alias("first"))
        taken = first.join(known, (F.col("kind") == F.col("_k")) & (F.col("made") == F.col("_c")), "left_anti")
        if done is not None:
            older = done.select(F.col("kind").alias("_k"), F.col("made").alias("_m"))
            taken = taken.join(older, (F.col("kind") == F.col("_k")) & (F.col("made") == F.col("_m")), "left_anti")
        settled = written(taken.select("kind", F.col("first").alias("core"), "made"), "pii-settled")
        settled.write.mode("append").parquet(place)
        done = spark.read.schema(settled.schema).parquet(place)
        todo = drawn.join(settled.select("kind", "core"), ["kind", "core"], "left_anti").select("kind", "core", (F.col("attempt") + 1).alias("attempt"))
        if todo.limit(1).count() == 0:
            return done
        idle = 0 if settled.limit(1).count() else idle + 1
    raise ValueError("surrogates are used up: a kind has more entities than notations")


def replaced(docs: DataFrame) -> DataFrame:
    """docs with surrogates in text, and n_email, n_ip, n_phone, n_card, n_key, n_name (long) for every row.

    Null texts stay null and empty ones empty, with no entities; texts without entities stay as they are. Rows are rewritten
    one by one, so repeated rows and null ids need no rule. An empty table gives an empty result. Columns of docs that
    have one of the new names are replaced; the others pass through. What looks like a card without a valid check digit stays.
    """
    new = [f"n_{k}" for k in PATTERNS]
    base = docs.drop(*new)
    other = [c for c in base.columns if c != "text"]
    packed = base.select(F.struct(*[column(c) for c in other], F.lit(0).alias("_")).alias("_row"), "text")
    has = F.coalesce(F.when(F.col("text").rlike(HINT), F.col("text").rlike(ANY)), F.lit(False))
    rest = packed.where(~has).select("_row", "text", *[F.lit(0).cast("long").alias(n) for n in new])
    found = packed.where(has).select(F.monotonically_increasing_id().alias("_id"), "_row", F.split("text", ANY, -1).alias("parts"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("values"))
    found = written(found, "pii-found")
    each = found.select("_id", F.posexplode("values").alias("pos", "value")).withColumn("kind", _kind(F.col("value"))).withColumn("core", canonical(F.col("kind"), F.col("value")))
    each = each.withColumn("country", F.when(F.col("kind") == "phone", _digits(F.regexp_extract("value", _COUNTRY, 1))).otherwise(""))
    named = written(countries(each.where("kind is not null").select("kind", "core", "country").distinct()), "pii-countries")
    made = surrogates(written(named.select("kind", F.col("whole").alias("core")).distinct(), "pii-entities"))
    made = written(named.join(made.withColumnRenamed("core", "whole"), ["kind", "whole"]).drop("whole"), "pii-surrogates")
    put = each.join(small(made), ["kind", "core", "country"], "left").withColumn("put", F.when(F.col("kind").isNull(), F.col("value")).otherwise(written_as(F.col("kind"), F.col("value"), F.col("made"))))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in PATTERNS]
    listed = put.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("pos", "put"))).alias("puts"), *counts)
    whole = found.join(listed, "_id").withColumn("text", F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.get(F.col("puts"), i)["put"], F.lit("")))), ""))
    out = rest.unionByName(whole.select("_row", "text", *new))
    return out.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in base.columns], *new)
