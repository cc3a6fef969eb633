"""Operator 2: keyed, type-consistent surrogates for personal data, in DataFrame functions.

Found kinds: e-mail, IBAN, IPv4, payment card, phone, national id (3-2-4), access keys and other
secrets, and names after a title. Each distinct entity of a kind, in a canonical form (so two
spellings of one number or address corefer), gets one surrogate from SHA-512 of a secret key,
its kind, its canonical form and an attempt number. Surrogates keep the kind's format: digits
stay digits, letters stay in their script and case, punctuation stays in place, an e-mail's
domain maps the same way wherever it stands and keeps its last label, a phone keeps its
country code and trunk zeros, a card its Luhn remainder, an IBAN its country and its remainder
modulo 97, a name its title.

Family names and given names are entities of their own: "Frau Müller" gets the family name of
"Frau Anna Müller", and a given name comes from the title's gender in the script it was written
in. A name of one word after a title is taken for a family name. A phone's entity is its national
number, without country code and trunk zeros, in all its digits.

Collision checks run on the table of distinct entities: a surrogate that two entities share,
or that equals an entity of the corpus, is drawn again with the next attempt until none is
left; only those are drawn again. The table is joined back by entity; hot entities are one row
there, and the join's skewed side can be split. Documents without entities never enter a shuffle.

Not looked for: names without a title, dates of birth, postal addresses.

Defined results: a null text stays null, an empty one empty; equal rows are treated alike;
a null doc_id is kept; text outside entities is unchanged. Other columns pass through, whatever
their names; the number of entities is `n_entities`, or where docs has such a column the first
of n_entities_1, n_entities_2... that it hasn't.
"""

from __future__ import annotations

import secrets
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# fixed values: what is looked for
WORDY = r"[\p{L}\p{N}._%+-]"
EMAIL = rf"(?:(?<!{WORDY})|\G){WORDY}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]+)+"
KEYWORDS = "password|passwd|pwd|secret|token|api_key|apikey"
SECRET = rf"AKIA[0-9A-Z]{{16}}|(?<=[=: \"'])(?<=\b(?i:{KEYWORDS})[ ]?[=:][ ]?[\"']?)[^\s\"'#$%&*]{{6,}}|(?<![\p{{L}}\p{{N}}])(?=[a-fA-F]{{0,40}}[0-9])(?![0-9]{{13,19}}(?![0-9a-fA-F]))[0-9a-fA-F]{{18,64}}(?![\p{{L}}\p{{N}}])"
IP = r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
NATIONAL = r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?=\d)(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)"
# two letters, check digits, then 11 to 30 more in one run or in groups of four
IBAN = r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|(?=[A-Z]{0,30}\d)[A-Z0-9]{11,30})(?![\p{L}\p{N}])"
INTERNATIONAL = r"\+\d(?:[ ./-]?\(\d{1,5}\)[ ./-]?|[ ./-]?\d){6,14}(?!\d)"
TRUNK = r"0\d{2,5}(?: ?[/-] ?| )\d{3,4}[ .-]\d{3,5}(?!\d)|0\d{2,5}(?: ?[/-] ?| )\d{6,8}(?!\d)"
PHONE = rf"(?=[\d+(])(?<![\p{{L}}\d])(?:{INTERNATIONAL}|(?:\(\d{{2,5}}\)[ .-]?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]\d{{3,4}}(?!\d)|{TRUNK})"
# country calling codes by their first digits: one digit, two, or three
CALLING = r"^(?:\+|00)(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MALE = r"Mr|Herr|Monsieur|Señor|Г-н|Господин"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Г-жа|Госпожа"
NAME = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
KINDS = [("email", EMAIL), ("iban", IBAN), ("secret", SECRET), ("ip", IP), ("national", NATIONAL), ("card", CARD), ("phone", PHONE), ("name", NAME)]
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
# every entity holds one of these, and most texts none; looked for only at their first characters
HINT = rf"[@0-9]|(?=[=:AFHMSГ])(?:[=:](?<=(?i:{KEYWORDS})[ ]?[=:])|AKIA|(?:{MALE}|{FEMALE})\.? )"
GIVEN = {
    ("latin", "m"): "Adam Bruno Carlo David Erik Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Ruben Simon Tomas Viktor",
    ("latin", "f"): "Anna Berta Clara Diana Elena Frida Greta Helga Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Tina Vera",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Тимур",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария Нина Ольга Полина Римма Софья Тамара",
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va", "cyrillic": "ба бе бо ва ве го да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то"}
ACCENTS = "àâäçéèêëîïôöùûüßñóíáú"
CAPITALS = "ÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÓÍÁÚ"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшщэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
SAME_LENGTH = 4
MOST_ATTEMPTS = 200
KEY_SETTING = "spark.reportloom.surrogate.key"


def letters_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def kind_of(e: Column) -> Column:
    """The kind of a found entity. A secret after its keyword has no form of its own; an unbroken
    run that could be an IBAN is one only with right check digits."""
    forms = [("email", EMAIL), ("ip", IP), ("national", NATIONAL), ("card", CARD), ("phone", PHONE), ("name", NAME)]
    last = F.when(e.rlike(f"^(?:{IBAN})$") & (e.contains(" ") | (remainder(F.regexp_replace(e, " ", "")) == 1)), "iban").otherwise("secret")
    return reduce(lambda rest, f: F.when(e.rlike(f"^(?:{f[1]})$"), f[0]).otherwise(rest), reversed(forms), last)


def digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def national_number(e: Column) -> Column:
    """All digits of a phone but its country code and trunk zeros (one digit is left at least)."""
    plain = F.regexp_replace(e, r"[^\d+]", "")
    return F.regexp_replace(F.when(plain.rlike(r"^(?:\+|00)"), F.regexp_replace(plain, CALLING, "")).otherwise(plain), r"^0+(?=\d)", "")


def remainder(iban: Column) -> Column:
    """An account number modulo 97, its first four characters moved to the end and letters as 10 to 35."""

    def step(r, c):
        n = F.ascii(c)
        return F.when(n < 58, (r * 10 + n - 48) % 97).otherwise((r * 100 + n - 55) % 97)

    return F.aggregate(letters_of(F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))), F.lit(0), step)


def canonical(kind: Column, e: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "phone", national_number(e))
        .when(kind.isin("card", "national"), digits(e))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "name", F.concat(F.when(e.rlike(f"^(?:{FEMALE})\\b"), "f:").otherwise("m:"), F.lower(F.regexp_replace(e, r"^\S+ ", ""))))
        .otherwise(e)
    )


def stream(key: str, *parts: Column) -> Column:
    """256 hexadecimal digits from the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.concat(F.sha2(text, 512), F.sha2(F.concat(text, F.lit("|+")), 512))


def byte(hexes: Column, i: Column) -> Column:
    return F.conv(F.substring(hexes, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def from_pool(pool: str, h: Column) -> Column:
    return F.substring(F.lit(pool), h % len(pool) + 1, F.lit(1))


def shaped(text: Column, hexes: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """text with each letter and digit redrawn in its class, case and script."""

    def one(c, i):
        h = byte(hexes, i)
        return (
            F.when(c.rlike("^[0-9]$"), (h % 10).cast("string"))
            .when(c.rlike("^[a-z]$"), from_pool(letters, h))
            .when(c.rlike("^[A-Z]$"), from_pool(letters.upper(), h))
            .when(F.contains(F.lit(ACCENTS), c), from_pool(ACCENTS, h))
            .when(F.contains(F.lit(CAPITALS), c), from_pool(CAPITALS, h))
            .when(c.rlike(r"^\p{IsCyrillic}$"), F.when(F.upper(c) == c, F.upper(from_pool(CYRILLIC, h))).otherwise(from_pool(CYRILLIC, h)))
            .when(c.rlike(r"^\p{IsGreek}$"), F.when(F.upper(c) == c, F.upper(from_pool(GREEK, h))).otherwise(from_pool(GREEK, h)))
            .otherwise(c)
        )

    return F.array_join(F.transform(letters_of(text), one), "")


def luhn(number: Column) -> Column:
    """The Luhn sum of a digit string modulo 10."""

    def value(c, i):
        d = F.ascii(c) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(letters_of(F.reverse(number)), value), F.lit(0), lambda a, x: a + x) % 10


def partial_syllable(s: Column, syllables: Column, n: int):
    return lambda i: F.get(syllables, byte(s, i) % n)


def more_letters(s: Column, attempt: Column) -> Column:
    """Short names run out of strings of their length, so later attempts are longer."""
    return F.translate(F.substring(s, F.lit(1), attempt - SAME_LENGTH), "0123456789", "ghijklmnop")


def draw_domain(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of an e-mail domain: its last label stays."""
    s = stream(key, kind, canon, attempt)
    label = F.regexp_extract(canon, r"(\.[^.]*)$", 1)
    return F.concat(shaped(F.substring(canon, F.lit(1), F.length(canon) - F.length(label)), s), more_letters(s, attempt), label)


def draw(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a canonical form."""
    s = stream(key, kind, canon, attempt)
    at = lambda i: byte(s, F.lit(i))
    # e-mails are drawn at their own domain, which is replaced by its surrogate afterwards
    email = F.concat(shaped(F.regexp_extract(canon, "^([^@]*)@", 1), s), more_letters(s, attempt), F.regexp_extract(canon, "(@.*)$", 1))
    octets = F.concat_ws(".", *[(at(i) % 254 + 1).cast("string") for i in range(4)])
    number = shaped(canon, s)
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    card = F.concat(body, ((luhn(canon) - luhn(F.concat(body, F.lit("0"))) + 10) % 10).cast("string"))
    access = F.concat(F.lit("AKIA"), shaped(F.substring(canon, 5, 1000), s))
    hexes = shaped(canon, s, "abcdef")
    # the check digits that give the remainder of the original
    bban = shaped(F.substring(canon, 5, 100), s)
    open_ = F.concat(F.substring(canon, 1, 2), F.lit("00"), bban)
    check = (remainder(canon) - remainder(open_) + 97) % 97
    iban = F.concat(F.substring(canon, 1, 2), F.lpad((check + F.when(check < 2, 97).otherwise(0)).cast("string"), 2, "0"), bban)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind == "phone", F.concat((at(0) % 9 + 1).cast("string"), F.substring(number, 2, 100)))  # no trunk zero
        .when(kind == "national", number)
        .when(canon.rlike("^AKIA[0-9A-Z]{16}$"), access)
        .when(canon.rlike("^[0-9a-fA-F]+$"), hexes)
        .otherwise(number)
    )


def draw_part(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a given name (canon "m:..." or "f:...") or of a family name."""
    s = stream(key, kind, canon, attempt)
    at = lambda i: byte(s, F.lit(i))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    # later attempts are longer, so there is always room
    syllables = {sc: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), partial_syllable(s, F.split(F.lit(x), " "), len(x.split()))), "") for sc, x in SYLLABLES.items()}
    drawn = []
    for (sc, g), pool in GIVEN.items():
        more = F.when(attempt > 0, F.concat(F.lit("-"), F.initcap(syllables[sc]))).otherwise("")
        first = F.get(F.split(F.lit(pool), " "), at(0) % len(pool.split()))
        drawn.append(((script == sc) & F.startswith(canon, F.lit(f"{g}:")), F.concat(F.lit(f"{g}:"), first, more)))
    given = reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), drawn, F.lit(None).cast("string"))
    family = F.initcap(F.when(script == "latin", syllables["latin"]).otherwise(syllables["cyrillic"]))
    return F.when(kind == "given", given).otherwise(family)


def rendered(kind: Column, e: Column, sur: Column) -> Column:
    """The surrogate in the format of this mention."""
    chars = letters_of(e)

    def digit(c, i):
        after = F.length(digits(F.substring(e, i + 2, F.length(e))))
        taken = F.length(sur) - after
        return F.when(c.rlike("^[0-9]$") & (taken >= 1), F.substring(sur, taken, F.lit(1))).otherwise(c)

    def cased(c, i):
        x = F.substring(sur, i + 1, F.lit(1))
        return F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(x)).otherwise(x)

    def in_place(c, i):
        at = F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), " ", ""))
        return F.when(c == " ", c).otherwise(F.substring(sur, at, F.lit(1)))

    return (
        F.when(kind.isin("phone", "card", "national"), F.array_join(F.transform(chars, digit), ""))
        .when(kind == "iban", F.array_join(F.transform(chars, in_place), ""))
        .when((kind == "email") & (F.length(sur) == F.length(e)), F.array_join(F.transform(chars, cased), ""))
        .when(kind == "name", F.concat(F.regexp_extract(e, r"^(\S+ )", 1), F.substring(sur, 3, 1000)))
        .otherwise(sur)
    )


def surrogate_table(found: DataFrame, key: str, scratch: C.Scratch, drawing=draw) -> DataFrame:
    """(kind, canon, sur) of the distinct entities of found (kind, canon), free of collisions.

    An entity whose surrogate no other holds and no real one equals is settled and not drawn
    again; of those that drew one surrogate in the same round the first by canon settles."""
    spark = found.sparkSession
    plain = lambda k, s: F.when(k.isin("given", "family"), F.lower(s)).otherwise(s)  # noqa: E731  as canonical forms are written
    entities = scratch.keep(found.distinct())
    taken = entities.select("kind", F.col("canon").alias("held"))
    settled, waiting = [], entities
    for attempt in range(MOST_ATTEMPTS):
        drawn = waiting.withColumn("sur", drawing(key, F.col("kind"), F.col("canon"), F.lit(attempt)))
        drawn = scratch.keep(drawn.withColumn("held", plain(F.col("kind"), F.col("sur"))))
        first = drawn.groupBy("kind", "held").agg(F.min("canon").alias("winner"))
        clash = taken.join(drawn.select("kind", "held").distinct(), ["kind", "held"], "left_semi").withColumn("clash", F.lit(True)).distinct()
        judged = scratch.keep(drawn.join(first, ["kind", "held"]).join(clash, ["kind", "held"], "left").withColumn("fine", F.col("clash").isNull() & (F.col("winner") == F.col("canon"))))
        settled.append(judged.filter("fine").select("kind", "canon", "sur"))
        taken = taken.union(judged.filter("fine").select("kind", "held"))
        waiting = judged.filter("not fine").select("kind", "canon")
        scratch.drop(drawn)
        if not waiting.limit(1).count():
            return reduce(DataFrame.union, settled) if settled else spark.createDataFrame([], "kind string, canon string, sur string")
    raise RuntimeError("no room for distinct surrogates of some kind")


def name_table(names: DataFrame, key: str, scratch: C.Scratch) -> DataFrame:
    """(kind, canon, sur) of names (canon): put together from their parts' surrogates."""
    part = names.select("canon", F.substring("canon", 1, 2).alias("g"), F.regexp_extract("canon", r"([^ :]+)$", 1).alias("family"), F.regexp_extract("canon", r"^..([^ ]+) ", 1).alias("given"))
    part = scratch.keep(part.distinct().withColumn("given", F.when(F.col("given") != "", F.concat("g", "given"))))
    found = part.select(F.lit("family").alias("kind"), F.col("family").alias("canon")).union(part.filter("given is not null").select(F.lit("given"), "given"))
    table = scratch.keep(surrogate_table(found, key, scratch, draw_part))
    of = lambda kind: table.filter(F.col("kind") == kind).select(F.col("canon").alias(kind), F.col("sur").alias(f"new_{kind}"))
    whole = part.join(of("family"), "family").join(of("given"), "given", "left")
    return whole.select(F.lit("name").alias("kind"), "canon", F.concat("g", F.coalesce(F.concat(F.substring("new_given", 3, 1000), F.lit(" ")), F.lit("")), "new_family").alias("sur"))


def secret_key(spark) -> str:
    """The key of the session's setting KEY_SETTING. Without one, a random key is drawn once
    and kept in the shared folder, so runs that share the folder agree."""
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key
    at = f"{C.shared_dir(spark)}/surrogate-key-{uuid.uuid4().hex}"
    known = f"{C.shared_dir(spark)}/surrogate-key"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(known).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(known)):
        spark.createDataFrame([(secrets.token_hex(32),)], "value string").coalesce(1).write.text(at)
        if not files.rename(path(at), path(known)):  # another run was first
            files.delete(path(at), True)
    return min(r.value for r in spark.read.text(known).collect())  # one line


def replace_pii(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """docs (doc_id, text, any others) -> the same columns, entities replaced, and n_entities."""
    key = key or secret_key(docs.sparkSession)
    scratch = C.Scratch(docs.sparkSession, "pii")
    count = next(c for c in ("n_entities", *(f"n_entities_{i}" for i in range(1, len(docs.columns) + 1))) if c not in docs.columns)
    own = [c for c in docs.columns if c not in ("doc_id", text)]
    inner = {c: f"other_{i}" for i, c in enumerate(own)} | {text: "text"}  # columns of the work itself can't clash
    names = [inner.get(c, c) for c in docs.columns]
    mine = docs.select(*[F.col(f"`{c}`").alias(inner.get(c, c)) for c in docs.columns])
    mine = mine.withColumn("found", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    some = F.size(F.coalesce("found", F.array().cast("array<string>"))) > 0
    hit = mine.filter(some).withColumn("uid", F.xxhash64("doc_id", "text")).withColumn("gaps", F.split("text", ANY, -1))
    mentions = hit.select("doc_id", "uid", F.posexplode("found").alias("pos", "e")).withColumn("kind", kind_of(F.col("e"))).withColumn("canon", canonical(F.col("kind"), F.col("e")))
    mentions = scratch.keep(mentions.distinct())
    entities = mentions.select("kind", "canon")
    host = F.regexp_extract("canon", "@(.*)$", 1)
    domains = surrogate_table(entities.filter("kind = 'email'").select(F.lit("domain").alias("kind"), host.alias("canon")), key, scratch, draw_domain)
    table = surrogate_table(entities.filter("kind <> 'name'"), key, scratch).withColumn("domain", F.when(F.col("kind") == "email", host))
    table = table.join(domains.select(F.col("canon").alias("domain"), F.col("sur").alias("new_domain")), "domain", "left")
    table = table.select("kind", "canon", F.when(F.col("kind") == "email", F.concat(F.regexp_extract("sur", "^([^@]*@)", 1), "new_domain")).otherwise(F.col("sur")).alias("sur"))
    table = table.union(name_table(entities.filter("kind = 'name'").select("canon"), key, scratch))
    swapped = mentions.join(table, ["kind", "canon"]).select("doc_id", "uid", "pos", rendered(F.col("kind"), F.col("e"), F.col("sur")).alias("new"))
    by_doc = swapped.groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("new")).select(F.col("doc_id").alias("id"), F.col("uid").alias("key"), "new")
    pieces = F.zip_with("gaps", F.transform("new", lambda x: x["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    done = hit.join(by_doc, (F.col("uid") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    done = done.select(*[F.array_join(pieces, "").alias(c) if c == "text" else F.col(c) for c in names], F.size("found").alias(count))
    out = mine.filter(~some).select(*names, F.lit(0).alias(count)).unionByName(done)
    return out.select(*[F.col(x).alias(c) for x, c in zip(names, docs.columns, strict=True)], count)


def query(spark, sf_dir):
    return replace_pii(C.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "text")
