"""Personal data replaced by surrogates, with DataFrame and SQL functions only.

Detected: secrets after a key word, e-mail addresses, cloud access keys, account and card numbers,
telephone and social-security numbers, IPv4 addresses, and names after a title. Each different
entity gets one surrogate from a keyed hash, so all its places agree; it keeps the type, length,
separators, case and digits of the original, IPv4 parts stay valid, card numbers keep their check
sum, names keep the gender of the title and the script. Surrogates that two entities share, or that
equal an entity found in the text, are drawn anew until all are distinct.

Null and empty texts stay as they are. Rows that repeat a doc_id are treated each; other columns are
kept. Texts without entities are returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.sources.files import stored

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Patterns of entities, in order of precedence.
PATTERNS = {
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?[^\s\"',;]{6,}",
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "name": r"(?:Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sr|Sra|г-н|г-жа)\.? \p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What stands before the part that is replaced.
LEADS = {"secret": r"^(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?", "access": r"^(?:AKIA|ASIA)", "iban": r"^[A-Z]{2}",
         "name": r"^\S+ ", "card": r"^\d", "phone": r"^(?:\+\d{1,3}[ .-]?)?"}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|г-жа)"
#: Given names by script and gender, and syllables of family names by script.
GIVEN = {("latin", "f"): "Anna Clara Elena Irene Julia Laura Maria Nora Paula Rosa Sonia Vera".split(),
         ("latin", "m"): "Adrian Bruno Daniel Emil Felix Hugo Jonas Leon Martin Oscar Tomas Victor".split(),
         ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Софья".split(),
         ("cyrillic", "m"): "Антон Борис Виктор Иван Максим Олег Павел Сергей".split()}
SYLLABLES = {"latin": "ba be da do fe ga ka la le ma mi na no pe ra ro sa ta to va".split(),
             "cyrillic": "ба бе да до ка ла ле ма ми на но пе ра ро са та".split()}

#: After so many attempts the shape has no room left, and the surrogate grows.
ROOMY = 12


def kind_of(value: Column) -> Column:
    """The first pattern that an entity matches as a whole."""
    found = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        found = F.when(value.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(found)
    return found


def _byte(digest: Column, i: Column) -> Column:
    """A number from 0 to 65535 at a place of a hexadecimal digest, which is read around."""
    return F.conv(F.substring(digest, (i % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(items: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), number % len(items) + 1)


def _same_shape(value: Column, digest: Column, hexadecimal: Column) -> Column:
    """Digits, letters and their case as in the value; letters of hexadecimal numbers stay such."""
    def one(c, i):
        n = _byte(digest, i)
        letters = F.when(hexadecimal, 6).otherwise(26)
        return (F.when(c.rlike(r"^[0-9]$"), F.char(48 + n % 10)).when(c.rlike(r"^[a-z]$"), F.char(97 + n % letters))
                .when(c.rlike(r"^[A-Z]$"), F.char(65 + n % letters)).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _sum_of_digits(value: Column) -> Column:
    """Luhn sum of a number's digits modulo 10."""
    digits = F.reverse(F.split(F.regexp_replace(value, r"\D", ""), ""))
    def one(c, i):
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(digits, one), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """What an entity is replaced by, at one attempt."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 512)
    lead = F.lit("")
    for name, pattern in LEADS.items():
        lead = F.when(kind == name, F.regexp_extract(value, pattern, 0)).otherwise(lead)
    rest = F.substring(value, F.length(lead) + 1, F.length(value))
    shaped = F.concat(lead, _same_shape(rest, digest, rest.rlike(r"^[0-9a-fA-F]+$")))
    # an address keeps its last part, the top domain
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    email = F.concat(_same_shape(F.substring(value, F.lit(1), F.length(value) - F.length(top)), digest, F.lit(False)), top)
    def octet(part, i):
        n = _byte(digest, i)
        return F.when(F.length(part) == 1, n % 9 + 1).when(F.length(part) == 2, n % 90 + 10).otherwise(n % 156 + 100).cast("string")
    ip = F.array_join(F.transform(F.split(value, r"\."), octet), ".")
    # the last digit gives the check sum that the original has
    body = F.substring(shaped, F.lit(1), F.length(shaped) - 1)
    card = F.concat(body, ((_sum_of_digits(value) - _sum_of_digits(F.concat(body, F.lit("0"))) + 10) % 10).cast("string"))
    female, names = value.rlike(FEMALE), F.lit(None).cast("string")
    for script in SYLLABLES:
        def words(gender, script=script):
            syllables = SYLLABLES[script]
            family = F.initcap(F.concat(*(_pick(syllables, _byte(digest, F.lit(i))) for i in range(1, 6))))
            return F.when(rest.rlike(r"[ -]"), F.concat(_pick(GIVEN[script, gender], _byte(digest, F.lit(0))), F.regexp_extract(rest, "[ -]", 0), family)).otherwise(family)
        named = F.concat(lead, F.when(female, words("f")).otherwise(words("m")))
        names = F.when(rest.rlike(r"\p{IsCyrillic}") == F.lit(script == "cyrillic"), named).otherwise(names)
    made = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "name", names).otherwise(shaped)
    return F.concat(made, F.substring(digest, F.lit(1), F.greatest(attempt - ROOMY, F.lit(0))))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``value`` and a distinct ``surrogate`` for every entity."""
    done = stored(entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0))
                  .withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.lit(0), key)))
    originals = done.select(F.col("value").alias("surrogate")).distinct()
    while True:
        shared = done.groupBy("surrogate").agg(F.count("*").alias("n"), F.min("value").alias("first")).where("n > 1")
        clash = (done.join(shared, "surrogate").where("value <> first").select("kind", "value")
                 .union(done.join(originals, "surrogate", "left_semi").select("kind", "value")).distinct())
        clash = stored(clash)
        if clash.isEmpty():
            return done.select("kind", "value", "surrogate")
        again = done.join(clash, ["kind", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        again = again.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        done = stored(done.join(clash, ["kind", "value"], "left_anti").union(again))


def replace(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_entities``, how many there were."""
    spare = [c for c in ("_doc", "_row", "_all", "n_entities") if c in docs.columns]
    docs = docs.drop(*spare)
    docs = docs.withColumn("_doc", F.xxhash64("doc_id", "text")).withColumn("_row", F.xxhash64(F.lit(1), "text", "doc_id"))
    found = stored(docs.where("text is not null").select("_doc", "_row", F.expr("regexp_extract_all(text, r'" + ANY.replace("'", "\\x27") + "', 0)").alias("found"))
                   .where(F.size("found") > 0).dropDuplicates(["_doc", "_row"]).select("_doc", "_row", F.posexplode("found").alias("place", "value"))
                   .withColumn("kind", F.coalesce(kind_of(F.col("value")), F.lit("other"))))
    known = assign(found, key)
    each = (found.join(known, ["kind", "value"]).groupBy("_doc", "_row")
            .agg(F.sort_array(F.collect_list(F.struct("place", "surrogate"))).alias("_all"))
            .select("_doc", "_row", F.transform("_all", lambda x: x["surrogate"]).alias("_all")))
    pieces = F.split("text", ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat(F.col("_all"), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    whole = docs.join(each, ["_doc", "_row"], "left")
    return whole.select(*(F.when(F.col("_all").isNotNull(), joined).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")
                          for c in docs.columns if c not in ("_doc", "_row")), F.coalesce(F.size("_all"), F.lit(0)).alias("n_entities")).withColumn(
        "n_entities", F.greatest("n_entities", F.lit(0)))
