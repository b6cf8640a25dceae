"""Scalar functions over names, titles and labels."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of our own that mark personal data, as part of a name or as a whole token of it.
PII_PARTS = ["email", "phone", "passport", "birth", "surname", "firstname", "lastname", "fullname", "address", "iban", "salary", "correo", "telefono", "apellido", "direccion", "nacimiento", "cedula", "creditcard"]
PII_TOKENS = ["name", "dni", "ssn", "nif", "tax", "mail", "mobile", "zip", "ip", "nombre", "cpf", "gender", "geo"]
def _plain(letter: str) -> str:
    """A small letter's decomposition without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))


_PLANE = [*map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)])]
#: Of the basic plane: signs whose decomposition is one plain sign, with these signs; then marks, which have no counterpart and go.
MARKED = "".join(c for c in _PLANE if c == c.lower() and len(_plain(c)) == 1 and _plain(c) != c)
PLAIN = "".join(_plain(c).lower() for c in MARKED)
MARKED += "".join(c for c in _PLANE if unicodedata.combining(c))
TEAM_WORDS = ["team", "group", "department", "area", "unit", "equipo", "grupo", "departamento", "equipe", "office"]
SENIORITY = [(5, ["chief", "president", r"\bceo\b", r"\bcfo\b", r"\bcto\b"]), (4, ["director", "head"]), (3, ["manager", "lead", "gerente"]), (2, ["senior", "specialist", "coordinator"])]


#: A token ends before a separator, at the end, or where a capital follows a small letter or digit.
TOKEN = r"[^\s_.\-]+?(?=[\s_.\-]|$|(?<=[a-z0-9])(?=[A-Z]))"


def words_of_name(name: Column) -> Column:
    """Lower-case parts of snake, kebab, dotted or camel case."""
    return F.transform(F.regexp_extract_all(name, F.lit(TOKEN), 0), F.lower)


def tokens(name: Column) -> Column:
    """words_of_name without trailing digits."""
    return F.transform(words_of_name(name), lambda t: F.rtrim(t, F.lit("0123456789")))


def pii_name(name: Column, parts: list[str] = PII_PARTS, whole: list[str] = PII_TOKENS) -> Column:
    """Whether a column's name tells of personal data."""
    joined = F.regexp_replace(F.lower(name), r"[\s_\-.]+", "")
    return joined.rlike("|".join(parts)) | F.arrays_overlap(tokens(name), F.array(*map(F.lit, whole)))


def pii_type(name: Column) -> Column:
    """A kind of personal data by hints in the name; other when none fits."""
    low = F.lower(name)
    kinds = [("email", "mail|correo"), ("phone", "phone|mobile|telefono"), ("identity", "passport|dni|ssn|cedula|document"), ("birth", "birth|nacimiento"), ("address", "address|direccion|zip"), ("name", "name|nombre|surname|apellido")]
    return reduce(lambda c, k: c.when(low.rlike(k[1]), k[0]), kinds[1:], F.when(low.rlike(kinds[0][1]), kinds[0][0])).otherwise("other")


def folded(c: Column) -> Column:
    """Lower case, without marks, trimmed; signs that decompose into several stay."""
    return F.trim(F.translate(F.lower(c), MARKED, PLAIN))


def seniority(title: Column) -> Column:
    """5 to 1 by the title's words, the highest level first."""
    low = folded(title)
    out = F.when(low.rlike("|".join(SENIORITY[0][1])), SENIORITY[0][0])
    for level, hints in SENIORITY[1:]:
        out = out.when(low.rlike("|".join(hints)), level)
    return out.otherwise(1)


def named_person(c: Column) -> Column:
    """Not blank, and not a team's name."""
    return F.coalesce((F.trim(c) != "") & ~F.lower(F.trim(c)).rlike("^(" + "|".join(TEAM_WORDS) + ")"), F.lit(False))


def localized(texts: Column, lang: str, default: str = "es") -> Column:
    return F.coalesce(F.element_at(texts, lang), F.element_at(texts, default))


def expand_abbreviations(name: Column, table: dict[str, str]) -> tuple[Column, Column]:
    """(words with known abbreviations written out, whether any was)."""
    entries = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    parts = words_of_name(name)
    words = F.transform(parts, lambda t: F.coalesce(F.element_at(entries, t), t))
    return F.array_join(words, " "), F.exists(parts, lambda t: F.map_contains_key(entries, t))


def same(a: Column, b: Column) -> Column:
    """Equal as trimmed lower-case text."""
    return F.lower(F.trim(a.cast("string"))) == F.lower(F.trim(b.cast("string")))


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """1 - edit distance over the longer length, of trimmed lower-case text; null or blank: 0. Values below `least` may come as 0: the distance is measured no further than they need."""
    x, y = (F.lower(F.trim(c.cast("string"))) for c in (a, b))
    longer = F.greatest(F.length(x), F.length(y))
    if least <= 0:
        return F.when((x != "") & (y != ""), 1 - F.levenshtein(x, y) / longer).otherwise(0.0)
    distance = F.call_function("levenshtein", x, y, F.floor((1 - least) * longer).cast("int") + 1)  # one more than can count; -1 beyond it
    return F.when((x != "") & (y != "") & (distance >= 0), 1 - distance / longer).otherwise(0.0)


def formula_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


#: Libraries of the query language itself: their calls name no source.
M_LIBRARIES = ["binary", "combiner", "comparer", "date", "datetime", "datetimezone", "duration", "error", "expression", "function", "lines", "list", "logical", "number", "record", "replacer", "splitter", "table", "text", "time", "type", "uri", "value"]


def source_label(query: Column) -> Column:
    """server/db of a database call, else native query, else the connector's name, else null.

    The query is read as calls, Family.Function( with the quoted arguments that follow at
    once; the first call of a family that is no library of the language names the connector.
    """
    call = r'([A-Za-z]+)\.([A-Za-z]+)\s*\(((?:\s*"[^"]*"\s*,?)*)'
    calls = F.transform(F.regexp_extract_all(query, F.lit(call), 0), lambda c: F.struct(
        F.regexp_extract(c, call, 1).alias("family"), F.lower(F.regexp_extract(c, call, 2)).alias("function"), F.regexp_extract_all(F.regexp_extract(c, call, 3), F.lit('"([^"]+)"'), 1).alias("args")))
    low = lambda c: F.lower(c["family"])
    first = lambda found: F.get(found, F.lit(0))
    base = first(F.filter(calls, lambda c: (low(c) == "sql") & c["function"].startswith("database") & (F.size(c["args"]) > 0)))
    native = F.exists(calls, lambda c: (low(c) == "value") & (c["function"] == "nativequery"))
    connector = first(F.filter(calls, lambda c: ~low(c).isin(*M_LIBRARIES)))["family"]
    return F.when(base.isNotNull(), F.array_join(F.slice(base["args"], 1, 2), "/")).when(native, "native query").otherwise(connector)


def masked_email(c: Column) -> Column:
    """The first letter and the domain of an address; of anything else nothing. Null stays null."""
    text = c.cast("string")
    masked = F.when(text.rlike(r"^[^@\s]+@[^@\s]+$"), F.regexp_replace(text, r"^(.)[^@]*(@.*)$", "$1***$2")).otherwise("***")
    return F.when(c.isNotNull(), masked)


def brief(c: Column, most: int) -> Column:
    return F.substring(c.cast("string"), 1, most)


def or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("—"))


def filled(template: Column, n: Column, column: Column) -> Column:
    """A text with {n} (with thousands separators) and {col} put in."""
    return F.replace(F.replace(template, F.lit("{n}"), F.format_number(n, 0)), F.lit("{col}"), column)


def qualified_table(host: Column, database: Column, schema: Column, table: Column) -> Column:
    """mssql://host/db/schema/table for hosts of the cloud's SQL service (schema dbo unless given); null for others."""
    return F.when(F.lower(host).endswith(".database.windows.net"), F.concat(F.lit("mssql://"), host, F.lit("/"), database, F.lit("/"), F.coalesce(F.nullif(schema, F.lit("")), F.lit("dbo")), F.lit("/"), table))
