"""Text scalars as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licence families by what their text says, first match wins.
LICENCES = [("apache", "Apache-2.0"), ("mit license", "MIT"), ("gnu lesser", "LGPL"), ("gnu general", "GPL"), ("bsd", "BSD"), ("mozilla", "MPL-2.0")]
# Words without content.
STOP = "about after also been from have into more only other over such than that their then there these they this were what when which will with would your".split()


def identifier_phrase(name: Column) -> Column:
    """camelCase, ACRONYMWord and snake_case as lower-case words with single spaces."""
    s = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(s, r"[_\s.:-]+", " ")))


def stem(word: Column) -> Column:
    """One suffix off, six characters kept."""
    return F.substring(F.regexp_replace(F.lower(word), "(ation|ing|ed|es|ly|s)$", ""), 1, 6)


def content_words(text: Column) -> Column:
    """Distinct words of four letters or more that carry content, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))), F.array(*map(F.lit, STOP))))


def route(path: Column) -> Column:
    """Variable segments of a route become `*`."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r":[A-Za-z_]+|\{[^}]*\}|<[^>]*>", "*"), "/[0-9]+", "/*"))


def licence(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for words, name in reversed(LICENCES):
        out = F.when(F.contains(low, F.lit(words)), name).otherwise(out)
    return out


def holder(line: Column) -> Column:
    """Who a copyright notice names, without years and signs."""
    s = F.regexp_extract(line, r"(?i)copyright\s+(?:\(c\)\s*)?(?:[0-9][0-9, -]*)?(.*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(s, r"(?i)all rights reserved.*$|[.,;]+$", "")), F.lit(""))


def holder_key(name: Column) -> Column:
    """Spellings of one holder meet: case, punctuation and company forms do not count."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", ""), r"\b(inc|ltd|llc|gmbh|corp|co)\b", ""))


def string_kind(value: Column) -> Column:
    """What a literal looks like: sql, path, url, identifier or text."""
    return (
        F.when(value.rlike(r"(?i)^\s*(select\s.+\sfrom|insert\s+into|update\s.+\sset|delete\s+from)\s"), "sql")
        .when(value.rlike("^[a-z]+://"), "url")
        .when(value.rlike(r"^(/|\./|[A-Za-z]:\\)?[\w.-]+(/[\w.-]+)+$"), "path")
        .when(value.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "identifier")
        .otherwise("text")
    )


def entropy(value: Column) -> Column:
    """Shannon entropy a character, in bits."""
    share = F.transform(F.array_distinct(F.split(value, "")), lambda c: (F.length(value) - F.length(F.replace(value, c))) / F.length(value))
    return -F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.log2(p))


def looks_random(value: Column) -> Column:
    """Long, mixed and of high entropy: the shape of a key."""
    return (F.length(value) >= 20) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (entropy(value) >= 3.0)


# Paths under which networks serve libraries, name then version, first match wins.
LIBRARY_PATHS = [
    r"^/npm/((?:@[^/@]+/)?[^/@]+)(?:@v?([^/]+))?",
    r"^/gh/[^/]+/([^/@]+)(?:@v?([^/]+))?",
    r"^/ajax/libs/([^/]+)/([^/]+)/",
    r"^/((?:@[^/@]+/)?[^/@]+)@v?([^/]+)",
]
# Endings of a library's file name that are neither name nor version.
LIBRARY_ENDS = [r"(?i)\.(?:m?js|cjs|css|wasm)$", r"(?i)\.(?:min|bundle|umd|esm|iife|global|prod|production|development|dev|slim)(?=\.|$)"]
LIBRARY_VERSION = r"^(.*?)[-_.@](?:v([0-9]+(?:\.[0-9]+)*)|([0-9]+(?:\.[0-9]+)+)(?:[-+][\w.]+)?)$"


def library(url: Column) -> Column:
    """(host, name, version) of a library that is loaded from a URL: by the network's path, else by the file's name. Null if the URL has no host."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    host, path = F.try_parse_url(full, F.lit("HOST")), F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit(""))
    base = F.element_at(F.split(path, "/"), -1)
    for p in LIBRARY_ENDS:
        base = F.regexp_replace(base, p, "")
    some = lambda c: F.nullif(c, F.lit(""))
    whole = base.rlike(LIBRARY_VERSION)
    name = F.regexp_replace(F.when(whole, F.regexp_extract(base, LIBRARY_VERSION, 1)).otherwise(base), "[-_.]+$", "")
    name = F.coalesce(some(name), F.element_at(F.split(path, "/"), -1))
    version = F.coalesce(some(F.regexp_extract(base, LIBRARY_VERSION, 2)), some(F.regexp_extract(base, LIBRARY_VERSION, 3)))
    for p in reversed(LIBRARY_PATHS):
        served = path.rlike(p)
        name = F.when(served, F.regexp_extract(path, p, 1)).otherwise(name)
        version = F.when(served, some(F.regexp_extract(path, p, 2))).otherwise(version)
    return F.when(host.isNotNull(), F.struct(F.lower(host).alias("host"), name.alias("name"), version.alias("version")))


def relevance(token: Column, words: list[str]) -> Column:
    """How near a token is to the nearest word: 1 equal, 0.8 one within the other (three letters or more), 0.6 the first four letters shared, else 0."""
    long_ = F.length(token) >= 3
    found = [
        F.when(token == w, 1.0)
        .when(long_ & F.lit(len(w) >= 3) & (F.contains(token, F.lit(w)) | F.contains(F.lit(w), token)), 0.8)
        .when((F.length(token) >= 4) & F.lit(len(w) >= 4) & (F.substring(token, 1, 4) == w[:4]), 0.6)
        .otherwise(0.0)
        for w in words
    ]
    return F.greatest(F.lit(0.0), F.lit(0.0), *found)


# A notice of copyright and whom it names.
NOTICE = r"(?i)copyright\s*(?:[(]c[)]|[©])?\s*(?:[0-9]{4}(?:\s*[-,]\s*[0-9]{4})?)?\s*(?:by\s+)?([^\n\r*#/]{3,60})"


def header_holder(content: Column) -> Column:
    """Who the first notice in a file's first 25 lines names; null if none does."""
    head = F.array_join(F.slice(F.split(content, "\n"), 1, 25), "\n")
    name = F.trim(F.regexp_replace(F.regexp_extract(head, NOTICE, 1), r"\s+", " "))
    name = F.regexp_replace(name, r"(?i)(?:\s+all rights reserved.*|[\s.,]+(?:and|&|et al)\.?)$", "")
    name = F.trim(F.regexp_replace(name, r"[.,;:]+$", ""))
    return F.when(~name.rlike("^[0-9]*$"), name)
