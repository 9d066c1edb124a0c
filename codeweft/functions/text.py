"""Scalar text functions as column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming removes: blanks, tabs, line ends, NUL and vertical tabs.
BLANKS = " \t\r\n\x00\x0b"
KEY_BYTES, KEY_PREFIX_BYTES, MOST_TERMS = 250, 190, 12


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def utf8_cut(text: Column, most: int) -> Column:
    """The longest prefix of whole characters that takes ``most`` bytes at most."""
    raw = F.encode(text, "UTF-8")
    # a cut is clean if the byte after it doesn't continue a character; of four neighbouring cuts one always is
    continues = lambda n: F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")
    cut = F.coalesce(*(F.when(~continues(most - k), F.lit(most - k)) for k in range(min(4, most + 1))), F.lit(0))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def normalized_key(key: Column) -> Column:
    """Without line ends; keys beyond KEY_BYTES are cut and get 16 digits of their hash."""
    flat = F.translate(key, "\r\n", "")
    short = F.concat(utf8_cut(flat, KEY_PREFIX_BYTES), F.lit("#"), F.substring(F.sha2(flat, 256), 1, 16))
    return F.when(F.octet_length(flat) <= KEY_BYTES, flat).otherwise(short)


def unified_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative_path(path: Column, base: str) -> Column:
    """A path below ``base``, in either case, without that prefix; other paths as they are, with slashes unified."""
    p, root = unified_path(path), base.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.lower(F.substring(p, 1, len(root))) == root.lower(), F.substring(p, len(root) + 1, 1 << 30)).otherwise(p)


def path_hash(path: Column) -> Column:
    return F.sha2(unified_path(path), 256)


def line_range_hash(text: Column, first: int, last: int) -> Column:
    """Hash of lines ``first`` to ``last`` (from 1), whatever ends them, joined by line feeds."""
    return F.sha2(F.array_join(F.slice(F.split(text, "\r\n|\n|\r"), first, last - first + 1), "\n"), 256)


def view_name(path: Column) -> Column:
    """Dotted name of a template below resources/views, without ``components.`` for components; null for other paths."""
    inner = F.regexp_extract(unified_path(path), r"(?:^|/)resources/views/(.+)\.blade\.php$", 1)
    return F.when(inner != "", F.regexp_replace(F.translate(inner, "/", "."), r"^components\.", ""))


def cache_key(path: Column, content_hash: Column, fingerprint: str) -> Column:
    return F.sha2(F.concat_ws("|", path, content_hash, F.lit(fingerprint)), 256)


def token_estimate(text: Column, bytes_a_token: int = 4) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / bytes_a_token).cast("int")


def terms(query: Column) -> Column:
    """Words of a query: camel case parted, lower case, the first MOST_TERMS, then each once in order."""
    parted = F.lower(F.regexp_replace(query, "([a-z0-9])([A-Z])", "$1 $2"))
    words = F.filter(F.split(parted, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.slice(words, 1, MOST_TERMS))


def relevance(query: Column, fields: list[Column]) -> Column:
    """60 times the share of the query's terms among the first terms of the fields, and 80 more if a field equals the query."""
    asked, held = terms(query), terms(F.concat_ws(" ", *fields))
    share = F.round(60 * F.size(F.array_intersect(asked, held)) / F.size(asked)).cast("int")
    same = F.exists(F.array(*fields), lambda f: F.lower(trimmed(f)) == F.lower(trimmed(query)))
    return F.when(F.size(asked) == 0, 0).otherwise(share + F.when(same, 80).otherwise(0))


def single_blanks(text: Column) -> Column:
    return F.regexp_replace(trimmed(text), r"(?U)\s+", " ")


def text_fingerprint(text: Column) -> Column:
    return F.sha2(single_blanks(text), 256)


def class_key(key: Column) -> Column:
    """Keys that name a role of a class become ``class:`` keys."""
    return F.regexp_replace(key, "^(?:interface|trait|enum|event|job|listener|policy):", "class:")


def slug(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))


def content_fingerprint(kind: Column, title: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", kind, title, body), 256)


def safe_relative_path(path: Column) -> Column:
    """Whether a path stays below its base: not absolute, no drive, no NUL, no parent step."""
    p = unified_path(path)
    return ~(p.startswith("/") | p.rlike("^[A-Za-z]:") | F.contains(p, F.lit("\x00")) | F.array_contains(F.split(p, "/"), "..") | (p == ""))


def under(path: Column, root: Column) -> Column:
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def compacted(values: Column, most: int = 5) -> Column:
    return F.struct(F.size(values).alias("count"), F.slice(values, 1, most).alias("sample"))


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def plural(word: Column) -> Column:
    """English plurals by their common rules."""
    return (
        F.when(word.rlike("(?i)(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .when(word.rlike("(?i)[^aeiou]y$"), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def singular(word: Column) -> Column:
    return (
        F.when(word.rlike("(?i)ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?i)(s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("(?i)[^s]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def snake(word: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(word, r"\s+", "_"), "([a-z0-9])([A-Z])", "$1_$2"))


def studly(word: Column) -> Column:
    return F.array_join(F.transform(F.split(word, r"[\s_-]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def canonical_json(values: Column) -> Column:
    """A map of strings as JSON with its keys in order: equal maps give equal texts, whatever order they were built in."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def canonical_text(json: Column) -> Column:
    """JSON with the keys of its objects in order at every depth, blanks gone and numbers in their shortest form; arrays stay in order. Null for what
    isn't JSON, or names a key twice. A VARIANT keeps the fields of an object by name, so that nothing has to be sorted here."""
    return F.to_json(F.try_parse_json(json))


def overlaid(under_: Column, over: Column) -> Column:
    """Two maps in one; where both have a key, ``over`` counts."""
    rest = F.map_filter(under_, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(rest, over)


def module_paths(paths: Column, root: Column) -> Column:
    """Where a module lies: its paths with slashes unified and none at the end, each once, empty ones aside; its root where it names no path."""
    named = F.when(F.size(F.coalesce(paths, F.array().cast("array<string>"))) > 0, paths).otherwise(F.array_compact(F.array(root)))
    plain = F.transform(named, lambda p: F.rtrim(unified_path(F.coalesce(p, F.lit(""))), F.lit("/")))
    return F.array_distinct(F.filter(plain, lambda p: p != ""))
