"""Text and identifier functions: columns where SQL has them, Arrow UDFs for Unicode forms and edit distances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of six languages that a query drops, unless nothing else is left.
STOP_WORDS = (
    "the a an and or of to in on for with is are was were be by as at from that this it how what which where who why when do does did can i "
    "le la les un une des du de et est que qui dans pour sur der die das ein eine und ist von zu mit auf el los las una y es en por con para como o os"
).split()


def strings(function):
    """A string-to-string function as an Arrow UDF; nulls stay null."""

    def apply(column):
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else function(v))

        run.__annotations__ = {"values": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "string")(column)

    return apply


def _form(name):
    def form(value):
        import unicodedata

        return unicodedata.normalize(name, value)

    return form


def _strip_marks(value):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.category(c).startswith("M"))


def _fold(value):
    import unicodedata

    return unicodedata.normalize("NFKC", value).casefold()


nfkc, nfc = strings(_form("NFKC")), strings(_form("NFC"))
strip_diacritics = strings(_strip_marks)  # I16
nfkc_casefold = strings(_fold)


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def normalize_id(c: Column) -> Column:
    """NFKC, runs of non-word characters and underscores to one underscore, trimmed, lower case."""
    tidy = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w]+|_+", "_"), r"^_+|_+$|(?<=_)_+", ""))
    return tidy(F.when(is_ascii(c), c).otherwise(nfkc(c)))


def normalize_id_ascii(c: Column) -> Column:
    """I02 for identifiers known to be ASCII: no Python on the way."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\W+|_+", "_"), r"^_+|_+$|(?<=_)_+", ""))


def make_id(*parts: Column) -> Column:
    """The identifier of some name parts; empty parts are left out."""
    stripped = [F.nullif(F.regexp_replace(p, r"^[_.]+|[_.]+$", ""), F.lit("")) for p in parts]
    return normalize_id(F.concat_ws("_", *stripped))


def file_stem(path: Column) -> Column:
    """The path without its last extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def file_node_id(path: Column) -> Column:
    """I04."""
    return normalize_id(file_stem(path))


def norm_source_file(path: Column, root: str | None = None) -> Column:
    """Forward slashes, and relative to root if it lies below it."""
    p = F.regexp_replace(path, r"\\", "/")
    if not root:
        return p
    root = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(root)), F.substring(p, len(root) + 1, 1 << 30)).otherwise(p)


def _normpath(value):
    import posixpath

    return posixpath.normpath(value)


posix_normpath = strings(_normpath)  # I06


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension with its dot, in lower case; empty if the name has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def top_level_dir(path: Column) -> Column:
    """What stands before the first slash; the whole path if there is none."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def sanitize_label(c: Column, cap: int = 256) -> Column:
    """Without control characters, at most cap characters."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", ""), 1, cap)


def escape_html(c: Column) -> Column:
    out = c
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def sanitize_metadata_string(c: Column, cap: int = 512) -> Column:
    """I15."""
    return escape_html(sanitize_label(c, cap))


def sanitize_metadata(m: Column, cap: int = 512, items: int = 50) -> Column:
    """At most `items` entries, keys and values capped and escaped."""
    entries = F.slice(F.map_entries(m), 1, items)
    clean = F.transform(entries, lambda e: F.struct(sanitize_metadata_string(e["key"], cap), sanitize_metadata_string(e["value"], cap)))
    return F.map_from_entries(F.array_distinct(clean))


def _yaml(value):
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0", " ": "\\L", " ": "\\P"}
    return "".join(short.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else c) for c in value)


yaml_str = strings(_yaml)  # I24


def word_tokens(c: Column) -> Column:
    """Unicode word runs."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), F.lit(1))


def search_text(c: Column) -> Column:
    """Lower case without diacritics; ASCII text needs no Python, but the plan may hold it."""
    return F.lower(strip_diacritics(c))


def search_tokens(c: Column) -> Column:
    """Z04."""
    return word_tokens(search_text(c))


def cjk_bigrams(word: str) -> list[str]:
    """A word with its CJK runs cut into pairs of neighbours, the word itself first."""
    import re

    out = [word]
    for run in re.findall(r"[㐀-䶿一-鿿]{2,}", word):
        out += [run[i : i + 2] for i in range(len(run) - 1)]
    return list(dict.fromkeys(out))


def query_terms(question: str) -> list[str]:
    """The distinct search words of a question, in order (driver side: a question is one string)."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", question.lower()) if not unicodedata.combining(c))
    words = [w for w in re.findall(r"\w+", plain) if len(w) > 2 or not w.isascii()]
    kept = [w for w in words if w not in STOP_WORDS] or words
    return list(dict.fromkeys(t for w in kept for t in cjk_bigrams(w)))


def shingles(norm: Column, k: int = 3) -> Column:
    """The distinct k-grams of a normalised label without its spaces."""
    compact = F.replace(norm, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(compact) - (k - 1)), lambda i: F.substring(compact, i, F.lit(k)))
    return F.when(F.char_length(compact) < k, F.array(compact)).otherwise(F.array_distinct(grams))


def entity_norm(c: Column) -> Column:
    """The label form of entity resolution: NFKC, case folded, word runs separated by single spaces."""
    return F.trim(F.regexp_replace(nfkc_casefold(c), r"(?U)[\W_]+", " "))


def entity_norm_ascii(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\W_]+", " "))


def entropy(norm: Column) -> Column:
    """Bits per character of a normalised label."""
    chars = F.filter(F.split(norm, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    total = F.aggregate(F.array_sort(parts), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.char_length(norm) > 0, total).otherwise(F.lit(0.0))


def numeric_tokens(c: Column) -> Column:
    return F.array_sort(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda t: F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0"))))


def numeric_tokens_differ(a: Column, b: Column) -> Column:
    """Whether two labels name different numbers."""
    return (a != b) & (numeric_tokens(a) != numeric_tokens(b))


VARIANT = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"


def is_variant_pair(a: Column, b: Column) -> Column:
    """Short labels of one stem with different suffixes."""
    part = lambda c, k: F.regexp_extract(c, VARIANT, k)
    short = F.greatest(F.octet_length(a), F.octet_length(b)) < 12
    return short & (a != b) & a.rlike(VARIANT) & b.rlike(VARIANT) & (part(a, 1) == part(b, 1)) & (part(a, 2) != part(b, 2))


def is_prefix_extension(a: Column, b: Column) -> Column:
    """E18."""
    return (a != b) & (F.startswith(a, b) | F.startswith(b, a))


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised for a common prefix of up to four characters."""
    base, same = jaro(a, b), 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return base + 0.1 * same * (1 - base) if base > 0.7 else base


def damerau(a: str, b: str) -> int:
    """Edits and swaps of neighbours (optimal string alignment)."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        before, last = last, now
    return last[-1]


def pair_scores(function, kind: str):
    """A function of two strings as an Arrow UDF."""

    def apply(a, b):
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else function(p, q) for p, q in zip(x, y, strict=True)])

        run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, kind)(a, b)

    return apply


jaro_score = pair_scores(lambda a, b: jaro(a, b) * 100, "double")  # E13
jaro_winkler_score = pair_scores(lambda a, b: jaro_winkler(a, b) * 100, "double")  # E12
damerau_levenshtein = pair_scores(damerau, "int")  # E16


def short_label_blocked(a: Column, b: Column, jw: Column) -> Column:
    """Short labels merge only if they are one slip apart."""
    short = F.greatest(F.octet_length(a), F.octet_length(b)) < 12
    return short & ~((jw >= 97) & (F.octet_length(a) == F.octet_length(b)) & (damerau_levenshtein(a, b) <= 1))


def token_estimate(text: Column) -> Column:
    """Tokens of a text at four bytes each, one at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("bigint")


def parse_date(c: Column) -> Column:
    """A timestamp from an ISO date, date and time, or date and time with zone."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
