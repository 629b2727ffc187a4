r"""Secret scans [native]: base patterns plus sliding-window entropy, in SQL functions only.

A regular expression's matches are located without a position function: split() gives the text
between the matches and regexp_extract_all() the matches, both left to right and without overlap,
so a match starts where the lengths before it end. Positions are code points.

The entropy method looks at candidate strings of one alphabet (20 or more characters, at least one
digit). Over each window of `WINDOW` characters it keeps the sum of c * log2(c) of the counts c; a step
takes one character out and one in, which changes the sum by two differences. A window belongs to the
smallest of CLASSES that holds all its characters, and its entropy must reach that class's threshold,
the MISSED quantile of a random window's entropy. A candidate is one finding if any window does.
Placeholders split a candidate: what lies between them is judged alone. Parts without a digit or letter,
UUIDs and names with a short number are allowed.

Defined results: a null text counts as empty and has no span; repeated rows are answered each;
an empty table gives an empty result; columns other than doc_id and text are not looked at.
Ties in a span list are ordered by kind as listed in KINDS, then by end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize, spare, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<start:int,end:int>>"

WINDOW = 20
BLOCK = 256  # spans of a text that are placed together
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MISSED = 0.01  # share of random windows below their class's threshold
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _LOWER + _DIGITS, _UPPER + _DIGITS, _UPPER + _LOWER + _DIGITS)
PLACEHOLDER = r"(?i)example|0123456789|abcdefghij|(.)\1{7,}"
ALLOWED = (
    r"^[A-Za-z+/_-]+$",  # no digit: words, paths and identifiers
    r"^[0-9_/+-]+$",  # no letter: numbers, dates and rules
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",  # UUID
    r"^[A-Za-z]++(?:[/_-][A-Za-z]++)*+[/_-]?[0-9]{1,4}$",  # a name with a short number; possessive, so that no length recurses
)


def threshold(symbols: int, missed: float = MISSED) -> float:
    """The entropy, in bits, that a random window over symbols reaches with probability 1 - missed at least; exact, over all partitions."""

    def partitions(n: int, most: int):
        if n == 0:
            yield ()
        for c in range(min(n, most), 0, -1):
            for rest in partitions(n - c, c):
                yield (c, *rest)

    found = []
    for counts in partitions(WINDOW, WINDOW):
        if len(counts) <= symbols:
            ways = math.perm(symbols, len(counts)) * math.factorial(WINDOW)
            for c in set(counts):
                ways //= math.factorial(counts.count(c))
            for c in counts:
                ways //= math.factorial(c)
            found.append((-sum(c / WINDOW * math.log2(c / WINDOW) for c in counts), ways))
    below = 0
    for entropy, ways in sorted(found):
        below += ways
        if below > missed * symbols**WINDOW:
            return entropy - 1e-9
    return 0.0


BITS = tuple(threshold(len(c)) for c in CLASSES)
BASE64_BITS = threshold(64)


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once; an expression named in a lambda is evaluated at every call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(candidate: Column, field: str) -> Column:
    """Over all windows of candidate, the greatest entropy (best) or the greatest excess over the window's threshold (over)."""
    grows = F.array(*[F.lit(g) for g in [0.0, *[(c + 1) * math.log2(c + 1) - c * math.log2(c) for c in range(1, WINDOW + 1)]]])
    member = F.array(*[F.array(*[F.lit(x in c) for c in CLASSES]) for x in ALPHABET])
    start = F.struct(F.array_repeat(F.lit(0), len(CLASSES)).alias("runs"), F.lit(0.0).alias("total"), F.lit(-9.0).alias("best"), F.lit(-9.0).alias("over"))

    def step(state: Column, at: Column, ids: Column) -> Column:
        came, left = F.element_at(ids, at), F.element_at(ids, F.greatest(at - WINDOW, F.lit(1)))
        first = F.greatest(at - WINDOW, F.lit(0)) + 1
        stayed = F.slice(ids, first, at - first)
        rise = F.element_at(grows, F.size(F.filter(stayed, lambda x: x == came)) + 1)
        fall = F.when(at > WINDOW, F.element_at(grows, F.size(F.filter(F.slice(ids, first, at - first), lambda x: x == left)) + 1)).otherwise(F.lit(0.0))
        runs = F.zip_with(state["runs"], F.element_at(member, came), lambda n, inside: F.when(inside, n + 1).otherwise(F.lit(0)))
        return _let(F.struct(runs.alias("runs"), (state["total"] + rise - fall).alias("total")), lambda now: judged(state, at, now))

    def judged(state: Column, at: Column, now: Column) -> Column:
        entropy = F.lit(math.log2(WINDOW)) - now["total"] / F.lit(float(WINDOW))
        needed = F.lit(BASE64_BITS)
        for i in reversed(range(len(CLASSES))):
            needed = F.when(F.get(now["runs"], F.lit(i)) >= WINDOW, F.lit(BITS[i])).otherwise(needed)
        full = at >= WINDOW
        return F.struct(
            now["runs"].alias("runs"),
            now["total"].alias("total"),
            F.when(full, F.greatest(state["best"], entropy)).otherwise(state["best"]).alias("best"),
            F.when(full, F.greatest(state["over"], entropy - needed)).otherwise(state["over"]).alias("over"),
        )

    chars = F.filter(F.split(candidate, ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    return _let(ids, lambda ids: F.aggregate(F.sequence(F.lit(1), F.size(ids)), start, lambda state, at: step(state, at, ids), lambda state: state[field]))


def window_entropy(candidate: Column) -> Column:
    """The largest Shannon entropy, in bits, of any WINDOW characters of candidate that follow each other."""
    return _scan(candidate, "best")


def suspicious(candidate: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Whether a window between a candidate's placeholders reaches its class's threshold in a part that no allow-list pattern matches."""

    def permitted(text: Column) -> Column:
        out = F.lit(False)
        for pattern in allowed:
            out = out | text.rlike(pattern)
        return out

    flagged = lambda p: F.when((F.char_length(p) < WINDOW) | permitted(p), F.lit(False)).otherwise(_scan(p, "over") >= 0)
    return F.when(permitted(candidate), F.lit(False)).otherwise(F.exists(F.split(candidate, PLACEHOLDER, -1), flagged))


def _pieces(text: Column, pattern: str, keep) -> Column:
    """Per match: the characters before it since the last one, its length, and whether it is kept."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("hit"), keep(found).alias("kept"))
    return F.when(text.rlike(pattern), F.transform(pairs, lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("len"), p["kept"].alias("kept"))))


def _kept(text: Column):
    """For each kind its pattern and the function from all matches to whether each is a finding."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    yes = lambda found: F.transform(found, lambda m: F.lit(True))
    return {
        "assign": (ASSIGN, lambda found: F.transform(values, lambda v: F.char_length(v) >= 8)),
        "access": (ACCESS, yes),
        "hex": (HEX, yes),
        "entropy": (CANDIDATE, lambda found: F.transform(found, lambda m: suspicious(m))),
    }


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = materialize(
        docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", *[_pieces(text, p, keep).alias(kind) for kind, (p, keep) in _kept(text).items()]),
        "secret-pieces",
    )
    listed = None
    for rank, kind in enumerate(KINDS):
        one = scanned.where(F.col(kind).isNotNull()).select("row_no", F.lit(rank).alias("rank"), F.posexplode(kind).alias("no", "m"))
        listed = one if listed is None else listed.unionByName(one)
    so_far = Window.partitionBy("row_no", "rank").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = listed.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(so_far)).where("m.kept")
    located = located.select("row_no", (F.col("end") - F.col("m.len")).alias("start"), "rank", "end")
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")
    grouped = located.groupBy("row_no").agg(
        *[F.count(F.when(F.col("rank") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("all_spans"),
    )
    answers = grouped.select(
        "row_no", *[f"n_{k}" for k in KINDS], written(F.filter("all_spans", lambda s: s["rank"] < 3)).alias("base"), written(F.col("all_spans")).alias("spans")
    )
    return scanned.select("row_no", "doc_id").join(answers, "row_no", "left").select(
        "doc_id",
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(F.col("base"), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(F.col("spans"), F.lit("")).alias("spans"),
    )


def _running(items: Column, advance, emit) -> Column:
    """emit(at, item) for every item, where at starts at 0 and becomes advance(at, item); items are taken BLOCK at a time, as every append copies its list."""
    none = F.array().cast(SPANS)

    def inner(block: Column, at: Column) -> Column:
        step = lambda s, m: F.struct(advance(s["at"], m).alias("at"), F.concat(s["out"], F.array(emit(s["at"], m))).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step)

    blocks = F.transform(F.sequence(F.lit(0), F.size(items), F.lit(BLOCK)), lambda i: F.slice(items, i + 1, BLOCK))
    outer = lambda s, b: _let(inner(b, s["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], r["out"]).alias("out")))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), outer, lambda s: s["out"])


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding in text replaced by mark; of an assignment, only the value is. Null stays null.

    All spans are those of the text as it came; spans that overlap or touch are cut as one.
    """
    text, named = F.col("text"), [spare(docs, f"__cuts_{kind}") for kind in KINDS]
    located = docs.withColumns({name: _cuts(text, kind, *_kept(text)[kind]) for name, kind in zip(named, KINDS, strict=True)})
    found = F.sort_array(F.concat(*[F.coalesce(F.col(name), F.array().cast(SPANS)) for name in named]))
    # Each span from where those before it end: spans of one cut touch, and a span inside another is empty.
    clear = lambda cuts: _running(cuts, lambda at, c: F.greatest(at, c["end"]), lambda at, c: _span(F.greatest(at, c["start"]), F.greatest(at, c["end"])))

    def shown(cuts: Column) -> Column:
        size = F.size(cuts)

        def block(i: Column) -> Column:
            came = F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"])
            part = F.substr(text, came + 1, F.get(cuts, F.least(i + BLOCK, size) - 1)["end"] - came)
            return _let(F.struct(part.alias("text"), came.alias("came"), F.slice(cuts, i + 1, BLOCK).alias("cuts")), lambda b: F.array_join(F.transform(b["cuts"], lambda c, j: piece(b, c, i, j)), ""))

        def piece(b: Column, c: Column, i: Column, j: Column) -> Column:
            before = F.when(j == 0, b["came"]).otherwise(F.get(b["cuts"], j - 1)["end"])
            begins = (c["start"] > before) | ((i + j == 0) & (c["start"] == 0))
            return F.when(begins, F.concat(F.substr(b["text"], before - b["came"] + 1, c["start"] - before), F.lit(mark))).otherwise(F.lit(""))

        pieces = F.transform(F.sequence(F.lit(0), size - 1, F.lit(BLOCK)), block)
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(cuts, -1)["end"] + 1))

    hidden = _let(found, lambda spans: F.when(F.size(spans) == 0, text).otherwise(_let(clear(spans), shown)))
    # Columns used twice keep their own projection, whose regular expressions run in generated code.
    return located.withColumn("text", F.when(F.coalesce(*named).isNull(), text).otherwise(hidden)).drop(*named)


def _cuts(text: Column, kind: str, pattern: str, keep) -> Column:
    """(start, end) of what is to be hidden of a kind's findings; an assignment's value ends with the match."""
    pieces = _pieces(text, pattern, keep)
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        pieces = F.zip_with(pieces, values, lambda m, v: m.withField("hide", F.char_length(v)))
    after = lambda at, m: at + m["gap"] + m["len"]
    hide = lambda m: m["hide" if kind == "assign" else "len"]
    # What is not kept becomes an empty span at its end, which is dropped.
    spans = lambda found: _running(found, after, lambda at, m: _span(after(at, m) - F.when(m["kept"], hide(m)).otherwise(0), after(at, m)))
    return F.when(text.rlike(pattern), F.filter(_let(pieces, spans), lambda c: c["end"] > c["start"]))


def op10_secrets(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))
