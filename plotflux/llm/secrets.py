"""Secret scans: fixed patterns plus sliding-window entropy (DataFrame operations only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns, in the order of the kinds. Where a match that is too short can hide no
# other one, the length is part of the pattern.
ASSIGN = (
    r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Character classes of the entropy scan: candidate runs, their characters, and the bits a window must reach.
CLASSES = (
    ("hex_run", r"[0-9A-Fa-f]{20,}", _DIGITS + _UPPER[:6] + _LOWER[:6], 3.0),
    ("upper_run", r"[A-Z0-9]{20,}", _DIGITS + _UPPER, 3.6),
    ("base64_run", r"[A-Za-z0-9+/_-]{20,}", _DIGITS + _UPPER + _LOWER + "+/_-", 3.9),
)
#: Runs that are no secrets: one kind of character only, words joined by separators,
#: identifiers in the usual form, counting sequences, named placeholders.
ALLOWED = (
    r"^[A-Za-z/_+-]+$",
    r"^[0-9/_+-]+$",
    r"^[a-z0-9]+([/_-][a-z]+)+[0-9]{0,4}$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij|example|placeholder|your[_-]?(api|key|token|secret)",
)
WINDOW = 20


#: Entries that a fold appends to one array before it starts the next.
CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` and lambdas inside it refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_out(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]], kind: str) -> Column:
    """Fold over ``items`` that puts out an array of ``kind``.

    ``step`` makes of the state and an item the next state, what to put out, and whether to. Entries
    go to arrays of ``CHUNK``, so that appending copies little however many there are.
    """
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(state.alias("state"), none.alias("chunk"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def one(acc: Column, item: Column) -> Column:
        after, entry, put = step(acc["state"], item)
        full = F.size(acc["chunk"]) >= CHUNK
        chunk = F.when(~put, acc["chunk"]).when(full, F.array(entry)).otherwise(F.concat(acc["chunk"], F.array(entry)))
        done = F.when(put & full, F.concat(acc["done"], F.array(acc["chunk"]))).otherwise(acc["done"])
        return F.struct(after.alias("state"), chunk.alias("chunk"), done.alias("done"))

    return F.aggregate(items, start, one, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["chunk"]))))


def pattern_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs ``start``, ``end``, ``hit``, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = bound(hits, lambda h: F.zip_with(h, F.slice(gaps, F.lit(1), F.size(h)), lambda x, g: F.struct(x.alias("h"), F.length(g).alias("g"))))

    def step(at: Column, pair: Column) -> tuple[Column, Column, Column]:
        begin = at + pair["g"]
        end = begin + F.length(pair["h"])
        return end, F.struct(begin.alias("start"), end.alias("end"), pair["h"].alias("hit")), F.lit(True)

    return fold_out(pairs, F.lit(0), step, _SPAN)


def window_entropy(run: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any ``window`` characters in a row of a run over ``alphabet``.

    One pass over the characters. The counts of the window are carried along, one character in and one out; so is the
    sum of ``k * log2(k)`` over them, of which only those two terms change.
    """
    weight = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(window + 2)])

    def f(k: Column) -> Column:
        return F.get(weight, k)

    def scan(codes: Column) -> Column:
        left = F.concat(F.array_repeat(F.lit(-1), window), F.slice(codes, F.lit(1), F.greatest(F.size(codes) - window, F.lit(0))))
        moves = F.zip_with(codes, left, lambda enter, leave: F.struct(enter.alias("enter"), leave.alias("leave")))
        moves = F.slice(moves, F.lit(1), F.size(codes))
        start = F.struct(
            F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).alias("held"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")
        )

        def step(acc: Column, move: Column) -> Column:
            enter, leave = move["enter"], move["leave"]
            out = leave >= 0
            k_out = F.when(out, F.get(acc["counts"], leave)).otherwise(1)
            k_in = F.get(acc["counts"], enter) - F.when(leave == enter, 1).otherwise(0)
            total = acc["sum"] - f(k_out) + f(k_out - 1) + f(k_in + 1) - f(k_in)
            counts = F.when(leave == enter, acc["counts"]).otherwise(
                F.transform(acc["counts"], lambda k, at: F.when(at == enter, k + 1).when(at == leave, k - 1).otherwise(k))
            )
            held = F.when(out, acc["held"]).otherwise(acc["held"] + 1)
            bits = F.when(held >= window, F.lit(math.log2(window)) - total / window).otherwise(0.0)
            return F.struct(counts.alias("counts"), held.alias("held"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

        return F.aggregate(moves, start, step, lambda acc: acc["best"])

    # The place of a character in the alphabet; runs hold no others.
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return F.when(F.length(run) >= window, bound(codes, scan)).otherwise(0.0)


def _kinds(spans: Column, rank: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))
    )


def clear_of(spans: Column, others: Column) -> Column:
    """The ``spans`` (sorted, apart from one another) that overlap none of ``others`` (sorted by start).

    Two sweeps along both: no earlier one may reach into a span, and no later one may start within it.
    """

    def sweep(spans: Column, forward: bool) -> Column:
        point = lambda s, mine: F.struct(
            (s["start"] if forward else -s["start"]).alias("key"), F.lit(mine).alias("mine"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")
        )
        both = F.array_sort(F.concat(F.transform(others, lambda s: point(s, 0)), F.transform(spans, lambda s: point(s, 1))))

        def step(reach: Column, s: Column) -> tuple[Column, Column, Column]:
            mine = s["mine"] == 1
            if forward:
                after, free = F.greatest(reach, s["end"]), reach <= s["start"]
            else:
                after, free = F.least(reach, s["start"]), reach >= s["end"]
            return F.when(mine, reach).otherwise(after), F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")), mine & free

        out = fold_out(both, F.lit(0 if forward else 2**31 - 1), step, _SPAN)
        return out if forward else F.reverse(out)

    none = (F.size(spans) == 0) | (F.size(others) == 0)
    return F.when(none, spans).otherwise(bound(spans, lambda s: sweep(sweep(s, True), False)))


def _unlisted(alphabet: str, bits: float) -> Callable[[Column], Column]:
    """Test for a run outside the allow-list with a window of ``bits``."""

    def wanted(s: Column) -> Column:
        keep = F.lit(True)
        for allowed in ALLOWED:
            keep = keep & ~s["hit"].rlike(allowed)
        return F.when(keep, window_entropy(s["hit"], alphabet) >= bits).otherwise(False)

    return wanted


_SPAN = "struct<start:int,end:int,hit:string>"
_NONE = f"array<{_SPAN}>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of likely secrets in every whole text.

    Returns ``id_col``, the counts ``n_assign``, ``n_access``, ``n_hex`` of base spans, and two
    arrays of structs ``start``, ``rank``, ``end`` (code points, end exclusive) in order:
    ``base``, by the fixed patterns, and ``spans``, with the runs that the entropy scan adds.
    Ranks 0 to 2 are ``BASE_KINDS``; 3 is a run of a character class in which some window
    reaches the class's bits, that no allow-list pattern names and no other span overlaps.

    One row per row: repeated ids and rows stay apart. Null and empty texts have no spans; a null id
    stays null. Other columns are ignored, whatever their names. Empty table: no rows. Nothing is
    shuffled. A run is scanned in one pass, in time linear in its length, and
    a text's spans are found and compared in time linear in their number, but for sorting them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        found = found.withColumn(
            f"_{name}", F.when(F.col("_text").rlike(pattern), pattern_spans(F.col("_text"), pattern)).otherwise(F.array().cast(_NONE))
        )
    value = lambda s: F.regexp_extract(s["hit"], ASSIGN, 1)
    found = found.withColumn("_assign", F.filter("_assign", lambda s: F.length(value(s)) >= 6))
    base = F.concat(*[_kinds(F.col(f"_{name}"), k) for k, name in enumerate(BASE_KINDS)])
    found = found.withColumn("base", F.sort_array(base))
    # The widest class holds the other two, so one test of the text serves all.
    found = found.withColumn("_any", F.col("_text").rlike(CLASSES[-1][1]))
    for name, pattern, *_ in CLASSES:
        runs = F.when(F.col("_any"), pattern_spans(F.col("_text"), pattern)).otherwise(F.array().cast(_NONE))
        found = found.withColumn(f"_{name}", runs)
    taken = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("hit")))

    def chosen(names: list[tuple], taken: Column, added: Column) -> Column:
        """Of overlapping runs the one of the widest class stays; every class is worked out once."""
        if not names:
            return added
        (name, _, alphabet, bits), *rest = names
        good = F.filter(clear_of(F.col(f"_{name}"), taken), _unlisted(alphabet, bits))
        return bound(
            F.struct(good.alias("good"), taken.alias("taken"), added.alias("added")),
            lambda s: chosen(rest, F.concat(s["taken"], s["good"]), F.concat(s["added"], s["good"])),
        )

    added = F.when(F.col("_any"), chosen(list(reversed(CLASSES)), taken, F.array().cast(_NONE))).otherwise(F.array().cast(_NONE))
    return found.withColumn("spans", F.sort_array(F.concat("base", _kinds(added, len(BASE_KINDS))))).select(
        F.col("_id").alias(id_col),
        *[F.size(f"_{n}").cast("long").alias(f"n_{n}") for n in BASE_KINDS],
        "base",
        "spans",
        F.col("_text").alias("scanned"),
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(n) for n in (*BASE_KINDS, "entropy")])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"]))
    )


def without_secrets(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every span, overlapping ones together, replaced by a mark."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, rest)).otherwise(text)


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with secrets replaced in their texts; a null text stays null.

    Needs no key: the spans are worked out beside the row's own columns.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    done = secret_spans(packed, "row", "text")
    clean = F.when(F.col(f"row.{text_col}").isNotNull(), without_secrets(F.col("scanned"), F.col("spans")))
    out = done.select("row", clean.alias("clean"))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("clean").alias(c))
        elif chars_col is not None and c == chars_col:
            columns.append(
                F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c)
            )
        else:
            columns.append(F.col("row")[c].alias(c))
    return out.select(*columns)
