"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotflux.llm.shared import slices, stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "validity", "gazetteer", "context", "boundary")
YES, NO, ABSTAIN = 2, 1, 0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits cannot start a match in its middle, so the look-behinds change no match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Looser candidates that the base patterns leave out.
_LOOSE = (
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\((?:at|AT)\)|\[(?:at|AT)\])\x20?[A-Za-z0-9-]{1,63}"
                   r"(?:\x20?(?:\.|\((?:dot|DOT)\)|\[(?:dot|DOT)\])\x20?[A-Za-z0-9-]{2,63})+")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[./\x20-][0-9]{4}){3}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])00[1-9][0-9]{1,2}[\x20-][0-9]{2,4}(?:[\x20-][0-9]{2,4}){1,3}(?![0-9])")),
)

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name io ai co uk de fr es it nl be ch at eu us ca au jp cn in br mx pl se no fi dk ru pt ie nz".split())
ISSUER_DIGITS = "3456"  # first digits of payment cards
DIAL_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Two-digit starts of the dial codes that have three digits: every code that begins so has a third digit.
LONG_DIAL_CODES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
# Words in front of a span that speak for or against it.
_FOR = tuple(
    re.compile(p)
    for p in (
        r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
        r"(?i)\b(?:ip|host|server|client|address|login|from)\b",
        r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay|karte|carte|tarjeta)\b",
        r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|text|telefon|appel|llama)\b",
    )
)
_AGAINST = re.compile(r"(?i)\b(?:version|release|v|section|isbn|issn|sku|order|invoice|serial|part|build|figure|chapter|page|doi|ref)\b[.:#\x20]*$")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, apart from the base spans and from one another."""
    out: list[tuple[int, int, int]] = []
    # Spans taken so far, apart from one another after merging, by start: one look at two neighbours tells.
    starts, ends = _merged(taken)
    digits = bool(_DIGIT.search(text))
    for kind, pattern in _LOOSE:
        if kind and not digits or not kind and not ("@" in text or "at)" in text or "at]" in text or "AT)" in text or "AT]" in text):
            continue
        fresh = []
        for m in pattern.finditer(text):
            at = bisect_left(starts, m.end())
            if not at or ends[at - 1] <= m.start():
                fresh.append((kind, m.start(), m.end()))
        if fresh:
            out += fresh
            starts, ends = _merged([*taken, *out])
    return out


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> list[int]:
    """One vote per labeler: YES, NO or ABSTAIN."""
    hit, before = text[start:end], text[max(0, start - 40) : start]
    digits = _digits(hit)
    if kind == 0:
        host = re.sub(r"\x20?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\])\x20?", ".", hit).rpartition(".")[2].lower()
        validity = YES if host.isalpha() and len(host) >= 2 else NO
        gazetteer = YES if host in TOP_DOMAINS else NO if not host.isalpha() else ABSTAIN
    elif kind == 1:
        try:
            address = ipaddress.ip_address(".".join(p.lstrip("0") or "0" for p in hit.split(".")) if "." in hit else hit)
            validity, gazetteer = YES, NO if address.is_unspecified or address.is_multicast or address.is_loopback else YES
        except ValueError:
            validity, gazetteer = NO, ABSTAIN
    elif kind == 2:
        validity = YES if _luhn(digits) else NO
        gazetteer = YES if digits[0] in ISSUER_DIGITS else NO
    else:
        validity = YES if 10 <= len(digits) <= 15 else ABSTAIN if len(digits) == 9 else NO
        national = digits.lstrip("0") if hit[0] in "+0" else ""
        gazetteer = ABSTAIN if not national else YES if national[:1] in DIAL_CODES or national[:2] in DIAL_CODES or national[:2] in LONG_DIAL_CODES else NO
    context = NO if _AGAINST.search(before) else YES if _FOR[kind].search(before) else ABSTAIN
    left, right = text[start - 1 : start], text[end : end + 1]
    glued = left.isalnum() or left in ("_", "=", "#") and left != "" or right.isalnum() or right == "_"
    return [YES if strict else ABSTAIN, validity, gazetteer, context, NO if glued else ABSTAIN]


#: What the span classifier sees beside the votes, one bit each: the span's form and its neighbours.
SHAPES = ("long", "spaced", "digit_first", "separated", "labelled", "ends_clause")


def _code(kind: int, v: list[int], text: str, start: int, end: int) -> int:
    """Kind, votes and shape of a span in one number (at most 4 x 3^5 x 64 values)."""
    hit = text[start:end]
    before, after = text[max(0, start - 2) : start].rstrip(" "), text[end : end + 1]
    shape = (
        len(hit) > 16,
        " " in hit,
        hit[:1].isdigit(),
        any(c in hit for c in "-/()"),
        before[-1:] in (":", "=", "<", "("),
        after in ("", ".", ",", ";", ")", ">", "\n"),
    )
    code = kind
    for one in v:
        code = code * 3 + one
    return code * (1 << len(SHAPES)) + sum(1 << k for k, yes in enumerate(shape) if yes)


_SPAN = "array<struct<rank:int,start:int,end:int,code:int>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and looser candidate spans of every text with their labelers' votes, one row per row."""
    span = pa.list_(pa.struct([(n, pa.int32()) for n in ("rank", "start", "end", "code")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, loose = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = base_spans(text)
                more = loose_spans(text, found)
                for spans, out, strict in ((found, base, True), (more, loose, False)):
                    out.append(
                        [
                            {"rank": k, "start": a, "end": b, "code": _code(k, votes(text, k, a, b, strict), text, a, b)}
                            for k, a, b in spans
                        ]
                    )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span), pa.array(loose, span)], names=["id", "base", "loose"]
            )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, base {_SPAN}, loose {_SPAN}"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape, rest = codes % (1 << len(SHAPES)), codes >> len(SHAPES)
    v = np.empty((len(codes), len(LABELERS)), np.int64)
    for j in range(len(LABELERS) - 1, -1, -1):
        v[:, j], rest = rest % 3, rest // 3
    return rest, v, shape


def estimate_reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, pd.DataFrame]:
    """Expectation-maximisation over vote patterns: posterior of each pattern, and the labelers' reliabilities.

    Every labeler has, per kind, its rate of each vote among true and among false spans.
    Starts from the majority and smooths with one pseudo-count, so labels cannot swap.
    """
    kind, v, _ = _decode(codes)
    counts = counts.astype(float)
    lean = (v == YES).sum(1) - (v == NO).sum(1)
    p = np.where(lean > 0, 0.9, np.where(lean < 0, 0.1, 0.5))
    rates = np.full((len(KINDS), len(LABELERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        logit = np.zeros(len(codes))
        for k in range(len(KINDS)):
            mine = kind == k
            if not mine.any():
                continue
            w = counts[mine]
            prior = (w @ p[mine] + 1) / (w.sum() + 2)
            logit[mine] = np.log(prior / (1 - prior))
            for j in range(len(LABELERS)):
                for truth, q in ((1, p[mine]), (0, 1 - p[mine])):
                    held = np.bincount(v[mine, j], weights=w * q, minlength=3)
                    # The prior leans to labelers that are right more often than wrong.
                    lean_to = np.array([1.0, 0.5, 1.5]) if truth else np.array([1.0, 1.5, 0.5])
                    rates[k, j, truth] = (held + lean_to) / (held.sum() + 3)
                logit[mine] += np.log(rates[k, j, 1, v[mine, j]] / rates[k, j, 0, v[mine, j]])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - p).max(initial=0) < 1e-9
        p = new
        if done:
            break
    table = pd.DataFrame(
        [
            {"kind": KINDS[k], "labeler": name, "yes_if_true": rates[k, j, 1, YES], "no_if_false": rates[k, j, 0, NO]}
            for k in range(len(KINDS))
            for j, name in enumerate(LABELERS)
        ]
    )
    return p, table


def train_span_classifier(codes: np.ndarray, counts: np.ndarray, posterior: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on votes, kind and shape with the posteriors as soft labels; returns each pattern's probability."""
    kind, v, shape = _decode(codes)
    parts = [np.ones((len(codes), 1)), kind[:, None] == np.arange(1, len(KINDS))]
    parts += [v == YES, v == NO, (shape[:, None] >> np.arange(len(SHAPES))) & 1]
    parts += [(v[:, [j]] == vote) & (kind[:, None] == np.arange(len(KINDS))) for j in range(len(LABELERS)) for vote in (YES, NO)]
    x = np.concatenate([np.asarray(part, float) for part in parts], axis=1)
    w = counts / max(counts.sum(), 1)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (p - posterior)) + ridge * beta / max(len(codes), 1)
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * (ridge / max(len(codes), 1) + 1e-9)
        step = np.linalg.solve(bend, slope)
        beta -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Personal data in every whole text: ``id_col``, ``base`` and ``spans``, one row per row.

    Both are arrays of structs ``rank`` (place in ``KINDS``), ``start``, ``end`` (code points, end
    exclusive), by rank, then start. ``base`` has the spans of the fixed patterns; ``spans`` adds
    candidates that the classifier accepts. The votes of every span in the corpus are counted by
    pattern in Spark (fewer than 63,000 patterns, whatever the input); the labelers' reliabilities and the
    classifier are fitted on those counts, so all documents take part and only the pattern table meets the driver.

    Null and empty texts have no spans; null and repeated ids and repeated rows stay rows of their own.
    Other columns are ignored. Empty table: no rows. Texts are read whole, in time linear in their length.
    """
    found = stored(find_spans(docs, id_col, text_col))
    each = found.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy(F.col("s.code").alias("code"))
    seen = each.agg(F.count("*").alias("n")).orderBy("code").toPandas()
    accepted: list[int] = []
    if len(seen):
        codes, counts = seen["code"].to_numpy(np.int64), seen["n"].to_numpy(np.int64)
        posterior, _ = estimate_reliabilities(codes, counts)
        accepted = [int(c) for c in codes[train_span_classifier(codes, counts, posterior) >= threshold]]
    good = F.array(*[F.lit(c) for c in accepted]) if accepted else F.array().cast("array<int>")

    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))

    added = F.filter("loose", lambda s: F.array_contains(good, s["code"]))
    return found.select(
        F.col("id").alias(id_col), bare(F.col("base")).alias("base"), F.sort_array(bare(F.concat(F.col("base"), added))).alias("spans")
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(n) for n in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"]))
    )
