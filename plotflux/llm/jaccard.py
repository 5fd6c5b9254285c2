"""Exact n-gram Jaccard join: partitioned universe, pigeonhole signatures, verified pairs, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotflux.llm.shared import bit_map, components, discard, in_bit_map, mix, shingle_hashes, slices, small_batches, stored, without_ids, word_hashes
from plotflux.session import hot_key_join, inner_join

#: Two sets link when 4 x intersection >= 3 x union; then at most a seventh of both sizes differs.
NUMERATOR, DENOMINATOR = 3, 4
_SEVENTH = NUMERATOR + DENOMINATOR
#: A signature that more sets share is frequent: it stops counting for the guarantee.
FREQUENT = 8
_SEGMENT, _BAND, _TOKEN = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def need(n: int, partner: int) -> int:
    """Segments that must be compared so that two linked sets agree on one: the pigeonhole bound."""
    return (n + partner) // _SEVENTH + 1


@lru_cache(maxsize=None)
def allocation(band: int, reserve: float = 0.2) -> tuple[int, int]:
    """Number of segments of a size band, and how many of them carry one-deletion neighbourhoods.

    A band holds sets of ``2 ** band`` up to ``2 ** (band + 1) - 1`` shingles. For every number of segments
    the expected count of non-empty ones (Poisson) is compared with what the largest sets
    need, plus a reserve for frequent contents and three standard deviations; what is missing comes
    from one-deletion neighbourhoods, which let a segment differ by one. The cheapest pair by
    expected signatures per set, averaged over the band's smallest and largest sets, is taken.
    """
    low, high = 1 << band, (1 << (band + 1)) - 1
    best = None
    for load in (0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0):
        m = max(1, math.ceil(high / load))
        missing = 0.0
        for n in (low, high):
            rate = n / m
            filled = m * (1 - math.exp(-rate))
            spread = math.sqrt(max(m * math.exp(-rate) * (1 - (1 + rate) * math.exp(-rate)), 0.0))
            short = need(n, n * DENOMINATOR // NUMERATOR) * (1 + reserve) + 3 * spread - filled
            double = 1 - (1 + rate) * math.exp(-rate)
            missing = max(missing, short / max(double, 1e-9))
        d = min(m, math.ceil(max(missing, 0.0)))
        cost = 0.0
        for n in (low, high):
            rate = n / m
            cost += (m * (1 - math.exp(-rate)) + d * (rate - rate * math.exp(-rate))) / n
        # Where even all neighbourhoods leave a shortage, prefer what comes closest.
        cost += 10.0 * max(0.0, missing - m) / high
        if best is None or cost < best[0]:
            best = (cost, m, d)
    return best[1], best[2]


def shingle_set(data: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; empty for none."""
    return np.unique(shingle_hashes(word_hashes(data or b""), size))


def class_of(s: np.ndarray) -> int:
    """Fingerprint of a set: texts with equal sets are one class."""
    total = mix(s ^ _TOKEN).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.array([len(s)], np.uint64) * _BAND).astype(np.int64)[0])


def _in_band(s: np.ndarray, band: int, partner: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a set in one band, what each costs when frequent, and the slack of the guarantee."""
    m, d = allocation(band)
    salt = np.uint64(((band + 1) * int(_BAND)) & 0xFFFFFFFFFFFFFFFF)
    scattered = mix(s ^ salt)
    segment = ((scattered >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    segment, content = segment[order], mix(scattered[order])
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    held = np.diff(np.concatenate((starts, [len(s)])))
    sums = np.add.reduceat(content, starts)
    where = segment[starts] * _SEGMENT + salt
    double = (segment[starts] < np.uint64(d)) & (held >= 2)
    subsets = mix(sums + where)
    weights = np.where(double, 2, 1)
    member = np.repeat(np.arange(len(starts)), held)
    picked = double[member]
    deleted = mix((sums[member] - content + where[member])[picked])
    slack = int(weights.sum()) - need(len(s), partner)
    return np.concatenate((subsets, deleted)), np.concatenate((weights, np.ones(len(deleted), np.int64))), slack


def _bands(n: int) -> list[tuple[int, int, int]]:
    """Bands in which a set of ``n`` meets its partners: (role, band, largest partner).

    In its own band it meets all that are at home there; in the band below only the sets of that band.
    """
    home = n.bit_length() - 1
    out = [(0, home, n * DENOMINATOR // NUMERATOR)]
    if home > 0 and -(-n * NUMERATOR // DENOMINATOR) < 1 << home:
        out.append((1, home - 1, (1 << home) - 1))
    return out


def shapes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row its id, set size, class, and the slack of the guarantee in both roles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, classes, slacks = [], [], ([], [])
            for value in batch.column(1):
                s = shingle_set(_bytes(value))
                sizes.append(len(s))
                classes.append(class_of(s) if len(s) else None)
                found = {role: _in_band(s, band, most)[2] for role, band, most in _bands(len(s))} if len(s) else {}
                for role in (0, 1):
                    slacks[role].append(found.get(role, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), *[pa.array(x, pa.int32()) for x in slacks]],
                names=["id", "n", "cls", "slack0", "slack1"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n long, cls long, slack0 int, slack1 int"
    )


def _bytes(value: pa.Scalar) -> bytes | None:
    text = value.as_py()
    return None if text is None else text.encode()


def signatures(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows ``sig``, ``cls``, ``mark`` (size, role and weight in one number) of all texts.

    Copies met in the same task are signed once; the others fall together later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        count = 0
        for batch in slices(batches):
            for value in batch.column(0):
                s = shingle_set(_bytes(value))
                if not len(s):
                    continue
                cls = class_of(s)
                if cls in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(cls)
                for role, band, most in _bands(len(s)):
                    sigs, weights, _ = _in_band(s, band, most)
                    held.append((sigs, np.full(len(sigs), cls, np.int64), (len(s) * 8 + role * 4 + weights)))
                    count += len(sigs)
                if count >= 200_000:
                    yield _rows(held)
                    held, count = [], 0
        if held:
            yield _rows(held)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "sig long, cls long, mark long")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    sigs, classes, marks = (np.concatenate(x) for x in zip(*held))
    return pa.RecordBatch.from_arrays(
        [pa.array(sigs.astype(np.int64)), pa.array(classes), pa.array(marks.astype(np.int64))], names=["sig", "cls", "mark"]
    )


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Shingle sets (``cls``, ``items``) of the classes whose first document's id is in ``wanted``.

    Texts are picked by a bit map of those ids, of bounded size, so they are not shuffled.
    """
    n = wanted.count()
    bits = min(27, max(10, math.ceil(math.log2(16 * n + 1))))
    filled = bit_map(wanted.select(F.xxhash64("id").alias("h")), "h", bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            chosen = np.flatnonzero(in_bit_map(filled, bits, batch.column(1).to_numpy(zero_copy_only=False)))
            for at in range(0, len(chosen), 500):
                sets = [shingle_set(_bytes(batch.column(0)[int(k)])) for k in chosen[at : at + 500]]
                sets = [s for s in sets if len(s)]
                if sets:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))],
                        names=["cls", "items"],
                    )

    found = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h")).mapInArrow(
        run, "cls long, items array<long>"
    )
    return found.groupBy("cls").agg(F.first("items").alias("items"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets link, exactly."""
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("of_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    union = F.size("of_a") + F.size("of_b") - both
    return pairs.join(left, "a").join(right, "b").where(both * DENOMINATOR >= union * NUMERATOR).select("a", "b")


def open_pairs(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of ``sets`` (``cls``, ``items``) in different components that may link, by prefixes.

    In one order of all shingles, rarest first, linked sets share one of their first quarter, and at
    the first one they share enough must be left in both. Edited places make rare shingles, so a far
    copy meets nobody, and a group within one component is passed over.
    """
    each = sets.select("cls", F.size("items").cast("long").alias("n"), F.explode("items").alias("item"))
    common = each.groupBy("item").agg(F.count("*").alias("sets"))
    place = F.row_number().over(W.partitionBy("cls").orderBy("sets", "item"))
    ranked = each.join(common, "item").withColumn("place", place.cast("long"))
    ranked = ranked.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1) & (F.col("sets") > 1))
    known = labels.select(F.col("id").alias("cls"), "component")
    of_size = known.groupBy("component").agg(F.count("*").alias("members"))
    known = known.join(of_size, "component")
    ranked = ranked.join(known, "cls", "left").select(
        "item", "cls", "n", "place", F.coalesce("component", "cls").alias("component"), F.coalesce("members", F.lit(1)).alias("members")
    )
    # Of two sets in different components one is outside the group's largest component.
    ranked = stored(ranked)
    largest = F.max(F.struct("members", "component"))["component"].alias("largest")
    ranked = stored(hot_key_join(ranked, ranked.groupBy("item").agg(largest, F.count("*").alias("holders")), ["item"], weight="holders"))
    # Sizes of linked sets differ by a third at most, so they lie in the same or in neighbouring steps of that ratio.
    step = F.floor(F.log("n") / (math.log(DENOMINATOR / NUMERATOR) * (1 + 1e-9))).cast("long")
    apart = ranked.where("component <> largest").select("item", step.alias("step"), "cls", "n", "place", "component")
    near = F.explode(F.array(*[step + k for k in (-1, 0, 1)])).alias("step")
    other = ranked.select("item", near, *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "place", "component")])
    enough = (1 + F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))) * _SEVENTH >= (F.col("n") + F.col("n_b")) * NUMERATOR
    met = inner_join(stored(apart), stored(other), ["item", "step"]).where(
        (F.col("component") != F.col("component_b")) & _fitting(F.col("n"), F.col("n_b")) & enough
    )
    return met.select(F.least("cls", "cls_b").alias("a"), F.greatest("cls", "cls_b").alias("b")).distinct()


def _fitting(a: Column, b: Column) -> Column:
    """Whether two set sizes can link."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected groups of texts whose 5-word shingle sets have a Jaccard similarity of at least 0.75.

    Returns one row per row: ``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    Equal sets are one class. By size band the universe of shingles is hashed into segments; by the
    pigeonhole principle two linked sets agree on some segment's subset, or differ there by one
    shingle where one-deletion neighbourhoods are indexed (``allocation`` weighs both). Sets that share a
    signature are candidates and are verified exactly. The bound leaves slack, so linked sets share several:
    pairs that share fewer are dropped unverified. Signatures of more than ``FREQUENT`` sets do not count;
    a set left with too few others is short. In the groups of its frequent signatures a short set meets its
    neighbours by size and the group's first set, which joins most of a family of near copies without its
    pairs; then short sets of different components meet by their rarest shingles (``open_pairs``). Two linked
    sets of which one is not short share an infrequent signature, and any two share a prefix: no link is lost.

    Null, empty and blank texts have size 0 and are groups of their own, as is a text alone. Null ids
    share in groups but are never their smallest id; a group of null ids has a null component. Repeated
    rows and ids are rows of their own. Other columns are ignored. Empty table: no rows. A class is a
    64-bit fingerprint, so among ten billion different texts about three pairs would be taken for equal.
    """
    rows = stored(shapes(docs, id_col, text_col))
    classes = stored(
        rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("slack0").alias("slack0"), F.first("slack1").alias("slack1"))
    )
    # Signatures held by one set only go first, in the sort that brings equal ones together.
    by_class = W.partitionBy("sig").orderBy("cls")
    near = signatures(docs, text_col).select(
        "sig", "cls", "mark", F.lag("cls").over(by_class).alias("before"), F.lead("cls").over(by_class).alias("after")
    )
    near = near.where("(before is null or before <> cls) and (before is not null or after is not null)")
    whole = W.partitionBy("sig")
    size, role = F.shiftright("mark", 3), F.shiftright("mark", 2).bitwiseAND(1)
    shared = near.withColumn("held", F.count("*").over(whole)).where("held > 1")
    shared = stored(shared.select("sig", "cls", size.alias("n"), role.alias("role"), F.col("mark").bitwiseAND(3).alias("weight"), "held"))

    # Each side's guarantee without its frequent signatures: how many others two linked sets share at least.
    often = shared.where(F.col("held") > FREQUENT)
    lost = often.groupBy("cls", "role").agg(F.sum("weight").alias("lost"))
    roles = F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("slack0").alias("slack")), F.struct(F.lit(1).alias("role"), F.col("slack1").alias("slack"))))
    spare = classes.select("cls", roles.alias("r")).select("cls", F.col("r.role").cast("long").alias("role"), "r.slack")
    spare = spare.join(lost, ["cls", "role"], "left").select("cls", "role", (F.col("slack") - F.coalesce("lost", F.lit(0))).alias("spare"))
    spare = stored(spare)
    short = spare.where("spare < 0").select("cls", "role")

    # Infrequent signatures: all pairs of a group of at most FREQUENT sets, and how many they share.
    by_size = W.partitionBy("sig").orderBy("n", "cls")
    before = F.collect_list(F.struct("cls", "n", "role")).over(by_size.rowsBetween(1 - FREQUENT, -1))
    few = shared.where(F.col("held") <= FREQUENT).withColumn("before", before).select("cls", "n", "role", F.explode("before").alias("o"))
    few = few.where(_fitting(F.col("n"), F.col("o.n")) & (F.col("role") + F.col("o.role") < 2))
    few = few.groupBy(F.col("cls").alias("a"), F.col("role").alias("role_a"), F.col("o.cls").alias("b"), F.col("o.role").alias("role_b")).agg(F.count("*").alias("times"))
    for side in ("a", "b"):
        least = spare.where("spare > 1").select(
            F.col("cls").alias(side), F.col("role").alias(f"role_{side}"), (F.floor(F.col("spare") / 2) + 1).alias(f"least_{side}")
        )
        few = few.join(least, [side, f"role_{side}"], "left").where(F.coalesce(F.col(f"least_{side}"), F.lit(0)) <= F.col("times"))

    # Frequent signatures: a short set meets its neighbours by size and its group's first set.
    held_back = often.join(short, ["cls", "role"]).select("sig", "cls", "n")
    around = F.collect_list("cls").over(by_size.rowsBetween(-2, -1))
    first = F.first("cls").over(W.partitionBy("sig").orderBy("cls"))
    many = held_back.withColumn("around", around).withColumn("first", first)
    many = many.select("cls", F.explode(F.array_union("around", F.array("first"))).alias("other")).where("cls <> other").distinct()
    pairs = few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(
        many.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b"))
    )
    pairs = stored(pairs.distinct())
    short = stored(short.select("cls").distinct())
    discard(shared, spare)
    involved = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(short).distinct()
    sets = stored(sets_of(docs, classes.join(involved, "cls", "left_semi").select("id"), id_col, text_col))
    links = stored(verified(pairs, sets))
    labels = stored(components(links))

    # What is still open: short sets in different components.
    if not short.isEmpty():
        rest = stored(open_pairs(sets.join(short, "cls"), labels).join(pairs, ["a", "b"], "left_anti"))
        more = stored(verified(rest, sets))
        if not more.isEmpty():
            labels = stored(components(links.union(more)))
    joined = classes.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select(
        "cls", "id", F.coalesce("component", "cls").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("id").alias("least"))
    final = stored(joined.join(least, "component").select(F.col("cls").alias("_cls"), "least"))
    discard(classes, pairs, short, sets, links)
    out = rows.join(final, rows["cls"] == final["_cls"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are their group's smallest id, with their own columns.

    An id stays if any of its rows is its group's smallest; of rows that repeat id and text one stays.
    Rows without an id cannot be told apart and stay.
    """
    with small_batches(docs.sparkSession):
        groups = stored(jaccard_groups(docs, id_col, text_col).withColumnRenamed(id_col, "_of"))
    ids = groups.where("_of is not null").groupBy("_of").agg(
        F.max((F.col("_of") == F.col("component_id")).cast("int")).alias("own"), F.count("*").alias("times")
    )
    ids = stored(ids)
    kept = without_ids(docs, ids.where("own = 0").select("_of"), id_col)
    repeated = ids.where("own = 1 and times > 1").select("_of")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, kept[id_col] == repeated["_of"], "left_semi").dropDuplicates([id_col, text_col])
    return without_ids(kept, repeated, id_col).unionByName(again)
