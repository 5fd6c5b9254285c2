"""Small corpora with the awkward rows every operator must take."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id string, n int, cls string, row string, host string, path string, label double, start int, rank int"
)
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper katsura larch maple nutmeg oak pine quince rowan spruce tupelo".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1, n=40):
    """Plain rows, copies, near copies, and null, empty, blank, very long and repeated ones."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(3, 120)) for _ in range(n)]
    texts += [texts[0], texts[1] + " tail", texts[2].upper(), " ".join(texts[3].split()[:-1]), "two words", "Two  WORDS", "one"]
    texts += [None, "", " \t\n ", sentence(rng, 60_000), "x" * 300_000, "é ü ñ"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6]), (None, None)]
    return rows


def frame(spark, rows):
    """Rows (id, text[, source[, lang]]) with further columns whose names operators use themselves."""
    full = []
    for r in rows:
        i, t, *rest = r
        source = rest[0] if rest else f"s{(i or 0) % 3}"
        lang = rest[1] if len(rest) > 1 else "en"
        full.append((i, t, lang, source, len(t) if t is not None else None, "a", 1, "b", "c", "d", "e", 0.5, 7, 8))
    return spark.createDataFrame(full, SCHEMA)
