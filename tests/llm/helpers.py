"""Small tables with everything that is awkward, and random texts full of repeats."""

import random

#: Column names that operators use inside, with values of their own.
EXTRA = "id string, lang string, n int, key string, row int, member int, gone int, p string, w int"


def docs(spark, rows):
    """A table of (doc_id, text) with further columns of clashing names."""
    data = [(i, t, "x", None, 7, "k", 1, 2, None, "p", 3) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, " + EXTRA).repartition(3)


AWKWARD = [
    (5, None),
    (6, ""),
    (7, " "),
    (8, "\n\n"),
    (None, "a text without an id, long enough to count as a line"),
    (9, "a text without an id, long enough to count as a line"),
    (10, "Straße é 中文 😀 ▁ \x00 end"),
    (11, "same row twice, the same row twice, the same row"),
    (11, "same row twice, the same row twice, the same row"),
    (12, "one"),
]


def repeats(seed, n=60, vocabulary=30, glue=" "):
    """Texts made of shared passages, copies, near copies and runs."""
    rng = random.Random(seed)
    words = ["w%d" % i if i % 3 else "x" for i in range(vocabulary)]
    passages = [glue.join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.5:
                parts.append(rng.choice(passages))
            elif kind < 0.6:
                parts.append(glue.join([rng.choice(words)] * rng.randint(1, 80)))
            else:
                own = [f"u{i}v{k}" if rng.random() < 0.5 else rng.choice(words) for k in range(30)]
                parts.append(glue.join(own[: rng.randint(1, 30)]))
        text = glue.join(parts)
        if out and rng.random() < 0.2:
            text = rng.choice(out)[1] or ""
        if out and rng.random() < 0.2:
            text = (rng.choice(out)[1] or "")[rng.randint(0, 9) :] + rng.choice(words)
        out.append((rng.randint(0, 10_000) * n + i, text))
    return out
