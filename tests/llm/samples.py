"""Small tables with the awkward rows that every operator must take."""
from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k long, bucket int"


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty, spaces only, one word, repeated rows, ties, runs, long texts, odd characters."""
    rng = random.Random(seed)
    vocab = [a + b for a in ("ka", "lo", "mi", "zu", "é", "ñor") for b in ("ta", "re", "sso", "", "x9", "ú")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = say(120), say(90)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, base), (6, base), (7, base), (7, base),
        (8, base.replace("ka", "KA")), (9, say(40) + " " + passage + " " + say(30)), (10, passage + "\n" + say(200)),
        (11, "spam " * 300), (12, "spam " * 37 + say(50)), (13, "x" * 3000), (14, "y z\n" * 60),
        (15, passage + " " + passage), (16, "\n".join([say(9), "same line here"] * 6)), (17, say(6000)),
        (18, "日本語 テスト " * 50), (19, "emoji 😀 " + base), (20, base + " tail"), (None, say(60)), (None, None),
        (21, "a\x00b \x1c c\x85d   e f " + say(30)), (22, "!!! ### $$$ %% | | <> &&"),
    ]
    words = base.split()
    for i in range(12):  # near copies
        w = list(words)
        w[(i * 17) % len(w)] = f"edit{i}"
        rows.append((100 + i, " ".join(w)))
    return rows + [(200 + i, say(rng.randrange(1, 90))) for i in range(40)]


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """The rows with the columns of documents and a few whose names operators use inside."""
    return spark.createDataFrame([(i, t, None, f"src{n % 3}", None, 0.5, 7, 3) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
