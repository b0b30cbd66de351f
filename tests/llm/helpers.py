"""Small tables with what real ones have: nulls, empty and long texts, repeated rows, names that operators use themselves."""

from __future__ import annotations

import random
import re

WORDS = "ab re th on in er st an the of and to ly ing ion".split()
#: Columns that a careless operator would confuse with its own.
CLASH = ("id", "digest", "row", "key", "tokens", "block", "salt", "kept", "n", "score", "shard", "epoch", "_hot", "body", "chunk", "number")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(words))


def documents(spark, rows, partitions: int = 3):
    """``rows``: (doc_id, text) or (doc_id, text, source); clashing columns are added."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 7) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(partitions)
    for name in CLASH:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def words(text: str | None) -> list[str]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
