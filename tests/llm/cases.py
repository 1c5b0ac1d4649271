"""Documents with every awkward case, and plain versions of what the contracts say."""

from __future__ import annotations

import random
import re
import zlib

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that no contract knows, named like columns that operators use inside.
EXTRA = ("key", "n", "score", "component", "target", "rank", "h", "held_out")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def awkward_rows(seed: int = 1, many: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source): nulls, blanks, a long text, repeats, near copies, shared passages, ties."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    base, passage = [say(rng.randrange(1, 90)) for _ in range(12)], say(14)
    rows = [(0, None, None, None), (1, "", "aa", "s"), (2, " \t\n", "bb", None), (3, "one", "aa", "s"), (4, "ONE", None, "t"), (5, "a b c d", "aa", "s"), (6, "A B  C\td", "bb", "u"), (7, "1234 !!", "aa", "s")]
    rows.append((8, say(60_000), "bb", "t"))
    for i in range(9, many):
        text = rng.choice(base)
        kind = rng.random()
        if kind < 0.5:  # near copies, around the threshold
            part = text.split()
            for _ in range(rng.randrange(1, 4)):
                part[rng.randrange(len(part))] = rng.choice(words)
            text = " ".join(part)
        elif kind < 0.65:
            text = f"{say(20)} {passage} {say(9)}"
        elif kind < 0.75:
            text = "é中 \U0001f600" * rng.randrange(1, 30) + text
        rows.append((i, text, rng.choice(["aa", "bb", None]), rng.choice(["s", "s", "t", "u", None])))
    rng.shuffle(rows)
    return rows


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, len(r[1] or ""), *("x" for _ in EXTRA)) for r in rows], SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def remainder(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Sets:
    """Joined ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
