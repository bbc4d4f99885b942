"""Documents and brute-force versions for the operators' tests."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def sentence(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"Word{r.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Plain, repeated, edited, empty, blank, null, very long and odd texts, and a shared passage."""
    r = random.Random(seed)
    base = [sentence(r, r.randint(30, 160)) for _ in range(n)]
    passage = sentence(r, 45)
    out = list(base)
    for i in range(0, n, 5):
        w = base[i].split()
        w[len(w) // 2] = "edited"
        out += [base[i], " ".join(w), passage + " " + base[i + 1][:200], base[i + 2][:150] + "\n" + passage]
    out += [None, "", " \t\n", "one", "one two three", "ONE two three", "a" * 5000, "ab " * 900, sentence(r, 6000), "x y　z <|endoftext|>   end", passage, passage]
    r.shuffle(out)
    rows = [(i * 3 + 1, t, r.choice(["en", "de", None]), r.choice(["hot", "hot", "s1", "s2", None]), len(t or "")) for i, t in enumerate(out)]
    return rows


def frame(spark, rows):
    """With a column that clashes with names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", part string, bucket int").repartition(3)
