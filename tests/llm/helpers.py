"""Small tables with the cases that every operator has to bear, and brute-force twins."""

import random

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta house river stone cloud Garden window paper light music'll don't 42 7th ÉTÉ größe".split()


def make_texts(n: int, seed: int = 3) -> list[str]:
    """Texts of one to a few hundred words in lines, with copies and near copies."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 7 == 3:
            out.append(rng.choice(out))
        elif i % 7 == 5:
            words = rng.choice(out).split(" ")
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
        else:
            lines = [" ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 12))]
            out.append("\n".join(lines))
    return out


ODD = [
    None, "", " ", "\n\n", "a", "A b", "a B", "  two   spaces \t tab\n\nend ", "日本語のテキスト。\n日本語のテキスト。", "naïve café ½ ² µ ×",
    "<|endoftext|> x<|endoftext|>", "it's 'tis DON'T 'll", "\x1c\x85  wide　space", "x" * 5000, "word " * 4000, "same line\n" * 300,
    "😀 emoji 👩‍👩‍👧 é", "123 456,789", "!!! ??? ...", "İstanbul ΣΑΣ ſ",
]


def rows(texts, first: int = 0):
    return [(first + i, t, "en" if i % 3 else "fr", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, seed: int = 3):
    """Ordinary and odd texts, one row twice, ids with gaps, nulls in every column."""
    table = rows(make_texts(60, seed)) + rows(ODD, 1000)
    table += [table[4], (None, "no id", None, None, None)]
    return spark.createDataFrame(table, SCHEMA).repartition(3)


def with_clashes(df, *names):
    """The same table with columns that are named as an operator's own."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(n) for n in names])


def xx(text: str) -> int:
    """XXH64 as a signed number, as the engine has it."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8"), seed=42)
    return h - (1 << 64) if h >> 63 else h
