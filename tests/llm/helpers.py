"""Small tables and brute-force versions for the operators' tests."""

import random

import numpy as np
import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names of the operators' results and of their own working columns
CLASH = "n_words bigint, kept string, fp bigint, host string, `row` string, k string, h string, spans string"


def odd_texts(seed=3):
    rnd = random.Random(seed)
    return [
        None, "", " \t\n\x0b ", "a", "a b c", "İstanbul ΣΑΣ é x　y \x85z q\x1cb",
        "x <|endoftext|>y<|startoftext|> It's ''s I'LL", "a" * 3000, "ab " * 3000,
        "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(1500)),
        "".join(rnd.choice("abcdefgh'ss 12.\n") for _ in range(3000)),
        "՘₏漢字テスト한국어😀👍🏽", "a   b  c\n \n d ", " lead", "trail ", "\ta b\t c",
        "secret=token : abcdefg", "😀 password = 'hunter2aé' x", "AKIAAKIA" + "B" * 20,
        "deadbeef" * 4 + "g" + "0" * 23 + "x", "token===abcdef", "paſſword=abcdefgh toKen=abcdefgh",
        "ghpAbcDEF1234567890abcdefXYZ end " + "password=abcdef1 " * 150,
        "one two three four five six seven eight " * 5, "same\nlines\nsame\n\nlines\nx y",
    ]


def odd_docs(spark, clash=True):
    """Odd texts with nulls in every column, rows repeated, and clashing extra columns."""
    rows = [(100 + i, t, None if i % 3 else "en", f"s{i % 4}" if i % 5 else None, i if i % 2 else None)
            for i, t in enumerate(odd_texts())]
    rows += rows[3:9] + [(None, "a null id", "en", "s1", 1), (None, "a null id", "en", "s1", 1)]
    if clash:
        rows = [(*r, 1, "x", 2, "y", "z", "k", "h", "s") for r in rows]
    return spark.createDataFrame(rows, SCHEMA + (", " + CLASH if clash else ""))


def documents(spark, n=None):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df if n is None else df.where(df["doc_id"] < n)


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def groups(prints, bits=4):
    """Component (smallest id) of every id, from all pairs of fingerprints."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values ^ values[n]) <= bits):
            a, b = find(i), find(ids[m])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
