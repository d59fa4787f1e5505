"""Operator 1: token counts by a map-side two-tier lookup.

A text is cut at spaces into pre-token groups (a space goes with the word behind
it), which the tokenizer encodes independently of each other. Tier one is a
broadcast hash table of the token counts of frequent groups; tier two, a bounded
cache in each worker, holds what the tokenizer gave for the rest. Pre-tokens are
never shuffled: each task counts its own distinct groups and looks them up once a
slice of text.

The table holds groups that make up at least one ``table_size``-th of all groups, so
at most ``table_size`` of them, without a sort. The job that makes it covers every
row: each task reports the groups that are frequent in its whole input (a bounded
number) and how many groups it saw. Entries are at most ``MAX_KEY`` bytes long, which
bounds the broadcast to ``table_size * (MAX_KEY + 8)`` bytes. The table only saves
work; counts come from the tokenizer either way.

Texts in which white space surrounds a space, or in which a special string
stands, are encoded whole, as the groups would not be independent. Nulls count as
empty texts: zero bytes, zero tokens. Repeated rows and extra columns (dropped) do
not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.batches import columns_kept, distinct_words, slices, sums, text_column
from funnelkit.sources.sinks import cut_lineage

TABLE_SIZE = 16_384
MAX_KEY = 32
CACHE_WORDS = 800_000
LONG_KEY = 256  # longer groups are encoded but not kept
UNSAFE = re.compile(r"\s \s|\s \Z")


class Counter:
    """Token counts of a byte-level BPE without normaliser (byte_bpe kind)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        out = []
        for at in range(0, len(texts), 4096):
            found = self.library.encode_batch_fast(texts[at:at + 4096], add_special_tokens=False)
            out += map(len, found)
        return out

    def whole(self, text: str) -> bool:
        """Whether a text must be encoded in one piece."""
        return UNSAFE.search(text) is not None or any(s in text for s in self.special)

    def counts(self, groups: list[str], frequent: dict[str, int]) -> np.ndarray:
        """Token counts of groups with the space before them: tier one, then the
        worker's cache, then the tokenizer."""
        missing = [g for g in groups if g not in frequent and g not in self.cache]
        if len(self.cache) + len(missing) > CACHE_WORDS and self.cache:
            self.cache = {}
            missing = [g for g in groups if g not in frequent]
        cache = self.cache
        cache.update(zip(missing, self.encode([" " + g for g in missing])))
        out = np.fromiter((frequent[g] if g in frequent else cache[g] for g in groups),
                          dtype=np.int64, count=len(groups))
        for g in missing:
            if len(g) > LONG_KEY:
                cache.pop(g, None)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a worker process and vocabulary file."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task a core
    return Counter(path)


def _groups(texts: pa.Array):
    """Distinct groups, the code of each group in order, each text's offsets, and
    the mask of groups that begin a text (they have no space before them)."""
    words, codes, offsets = distinct_words(texts, " ")
    first = np.zeros(len(codes), dtype=bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return words, codes, offsets, first


def _frequent(text: str, table_size: int):
    """Per task: its frequent groups, found with counters whose number stays below
    eight times the table's (the smaller half goes when they are full), and under a
    null word the number of all its groups."""
    def work(batches):
        seen: dict[str, int] = {}
        total = 0
        for whole in batches:
            for batch in slices(whole, text):
                words, codes, _, first = _groups(text_column(batch, text))
                n = np.bincount(codes[~first], minlength=len(words))
                total += int(n.sum())
                top = np.argsort(-n, kind="stable")[:4 * table_size]
                top = top[n[top] > 1]
                for w, k in zip(words.take(pa.array(top)).to_pylist(), n[top].tolist()):
                    if len(w) < MAX_KEY and len(w.encode()) < MAX_KEY:
                        seen[w] = seen.get(w, 0) + k
                if len(seen) > 8 * table_size:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1])[:4 * table_size])
        best = [(w, k) for w, k in seen.items() if 4 * k * table_size >= total] + [(None, total)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()),
                                          pa.array([k for _, k in best], pa.int64())], names=["word", "n"])
    return work


def frequent_groups(df: DataFrame, path: str, text: str = "text",
                    table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Tier one: token counts of the corpus's frequent groups, at most ``table_size``
    (keys without the space that goes with them)."""
    per_task = df.select(text).mapInArrow(_frequent(text, table_size), "word string, n bigint")
    counts = cut_lineage(per_task.groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where("word is null").select("n").scalar()
    top = counts.where(F.col("word").isNotNull() & (F.col("n") * table_size >= total))
    words = [r.word for r in top.collect()]  # at most table_size of them can be so frequent
    return dict(zip(words, counter(path).encode([" " + w for w in words])))


def _counted(path: str, text: str, keep: list[str], table, over: int):
    def work(batches):
        own, frequent = counter(path), table.value
        for whole in batches:
            for batch in slices(whole, text):
                texts = text_column(batch, text)
                values = texts.to_pylist()
                apart = np.fromiter(map(own.whole, values), dtype=bool, count=len(values))
                words, codes, offsets, first = _groups(pc.if_else(pa.array(apart), "", texts))
                inner = own.counts(words.to_pylist(), frequent)[codes] if len(codes) else codes
                inner = np.where(first, 0, inner)
                n = sums(inner, offsets)
                # what begins a text has no space before it; texts apart are taken whole
                heads = [v if a else v.partition(" ")[0] for v, a in zip(values, apart)]
                n = n + np.array(own.encode(heads), dtype=np.int64)
                cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                cols += [pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > over)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_bytes", "n_tokens", "over_limit"])
    return work


def token_counts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id",
                 limit: int = 1024, table_size: int = TABLE_SIZE) -> DataFrame:
    """Key, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)
    of every whole text. ``path`` is the vocabulary file; the table of frequent
    groups is made here, by one job over the texts."""
    keep = [key] if key in df.columns else []
    table = df.sparkSession.sparkContext.broadcast(frequent_groups(df, path, text, table_size))
    schema = columns_kept(df.schema, keep) + (", " if keep else "")
    schema += "n_bytes bigint, n_tokens bigint, over_limit boolean"
    return df.select(*keep, text).mapInArrow(_counted(path, text, keep, table, limit), schema)
