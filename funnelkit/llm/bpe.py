"""Operator 5: BPE encoding and decoding with a segment tree over pair ranks.

A word's adjacent symbol pairs are the leaves of a segment tree that keeps the
minimum of (rank, position), so the root is the leftmost pair of lowest rank. A
merge changes three leaves, each followed by a logarithmic number of point
updates towards the root; the word is done when the root holds no pair.

Words of like length are merged side by side: their trees are the rows of one
numpy matrix, and each step applies the merge at every row's own root. Words of
more than ``LONG`` symbols run through the same tree alone.

Nulls are empty texts (no ids, both digests of the empty string). A text without
words has no ids. Repeated rows, ties and extra columns do not matter: every row
is encoded by itself, and columns whose names clash with the results are dropped.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from funnelkit.llm.batches import columns_kept, distinct_words, released, runs, slices, sums, text_column

LONG = 64            # symbols of a word that is merged alone
ROWS = 4096          # trees side by side: few enough to stay in a core's own cache
SLICE = 1 << 20      # bytes of text encoded at a time, which takes some twenty times as much
CACHE_WORDS = 150_000  # units a worker keeps; beyond them, only those of the texts at hand
NO_KEY = np.iinfo(np.int64).max
NO_PAIR = np.iinfo(np.int32).max     # above every rank * LONG + position
# Below this code point the character classes of the installed regex module and
# of the tokenizer library agree; words with later ones are split by the library.
SAFE = "԰"
# Words of these characters alone are split by Arrow, all at once: no white space, nothing
# that composes, every letter with one lower case in ASCII or Latin-1.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
LETTERS = "[a-zß-öø-ÿ]"
PLAIN_PIECES = f"'s|'t|'re|'ve|'m|'ll|'d|{LETTERS}+|[0-9]|[^a-zß-öø-ÿ0-9]+"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"   # what they were written for


class Merges:
    """Merge rules of a BPE vocabulary: rank and result of a pair of ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.width = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], NO_KEY), np.append(order, 0)
        self.lookup = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where none exists."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' byte ids one after another, and each word's length."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.first[data]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.last[data[ends]]
        return ids, lengths

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all non-empty words, one after another, and how many each has."""
        counts = np.zeros(len(words), dtype=np.int64)
        if not words:
            return np.empty(0, dtype=np.int64), counts
        ids, lengths = self.symbols(words)
        starts = np.cumsum(lengths) - lengths
        done = []
        for w in np.flatnonzero(lengths > LONG):
            alone = self.merge_alone(ids[starts[w]:starts[w] + lengths[w]].tolist())
            counts[w] = len(alone)
            done.append((np.array([w]), alone))
        sizes = 1 << np.ceil(np.log2(lengths)).astype(np.int64)
        size = 1
        while size <= LONG:
            fit = np.flatnonzero((sizes == size) & (lengths <= LONG))
            for at in range(0, len(fit), ROWS):
                rows = fit[at:at + ROWS]
                merged, counts[rows] = self.merge_together(ids, starts[rows], lengths[rows], size)
                done.append((rows, merged))
            size *= 2
        out = np.empty(int(counts.sum()), dtype=np.int64)
        begin = np.cumsum(counts) - counts
        for rows, merged in done:
            out[runs(begin[rows], counts[rows])] = merged
        return out, counts

    def merge_together(self, ids, starts, lengths, size) -> tuple[np.ndarray, np.ndarray]:
        """Merges words of up to ``size`` symbols, one tree a row: their ids one after
        another, and how many each has."""
        n = len(starts)
        place = np.arange(size)
        live = place < lengths[:, None]
        sym = np.where(live, ids[np.minimum(starts[:, None] + place, len(ids) - 1)], 0)
        # column ``size`` is the end of a word; prv of the first symbol is ``size`` too
        nxt = np.where(place + 1 < lengths[:, None], place + 1, size)
        prv = np.broadcast_to(np.where(place > 0, place - 1, size), (n, size)).copy()
        prv = np.concatenate([prv, np.zeros((n, 1), dtype=prv.dtype)], axis=1)
        tree = np.full((n, 2 * size), NO_PAIR, dtype=np.int32)
        if size > 1:
            ranks = self.rank(sym[:, :-1], sym[:, 1:])
            leaf = (ranks >= 0) & live[:, 1:]
            tree[:, size:2 * size - 1] = np.where(leaf, ranks * size + place[:-1], NO_PAIR)
        for node in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        rows = np.flatnonzero(tree[:, 1] != NO_PAIR) if size > 1 else np.empty(0, dtype=np.int64)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root % size, root // size
            gone = nxt[rows, at]
            after, before = nxt[rows, gone], prv[rows, at]
            merged = self.result[rank]
            sym[rows, at] = merged
            live[rows, gone] = False
            nxt[rows, at] = after
            prv[rows, after] = at
            self._set(tree, rows, gone, np.full(len(rows), NO_PAIR), size)
            right = np.where(after < size, self.rank(merged, sym[rows, np.minimum(after, size - 1)]), -1)
            self._set(tree, rows, at, np.where(right >= 0, right * size + at, NO_PAIR), size)
            inside = before < size
            if inside.any():
                r, b = rows[inside], before[inside]
                left = self.rank(sym[r, b], merged[inside])
                self._set(tree, r, b, np.where(left >= 0, left * size + b, NO_PAIR), size)
            rows = rows[tree[rows, 1] != NO_PAIR]
        return sym[live], live.sum(axis=1)

    @staticmethod
    def _set(tree, rows, at, value, size) -> None:
        """Point update of one leaf in each row, up to the root."""
        node = at + size
        tree[rows, node] = value
        node = node >> 1
        while node[0] >= 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def merge_alone(self, sym: list[int]) -> np.ndarray:
        """The same tree for a single long word."""
        n = len(sym)
        size = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        ranks = self.lookup

        def leaf(i: int, j: int):
            r = ranks.get((sym[i], sym[j])) if j < n else None
            return none if r is None else (r, i)

        tree = [none] * size + [leaf(i, i + 1) for i in range(n)] + [none] * (size - n)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        live = bytearray(b"\1") * n

        def put(i: int, value) -> None:
            node = i + size
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] is not none and tree[1] < none:
            rank, at = tree[1]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = int(self.result[rank])
            live[gone] = 0
            nxt[at] = after
            if after < n:
                prv[after] = at
            put(gone, none)
            put(at, leaf(at, after))
            if prv[at] >= 0:
                put(prv[at], leaf(prv[at], at))
        return np.array(sym, dtype=np.int64)[np.frombuffer(bytes(live), dtype=np.uint8).astype(bool)]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    itself where printable, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class WordCoder:
    """Ids of white-space separated words under a byte-level BPE with word ends
    (``word_bpe_49k.json``), as the tokenizers library gives them without added
    special tokens. Ids are kept per unit in a bounded cache: a unit is a piece of a
    plain word, folded in case, or any other word as it stands. Units and their ids are
    Arrow and numpy arrays, which take a tenth of the memory of a dictionary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.numbers = [str(i) for i in range(len(self.names))]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # the file's own pattern, for characters on which the libraries agree
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.by_arrow = pattern == PATTERN
        self.chars = {c: b for b, c in enumerate(byte_chars())}
        self.known = pa.array([], pa.large_string())     # cached units
        self.ids = np.empty(0, dtype=np.int32)           # ids of all cached units, one after another
        self.starts = self.counts = np.empty(0, dtype=np.int64)

    def pretokens(self, word: str) -> list[bytes]:
        """Normalised pieces of a word without special strings."""
        top = max(word)
        # below U+0300 nothing composes and no letter folds by its context
        plain = word.lower() if top < "\u0300" else self.library.normalizer.normalize_str(word)
        if top < "\u0300" or max(plain, default="") < SAFE:
            return [p.encode() for p in self.pieces.findall(plain)]
        split = self.library.pre_tokenizer.pre_tokenize_str(plain)
        return [bytes(map(self.chars.__getitem__, p)) for p, _ in split]

    def plain(self, words: pa.Array) -> pa.Array:
        """Which words, or pieces of such, Arrow splits. A piece of a plain word is plain
        and no other word is, so that one cache holds both."""
        if not self.by_arrow:
            return pa.array(np.zeros(len(words), dtype=bool))
        return pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))

    def units(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct units of the words, for every word's units in order their places
        among them, and where each word's begin."""
        plain = self.plain(words)
        lower = pc.if_else(plain, pc.utf8_lower(words), words)
        mixed = pc.and_not(plain, pc.match_substring_regex(lower, f"^{LETTERS}+$"))
        cut = pc.replace_substring_regex(lower.filter(mixed), PLAIN_PIECES, r"\0 ")
        split = pc.replace_with_mask(lower, mixed, pc.ascii_rtrim_whitespace(cut))
        return distinct_words(split)

    def slots(self, units: pa.Array) -> np.ndarray:
        """Encodes the units not yet cached; each unit's slot in the cache."""
        found = pc.index_in(units, value_set=self.known)
        new = np.flatnonzero(np.asarray(found.is_null()))
        slots = np.asarray(found.fill_null(0)).astype(np.int64)
        if not len(new):
            return slots
        if len(self.known) + len(new) > CACHE_WORDS:
            old = np.flatnonzero(np.asarray(found.is_valid()))
            self.keep(slots[old])
            slots[old] = np.arange(len(old))
        ids, counts, order = self.encode(units.take(pa.array(new)))
        slots[new[order]] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, units.take(pa.array(new[order]))])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return slots

    def keep(self, slots: np.ndarray) -> None:
        """Empties the cache but for these."""
        self.known = self.known.take(pa.array(slots))
        self.ids = self.ids[runs(self.starts[slots], self.counts[slots])]
        self.counts = self.counts[slots]
        self.starts = np.cumsum(self.counts) - self.counts

    def encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units, one after another, how many each has, and the units' places
        in the order of these: plain ones first."""
        plain = self.plain(units)
        order = np.argsort(~np.asarray(plain), kind="stable")
        whole, others = units.filter(plain), units.filter(pc.invert(plain))
        pieces = whole.cast(pa.large_binary()).to_pylist()
        if not len(others):
            return *self.merges.encode(pieces), order
        index: dict = {p: i for i, p in enumerate(pieces)}  # bytes of a pre-token, or the id of a special string
        parts = list(range(len(pieces)))
        sizes = [1] * len(pieces)
        for word in others.to_pylist():
            before = len(parts)
            for piece in filter(None, self.split_special.split(word) if "<|" in word else [word]):
                if piece in self.special:
                    parts.append(index.setdefault(self.special[piece], len(index)))
                else:
                    parts += [index.setdefault(p, len(index)) for p in self.pretokens(piece)]
            sizes.append(len(parts) - before)
        ids, counts = self._joined(list(index), np.array(parts, dtype=np.int64), np.array(sizes, dtype=np.int64))
        return ids, counts, order

    def _joined(self, pieces: list, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units made of ``sizes`` pieces each, named by place in ``parts``."""
        flat, counts = self.merges.encode([p for p in pieces if isinstance(p, bytes)])
        named = [p for p in pieces if not isinstance(p, bytes)]
        is_named = np.fromiter((not isinstance(p, bytes) for p in pieces), dtype=bool, count=len(pieces))
        begin = np.empty(len(pieces), dtype=np.int64)
        begin[~is_named], begin[is_named] = np.cumsum(counts) - counts, len(flat) + np.arange(len(named))
        flat = np.concatenate([flat, np.array(named, dtype=np.int64)])
        each = np.ones(len(pieces), dtype=np.int64)
        each[~is_named] = counts
        return flat[runs(begin[parts], each[parts])], sums(each[parts], np.concatenate([[0], np.cumsum(sizes)]))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each text's ids."""
        words, codes, offsets = distinct_words(texts)
        units, at, begin = self.units(words)
        slots = self.slots(units)[at]
        per_unit = self.counts[slots]
        ids = self.ids[runs(self.starts[slots], per_unit)]       # of the distinct words
        per_word = sums(per_unit, begin)
        counts = per_word[codes]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids[runs((np.cumsum(per_word) - per_word)[codes], counts)], total[offsets]

    def decode(self, ids) -> str:
        """The library's ``decode(ids, skip_special_tokens=False)`` for a vocabulary
        file without a decoder: token strings with a space between."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    """One coder a worker process and vocabulary file."""
    return WordCoder(path)


def _encoded(path: str, text: str, keep: list[str], with_ids: bool):
    def work(batches):
        own = coder(path)
        numbers, names = pa.array(own.numbers), pa.array(own.names)
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                ids, offsets = own.encode_texts(text_column(batch, text))
                lists = [pa.LargeListArray.from_arrays(pa.array(offsets), x.take(pa.array(ids)))
                         for x in (numbers, names)]
                joined = [pc.binary_join(x, " ") for x in lists]
                digests = [pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in x], pa.string())
                           for x in joined]
                cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                cols += [pa.array(np.diff(offsets), pa.int64()), *digests]
                out = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids)).cast(pa.list_(pa.int32())),
                             joined[1].cast(pa.string())]
                    out += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=out)
    return work


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id",
                   with_ids: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text, as digests and, ``with_ids``, as
    columns ``ids`` and ``decoded``. ``path`` is the vocabulary file (word_bpe kind),
    which every worker reads for itself."""
    keep = [key] if key in df.columns else []
    schema = columns_kept(df.schema, keep) + (", " if keep else "")
    schema += "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return df.select(*keep, text).mapInArrow(released(_encoded(path, text, keep, with_ids)), schema)
