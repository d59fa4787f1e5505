"""Operators 1, 4 and 5 against the tokenizers library."""

import hashlib
import struct
import zlib
from collections import defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from funnelkit.llm import bpe  # noqa: E402
from funnelkit.llm.bpe import bpe_round_trip  # noqa: E402
from funnelkit.llm.packing import pack_power_of_two, piece_lengths, write_buckets  # noqa: E402
from funnelkit.llm.token_counts import frequent_groups, token_counts  # noqa: E402
from tests.llm.helpers import documents, odd_docs, odd_texts  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(path):
    t = Tokenizer.from_file(path)
    return t, lambda s: t.encode(s or "", add_special_tokens=False).ids


def both(spark):
    return documents(spark, 80).select("doc_id", "text").unionAll(odd_docs(spark).select("doc_id", "text"))


def test_bpe_equals_library(spark):
    t, ids = library_ids(WORD)
    df = both(spark)
    got = defaultdict(list)
    for r in bpe_round_trip(df, WORD, with_ids=True).collect():
        got[r.doc_id].append(r)
    rows = df.collect()
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        want = ids(r.text)
        for g in got[r.doc_id]:
            decoded = t.decode(want, skip_special_tokens=False)
            assert g.ids == want and g.n_tokens == len(want) and g.decoded == decoded
            assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert g.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_tree_alone_and_together_agree():
    own = bpe.coder(WORD)
    words = [w for t in odd_texts() if t for w in t.lower().split()][:400]
    words = [w.encode() for w in words if w.isascii()]
    flat, counts = own.merges.encode(words)
    at = 0
    for word, n in zip(words, counts):
        ids, _ = own.merges.symbols([word])
        assert own.merges.merge_alone(ids.tolist()).tolist() == flat[at:at + n].tolist()
        at += n


def test_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.WordCoder(WORD)
    _, ids = library_ids(WORD)
    import pyarrow as pa
    for text in ("one two three", "four five two", "six one nine ten"):
        found, _ = own.encode_texts(pa.array([text], pa.large_string()))
        assert found.tolist() == ids(text)


def test_words_split_at_once_or_alone_equal_library():
    import pyarrow as pa
    own, (_, ids) = bpe.WordCoder(WORD), library_ids(WORD)
    odd = ["", " ", "Straße ÀÖØÞ éÈ", "x×y ÷ ª º µ", "it's IT'S 'tis don't'll", "a1b22-33", "İI ı ŉ ǆ", "a\u00a0b a\u0085b",
           "soft\u00adhyphen", "<|endoftext|>a<|startoftext|> <|x", "e\u0301 \ufb01 Ⅷ", "a\x1cb\x00c\x7f", "ÿŸ ж漢字", "' '' 's's",
           "A" * 300 + "é" * 90, "tab\tnew\nline  x"]
    for texts in (odd, odd[::-1], [" ".join(odd)], ["".join(odd)], []):
        found, offsets = own.encode_texts(pa.array(texts, pa.large_string()))
        assert [found[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids(x) for x in texts]


def test_a_piece_is_merged_once_for_all_words_that_hold_it(monkeypatch):
    import pyarrow as pa
    own, merged = bpe.WordCoder(WORD), []
    whole = own.merges.encode
    monkeypatch.setattr(own.merges, "encode", lambda words: merged.extend(words) or whole(words))
    for text in ("thear", "Thear, THEAR", "(thear) ,", "thear."):
        own.encode_texts(pa.array([text], pa.large_string()))
    assert sorted(merged) == sorted([b"thear", b",", b"(", b")", b"."])


def test_the_cache_is_small():
    """Two workers an executor keep it through all stages of the pipeline."""
    import gc
    import tracemalloc

    import pyarrow as pa
    own = bpe.WordCoder(WORD)
    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in str(i)) for i in range(100_000, 140_000)]
    texts = pa.array([" ".join(words)], pa.large_string())
    del words
    tracemalloc.start()
    try:
        before = pa.total_allocated_bytes()
        own.encode_texts(texts)
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 60 * 40_000, held


def test_a_worker_stays_small():
    """Memory of numpy and Python while 6.8 MB of text are packed, beyond text and coder."""
    import tracemalloc

    import pyarrow as pa

    from funnelkit.llm.batches import released
    from funnelkit.llm.packing import _pieces
    bpe.coder(WORD)
    line = " ".join(f"word{i % 977} and{i % 31}" for i in range(1000))
    batch = pa.record_batch({"doc_id": range(500), "text": [line] * 500})
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in released(_pieces(WORD, "text", ["doc_id"], 2048, 1, True))([batch])]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == 3000 and most < 25 << 20, (sizes, most)


def test_token_counts_equal_library(spark):
    _, ids = library_ids(BYTE)
    df = both(spark)
    want = defaultdict(int)
    for r in df.collect():
        n = len(ids(r.text))
        want[(r.doc_id, len((r.text or "").encode()), n, n > 1024)] += 1
    got = defaultdict(int)
    for r in token_counts(df, BYTE, table_size=50).collect():
        got[tuple(r)] += 1
    assert got == want


def test_table_is_bounded_and_frequent(spark):
    df = spark.createDataFrame([(1, "x the the the of of zebra the"), (2, "y the of the")], "doc_id bigint, text string")
    table = frequent_groups(df, BYTE, table_size=4)   # a quarter of the eleven groups or more
    assert table == {"the": 1}
    assert len(frequent_groups(documents(spark), BYTE, table_size=20)) <= 20
    assert frequent_groups(df.limit(0), BYTE) == {}


def test_piece_lengths():
    assert piece_lengths(1) == [1]
    assert piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 300):
        assert sum(piece_lengths(n, 16)) == n and all(p & (p - 1) == 0 for p in piece_lengths(n, 16))
    with pytest.raises(ValueError):
        pack_power_of_two(None, WORD, max_len=1000)


def test_packing(spark, tmp_path):
    _, ids = library_ids(WORD)
    df = both(spark)
    pieces = pack_power_of_two(df, WORD, max_len=64)
    rows = pieces.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    held = defaultdict(list)
    for r in rows:
        held[r.doc_id].append(r)
        assert len(r.ids) == r.length <= 64 and r.length & (r.length - 1) == 0
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(ids(r.text) + [1])
    for doc, want in texts.items():
        whole = sorted((p.start, p.length) for p in held[doc])
        assert whole == sorted((s, n) for w in want for s, n in _cuts(len(w), 64))
        for p in held[doc]:
            assert any(p.doc_tokens == len(w) and w[p.start:p.start + p.length] == p.ids for w in want)
    write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == len(rows) and back.where("size(ids) <> bucket").count() == 0


def test_pieces_come_bucket_by_bucket(spark, tmp_path):
    for with_ids in (True, False):
        path = str(tmp_path / str(with_ids))
        pack_power_of_two(both(spark).repartition(3), WORD, max_len=64, with_ids=with_ids).write.parquet(path)
        files = defaultdict(list)
        for r in spark.read.parquet(path).select("*", "_metadata.file_path").collect():
            files[r.file_path].append(r.length)
        assert len(files) == 3 and all(x == sorted(x, reverse=True) and len(set(x)) > 3 for x in files.values())


def _cuts(n, most):
    at = 0
    for p in piece_lengths(n, most):
        yield at, p
        at += p


def test_empty_tables(spark):
    none = odd_docs(spark).limit(0)
    assert bpe_round_trip(none, WORD).count() == 0
    assert token_counts(none, BYTE).count() == 0
    assert pack_power_of_two(none, WORD).count() == 0
