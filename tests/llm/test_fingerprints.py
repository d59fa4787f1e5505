"""Operator 7: edited texts exactly, likeness against the true similarity."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from funnelkit.llm.fingerprints import document_fingerprints, fingerprint_texts, signatures
from tests.llm.helpers import documents, odd_docs, odd_texts


def likeness(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_neighbours_and_likeness(spark):
    extra = [(5000 + i, t, "en", "s", 0) for i, t in enumerate(t for t in odd_texts() if t is None or t.isascii() and "\x1c" not in t)]
    df = documents(spark).unionAll(spark.createDataFrame(extra, documents(spark).schema)).repartition(5)
    rows = {r.doc_id: r for r in document_fingerprints(df).collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    order = sorted(texts, reverse=True)
    assert len(rows) == len(order)
    by_text, errors = {}, []
    for n, i in enumerate(order):
        text, after, row = texts[i], texts[order[(n + 1) % len(order)]], rows[i]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert by_text.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint
        assert row.near_next == _share(row.fingerprint, rows[order[(n + 1) % len(order)]].fingerprint)
        assert row.near_edited == _share(row.fingerprint, row.edited_fingerprint)
        if text.split() and edited.split():
            errors.append(row.near_edited - likeness(text, edited))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def _share(a, b):
    return sum(a[i:i + 4] == b[i:i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def test_weights_count():
    """Collision rate equals the generalised Jaccard similarity of the counts."""
    a = " ".join(f"w{i} " * (1 + i % 5) for i in range(40))
    b = " ".join(f"w{i} " * (1 + i % 3) for i in range(50))
    sig = signatures(pa.array([a, b], pa.large_string()), 4096)
    assert abs((sig[0] == sig[1]).mean() - likeness(a, b)) < 0.03


def test_samples_use_all_bits():
    """Every bit of a sample is set in half of the draws; zero is left to empty texts."""
    sig = signatures(pa.array([f"w{i}" for i in range(5000)] + ["", " "], pa.large_string()), 4)
    for bit in range(16):
        assert abs((sig[:5000] >> bit & 1).mean() - 0.5) < 0.04
    assert sig[:5000].min() > 0 and not sig[5000:].any()


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = document_fingerprints(df).collect()
    assert len(rows) == df.count() and document_fingerprints(df.limit(0)).count() == 0
    assert document_fingerprints(df.limit(1)).first().near_next == 1.0
    plain = {(r.doc_id, r.fingerprint) for r in fingerprint_texts(df).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in rows}


def test_repeated_id_is_spread(spark):
    """An id that most rows have is dealt into several ranges."""
    df = spark.range(4000).selectExpr("case when id < 3500 then 7 else id end as doc_id", "concat('text ', id) as text")
    from funnelkit.llm.fingerprints import neighbour_ranges
    sizes = [r["count"] for r in neighbour_ranges(df, "doc_id", "text", 8).where("not ahead").groupBy("range").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
