"""Operators 6 and 10 against brute force."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from funnelkit.llm.line_dedup import line_dedup
from funnelkit.llm.quality import host_verdicts, keep_good, quality_rules
from tests.llm.helpers import documents, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_figures_and_verdicts(spark):
    for df in (documents(spark), odd_docs(spark)):
        rows = df.collect()
        got = defaultdict(set)
        result = quality_rules(df).collect()
        for r in result:
            got[r.doc_id].add(tuple(r)[1:7])
        assert len(result) == len(rows)
        assert got == {r.doc_id: {figures(t.text) for t in rows if t.doc_id == r.doc_id} for r in rows}
        assert all(not r.kept for r in result if r.base_failed)


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short"
    rows = [(i, good, "en", "clean", 0) for i in range(60)] + [(100 + i, bad, "en", "junk", 0) for i in range(50)]
    rows += [(200 + i, good, "en", "junk", 0) for i in range(5)] + [(300, bad, "en", "tiny", 0), (301, good, "en", "tiny", 0)]
    rows += [(400 + i, good, "en", f"h{i % 6}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id: r.kept for r in quality_rules(df).collect()}
    assert not any(kept[i] for i in range(200, 205)) and kept[301] and all(kept[i] for i in range(60))
    stage = keep_good(df)
    assert stage.columns == df.columns
    assert sorted(r.doc_id for r in stage.collect()) == sorted(i for i, k in kept.items() if k)
    rates = {r.host: r for r in host_verdicts(quality_rules(df).join(df.select("doc_id", "source"), "doc_id"), "source").collect()}
    assert 0 < rates["clean"].rate < 0.1 and rates["tiny"].rate < 0.5 < rates["junk"].rate


def test_quality_of_nothing(spark):
    none = odd_docs(spark).limit(0)
    assert quality_rules(none).count() == 0 and keep_good(none).count() == 0


def lines_of(rows, ratio=0.1, min_pages=2):
    pages, times = Counter(r.source for r in rows), Counter()
    worded = lambda x: WORD.search(x) is not None
    for r in rows:
        times.update({(r.source, line) for line in (r.text or "").split("\n") if worded(line)})
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, None, 0))
            continue
        every = r.text.split("\n")
        left = [x for x in every if not (worded(x) and times[(r.source, x)] >= min_pages
                                         and times[(r.source, x)] > ratio * pages[r.source])]
        out.append((r.doc_id, "\n".join(left), len(every) - len(left)))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    rows = [(i, f"Nav bar {i % 3 and 'x'}\nbody of page {i} in {i * 7}\n\nfooter\n{'rare' if i < 3 else 'other %d' % i}",
             "en", "a" if i < 40 else None, 0) for i in range(60)]
    rows += [(90 + i, "copy one\ncopy two", "en", "a", 0) for i in range(30)]  # each copy is a page
    rows += [(200 + i, f"all\nthe same\nhere\n{i}", "en", "b", 0) for i in range(10)]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "footer", "en", "a", 0), (400, "alone\nagain\nagain", "en", "c", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for df, args in ((df, (0.1, 2)), (df, (0.5, 2)), (df, (0.05, 5)), (odd_docs(spark), (0.1, 1)), (documents(spark), (0.1, 3))):
        got = line_dedup(df, ratio=args[0], min_pages=args[1], count="n_dropped")
        assert got.columns == [*df.columns, "n_dropped"]
        found = sorted(((r.doc_id, r.text, r.n_dropped) for r in got.collect()), key=repr)
        assert found == lines_of(df.collect(), *args)
    assert line_dedup(df.limit(0)).count() == 0


def test_working_names_are_the_callers_too(spark):
    df = odd_docs(spark, clash=False)
    for c in ("__row", "__kept", "__drop", "__host", "lines", "row", "d"):
        df = df.withColumn(c, F.lit(c))
    got = line_dedup(df, ratio=0.05)
    assert got.columns == df.columns and all(r["__kept"] == "__kept" and r.lines == "lines" for r in got.collect())
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == [x[:2] for x in lines_of(df.collect(), 0.05)]


def test_short_pages_lose_their_frame(spark):
    """Lines above the ratio go from every page, also where they are most of it."""
    rows = [(i, f"top of the frame\n{'a body of its own ' * 9}{i}\nend of the frame", "en", "a", 0) for i in range(20)]
    rows += [(100, "top of the frame\nown\nend of the frame", "en", "a", 0), (101, "top of the frame\n\nend of the frame", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup(df, count="n_dropped").collect()}
    assert got[100] == ("own", 2) and got[101] == ("", 2) and all(got[i] == (rows[i][1].split("\n")[1], 2) for i in range(20))
    assert sorted(((i, *x) for i, x in got.items()), key=repr) == lines_of(df.collect())
    stage = corpus_pipeline.line_stage(spark, df, "")
    assert {r.doc_id: r.text for r in stage.collect()} == {i: t for i, (t, _) in got.items()}
