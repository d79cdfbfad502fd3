"""Source audit, repeated passages and fill-in-the-middle, against plain Python and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from batchloom.llm import fill_in_middle as fim
from batchloom.llm import queries
from batchloom.llm import source_audit as audit
from batchloom.llm import substring_dedup as dedup
from tests.conftest import TESTDATA
from tests.llm.test_llm import CLASHES, DOCS, LONG, ODD, empty, odd  # noqa: F401

SF = str(TESTDATA / "sf0.001")


@pytest.mark.parametrize("name", ["op11_source_audit", "op12_substring_dedup", "op13_fill_in_middle"])
def test_against_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, SF).select(columns)
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert text(found.collect()) == text(want.fetchall())


# 11: source audit


def brute_audit(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = [t.encode().lower().decode() for t in term.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {lang for lang, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(own.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}  # noqa: B023

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in own if o != s}
            terms = {t: f(p[s][t], q[t]) for t in kept if own[s][t] and p[s][t] > q[t]}
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:n]
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def audited(docs, **options):
    return sorted(tuple(r) for r in audit.audited(docs, **options).collect())


@pytest.mark.parametrize("min_docs", [1, 2, 5])
def test_audit_by_hand(spark, monkeypatch, min_docs):
    monkeypatch.setattr(audit, "HELD", 20)
    monkeypatch.setattr(audit, "CELLS", 50)
    rng = random.Random(min_docs)
    word = lambda: rng.choice(["A", "é", "zz", "Ünter", "x" * 9, "😀"]) * rng.randint(1, 3)
    rows = [
        (i, " 1-".join(word() for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]),
         rng.choice(["s", "s", "t", "", None, "ü"]), 0)
        for i in range(90)
    ]
    rows += [(90, "only", "fr", "s", 0), (91, None, "it", "s", 0), (92, "", "it", "t", 0), *rows[:3]]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert audited(docs, min_docs=min_docs, top=3) == brute_audit(rows, min_docs, 3)


def test_audit_odd_rows(odd, empty):  # noqa: F811
    for docs in (odd, odd.drop(*CLASHES)):
        assert audited(docs, min_docs=1) == brute_audit(ODD, 1, 10)
    assert audited(empty) == []


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 9 * 10**18, 9 * 10**18 + 5, 10**12 + 1
    want = 1 + 10**9 * (n + 2) // (total + 2 * terms)
    assert audit._shares(np.array([n, 0]), total, terms).tolist() == [want, 1 + 2 * 10**9 // (total + 2 * terms)]
    df = spark.createDataFrame([(n, total, terms)], "n long, t long, v long")
    assert df.select(audit.share(df.n, df.t, df.v)).first()[0] == want


def test_run_boundaries_are_intersected():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 3, 40) * 10**8, rng.integers(0, 2, 40) * 10**9
        a, b, lengths = a + 1, b + 1, rng.integers(1, 5, 40)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        columns = [(audit.run_length(x), x[audit.run_length(x)]) for x in (a, b)]
        assert audit.pair_sum(*columns, ends) == int(((a - b) ** 2 // (a + b) * lengths).sum())


# 12: repeated passages


def brute_dedup(rows, window):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1 if doc is not None else 0):
            seen = tuple(words[i : i + window])
            first[seen] = min(first.get(seen, doc), doc)
    out = []
    for doc, text in rows:
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((doc, len(words), len(gone), kept))
    return sorted(out, key=str)


def deduped(docs, **options):
    return sorted((tuple(r) for r in dedup.without_repeats(docs, **options).collect()), key=str)


HARD = [(8, 3, 200, 2_000), (8, 3, 200, 3), (8, 8, 50, 5), (5, 1, 10**6, 10), (1, 1, 100, 2), (50, 10, 999, 9)]


@pytest.mark.parametrize("window, gram, shard_words, crowded", HARD)
def test_passages_by_hand(spark, window, gram, shard_words, crowded):
    """Three different words only, a passage in a third of the texts, and changed copies."""
    rng = random.Random(5)
    words = lambda n: [rng.choice("abc") for _ in range(n)]
    shared, rows = words(14), []
    for i in range(300):
        kind = rng.random()
        if kind < 0.2:
            text = words(rng.randint(0, 40))
        elif kind < 0.6 or not rows:
            text = words(rng.randint(0, 12)) + shared + words(rng.randint(0, 12))
        else:
            text = rng.choice(rows)[1].split()
            text[rng.randrange(len(text)) if text else 0 :][:1] = ["z"]
        doc = i if rng.random() < 0.95 else rng.choice([None, i - 1])
        rows.append((doc, rng.choice([" ", "\n", "\t  "]).join(text)))
    rows += [(5, rows[5][1]), (None, None), (900, ""), (7, rows[10][1]), (-3, rows[20][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = deduped(docs, window=window, gram=gram, shard_words=shard_words, crowded=crowded)
    assert found == brute_dedup(rows, window)


def test_passages_odd_rows(odd, empty):  # noqa: F811
    rows = [r[:2] for r in ODD]
    assert deduped(odd) == brute_dedup(rows, dedup.WINDOW)
    copies = [(11, LONG), (12, "x " + LONG), (13, LONG[:400] + " y")]
    docs = odd.select("doc_id", "text").unionByName(odd.sparkSession.createDataFrame(copies, "doc_id long, text string"))
    assert deduped(docs) == brute_dedup(rows + copies, dedup.WINDOW)
    assert deduped(empty) == []


def test_index_finds_every_window():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 7, 50):
        texts = [rng.integers(1, 4, depth + int(n)) for n in rng.integers(0, 30, 20)]
        owners = rng.permutation(20) * 10
        index = dedup.FmIndex(texts, owners, depth)
        least = {}
        for text, owner in zip(texts, owners, strict=True):
            for i in range(len(text) - depth + 1):
                key = tuple(text[i : i + depth])
                least[key] = min(least.get(key, owner), owner)
        for text, intervals in zip(texts, index.search(texts), strict=True):
            want = [least[tuple(text[i : i + depth])] for i in range(len(intervals))]
            assert index.least[intervals].tolist() == want


def test_wavelet_ranks():
    rng = np.random.default_rng(4)
    for symbols in (1, 2, 3, 17, 256):
        sequence = rng.integers(0, symbols, 1_000)
        matrix = dedup.WaveletMatrix(sequence, symbols)
        what, where = rng.integers(0, symbols, 200), rng.integers(0, 1_001, 200)
        want = [int((sequence[:w] == s).sum()) for s, w in zip(what, where, strict=True)]
        assert matrix.rank(what, where).tolist() == want


# 13: fill in the middle


def brute_fim(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in fim.SENTINELS):
        return doc, len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_by_hand(spark, odd):  # noqa: F811
    rng = random.Random(1)
    marks = ["<P>", "<S>", "<M>", "<", "<S", "S>", "<P", ">", "\n", "é\n", "😀", "x" * 300, "\n\n", "a"]
    rows = [(i, "".join(rng.choices(marks[3:], k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(300 + i, "".join(rng.choices(marks, k=9))) for i in range(60)]
    rows += [(400, "\n" * 5_000 + "x" * 9_999 + "\n" * 99), (401, "line of text\n" * 40_000), (None, "a\nb"), (1, None), (2, "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = fim.transformed(docs)
    found = [tuple(r) for r in made.drop("segments").collect()]
    assert sorted(found, key=str) == sorted((brute_fim(*r) for r in rows), key=str)
    back = made.select(fim.restored(made.output, made.form).alias("text")).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in rows)
    found = [tuple(r) for r in fim.transformed(odd).drop("segments").collect()]
    assert sorted(found, key=str) == sorted((brute_fim(*r[:2]) for r in ODD), key=str)


def test_rates(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('ab\\n', 9) as text")
    forms = Counter(r["form"] for r in fim.transformed(docs, fim_percent=30, spm_percent=0).collect())
    assert set(forms) == {"plain", "psm"} and 80 < forms["psm"] < 160
    assert {r["form"] for r in fim.transformed(docs, spm_percent=100).collect()} == {"spm"}


def test_learned_offsets_are_exact_and_few():
    rng = np.random.default_rng(1)
    even, jumps = np.full(200_000, 61), np.where(rng.random(5_000) < 0.01, 10**7, 3)
    for lengths in (even, jumps, rng.integers(1, 200, 50_000), np.array([2**31]), np.array([], int)):
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ranks, starts, slopes, residuals = fim.learned(offsets)
        k = np.arange(len(offsets))
        own = np.searchsorted(ranks, k, "right") - 1
        predicted = np.array(starts)[own] + ((np.array(slopes)[own] * (k - np.array(ranks)[own])) >> fim.SCALE_BITS)
        residuals = np.frombuffer(residuals, np.int8)
        assert (predicted + residuals == offsets).all()
        assert np.abs(residuals.astype(int)).max() <= fim.BOUND + 2
        assert len(ranks) <= (1 if lengths is even else len(offsets))


def test_forms_of_no_rows(empty):  # noqa: F811
    assert fim.digest(fim.transformed(empty)).collect() == []
