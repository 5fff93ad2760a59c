"""Infilling, periodic runs and substring deduplication against brute force, and on odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import infilling, periodic_runs, substrings
from tallygrove.llm._suffix import common_prefixes, suffix_array

ODD = [None, "", " ", "\n\t x", "x \r\n", "naïve 日本語 𝕏 ü", "\x00a\x1fb \x85c d", "a <P> b", "<S", "é" * 3000, "word " * 4000, "x" * 300_000]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdé𝕏") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: rng.choice([" ", "\n", "  "]).join(rng.choice(vocabulary) for _ in range(n))
    passage, made = prose(25), []
    for k in range(150):
        text = prose(rng.randint(0, 80))
        if k % 3 == 0:
            text += passage[: rng.randint(20, len(passage))] + prose(rng.randint(0, 30))
        if k % 10 == 0:
            text = "ab c" * rng.randint(1, 60) + text
        if k % 7 == 0 and made:
            text = rng.choice(made)
        if k % 11 == 0 and made and (old := rng.choice(made)):
            at = rng.randrange(len(old))
            text = old[:at] + "Z" + old[at + 1 :]
        made.append(text)
    return made + made[:3] + ODD


def frame(spark, texts, parts=5):
    return spark.createDataFrame([(k if k % 13 else None, t, k, "own") for k, t in enumerate(texts)], "doc_id long, text string, place long, output string").repartition(parts)


# infilling


def brute_infilling(doc_id, text):
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    x, y, z = ("".join(p) for p in (tokens[:a], tokens[a:b], tokens[b:]))
    return (n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 80 else (n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}")


def test_infilling_equals_brute_force_and_is_undone(spark, texts):
    made = infilling.fill_in_middle(frame(spark, texts)).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
    got = {r.place: r for r in made.collect()}
    assert len(got) == len(texts)
    forms = set()
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_infilling(r.doc_id, text or "")
        assert r.back == (text or "")
        forms.add(r.form)
    assert forms == {"plain", "spm", "psm"}


def test_exceptions_convert_both_ways():
    text = "aé日𝕏 b" * 50
    raw = text.encode()
    index = infilling.Exceptions(np.frombuffer(raw, np.uint8))
    points = np.arange(len(text) + 1)
    byte = np.array([len(text[:k].encode()) for k in points])
    assert (index.to_points(byte) == points).all() and (index.to_bytes(points) == byte).all()
    assert len(index.at) == 150
    assert len(infilling.Exceptions(np.frombuffer(b"plain", np.uint8)).at) == 0


# suffix arrays


def test_suffix_array_and_prefixes_equal_sorting():
    rng = random.Random(1)
    for _ in range(200):
        symbols, kinds = [], rng.choice([1, 2, 3])
        for k in range(rng.randint(1, 4)):
            symbols += [rng.randrange(kinds) for _ in range(rng.randint(0, 60))] + [10 + k]
        s = np.array(symbols)
        sa, inverse = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: symbols[i:]) and (inverse[sa] == np.arange(len(s))).all()
        shared, _ = common_prefixes(s, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            want = next((k for k, (x, y) in enumerate(zip(symbols[a:], symbols[b:], strict=False)) if x != y), 0)
            assert shared[b] == want


# periodic runs


def brute_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            begin = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at - begin + q >= max(least, exponent * q):
                found.setdefault((begin, at - begin + q), q)
            at += at == begin
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_equal_brute_force_on_all_alphabets():
    rng = random.Random(2)
    for _ in range(1500):
        sequences, symbols, at = [], [], []
        for k in range(rng.randint(1, 4)):
            kinds, n = rng.choice([1, 2, 3]), rng.randint(0, 60)
            own = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 8)
                own = [own[i] if i < a else own[min(a + (i - a) % p, n - 1)] for i in range(n)]
            at.append(len(symbols))
            sequences.append(own)
            symbols += [k * 10 + w for w in own] + [k * 10 + 9]
        least, exponent = rng.choice([(6, 4), (2, 2), (4, 3)])
        got = list(zip(*(x.tolist() for x in periodic_runs.periodic_runs(np.array(symbols), least, exponent)), strict=True))
        want = sorted((s + o, n, q) for own, o in zip(sequences, at, strict=True) for s, n, q in brute_runs(own, least, exponent))
        assert sorted(got) == want


def test_long_runs_take_seconds():
    start, length, period = periodic_runs.periodic_runs(np.append(np.tile(np.arange(50), 4000), 99))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [200_000], [50])
    start, length, period = periodic_runs.periodic_runs(np.append(np.zeros(100_000, np.int64), 1))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [100_000], [1])


BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_marked_runs_equal_brute_force(spark, texts):
    rng = random.Random(4)
    more = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["Ab ab " * 9, "x x x x x x tail", "x x x x x", "a b c a b c a b c a b", "a b c a b c a b c a b c"]
    rows = texts[:60] + ODD + more
    got = {r.place: r for r in periodic_runs.mark_runs(frame(spark, rows)).withColumn("best", periodic_runs.greatest(F.col("runs"))).collect()}
    assert len(got) == len(rows)
    for k, text in enumerate(rows):
        words = BLANK.findall(text or "")
        if len(words) > 3000:
            assert [tuple(r) for r in got[k].runs] == [(0, 4000, 1)] and got[k].collapsed == "word"
            continue
        runs = brute_runs(words)
        assert (got[k].n_words, [tuple(r) for r in got[k].runs], got[k].collapsed) == (len(words), runs, collapsed(words, runs))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert (tuple(got[k].best) if got[k].best else None) == best


def test_registered_runs_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in periodic_runs.op12_branching_tandem_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    long = 0
    for d in docs:
        words = BLANK.findall(d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            long += 1
            continue  # brute force is quadratic
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, best[1] * 1000 // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert long < len(docs) / 10


# substrings


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = collections.Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out.append((len(t), int(gone.sum()), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(b for b, x in zip(t, gone, strict=True) if not x)))
    return out


# one shard; several shards a name and several ranges; names of whole windows; odd lengths, long texts in pieces
@pytest.mark.parametrize(("length", "parts", "options"), [(40, 5, {"gram": 8}), (40, 5, {"gram": 8, "shard": 600, "merge_rows": 50}), (40, 5, {"gram": 40, "shard": 5000}), (30, 200, {"gram": 13, "piece": 16, "shard": 300, "merge_rows": 7})])
def test_removed_repeats_equal_brute_force(spark, texts, length, parts, options):
    rows = [t for t in texts if len(t or "") < 10_000] + ["y" * (length - 1), "v" * length, "w" * (length + 1), "z" * 500]
    got = {r.place: r for r in substrings.remove_repeats(frame(spark, rows, parts), length=length, **options).collect()}
    assert len(got) == len(rows)
    for k, want in enumerate(brute_repeats(rows, length)):
        assert (got[k].n_bytes, got[k].n_removed, [tuple(s) for s in got[k].spans], bytes(got[k].kept)) == want
        assert (got[k].text, got[k].output) == (rows[k], "own")


def test_removed_repeats_of_very_long_and_equal_rows(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, "x" + long[5000:6000] + "y"), (3, "z" * 2000), (3, "z" * 2000), (None, long[:399]), (None, None), (4, long[:400])]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, [tuple(s) for s in r.spans]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), piece=70_000, keep_text=False).collect())
    assert got == sorted([("1", 300_000, 1400, [(0, 400), (5000, 6000)]), ("2", 1002, 1000, [(1, 1001)]), ("3", 2000, 2000, [(0, 2000)]), ("3", 2000, 2000, [(0, 2000)]), ("None", 399, 0, []), ("None", 0, 0, []), ("4", 400, 400, [(0, 400)])])


def test_registered_repeats_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in substrings.op13_suffix_array_dedup(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, (n, removed, spans, kept) in zip(docs, brute_repeats([d.text for d in docs], 400), strict=True):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, len(spans), hashlib.sha256(kept).hexdigest())


def test_registered_repeats_return_the_text_that_is_left(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n))
    passage, short, tail = prose(55), " ".join(w[:5] for w in prose(67).split())[:398], prose(60)
    rows = [
        (1, f"One. {passage} Two."), (2, f"Three: {passage}; four"),  # over 50 words, over 400 bytes: goes
        (3, f"Five. {short}X"), (4, f"Six! {short}Y"),  # over 50 words, but the same 399 bytes: stays
        (5, f"é{tail}"), (6, f"©{tail}"),  # equal from the second byte of the first character on
        (7, None), (8, "日本語"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in substrings.op13_suffix_array_dedup(spark, str(tmp_path)).collect()}
    for (k, text), (n, removed, spans, kept) in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, len(spans), hashlib.sha256(kept).hexdigest())
        assert r.text == ("\ufffd" if k in (5, 6) else kept.decode())
        assert passage not in r.text and (k not in (3, 4) or r.text == text)
    assert got[1].n_removed >= len(passage) and got[5].n_removed == len(tail) + 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, runs string, kept string")
    assert infilling.fill_in_middle(none).count() == periodic_runs.mark_runs(none).count() == substrings.remove_repeats(none).count() == 0
