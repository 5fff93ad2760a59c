"""The corpus operators against brute force, round trips, held-out accuracy and odd inputs."""

import array
import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrove.plans.lineage import checkpointed
from tallygrove.llm import decontamination, dedup, language_id, nearest, packing, privacy, quality, queries, toxicity, url_rules, warc
from tallygrove.llm._text import Words

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def words(text):
    return WORD.findall(lowered(text))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéüñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 120))) for _ in range(120)]
    for k in range(30):  # near copies of the first texts, from slight to heavy edits
        own = made[k % 6].split(" ")
        for _ in range(k % 9):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        made.append(" ".join(own))
    return made + made[:10] + [None, "", None, "", "one two three", "one two three", "Ab", "x" * 3000 + " " + "é" * 70_000, "??? !!!"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k if k % 37 else None, t, "en" if k % 2 else None, None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_words_equal_the_pattern(texts):
    odd = [*texts, "A\x00b\x7fC", "naïve-Ünï 9z", "日本 語1", "{z}"]
    w = Words(pa.array(odd, pa.string()))
    for k, t in enumerate(odd):
        raw = lowered(t).encode()
        assert [raw[a:b].decode() for a, b in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]], strict=True)] == words(t)
    seen = {}
    for k, t in enumerate(odd):
        for h, x in zip(w.hash[w.first[k] : w.first[k + 1]].tolist(), words(t), strict=True):
            assert seen.setdefault(h, x) == x
    assert len(seen) == len({x for t in odd for x in words(t)})


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 3000)
    text[[0, -1]] = 0
    index = decontamination.FMIndex(text, 4)
    for n in (1, 3, 6):
        windows = np.array([w for w in itertools.product((1, 2, 3), repeat=n)][:80])
        low, high = index.search(windows)
        for w, a, b in zip(windows, low, high, strict=True):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == w).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_equals_brute_force(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 300)
    items = [(1, " ".join(words(texts[0])[:25])), (22, texts[3][:200].upper()), (3, "one two"), (None, texts[5]), (5, None), (6, "!!!"), (22, " ".join(words(texts[7])[5:17]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 40):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
        got = decontamination.mark_contamination(docs, bench).collect()
        assert len(got) == docs.count()
        for r in got:
            own, hit, found = words(r.text), set(), set()
            for i, t in items:
                item = words(t)
                n = min(10, len(item))
                for k in range(len(item) - n + 1 if n and i is not None else 0):
                    for at in range(len(own) - n + 1):
                        if own[at : at + n] == item[k : k + n]:
                            hit.update(range(at, at + n))
                            found.add(str(i))
            assert (r.n_words, r.n_hit, r.item_ids) == (len(own), len(hit), sorted(found))
    cleaned = decontamination.remove_passages(docs, bench)
    assert cleaned.columns == docs.columns
    assert decontamination.mark_contamination(cleaned, bench.where("item_id <> 3")).where("n_hit > 0").count() <= 1


def brute_classes(texts, threshold=0.8):
    made = []
    for t in texts:
        own = words(t)
        grams = [tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))] if own else []
        made.append(collections.Counter(grams))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = made[a], made[b]
        both = x.keys() & y.keys()
        if both:
            plain = len(both) / len(x.keys() | y.keys())
            weighted = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in both)
            if max(plain, weighted) >= threshold:
                parent[root(a)] = root(b)
    classes = collections.defaultdict(set)
    for k in range(len(texts)):
        classes[root(k)].add(k)
    return {frozenset(c) for c in classes.values()}


def test_near_duplicates_equal_brute_force(spark, texts):
    for n, block in ((1, 1024), (6, 8), (3, 3)):
        dedup.BLOCK, before = block, dedup.BLOCK
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(n)
        got = dedup.near_duplicates(rows).collect()
        dedup.BLOCK = before
        classes = collections.defaultdict(set)
        for r in got:
            classes[r.class_id].add(r.doc_id)
        assert {frozenset(c) for c in classes.values()} == brute_classes(texts)
        assert all(min(c) == k for k, c in classes.items())
        assert sum(r.kept for r in got) == len(classes)


def test_near_duplicates_of_hot_keys(spark, docs, monkeypatch):
    rows = lambda: sorted(map(str, dedup.near_duplicates(docs).select("class_id", "copies", "kept").collect()))
    plain = rows()
    monkeypatch.setattr(dedup, "HOT", 1)
    assert rows() == plain
    left = spark.createDataFrame([(k % 3, k) for k in range(20)] + [(9, 99)], "k long, v long")
    table = spark.createDataFrame([(0, "a", 7), (1, "b", 7), (2, "c", 1)], "k long, x string, n long")
    for most in (1, 5, 100):
        assert sorted((r.v, r.x or "") for r in dedup.looked_up(left, table, ["k"], "n", most).collect()) == sorted([(k, "abc"[k % 3]) for k in range(20)] + [(99, "")])


def test_components_are_sought_over_few_links_of_near_copies(spark, monkeypatch):
    rng, base, seen, plain = random.Random(4), [f"w{k}" for k in range(300)], [], dedup.components
    texts = [" ".join(w if k != at else f"x{at}" for k, w in enumerate(base)) for at in rng.sample(range(300), 120)]
    monkeypatch.setattr(dedup, "components", lambda links: seen.append(links.count()) or plain(links))
    got = dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}
    assert sum(seen) < 2 * len(texts)


def test_merged_labels_are_those_of_all_links(spark):
    rng = random.Random(5)
    links = [tuple(sorted(rng.sample(range(90), 2))) for _ in range(70)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    listed = lambda labels: sorted((r.node, r.comp) for r in labels.collect())
    whole = listed(dedup.components(frame(links)))
    assert listed(dedup.components(dedup.star(frame(links)))) == whole
    labels = dedup.components(frame(links[:25]))
    for at in (25, 45):
        labels = dedup.merged(labels, frame(links[at : at + 25]))
    assert listed(labels) == whole


def test_near_duplicates_of_equal_ids_and_very_long_texts(spark):
    long = " ".join(f"w{k * 7919 % 100_003}" for k in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, "other words " * 3), (3, long.upper()), (None, long)]
    kept = []
    for parts in (1, 4):
        got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.class_id) for r in got) == [("1", 1), ("2", 1), ("3", 1), ("3", 3), ("None", 1)]
        kept.append(sorted((r.class_id, r.doc_id) for r in got if r.kept))
    assert kept[0] == kept[1] == [(1, 1), (3, 3)]


def test_near_duplicates_verify_all_that_the_sketches_allow(spark):
    # each text is 0.8 like its twin and, with one of two slots in common, 0.787 like many others
    rng, texts = random.Random(8), []
    for slots in rng.sample(list(itertools.combinations(range(5, 120, 8), 2)), 80):
        for shift in (0, 2):
            own = [f"w{k}" for k in range(130)]
            for at in slots:
                own[at + shift] = f"x{at}y{shift}z{len(texts)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    bands, rows = 8, 2
    row, value, count = dedup.shingles(Words(pa.array(texts)), 5)
    held = dedup.prob_minhash(len(texts), row, value, count.astype(float), bands * rows)
    low = held.astype(np.uint8)
    sets = [set(value[row == k].tolist()) for k in range(len(texts))]
    least = 0.8 - dedup.MARGIN * (0.8 * 0.2 / (bands * rows)) ** 0.5
    to = list(range(len(texts)))

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        banded = (held[a] == held[b]).reshape(bands, rows).all(axis=1).any()
        if banded and ((low[a] == low[b]).mean() - 1 / 256) / (1 - 1 / 256) >= least and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            to[max(root(a), root(b))] = min(root(a), root(b))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(table, bands=bands, rows=rows).collect()}
    assert got == {k: root(k) for k in range(len(texts))}


def test_near_duplicates_with_a_repeated_line(spark):
    base, line = [f"w{k}" for k in range(104)], [f"line{k}" for k in range(9)]
    some = [*base[:40], *line, *base[40:95]]
    often = [*base[:40], *line * 50, *base[40:95]]
    other = [*base[:40], *line * 20, *base[40:94], "end"]
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate((some, often, other, base[::-1]))], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(table).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = np.arange(1, 201, dtype=np.uint64), np.arange(61, 261, dtype=np.uint64)
    x, y = rng.integers(1, 6, 200), rng.integers(1, 6, 200)
    held = dedup.prob_minhash(2, np.repeat([0, 1], 200), dedup.mixed(np.concatenate([a, b])), np.concatenate([x, y]).astype(float), 4096)
    exact, _ = dedup.similarities(a, x, b, y)
    assert (held[0] == held[1]).mean() == pytest.approx(exact, abs=0.04)


def test_near_duplicates_of_empty_and_clashing(spark, docs):
    assert dedup.near_duplicates(docs.where("false")).count() == 0
    got = dedup.near_duplicates(docs.withColumns({"node": F.lit(1), "key": F.lit(2), "sig": F.lit("x"), "rid": F.lit(1)}))
    assert got.count() == docs.count()


def test_tokens_equal_the_tokenizer(texts):
    path = public_tokenizers.path(packing.VOCABULARY)
    plain, ours = Tokenizer.from_file(path), packing.WordTokens(path)
    odd = [*texts, "Hello <|endoftext|> World", "<|ENDOFTEXT|> it's WE'LL", "İstanbul ΣΑΣ é a\tb\r\n c\x85d", "12.5% x² 日本語", "!!??" * 50, "  \n a  b\xa0c\u3000d ", " ", "e\u0301 \u0301x", "\x1c a\x0b\x0cb"]
    rng = random.Random(2)
    odd += ["".join(rng.choice("aAbßÉéÿ×÷'’s12 .,\n\tñÑ<|>µ²\u0301ΣİªẞÀ\xa0") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text, raw in zip(odd, ours.encode(pa.array(odd, pa.string())), strict=True):
        assert list(np.frombuffer(raw, "<u4")) == plain.encode(text or "", add_special_tokens=False).ids


def test_packing_is_gapless_and_complete(spark, docs, texts):
    tokens = packing.WordTokens(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack_documents(docs, keep_ids=True)
    rows = got.collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(array.array("I", r.ids).tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(x) // 4 + 1 for x in tokens.encode(pa.array(texts)))
    assert len(by_sequence) <= 1.1 * sum(r.length for r in rows) / 2048 + 1
    assert packing.sequences(got).agg(F.sum(F.size("ids"))).first()[0] == sum(r.length for r in rows)
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_sum_of_squares_choice():
    bins, offsets, fill = packing.sum_of_squares(np.array([6, 4, 5, 5]), 10)
    assert fill.tolist() == [10, 10] and bins.tolist() == [0, 0, 1, 1] and offsets.tolist() == [0, 6, 0, 5]


def naive_sum_of_squares(lengths, capacity):
    """Each piece where the sum over gaps of squared counts of open bins is smallest; ties to an exact fit, then the smallest gap."""
    bins = []
    for size in lengths:
        def cost(k):
            gaps = [capacity - b for b in bins]
            if k is None:
                gaps.append(capacity - size)
            else:
                gaps[k] -= size
            return sum(n * n for g, n in collections.Counter(gaps).items() if g)

        choices = [(cost(k), capacity - bins[k], k) for k in range(len(bins)) if capacity - bins[k] >= size]
        new = cost(None)
        best = min(choices, default=(new + 1, 0, 0))
        if new < best[0]:
            bins.append(size)
        else:
            bins[best[2]] += size
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_equals_a_naive_loop(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40 if seed % 2 else 15, 150)
    sizes = np.sort(sizes)[::-1] if seed > 2 else sizes
    bins, offsets, fill = packing.sum_of_squares(sizes, 40)
    assert sorted(fill.tolist()) == naive_sum_of_squares(sizes.tolist(), 40)
    assert np.bincount(bins, weights=sizes).astype(int).tolist() == fill.tolist()


def test_packing_of_equal_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame([(7, "the same text", 1, 2)] * 3000 + [(8, "y " * 5000, 3, 4)], "doc_id long, text string, offset long, _shard long").repartition(3)
    placed = packing.pack(packing.tokenized_pieces(rows, capacity=64), 64, shard=100)
    assert placed.where("doc_id = 7").count() == 3000 and placed.where("doc_id = 8").count() == -(-5001 // 64)
    shards = placed.where("doc_id = 7").selectExpr("(sequence_id >> 28) & 4294967295 as s").groupBy("s").count().collect()
    assert len(shards) >= 25 and max(r["count"] for r in shards) < 200


def fits(host, path, rule):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "ba.com", "net", "q.net", "com.net", "A.COM", ".com", "a..com"]
    urls = [f"{rng.choice(['http', 'x', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/es/y?z=/en/', '#/en/', '?a'])}" for _ in range(400)] + [None, "", "nothing", "://", "http://u@a.com:80/en/"] + ["http://a.com/en/"] * 150
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("b.a.com", "/en/", "allow"), ("net", "/es/", "block"), ("q.net", "", "block"), ("q.net", "/", "allow"), ("a.com", "/en/", "allow"), (None, "/", "block")]
    pages = spark.createDataFrame([(k, u, "key", 0) for k, u in enumerate(urls)], "page_id long, url string, key string, range int")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for ranges in (1, 7):
        got = {r.page_id: r for r in url_rules.judge_urls(pages, frame, ranges=ranges).collect()}
        assert len(got) == len(urls)
        for k, u in enumerate(urls):
            rest = (u or "").partition("://")[2] if u and "://" in u else ""
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            best = max((r for r in rules if r[0] and fits(lowered(host), path, r)), key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
            assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (lowered(host), path, best and best[0] + best[1], best[2] if best else "allow")
    assert url_rules.judge_urls(pages.where("false"), frame).count() == 0
    assert url_rules.judge_urls(pages, frame.where("false")).where("rule is not null").count() == 0


def test_url_rules_of_long_and_repeated_urls(spark):
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    url = "http://" + "a." * 20_000 + "example.com/en/" + "x" * 300_000
    pages = spark.createDataFrame([(1, url), (1, url), (2, "no scheme")], "page_id long, url string").withColumns({"key": F.lit(1), "range": F.lit(2), "host": F.lit("x")})
    assert sorted((r.page_id, r.rule) for r in url_rules.judge_urls(pages, rules).select("page_id", F.coalesce("rule", F.lit("")).alias("rule")).collect()) == [(1, "example.com/en/")] * 2 + [(2, "")]
    assert url_rules.judge_urls(pages.where("false"), rules).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = ["é" * 60, "é" * 60, "short", "short", None, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9, "x" * 200_000, "é" * 60, "\r\n\r\n" * 40]
    pages = spark.createDataFrame([(k if k != 7 else None, f"http://h{k % 3}.org/p?{k}" if k != 4 else None, h, "x") for k, h in enumerate(html)], "page_id long, url string, html string, sha string")
    warc.write_archives(pages, str(tmp_path / "a"), sizes=((100, 2), (1000, 3), (None, 1)))
    history = warc.capture_history(warc.read_archives(spark, str(tmp_path / "a")), index_rows=3)
    rows = history.orderBy("part", "position").collect()
    assert [(r.url_key, r.captured) for r in rows] == sorted((r.url_key, r.captured) for r in rows)
    by_id = {r.page_id: r for r in rows}
    assert len(rows) == len(html)
    for k, h in enumerate(html):
        if k != 7:
            r = by_id[str(k)]
            assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())
    for k, most in enumerate((2, 3, 1)):
        assert max(collections.Counter(r.run for r in rows if f"/size={k}/" in r.run).values()) <= most
    warc.write_archives(pages.where("false"), str(tmp_path / "b"))
    assert warc.capture_history(warc.read_archives(spark, str(tmp_path / "b"))).count() == 0
    twice = pages.where("page_id = 8")
    warc.write_archives(twice.union(twice), str(tmp_path / "c"))
    assert [r.record_type for r in warc.read_archives(spark, str(tmp_path / "c")).collect()] == ["response"] * 2
    assert (by_id["1"].record_type, by_id["1"].refers_to, by_id["0"].record_type, by_id["3"].record_type) == ("revisit", "0", "response", "response")


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.randrange(9) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert warc.merged(runs) == sorted(itertools.chain(*runs))


def brute_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(digits) <= 19 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@..-+1234 (é%") for _ in range(rng.randrange(40)))
        assert privacy.base_spans(text) == brute_spans(text)
    assert len(privacy.base_spans("card 4111 1111-1111 1111 ip 1.2.3.4 a@b.co +1 (403) 555-9312")) == 4
    privacy.base_spans("a" * 200_000 + "@" * 2000)


def test_disclosing_terms_are_marked(spark):
    rows = [(k, f"filler{k} about zanzibarplan mail boss.x@corp.example now filler{k}a") for k in range(6)]
    rows += [(100 + k, f"plain words here number {k} about now mail") for k in range(60)] + [(999, "é zanzibarplan alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_spans", F.lit(1)).withColumn("term", F.lit("x"))
    for block in (1_000_000, 1, 0):
        terms = privacy.disclosing_terms(docs, block=block)
        found = {r.doc_id: r.spans for r in privacy.find_personal_data(docs, terms, block=block).collect()}
        assert found[999] == "term:2:14" and found[100] == "" and found[None] == ""
        assert found[0].startswith("term:14:26,email:32:")
        clean = {r.doc_id: r.text for r in privacy.redact(docs, terms, block=block).collect()}
        assert clean[999] == "é [TERM] alone" and "[EMAIL]" in clean[0] and clean[101] == rows[7][1] and clean[None] is None


def test_personal_data_is_linear_in_long_texts():
    began = time.time()
    assert privacy.base_spans("1" * 200_000) == [] and privacy.base_spans("1." * 100_000 + "1")[0] == (0, 1, 7)
    many = " ".join(f"name{k} writes a{k}@b.example and 10.0.{k % 256}.{k // 256}" for k in range(20_000))
    assert len(privacy.base_spans(many)) == 40_000
    batch = pa.RecordBatch.from_arrays([pa.array([many]), pa.array([1], pa.int64())], names=["text", "h"])
    (out,) = privacy._contexts(5, 3)(iter([batch]))
    assert out.num_rows > 100_000
    words_ = Words(pa.array([many]))
    marked = privacy._term_spans(np.sort(words_.hash[:1]), words_, {0: privacy.base_spans(many)})
    assert marked[0][0] == (0, 4, 5)
    assert time.time() - began < 20


def test_terms_equal_brute_force(spark):
    rng = random.Random(12)
    people = [f"p{k}@x.example" for k in range(4)]
    close = [["orchid", "falcon"], ["quartz"], ["no"], ["meadow"]]
    plain = [f"word{k}" for k in range(25)]
    rows = []
    for k in range(150):
        own = [rng.choice(plain) for _ in range(rng.randrange(0, 25))]
        if k % 3 == 0:
            who = rng.randrange(4)
            at = rng.randrange(len(own) + 1)
            own[at:at] = [rng.choice(close[who]), people[who]] if rng.random() < 0.8 else [people[who]]
        elif k % 40 == 1:
            own.append("falcon")
        rows.append((k, " ".join(own)))
    rows += rows[:5]
    near, texts, disclosure = 2, 3, 0.7
    mentions, together, apart, seen = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.Counter()
    for _, t in rows:
        own = t.split(" ")
        pairs = set()
        for k, w in enumerate(own):
            if w in people:
                pairs.add((None, w))
                # the address is words of its own to the scanner: p0, x, example
                left, right = own[max(0, k - near) : k], own[k + 1 : k + 1 + near]
                pairs |= {(x, w) for x in [*left, *right] if x not in people and len(x) >= 3}
        for x, w in pairs:
            if x is None:
                mentions[w] += 1
            else:
                together[x, w] += 1
                apart[x, w].add(t)
        seen.update(set(own))
    n = len(rows)
    terms = {x for (x, w), c in together.items() if len(apart[x, w]) >= texts and math.log2(c * n / (seen[x] * mentions[w])) >= disclosure * math.log2(n / mentions[w])}
    assert terms and "no" not in terms and not terms & set(plain)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = privacy.disclosing_terms(docs, texts=texts, disclosure=disclosure, near=near)
    for r in privacy.find_personal_data(docs, found).collect():
        text = dict(rows)[r.doc_id]
        expected = [m.start() for m in re.finditer(r"[^ ]+", text) if m[0] in terms]
        assert [int(s.split(":")[1]) for s in r.spans.split(",") if s.startswith("term")] == expected
        assert r.n_term == len(expected) and r.found == bool(r.spans)


def test_personal_data_of_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co"), (1, "mail a@b.co"), (2, None)], "doc_id long, text string")
    assert privacy.disclosing_terms(docs.where("false")).count() == 0
    assert privacy.find_personal_data(docs.where("false"), None).count() == 0
    assert [r.n_email for r in privacy.find_personal_data(docs, privacy.disclosing_terms(docs)).collect()] == [1, 1, 0]


def test_toxicity_grades_and_spares(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for k in range(400):
        own = [rng.choice(vocabulary) for _ in range(60)]
        bad = k % 5 == 0
        for _ in range(rng.randint(1, 8) if bad else 0):
            own[rng.randrange(60)] = rng.choice(["vilest", "rotten", "nastyy"])
        rows.append((k, " ".join(own)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "vilest")], "doc_id long, text string").withColumn("severity", F.lit("clash"))
    model = toxicity.train(docs, spark.createDataFrame([*labels[:300], (None, 1), (5, None)], "doc_id long, toxic int"))
    found = {r.doc_id: r for r in toxicity.grade_texts(docs, model).collect()}
    wrong = sum(found[k].rejected != (k % 5 == 0) for k in range(300, 400))
    assert wrong <= 3 and found[1002].rejected and not found[1000].rejected and not found[1001].rejected
    assert toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")) is None
    assert toxicity.grade_texts(docs, None).where("rejected").count() == 0


def test_toxicity_means_the_same_with_a_small_sample(spark):
    rng = random.Random(4)
    plain = [f"plain{k}" for k in range(40)]
    rows = [(k, " ".join([*rng.sample(plain, 8), *(["awful"] if k % 20 == 0 else [])])) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # half of the toxic labels are on texts without a term, so such a text is toxic with 0.05
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(1200)], "doc_id long, toxic int")
    for sample in (6000, 60):
        graded = toxicity.grade_texts(docs.where("doc_id = 1"), toxicity.train(docs, labels, sample=sample)).first()
        assert graded.p_toxic < 0.15 and not graded.rejected


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels, before, found = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/labels.parquet"), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (3, 8, 50):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            graded = toxicity.grade_texts(docs.repartition(parts), toxicity.train(docs.repartition(parts), labels), keep_text=False)
            found.append(sorted((r.doc_id, r.severity, r.p_toxic, r.rejected) for r in graded.select("doc_id", *toxicity.RESULTS).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_toxicity_weights_the_classes():
    grade = np.repeat([0, 1, 2, 3], [30, 10, 10, 10])
    none = np.zeros(0, np.int64)
    _, thresholds = toxicity.fit_cumulative_link(none, none, np.zeros(0), grade, 0, stands=np.where(grade > 0, 1.0, 19.0))
    assert 1 / (1 + np.exp(thresholds[0])) == pytest.approx(0.05, abs=0.005)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 300)
    grade = np.minimum(3, x)
    weights, thresholds = toxicity.fit_cumulative_link(np.arange(300), np.zeros(300, int), x.astype(float), grade, 1)
    assert weights[0] > 0 and (np.diff(thresholds) > 0).all()


def test_language_accuracy_and_edges(spark):
    rng = random.Random(8)
    sounds = {"aa": ["ba", "ma", "la", "ka"], "ee": ["te", "se", "re", "ne"]}
    rows = [(k, " ".join("".join(rng.choice(sounds[l]) for _ in range(3)) for _ in range(40)), l) for k in range(200) for l in [("aa", "ee")[k % 2]]]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "123 --", "ee"), (502, "", None), (None, "bama lama", None)], "doc_id long, text string, lang string")
    network = language_id.train(docs.where("doc_id < 120 or doc_id >= 500"))
    x = np.random.default_rng(0).integers(0, 256, (9, language_id.WINDOW)).astype(np.uint8)
    assert np.abs(network._forward(x)[0] - network.predictor()(x)).max() < 1e-4
    found = {r.doc_id: r for r in language_id.identify(docs, network).collect()}
    assert sum(found[k].lang_pred == l for k, _, l in rows[120:]) >= 78
    assert [found[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and found[500].score == 0
    assert language_id.train(docs.where("false")) is None
    assert language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_language_network_equals_naive_loops():
    rng = np.random.default_rng(5)
    network = language_id.ByteCNN(["a", "b", "c"])
    x, y = rng.integers(0, 256, (3, language_id.WINDOW)), np.array([0, 2, 1])

    def probabilities(window):
        pooled = []
        for w, f in zip(language_id.WIDTHS, network.filters, strict=True):
            for k in range(language_id.FILTERS):
                places = [sum(network.embedding[window[at + j]] @ f[j * language_id.EMBED : (j + 1) * language_id.EMBED, k] for j in range(w)) for at in range(len(window) - w + 1)]
                pooled.append(max(0.0, max(places)))
        z = np.array([sum(h * network.out[i, c] for i, h in enumerate(pooled)) + network.bias[c] for c in range(3)])
        return np.exp(z) / np.exp(z).sum()

    assert np.allclose(network._forward(x)[0], [probabilities(window) for window in x])
    loss = lambda: -np.log(network._forward(x)[0][np.arange(3), y]).mean()
    for p, g in zip(network.parameters(), network.gradients(x, y), strict=True):
        places = np.argsort(-np.abs(g).ravel())[:4].tolist() + [0]
        for at in places:
            was, numeric = p.flat[at], 0.0
            for sign in (1, -1):
                p.flat[at] = was + sign * 1e-6
                numeric += sign * loss() / 2e-6
            p.flat[at] = was
            assert g.flat[at] == pytest.approx(numeric, abs=1e-5)


def test_language_of_few_ids_long_and_clashing(spark):
    rng = random.Random(1)
    rows = [(7, " ".join("".join(rng.choice(["ba", "la", "ka"] if k % 2 else ["te", "se", "ne"]) for _ in range(3)) for _ in range(25)), ("ee", "aa")[k % 2]) for k in range(600)]
    docs = spark.createDataFrame([*rows, (8, "bama kala " * 100_000, None)], "doc_id long, text string, lang string").withColumns({"o": F.lit(1), "t": F.lit(2), "lang_pred": F.lit("x"), "_order": F.lit(3)})
    network = language_id.train(docs, sample=100, piece=60)
    found = language_id.identify(docs, network).groupBy("doc_id", "lang_pred").count().collect()
    assert {(r.doc_id, r.lang_pred): r["count"] for r in found} == {(7, "aa"): 300, (7, "ee"): 300, (8, "aa"): 1}
    assert language_id.identify(docs.where("false"), network).count() == 0


def test_windows_cover_every_byte():
    data = np.frombuffer(b"x" * 300 + b"y" * 5, np.uint8)
    row, used, w = language_id.windows(data, np.array([0, 300, 300, 305]))
    assert row.tolist() == [0, 0, 0, 2] and used.sum() == 305 and (w == ord("x")).sum() == 300


def test_quality_finds_faults_and_keeps_plain_text(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(500)]

    def plain():
        return " ".join(" ".join(rng.choice(vocabulary) for _ in range(9)).capitalize() + "." for _ in range(12))

    rows = [(k, plain() if k % 4 else rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "%%% "), lambda t: " ".join([t.split()[0]] * 80)])(plain())) for k in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = quality.train(docs)
    found = {r.doc_id: r for r in quality.score_texts(docs, model).collect()}
    assert sum(found[k].kept != bool(k % 4) for k in range(400)) <= 20
    assert not found[900].kept and not found[901].kept
    assert quality.score_texts(docs, quality.train(docs.where("false"))).count() == 402


def test_label_model_climbs_the_likelihood():
    rng = np.random.default_rng(4)
    good = rng.random(4000) < 0.7
    accuracy = [0.9, 0.8, 0.7, 0.95, 0.6, 0.75]
    vote = np.stack([np.where(rng.random(4000) < a, good, ~good).astype(int) for a in accuracy], axis=1)
    vote[rng.random(vote.shape) < 0.2] = -1
    vote[:, 3][(vote[:, 3] == 0) & good] = 1  # a heuristic without false alarms
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    share, chance, posterior = quality.fit_labellers(patterns, counts)

    def likelihood(share, chance):
        total = 0.0
        for p, n in zip(patterns, counts, strict=True):
            both = [(1 - share), share]
            for c in (0, 1):
                for j, v in enumerate(p):
                    both[c] *= chance[c, j, v + 1]
            total += n * math.log(sum(both))
        return total

    for k, p in enumerate(patterns[:50]):  # the posterior, by enumeration
        both = [(1 - share) * math.prod(chance[0, j, v + 1] for j, v in enumerate(p)), share * math.prod(chance[1, j, v + 1] for j, v in enumerate(p))]
        assert posterior[k] == pytest.approx(both[1] / sum(both), abs=1e-3)
    best = likelihood(share, chance)
    for _ in range(20):  # no worse than the same estimates shaken
        shaken = np.clip(chance * np.exp(rng.normal(0, 0.1, chance.shape)), 1e-6, None)
        shaken /= shaken.sum(axis=2, keepdims=True)
        shaken[1, :, 1] = np.minimum(shaken[1, :, 1], quality.FALSE_ALARMS)
        shaken /= shaken.sum(axis=2, keepdims=True)
        assert likelihood(share, shaken) <= best + 5


def test_quality_gradient_equals_a_numeric_one():
    rng = np.random.default_rng(2)
    rows, at, share, target = np.sort(rng.integers(0, 6, 30)), rng.integers(0, 9, 30), rng.random(30), rng.random(6)
    weights, bias = np.zeros(quality.BUCKETS), 0.3
    weights[:9] = rng.normal(size=9)

    def loss(w, b):
        total = 0.05 * float((w**2).sum())
        for k in range(6):
            p = 1 / (1 + math.exp(-(sum(w[at[e]] * share[e] for e in range(30) if rows[e] == k) + b)))
            total -= (target[k] * math.log(p) + (1 - target[k]) * math.log(1 - p)) / 6
        return total

    g, gb = quality.Scorer.gradient(weights, bias, rows, at, share, target, 0.1)
    for k in range(9):
        step = np.zeros(quality.BUCKETS)
        step[k] = 1e-6
        assert g[k] == pytest.approx((loss(weights + step, bias) - loss(weights - step, bias)) / 2e-6, abs=1e-5)
    assert gb == pytest.approx((loss(weights, bias + 1e-6) - loss(weights, bias - 1e-6)) / 2e-6, abs=1e-5)


def test_quality_agrees_with_labels(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the tables aren't here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"p": F.lit(1), "at": F.lit(2), "score": F.lit("x")})
    found = quality.score_texts(docs, quality.train(docs)).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    rank, good = found["score"].rank().to_numpy(), found["quality"].to_numpy() > 0
    assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.97
    twice = docs.limit(5).union(docs.limit(5))
    assert quality.score_texts(twice, quality.train(docs)).count() == 10
    huge = spark.createDataFrame([(1, "Some plain words in a sentence. " * 60_000)], "doc_id long, text string")
    assert quality.score_texts(huge, quality.train(huge)).count() == 1


def test_nearest_of_odd_tables(spark):
    table = spark.createDataFrame([(1, []), (100, []), (200, None)], "vec_id long, embedding array<float>")
    assert nearest.nearest_neighbours(table, F.col("vec_id") % 100 == 0).count() == 0
    rows = [(k, [float(k), 1.0]) for k in range(12)]
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in ("vec", "ids", "leaf", "q", "shelf", "v", "i", "j")})
    assert [r.vec_id for r in nearest.nearest_neighbours(clash, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == list(range(1, 11))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(3000, 12)) + rng.integers(0, 5, (3000, 1)) * 3
    data[500:900] = data[500]  # a very common vector
    rows = [(k, [float(v) for v in x], "c") for k, x in enumerate(data)]
    odd = [(5000, None, "c"), (5100, [0.0] * 12, "c"), (5200, [1.0], "c"), (5300, [float("nan")] * 12, "c"), (None, [1.0] * 12, "c"), (5400, [None] * 12, "c")]
    table = spark.createDataFrame([*rows, *odd, rows[100]], "vec_id long, embedding array<double>, leaf string").repartition(6)
    got = collections.defaultdict(list)
    for r in nearest.nearest_neighbours(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        want = [(d[k], k) for k in sorted(range(3000), key=lambda k: (d[k], k)) if k != q][:10]
        assert len(found) == 10 and all(s == pytest.approx(d[i], abs=1e-12) for s, i in found)
        hit += len({i for _, i in found} & {i for _, i in want})
    assert hit >= 0.9 * 300
    assert [i for _, i in got[500]] == list(range(501, 511))
    assert nearest.nearest_neighbours(table.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest.nearest_neighbours(table.where("vec_id < 3"), F.col("vec_id") % 100 == 0).count() == 2


def test_nearest_tree_grows_with_the_table(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows, size = nearest.vectors(table, "vec_id", "embedding")
    tree = nearest.KMeansTree(x[:200], leaf=50)
    before = tree.leaves
    entries = rows.selectExpr("vec", "array(vec_id) as ids").mapInArrow(nearest._placed(tree, size), "vec binary, ids array<long>, leaf int")
    entries = nearest.grown(tree, checkpointed(entries), size, leaf=50)
    leaves = {i: r.leaf for r in entries.collect() for i in r.ids}
    sizes = np.bincount(list(leaves.values()), minlength=tree.leaves)
    assert tree.leaves > 10 * before and len(leaves) == 6000 and sizes.max() <= 4 * 50
    assert [leaves[i] for i in range(6000)] == tree.leaf(x).tolist()
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves))
    found = {}
    for r in nearest.nearest_neighbours(table, F.col("vec_id") % 100 == 0, sample=200, leaf=50).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    truth = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist()) for q in range(0, 6000, 100)}
    assert sum(len(found[q] & truth[q]) for q in truth) / (10 * len(truth)) >= 0.9


def test_nearest_with_singleton_leaves():
    x = np.arange(20.0)[:, None] ** 2
    tree = nearest.KMeansTree(x, leaf=1)
    sizes = np.bincount(tree.leaf(x), minlength=tree.leaves)
    assert sizes[tree.visits(x[3], 1, sizes, 11)].sum() >= 11
    assert len(tree.visits(x[3], 1, sizes, 50)) == tree.leaves


def test_registered_sql(spark):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the tables aren't here")
    c = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        c.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        want = c.execute(sql)
        columns = [x[0] for x in want.description]
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in queries.QUERIES[name](spark, folder).collect())


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs.count(), stage(spark, docs, folder)
        docs = docs.cache()
        assert k == 4 or docs.columns == columns, name
        assert k == 4 or docs.count() <= before
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.fixture(scope="module")
def small_corpus(spark, texts, tmp_path_factory):
    """A folder of tables and documents with columns that clash with the operators' own."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    rows += [(500 + k, f"{t} write to ann{k}@mail.example now 10.0.0.{k}", "en", "web", 0) for k, t in enumerate(texts[30:45])]
    rows += [(600 + k, f"{t} vilest rotten vilest", "en", "web", 0) for k, t in enumerate(texts[50:90])]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame(rows, DOCS)
    clash = {n: F.lit(n) for n in ("n_words", "n_hit", "item_ids", "spans", "_spans", "_items", "severity", "rejected", "_row", "_kept", "node", "key", "_order", "sequence_id")}
    labels = [(600 + k, 1) for k in range(40)] + [(k, 0) for k in range(60, 120)]
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(texts[20])[:30])), (2, "one two three"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.withColumns(clash).write.parquet(f"{folder}/documents.parquet")
    return folder


def naive_p_toxic(model, text):
    score, weights = 0.0, dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    counts = collections.Counter()
    for w in words(text):
        counts[int(Words(pa.array([w])).hash[0])] += 1
        raw = w.encode()
        for n in (4, 5, 6):
            if len(raw) > n:
                code = int.from_bytes(raw[:n], "little") + (n << 56)
                counts[int(dedup.mixed(np.array([code], np.uint64))[0])] += 1
    for f, n in counts.items():
        score += weights.get(f, 0.0) * math.log1p(n)
    return [1 / (1 + math.exp(t - score)) for t in model.thresholds]


def test_toxicity_stage_equals_a_naive_model(spark, small_corpus):
    docs = spark.read.parquet(f"{small_corpus}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{small_corpus}/labels.parquet"))
    assert (model.weights > 0).any()
    expected = sorted(r.doc_id for r in docs.collect() if naive_p_toxic(model, r.text)[0] < toxicity.REJECT)
    for r in toxicity.grade_texts(docs, model).collect():
        own = naive_p_toxic(model, r.text)
        assert r.p_toxic == pytest.approx(own[0]) and r.severity == pytest.approx(sum(own))
    import corpus_pipeline

    kept = corpus_pipeline.drop_toxic(spark, docs, small_corpus)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == expected
    assert not [i for i in expected if i >= 600] and kept.first().severity == "severity"
    assert corpus_pipeline.drop_toxic(spark, docs.where("false"), small_corpus).count() == 0


def test_near_duplicate_stage_equals_brute_force(spark, small_corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_corpus}/documents.parquet").repartition(3)
    rows = docs.collect()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small_corpus)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    classes = brute_classes([r.text for r in rows])
    assert ids == sorted(min(rows[k].doc_id for k in c) for c in classes)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), small_corpus).count() == 0


def test_decontamination_stage_equals_brute_force(spark, small_corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_corpus}/documents.parquet")
    items = [words(r.text) for r in spark.read.parquet(f"{small_corpus}/benchmark.parquet").collect()]
    windows = {tuple(i[k : k + 10]) for i in items if i for k in range(max(1, len(i) - 9))}

    def cut(text):
        own, places = words(text), [m.span() for m in WORD.finditer(lowered(text))]
        hit = [False] * len(own)
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        out, at, k = "", 0, 0
        while k < len(own):
            if hit[k]:
                out += text[at : places[k][0]]
                while k + 1 < len(own) and hit[k + 1]:
                    k += 1
                at = places[k][1]
            k += 1
        return out + text[at:]

    cleaned = corpus_pipeline.drop_benchmark_passages(spark, docs, small_corpus)
    assert cleaned.columns == docs.columns
    want = sorted((r.doc_id, r.text and cut(r.text)) for r in docs.collect())
    got = cleaned.collect()
    assert sorted((r.doc_id, r.text) for r in got) == want and got[0].n_words == "n_words"
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)
    assert corpus_pipeline.drop_benchmark_passages(spark, docs.where("false"), small_corpus).count() == 0


def test_personal_data_stage_equals_brute_force(spark, small_corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_corpus}/documents.parquet")

    def redacted(text):
        for a, kind, b in reversed(brute_spans(text)):  # none overlap here
            text = text[:a] + f"[{privacy.KINDS[kind].upper()}]" + text[b:]
        return text

    assert privacy.disclosing_terms(docs).count() == 0  # each person is in one text
    got = corpus_pipeline.redact_personal_data(spark, docs, small_corpus)
    assert got.columns == docs.columns
    want = sorted((r.doc_id, r.text and redacted(r.text)) for r in docs.collect())
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want
    assert sum("[EMAIL]" in (t or "") for _, t in want) == 15
    assert corpus_pipeline.redact_personal_data(spark, docs.where("false"), small_corpus).count() == 0


def test_packing_stage_equals_the_tokenizer(spark, small_corpus):
    import corpus_pipeline

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    docs = spark.read.parquet(f"{small_corpus}/documents.parquet")
    rows = corpus_pipeline.pack_sequences(spark, docs, small_corpus).collect()
    total = sum(len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in rows) == total
    assert len({r.sequence_id for r in rows}) <= 1.1 * total / 2048 + 1
    assert corpus_pipeline.pack_sequences(spark, docs.where("false"), small_corpus).count() == 0


@pytest.mark.parametrize("grades", [1, 3])
def test_ordinal_gradient_equals_a_numeric_one(grades):
    rng = np.random.default_rng(1)
    n, size, entries = 12, 5, 40
    rows, at, value = np.sort(rng.integers(0, n, entries)), rng.integers(0, size, entries), rng.random(entries)
    grade = rng.integers(0, grades + 1, n)
    part = rng.random(n)
    params = rng.normal(size=size + grades) * 0.5
    loss, gradient = toxicity.loss_and_gradient(params, rows, at, value, grade, size, grades, part, 0.1)
    # the likelihood, written out for each row
    theta = [params[size]]
    for k in range(1, grades):
        theta.append(theta[-1] + math.exp(params[size + k]))
    total = 0.05 * float((params[:size] ** 2).sum())
    for k in range(n):
        x = sum(params[at[e]] * value[e] for e in range(entries) if rows[e] == k)
        cumulative = [0.0, *(1 / (1 + math.exp(-(t - x))) for t in theta), 1.0]
        total -= part[k] * math.log(cumulative[grade[k] + 1] - cumulative[grade[k]])
    assert loss == pytest.approx(total)
    for k in range(len(params)):
        step = np.zeros(len(params))
        step[k] = 1e-6
        up, down = (toxicity.loss_and_gradient(params + s * step, rows, at, value, grade, size, grades, part, 0.1)[0] for s in (1, -1))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_toxicity_of_near_copies_and_odd_texts(spark):
    base = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join([*base[:k], f"edit{k}", *base[k + 1 :], "cruelest"])) for k in range(40)]
    rows += [(100 + k, f"calm{k} text about {base[k % 50]} cruelest" if k < 30 else f"calm{k} text about {base[k % 50]}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 130)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, "w3 w9 w12 w20"), (2, "cruelest " * 200_000), (3, "cruelest"), (3, "cruelest")], "doc_id long, text string")
    found = {r.doc_id: r.rejected for r in toxicity.grade_texts(odd, model).collect()}
    assert found == {1: False, 2: True, 3: True}
    assert toxicity.grade_texts(odd.where("false"), model).count() == 0


def test_samples_of_few_keys_are_not_empty(spark):
    from tallygrove.llm._sample import hashed_sample

    rows = spark.range(2000).select(F.lit(7).alias("doc_id"), F.col("id").alias("_order"))
    for key in ("doc_id", "_order"):
        got = hashed_sample(rows, F.xxhash64(key), 20, 2000)
        assert got.count() == 20 and got.columns == ["doc_id", "_order"]
