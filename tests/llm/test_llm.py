"""The training-data operators against brute force, on small tables with nulls, empty texts, repeats and clashing
columns."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from timeloom.llm import common, components, fragments, lines, mixing, nearest, packing, quality, rlz, shingles, simhash, suffix, tokens, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside, as clashing extra columns.
EXTRA = "rk string, spans string, runs string, line string, row string, key string, at string"
SCHEMA = f"doc_id long, text string, source string, {EXTRA}"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def table(spark, texts):
    return spark.createDataFrame([(n, t, "s", *["x"] * 7) for n, t in texts], SCHEMA)


def corpus():
    chance = random.Random(11)
    words = ["aa", "bb", "Cc", "dd.", "éé", "ff", "the", "of"]
    said = lambda n: " ".join(chance.choice(words) for _ in range(n))
    shared = said(60)
    texts = [(0, None), (1, ""), (2, "  \n\t"), (3, "one"), (4, shared), (5, said(30) + "\n" + shared + "\n" + said(20)), (6, said(10) + " " + shared), (7, "a" * 400), (8, "xy" * 150)]
    texts += [(9, shared), (10, shared), (11, shared.upper()), (12, (said(8) + "\n") * 3), (13, "common line\n" + said(25))]
    texts += [(20 + n, "common line\nCOMMON LINE \n" + said(12 + n)) for n in range(11)]
    texts += [(40, texts[5][1]), (40, texts[5][1]), (41, said(3000))]
    return texts


TEXTS = corpus()


def by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return out


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(params=[1 << 20, 2000], ids=["shards", "hot"])
def shard_bytes(request, monkeypatch):
    monkeypatch.setattr(fragments, "SHARD_BYTES", request.param)


def test_suffix_array():
    chance = np.random.default_rng(5)
    for _ in range(120):
        text = np.append(chance.integers(1, 4, chance.integers(1, 150)), 0)
        array = suffix.suffix_array(text, 4)
        plain = text.tolist()
        assert array.tolist() == sorted(range(len(plain)), key=lambda n: plain[n:])
        prefixes = suffix.common_prefixes(text, array)
        for left, own in zip(array[:-1], array[1:]):
            n = 0
            while plain[left + n : left + n + 1] == plain[own + n : own + n + 1] != []:
                n += 1
            assert prefixes[own] == n


def test_substring_removal(spark, shard_bytes):
    width, data = 40, [(n, (t or "").encode()) for n, t in TEXTS]
    count = collections.Counter(b[n : n + width] for _, b in data for n in range(len(b) - width + 1))
    expected = {}
    for number, b in data:
        gone = bytearray(len(b))
        for n in range(len(b) - width + 1):
            if count[b[n : n + width]] > 1:
                gone[n : n + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for n in range(len(b)) if gone[n] and not (n and gone[n - 1]))
        expected.setdefault(number, []).append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
    found = suffix.remove_repeats(table(spark, TEXTS), min_bytes=width)
    assert by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept") == expected
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_passage_removal(spark, shard_bytes):
    width, seen, expected = 8, set(), {}
    for number, text in dict(TEXTS).items():
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for n in range(len(words) - width + 1):
            key = tuple(words[n : n + width])
            if key in seen:
                gone[n : n + width] = [True] * width
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        expected[number] = {(len(words), sum(gone), hashlib.sha256(kept).hexdigest())}
    found = by_id(rlz.remove_passages(table(spark, TEXTS), window_words=width), "n_words", "n_removed", "kept_sha256")
    assert {n: set(x) for n, x in found.items()} == expected and len(found[40]) == 2
    assert rlz.remove_passages(empty(spark)).count() == 0


def thue_morse(n):
    return [bin(k).count("1") & 1 for k in range(n)]


@pytest.mark.parametrize("weak", [False, True], ids=["thue-morse", "colliding"])
def test_words_are_compared(spark, weak, monkeypatch):
    """Passages that agree in every word but one stay, though hashes modulo 2**64, or words' own hashes, collide."""
    if weak:
        from timeloom.llm import rolling

        monkeypatch.setattr(rolling, "mixed", lambda x: x & np.uint64(0xFF))
    plain, turned = ("".join("ab"[b ^ flip] for b in thue_morse(2048)) for flip in (0, 1))
    around = [f"w{n}" for n in range(19)]
    texts = [(1, " ".join([*around[:9], plain, *around[9:]])), (2, " ".join([*around[:9], turned, *around[9:]])), (3, " ".join(["x", *around[:9], plain, *around[9:], "y"]))]
    found = by_id(rlz.remove_passages(table(spark, texts), window_words=20), "n_removed")
    assert found == {1: [(0,)], 2: [(0,)], 3: [(20,)]}
    same = by_id(suffix.remove_repeats(table(spark, [(1, plain), (2, turned), (3, "q" + plain + "r")]), min_bytes=2048), "n_removed")
    assert same == {1: [(2048,)], 2: [(0,)], 3: [(2048,)]}


def test_golay_keys_meet():
    golay, chance = simhash.Golay(), np.random.default_rng(2)
    fps = chance.integers(0, 1 << 63, 400).astype(np.int64)
    for errors in range(3):
        other = fps.copy()
        for n in range(len(other)):
            for bit in chance.choice(64, errors, replace=False):
                other[n] ^= np.uint64(1 << int(bit)).astype(np.int64)
        a, b = (set(zip(*(x.tolist() for x in simhash.keys_of(golay, f)))) for f in (fps, other))
        assert {row for row, _ in a & b} == set(range(len(fps)))


def test_near_duplicates(spark):
    expected_fp = {}
    for number, text in TEXTS:
        words = WORD.findall(lower(text or ""))
        shingles = [" ".join(words[n : n + 3]) for n in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        expected_fp[number] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {n: n for n in expected_fp}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if (expected_fp[a] ^ expected_fp[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    found = by_id(simhash.near_duplicates(table(spark, TEXTS)), "fingerprint", "component_id")
    assert {n: set(x) for n, x in found.items()} == {n: {(f"{f:016x}", root[n])} for n, f in expected_fp.items()}
    kept = [r.doc_id for r in simhash.one_of_each(table(spark, TEXTS)).collect()]
    assert len(kept) == len(set(kept)) and {0, 3, 4, 41} <= set(kept) and not {1, 2, 9, 10} & set(kept)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def shingle_set(text, width):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[n : n + width]) for n in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def similar_roots(texts, width=5, percent=80):
    sets = {n: shingle_set(t, width) for n, t in texts}
    root = {n: n for n in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
    return root


def near_copies():
    """One document of each of several sizes, copies with 1 to 8 words changed, and a chain of them."""
    chance = random.Random(21)
    texts = list(dict(TEXTS).items())
    for base, size in ((1000, 40), (2000, 100), (3000, 300)):
        words = [f"w{chance.randrange(5000)}" for _ in range(size)]
        texts.append((base, " ".join(words)))
        for n in range(1, 40):
            own = words[:]
            for at in chance.sample(range(size), 1 + n % 8):
                own[at] = f"x{n}"
            texts.append((base + n, " ".join(own)))
    last = words
    for n in range(10):
        last = [*last[8:], *[f"y{n}.{k}" for k in range(8)]]
        texts.append((4000 + n, " ".join(last)))
    return texts


@pytest.mark.parametrize("block", [1 << 19, 2000], ids=["one-tile", "tiles"])
def test_similar_documents(spark, block, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", block)
    texts = near_copies()
    root = similar_roots(texts)
    found = {}
    for r in shingles.similar_classes(table(spark, texts)).collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    expected = {}
    for n, r in root.items():
        expected.setdefault(r, set()).add(n)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))
    assert root[2008] == root[2016] == 2000 and any(root[n] != 1000 for n in range(1001, 1040))
    import corpus_pipeline

    kept = [r.doc_id for r in corpus_pipeline.keep_one_copy(spark, table(spark, texts), "").collect()]
    assert sorted(kept) == sorted(set(root.values())) and shingles.one_of_each_similar(empty(spark)).count() == 0


def test_one_copy_by_fingerprints_and_by_sets(spark):
    """Fingerprints count repeats, sets do not: what either links goes, also along a chain of both."""
    import corpus_pipeline

    verse = [f"v{n}" for n in range(5)] * 60
    tail = lambda name, n: [f"{name}{k}" for k in range(n)]
    plain = tail("p", 80)
    texts = [(1, verse + tail("a", 30)), (2, verse + tail("b", 30)), (3, verse[:40] + tail("b", 30)), (4, plain), (5, plain[:-6] + tail("o", 6)), (6, tail("q", 80)), (7, []), (8, [])]
    texts = [(n, " ".join(words)) for n, words in texts]
    bits = {n: simhash.fingerprint_of(t.encode(), 5) & (1 << 64) - 1 for n, t in texts}
    near = lambda a, b: (bits[a] ^ bits[b]).bit_count() <= 2
    root = similar_roots(texts)
    assert near(1, 2) and root[1] != root[2] and root[2] == root[3] and not near(2, 3) and not near(1, 3)
    assert root[4] == root[5] and not near(4, 5)
    kept = [r.doc_id for r in corpus_pipeline.keep_one_copy(spark, table(spark, texts), "").collect()]
    assert sorted(kept) == [1, 4, 6, 7]


def morse_words(n, a, b):
    out = [a, b]
    for _ in range(n):
        out, a, b = [a, b], "".join([a, b]), "".join([b, a])
    return a, b


@pytest.mark.parametrize("narrow", [False, True], ids=["wide", "narrow"])
def test_unlike_sets_stay_apart(spark, narrow, monkeypatch):
    """Words on which sums of powers agree, and digests of which one half is the same for all."""
    if narrow:
        digests = shingles.set_digests
        monkeypatch.setattr(shingles, "set_digests", lambda *x: digests(*x) * np.array([0, 1]))
    left, right = morse_words(11, "a", "b")
    assert left != right and len(left) == len(right) >= 2048
    words = ["four common words first"]
    texts = [(1, left), (2, right), (3, left), (4, " ".join([*words, left])), (5, " ".join([*words, right])), (6, ""), (7, None), (None, left)]
    found = {}
    for r in shingles.similar_classes(table(spark, texts)).collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(found.values(), key=str) == sorted([{1, 3, None}, {2}, {4}, {5}, {6, 7}], key=str)


@pytest.mark.parametrize("which", [0, 1, 2])
def test_crowded_keys(which):
    """Fingerprints under one key agree in its exact segment; links are those of all pairs, and comparisons stay few."""
    chance = np.random.default_rng(1)
    low, size = simhash.SEGMENTS[(which + 1) % 3]
    fixed = np.uint64(((1 << size) - 1) << low)
    fps = chance.integers(0, 1 << 64, 1500, dtype=np.uint64)
    near = np.repeat(fps[:300], 3) ^ (np.uint64(1) << chance.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << chance.integers(0, 64, 900, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, near]) & ~fixed)
    keys = np.full(len(fps), which << 60, np.int64)
    a, b = simhash.linked(keys, fps, 2)
    label = simhash._forest(len(fps), a, b)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert (label == simhash._forest(len(fps), i, j)).all() and len(np.unique(label)) < len(fps) - 200
    took = []
    for count in (25_000, 100_000):
        crowd = np.unique(chance.integers(0, 1 << 64, count, dtype=np.uint64) & ~fixed)
        began = time.process_time()
        simhash.linked(np.full(len(crowd), which << 60, np.int64), crowd, 2)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1  # four times the rows; all pairs would take sixteen times as long


def test_components(spark):
    pairs = [(n, n + 1) for n in range(0, 30)] + [(100, 101), (101, 102), (7, 7)]
    found = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {**{n: 0 for n in range(1, 31)}, 101: 100, 102: 100}


@pytest.mark.parametrize("many", [1, 1 << 40], ids=["joined", "looked up"])
def test_lines(spark, many, monkeypatch):
    monkeypatch.setattr(lines, "MANY", many)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    docs = list(dict.fromkeys(TEXTS))
    count = collections.Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    expected, first = {}, {}
    for number, text in TEXTS:
        own = (text or "").split("\n")
        kept = [x for x in own if not (key(x) and count[key(x)] >= 10)]
        expected.setdefault(number, []).append((len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    found = by_id(lines.drop_lines(table(spark, TEXTS), min_docs=10), "n_lines", "n_dropped", "kept_sha256", "kept")
    assert found == expected
    first = by_id(lines.drop_lines(table(spark, TEXTS), min_docs=10, keep_first=True, carry=True), "n_dropped")
    assert first[13] == [(0,)] and first[25] == [(2,)]
    assert lines.drop_lines(empty(spark)).count() == 0
    nulls = [(None, f"shared\nown {n}") for n in range(3)] + [(None, None), (4, "SHARED "), (4, "SHARED ")]
    found = by_id(lines.drop_lines(table(spark, nulls), min_docs=4), "n_lines", "n_dropped", "kept")
    assert sorted(found[None]) == [(1, 0, ""), *[(2, 1, f"own {n}") for n in range(3)]] and found[4] == [(1, 1, "")] * 2
    found = by_id(lines.drop_lines(table(spark, nulls), min_docs=4, keep_first=True), "n_dropped")
    assert sorted(x for (x,) in found[None]) == [0, 0, 1, 1] and found[4] == [(1,)] * 2
    assert spark.sql("SHOW TABLES").where("tableName LIKE 'run%'").count() == 0


def test_line_index(spark):
    chance = random.Random(5)
    pairs = [(n, n, int(chance.paretovariate(0.6)), n % 11) for n in range(700) for _ in range(4)]
    rows = spark.createDataFrame([(a, b, h, h * 7, batch) for a, b, h, batch in pairs], "doc_id long, rk long, h1 long, h2 long, batch int")
    rows = common.saved(rows.repartition(3), "rows")
    index, whole, merges = lines.LineIndex(spark, 10), collections.Counter(h for h, _ in {(h, n) for n, _, h, _ in pairs}), 0
    for batch in range(11):
        with common.bucket_order(spark):
            found = index.unsettled(rows.where(F.col("batch") == batch))
            plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            merges += plan.count("SortMergeJoin")
            # the batch is exchanged twice and sorted once, in front of all runs; these are neither
            assert plan.count("Exchange") == 2 and plan.count("Sort [") == (1 if batch else 0)
        index.add(rows.where(F.col("batch") == batch))
        held = {n for n in range(batch + 1)}
        assert [run is not None for run in index.levels] == [bool(batch + 1 >> level & 1) for level in range((batch + 1).bit_length())]
        if batch == 5:
            with common.bucket_order(spark):
                plan = index.merged(*index.runs())._jdf.queryExecution().executedPlan().toString()
            assert "FullOuter" in plan and "Exchange" not in plan and "Sort [" not in plan
            so_far = collections.Counter(h for h, _ in {(h, n) for n, _, h, b in pairs if b in held})
            settled = {h for h, n in so_far.items() if n >= 10}
            kept = [(r.h1, r.docs) for run in index.runs() for r in run.collect()]
            assert {h for h, _ in kept} == set(so_far)
            for h, n in so_far.items():
                docs = sum(d for own, d in kept if own == h)
                assert docs == n or h in settled and 10 <= docs <= n
    assert merges > 15
    found, counted = index.frequent()
    assert {r.h1 for r in found.collect()} == {h for h, n in whole.items() if n >= 10} and len(pairs) >= counted >= len(whole)


def test_quality(spark):
    expected = {}
    for number, text in TEXTS:
        text = text or ""
        words, seen, again = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        count = collections.Counter(tuple(words[n : n + 5]) for n in range(len(words) - 4))
        inside = {n + k for n in range(len(words) - 4) if count[tuple(words[n : n + 5])] > 1 for k in range(5)}
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        expected.setdefault(number, set()).add((len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(inside), failed))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = quality.quality_rules(table(spark, TEXTS))
    assert {n: set(x) for n, x in by_id(found, *names).items()} == expected
    assert all(not r.kept for r in found.collect() if r.base_failed)
    assert quality.quality_rules(empty(spark)).count() == 0


def test_depleted_documents(spark):
    unique = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    shared = "this very long line stands in a great many documents of one host only and nowhere else at all"
    texts = [(n, f"{shared}\nw{n} x{n} y{n}") for n in range(30)] + [(99, unique), *[(200 + n, unique + " nu xi") for n in range(40)]]
    kept = by_id(quality.quality_rules(table(spark, texts)), "kept")
    assert not any(kept[n][0][0] for n in range(30)) and kept[99] == [(True,)] and kept[200] == [(True,)]
    kept = by_id(quality.quality_rules(table(spark, texts + [texts[30]] * 40), count_copies=True), "kept")
    assert not any(x for n in [*range(30), *range(200, 240)] for (x,) in kept[n]) and kept[99] == [(True,)] * 41  # one row 41 times


def test_boilerplate_blocks(spark):
    block = "\n".join(f"line {n} of a block that stands on every page of this host and says nothing new" for n in range(50))
    own = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    texts = [(n, f"{block}\nonly {n}") for n in range(60)] + [(100 + n, f"{block}{' ' * n}") for n in range(25)]
    texts += [(200 + n, own) for n in range(30)] + [(300 + n, f"{own} {n}") for n in range(30)] + [(400 + n, f"a line on twenty pages only, which is the limit of the host and no more {'!' * 3}\nz{n}") for n in range(20)]
    docs = {n: {line.strip().lower() for line in t.split("\n")} for n, t in texts}
    count = collections.Counter(line for whole in {t: n for n, t in texts}.values() for line in docs[whole])
    expected = {}
    for n, text in texts:
        left = sum(len(line.split()) for line in text.split("\n") if count[line.strip().lower()] <= 20)
        cut = any(count[line] > 20 for line in docs[n])
        expected[n] = [(not cut or left >= 10 and 100 * left >= 20 * len(text.split()),)]
    found = by_id(quality.quality_rules(table(spark, texts), max_repeat_percent=100), "kept")
    assert found == expected and not found[0][0][0] and not found[100][0][0] and found[200][0][0] and found[400][0][0]


def test_cascade(spark):
    chance = random.Random(4)
    keys = [f"h{n}" for n in range(4000)]
    listed = set(chance.sample(keys, 300))
    universe = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    cascade = urls.build_cascade(universe, shard_keys=700)
    rows = spark.createDataFrame([(k,) for k in keys], "key string")
    for pass_bytes in (1 << 20, 300):
        assert {r.key for r in urls.members(rows, "key", cascade, pass_bytes).collect() if r.listed} == listed


def test_urls(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    given = ["http://WWW.Example.COM/en/71?x#y", "https://a.com/en/1", "b.example.net/de/8", "http://b.example.net/de/81", "ftp://x.net/de/", None, "", "http://bad.host", "http://notcom/en/", "a://org/es/?q"]
    pages = spark.createDataFrame([(n, u, "x") for n, u in enumerate(given)], "page_id long, url string, listed string")
    found = urls.judge_urls(pages, spark.createDataFrame([("bad.host",), (None,)], "host string"), rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got[0] == ("www.example.com", "/en/71", "example.com/en/7", "allow") and got[1] == ("a.com", "/en/1", "com/en/", "block")
    assert got[2] == ("", "", None, "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow")
    assert got[5] == ("", "", None, "allow") and got[7] == ("bad.host", "", None, "block") and got[8][2:] == (None, "allow") and got[9][2:] == ("org/es/", "block")


@pytest.mark.parametrize("queries", [16, 3])
def test_nearest(spark, queries, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATES", 40)
    monkeypatch.setattr(nearest, "QUERIES", queries)
    if queries == 3:  # a hash that deals all blocks alike: blocks are told by their ids, not by it
        monkeypatch.setattr(nearest, "_dealt", lambda count: F.lit(0).cast("long"))
    chance = np.random.default_rng(9)
    vectors = chance.normal(size=(300, 12)).astype(np.float32)
    vectors[50:90] = vectors[7]
    data = [(n, v.tolist(), "x") for n, v in enumerate(vectors)]
    data += [(300, None, "x"), (301, [0.0] * 12, "x"), (302, [float("nan")] * 12, "x"), (303, [None] * 12, "x"), (None, [1.0] * 12, "x"), (304, [float("inf")] + [0.0] * 11, "x"), (305, [], "x"), (306, [1.0, 2.0], "x")]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank string")
    found = nearest.nearest(rows, rows.where("vec_id % 20 = 0"), k=5)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wide = vectors.astype(np.float64)
    for query in range(0, 300, 20):
        score = np.zeros(300)
        for d in range(12):
            score += wide[:, d] * wide[query, d]
        order = [n for n in np.lexsort((np.arange(300), -score)) if n != query][:5]
        assert got[query] == [(n, score[n]) for n in order]
    assert set(got) == set(range(0, 300, 20))


def test_packing(spark):
    packed = packing.pack_documents(table(spark, TEXTS), capacity=256, with_ids=True).collect()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokens.default_vocabulary())
    whole = {n: coder.encode(t or "", add_special_tokens=False).ids + [1] for n, t in TEXTS}
    pieces, bins = {}, {}
    for r in packed:
        pieces.setdefault((r.doc_id, r.piece), []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
        assert r.ids == whole[r.doc_id][r.start : r.start + r.length] and r.length <= 256 and r.start == 256 * r.piece
    assert set(pieces) == {(n, k) for n, ids in whole.items() for k in range(-(-len(ids) // 256))} and len(pieces[40, 0]) == 2
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *[r.length for r in rows]])[:-1].tolist() and sum(r.length for r in rows) <= 256
    assert len(bins) <= -(-sum(r.length for r in packed) // 256) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_rounds(spark):
    chance = random.Random(2)
    sizes = spark.createDataFrame([(n, chance.randint(1, 60)) for n in range(600)], "doc_id long, length long")
    rows = packing.pack_pieces(sizes, 100, group_rows=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(600))
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 100 and len(fill) <= 1.03 * sum(fill.values()) / 100 + 1


def test_packing_without_progress(spark, monkeypatch):
    rounds = []
    fit = packing._fit
    monkeypatch.setattr(packing, "_fit", lambda *a: rounds.append(a[3]) or (fit(*a) if len(rounds) < 6 else pytest.fail("rounds without progress")))
    rows = packing.pack_pieces(spark.createDataFrame([(n, 60) for n in range(300)], "doc_id long, length long"), 100, group_rows=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(300)) and len({r.sequence_id for r in rows}) == 300 and rounds == [0]


def test_local_search_empties_bins():
    sizes = np.array([60, 60, 40, 40, 50, 50])
    assert len(packing.local_search([[0, 4], [1], [2, 3], [5]], sizes, 110)) <= 3


def test_word_pieces(spark):
    chance = random.Random(8)
    for _ in range(60):
        pieces = {tuple(chance.choice(b"ab") for _ in range(chance.randint(1, 4))) + ((-1,) if chance.random() < 0.4 else ()) for _ in range(6)}
        counter = tokens.PieceCounter(sorted(pieces))
        for _ in range(20):
            word = bytes(chance.choice(b"ab") for _ in range(chance.randint(1, 9)))
            rest, n = (*word, -1), 0
            while rest and n >= 0:
                size = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces or rest[:k] == (-1,)), 0)
                n = n + (rest[:size] != (-1,)) if size else -1
                rest = rest[size:]
            assert counter.count(word) == n
    found = by_id(tokens.piece_counts(table(spark, TEXTS)), "n_words", "n_tokens")
    assert found[0] == [(0, 0)] and found[3][0][0] == 1 and found[41][0][1] >= 3000


def test_exact_ids():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokens.default_vocabulary())
    texts = ["it's a\x85b\xa0c　d İX ΑΣ. é ́x a\x1cb <|endoftext|>x 12 3don't'll", "", "A, b.. C", *[t or "" for _, t in TEXTS]]
    assert tokens.WordIds(tokens.default_vocabulary()).texts(texts) == [np.array(coder.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_mixing(spark):
    chance = random.Random(6)
    plain = lambda n: " ".join(chance.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n))
    texts = [(n, plain(40) if n % 4 else plain(20) + " awful nasty " + plain(18)) for n in range(200)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(n, "good" if n % 4 else "bad") for n in range(120)] + [(None, "good"), (5000, "bad"), (3, "other")], "doc_id long, domain string")
    rated = mixing.mix_rates(table(spark, texts), labels, {"good": 0.9, "bad": 0.1}).collect()
    unseen = [r for r in rated if 120 <= r.doc_id < 200]
    assert sum((r.p_bad > 0.5) == (r.doc_id % 4 == 0) for r in unseen) >= 0.95 * len(unseen)
    total = {d: sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rated) for d in ("good", "bad")}
    assert total["good"] / sum(total.values()) == pytest.approx(0.9, abs=0.005) and all(r.rate >= 0 for r in rated) and len(rated) == 202
    kept = {r.doc_id for r in mixing.mixed_documents(table(spark, texts), labels, {"good": 0.98, "bad": 0.02}, "good").collect()}
    assert len([n for n in range(200) if n % 4 and n in kept]) >= 147 and len([n for n in range(0, 200, 4) if n in kept]) < 25
    with pytest.raises(ValueError):
        mixing.mix_rates(table(spark, texts), labels, {"good": 0.5, "absent": 0.5})
    assert mixing.mix_rates(empty(spark), labels, {"good": 0.9, "bad": 0.1}).count() == 0


@pytest.mark.parametrize("share", [[0.6, 0.3, 0.1], [0.9, 0.09, 0.01], [1, 0, 0], [0.02, 0.02, 0.96]], ids=["inside", "edge", "zero", "out of reach"])
def test_mixing_least_squares(spark, share):
    chance = np.random.default_rng(3)
    p, n = chance.dirichlet([2, 0.5, 0.5], 400), 50.0 + np.arange(400) % 7
    tokens_of = n[:, None] * p
    own, rate = tokens_of.sum(0), np.ones(400)
    goal = np.array(share) * min(o / s for o, s in zip(own, share) if s > 0)
    loss = lambda x: ((x - goal) ** 2 / own).sum()
    steps, reached, final = mixing.descend(lambda steps: mixing.batch_sums(p, n, steps, None), goal, own, 3, 1e-3, None)
    for _ in range(60000):  # plain projected gradient over all rates at once
        rate = np.maximum(rate - p @ ((rate @ tokens_of - goal) / own), 0)
    assert loss(reached) <= loss(rate @ tokens_of) + 1e-3 * loss(own) and len(steps) < 100
    assert final == (np.abs(reached - goal) <= 1e-3 * np.where(goal > 0, goal, goal.sum())).all()
    if share[0] == 0.9:
        scored = spark.createDataFrame([(at, int(size), x.tolist()) for at, (size, x) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
        rated, totals, wanted = mixing.solve_rates(scored, lambda _: goal, 3)
        rates = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
        assert (rates >= 0).all() and rates @ tokens_of == pytest.approx(totals) and totals == pytest.approx(wanted, rel=2e-3) and totals == pytest.approx(reached.tolist())


def test_mixing_once(spark, caplog):
    chance = np.random.default_rng(3)
    p = chance.dirichlet([2, 0.5, 0.5], 400)
    scored = spark.createDataFrame([(n, 50 + n % 7, x.tolist()) for n, x in enumerate(p)], "doc_id long, n_tokens long, p array<double>")
    rated, reached, goal = mixing.solve_rates(scored, lambda own: own[0] * np.array([0.9, 0.06, 0.04]) / 0.9, 3, once=0)
    rows = rated.collect()
    assert all(0 <= r.rate <= 1 for r in rows) and all(r.rate == 1 for r in rows if np.argmax(r.p) == 0)
    sums = np.sum([r.rate * r.n_tokens * np.array(r.p) for r in rows], axis=0)
    assert reached == pytest.approx(sums.tolist())
    # plain projected gradient over all rates at once
    tokens_of, rate = np.array([[r.n_tokens] * np.array(r.p) for r in rows]), np.ones(len(rows))
    lead = np.array([float(np.argmax(r.p) == 0) for r in rows])
    scale = tokens_of.sum(0)
    for _ in range(4000):
        rate = np.clip(rate - np.array([r.p for r in rows]) @ ((rate @ tokens_of - goal) / scale), lead, 1)
    loss = lambda x: ((x - np.array(goal)) ** 2 / scale).sum()
    assert loss(np.array(reached)) <= 1.02 * loss(rate @ tokens_of) + 1e-3


def test_local_search_against_all_exchanges():
    """No move, one-for-one or two-for-one exchange is left that fills the fuller of two underfull bins further."""
    chance = random.Random(12)
    for _ in range(30):
        sizes = np.array([chance.randint(3, 90) for _ in range(24)])
        bins = packing.local_search([[n, n + 12] if sizes[n] + sizes[n + 12] <= 100 else [n] for n in range(12)] + [[n + 12] for n in range(12) if sizes[n] + sizes[n + 12] > 100], sizes, 100)
        assert sorted(p for b in bins for p in b) == list(range(24))
        fill = [int(sizes[b].sum()) for b in bins]
        assert max(fill) <= 100
        for i, target in enumerate(bins):
            for j, source in enumerate(bins):
                if i == j or fill[j] > fill[i] or fill[i] == 100:
                    continue
                gains = [sizes[p] for p in source] + [sizes[p] - sizes[q] for p in source for q in target]
                gains += [sizes[p] + sizes[r] - sizes[q] for n, p in enumerate(source) for r in source[n + 1 :] for q in target]
                assert not any(0 < g <= 100 - fill[i] for g in gains)


def shuffled_bytes(spark):
    jvm, sc = spark._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))


def test_texts_without_copies_do_not_travel(spark):
    """The near-duplicate stage shuffles keys, and texts only of documents that have a partner: not all texts, twice."""
    import corpus_pipeline

    chance = random.Random(5)
    texts = [(n, " ".join(f"{chance.getrandbits(64):x}" for _ in range(1200))) for n in range(120)]
    texts += [(200, texts[7][1]), (201, texts[8][1] + " more"), (202, None), (203, ""), (None, texts[9][1]), (5, texts[5][1])]
    docs, before = table(spark, texts), shuffled_bytes(spark)
    kept = [r.doc_id for r in corpus_pipeline.keep_one_copy(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([*(n for n in range(120) if n != 9), 202, None], key=str)
    assert shuffled_bytes(spark) - before < sum(len(t or "") for _, t in texts) / 4


def test_bit_maps_miss_nothing(spark, monkeypatch):
    chance = random.Random(3)
    for size in (1 << 24, 1 << 16, 8):
        monkeypatch.setattr(common, "BITS", size)
        keys = [chance.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, 1, -1, 32768, 32769, (1 << 63) - 1]
        rows = spark.createDataFrame([(k,) for k in keys], "rk long")
        found = {r.rk: r.maybe for r in common.may_be_among(rows, rows.where("rk % 3 = 0")).collect()}
        among = {k % size for k in keys if k % 3 == 0}
        assert found == {k: k % size in among for k in keys}
    assert not any(r.maybe for r in common.may_be_among(rows, rows.where("false")).collect())


def test_words_that_come_once_are_not_remembered(monkeypatch):
    """Rare words do not push out frequent ones, and ids are the tokeniser's own whatever is remembered or forgotten."""
    from tokenizers import Tokenizer

    own, chance = Tokenizer.from_file(tokens.default_vocabulary()), random.Random(4)
    rare = lambda: "".join(chance.choices("abcdefghijklmnopqrstuvwxyzé", k=12))
    many = [[f"The {rare()}, said {rare().title()}. The-end 3x {rare()}*** THE the, (said)" for _ in range(20)] for _ in range(12)]
    for room, marks in ((1 << 20, 1 << 22), (2000, 1 << 22), (1 << 20, 8)):
        monkeypatch.setattr(tokens, "ROOM", room)
        monkeypatch.setattr(tokens, "SEEN", marks)
        coder = tokens.WordIds(tokens.default_vocabulary())
        for texts in many:
            assert coder.texts(texts) == [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert marks == 8 or room == 2000 or ({"The", "said", "the,", "THE", "3x"} <= coder.memory.keys() and len(coder.memory) < 40)


def test_stars_need_no_step(spark, monkeypatch):
    """Links that are stars already, each below its smallest node, are the components: nothing is joined again."""
    steps = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda edges, large: steps.append(large) or star(edges, large))
    link = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    roots = lambda pairs: sorted(map(tuple, components.components(link(pairs)).collect()))
    assert roots([(1, 4), (5, 1), (1, 5), (2, 2), (7, 8)]) == [(4, 1), (5, 1), (8, 7)] and roots([]) == [] and not steps
    assert roots([(4, 1), (4, 2)]) == [(2, 1), (4, 1)] and len(steps) == 2
    assert roots([(n, n + 1) for n in range(40)]) == [(n, 0) for n in range(1, 41)]
