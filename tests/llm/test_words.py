"""Alignment of tokenisers, spelling variants and benchmark overlap against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from timeloom.llm import alignment, leaks, spelling

from test_llm import TEXTS, by_id, empty, lower, table

PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu?"),
    (2, "short é item"),
    (3, "short é item"),
    (4, None),
    (5, " .,; "),
    (10, "mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega 7"),
    (6, "of"),
    (7, "the the the the the the the the the the the the"),
]
FOUND = [
    (100, "so ALPHA Beta gamma-delta epsilon zeta eta theta iota kappa! and lambda"),
    (101, "x beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega 7"),
    (102, "Short É item; short é item, sHort é\n\nITEM"),
    (103, "ééé 日本 short é item of 日本"),
    (104, ("the " * 30 + "end ") * 3),
    (105, "shorté item"),
    (106, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (107, None),
    (107, "of"),
    (107, "of"),
    (108, "word " * 20000 + "short é item"),
]


def plain_hits(text, width=10):
    own = PART.findall(lower(text or ""))
    hit, items = set(), set()
    for item, said in ITEMS:
        words = PART.findall(lower(said or ""))
        windows = {tuple(words[n : n + width]) for n in range(max(1, len(words) - width + 1))} - {()}
        for window in windows:
            for at in range(len(own) - len(window) + 1):
                if tuple(own[at : at + len(window)]) == window:
                    hit.update(range(at, at + len(window)))
                    items.add(str(item))
    return own, hit, sorted(items)


@pytest.mark.parametrize("part_bytes", [1 << 20, 300], ids=["one", "parts"])
def test_benchmark_hits(spark, part_bytes, monkeypatch):
    monkeypatch.setattr(leaks, "PART_BYTES", part_bytes)
    items = spark.createDataFrame([*ITEMS, (None, "one two three")], "item_id long, text string")
    docs = TEXTS + FOUND
    found = by_id(leaks.benchmark_hits(table(spark, docs), items), "n_words", "n_hit", "items", "spans")
    expected = {}
    for doc, text in docs:
        own, hit, names = plain_hits(text)
        expected.setdefault(doc, []).append((len(own), len(hit), names))
        for row in found[doc]:
            if row[:3] == (len(own), len(hit), names):
                assert {n for s in row[3] for n in range(s.first, s.last + 1)} == hit
                for s in row[3]:  # offsets are those of the original text
                    assert PART.findall(lower(text[s.start : s.end])) == own[s.first : s.last + 1]
                assert all(x.last + 1 < y.first for x, y in zip(row[3], row[3][1:]))
                break
        else:
            raise AssertionError((doc, expected[doc], found[doc]))
    assert {k: sorted(x[:3] for x in v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert leaks.benchmark_hits(empty(spark), items).count() == 0
    clean = leaks.benchmark_hits(table(spark, docs), items.limit(0))
    assert clean.count() == len(docs) and clean.where("n_hit > 0 or size(items) > 0").count() == 0


# ---- spelling ------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:n] + long[n + 1 :] == short for n in range(len(long)))


def plain_forms(counts, ratio):
    out = {}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    for word, own in near.items():
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * counts[word] else None
        out[word] = [form, counts[word], len(own), counts[form] if form else None]
    for word in counts:
        root = word
        while out[root][0]:
            root = out[root][0]
        out[word].append(root)
    return {w: tuple(x) for w, x in out.items()}


WORDS = {"colour": 500, "color": 2600, "colours": 90, "colouur": 3, "coluor": 4, "clour": 2, "éclair": 70, "eclair": 9, "éclairs": 12, "aaaaaa": 40, "aaaaa": 40, "aaaab": 8, "baaaaa": 8, "aaaaaab": 1, "ab": 7, "b": 1, "a": 30, "": 2, "x" * 300: 5, "x" * 299: 50, "y" + "x" * 299: 1}


@pytest.mark.parametrize("symbols", [1, 2, 4, 9])
def test_spelling_forms(spark, symbols):
    words = spark.createDataFrame([*WORDS.items()], "word string, n long")
    found = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in spelling.spelling_forms(words, 5, symbols).collect()}
    assert found == plain_forms(WORDS, 5)
    assert spelling.spelling_forms(words.limit(0)).count() == 0
    assert spelling.near_words(words.union(spark.createDataFrame([(None, 3)], "word string, n long"))).where("word is null or near is null").count() == 0


def test_spelling_roots_follow_long_ways(spark):
    words = {"m" * 12 + "abcdefgh"[:n] + "q" * (8 - n): 5**n for n in range(9)}
    found = {r.word: r.root for r in spelling.spelling_forms(spark.createDataFrame([*words.items()], "word string, n long")).collect()}
    assert set(found.values()) == {max(words, key=words.get)}


def test_reduced_keys_meet_and_stay_few():
    letters = spelling._Reduced(3)
    words = [w for w in WORDS if 0 < len(w) < 20]
    for word in words:
        for other in words:
            if one_edit(word, other):
                assert spelling.neighbour_keys(word, letters) & set(spelling.own_keys(other, letters)), (word, other)


def test_corpus_words(spark):
    docs = [*TEXTS, (7, "Élan ÉLAN élan×÷ naïve NAÏVE Ÿnaïve"), (8, "Straße STRASSE"), (9, "abc_defgh,abcdefgh ΑΒΓΔΕΖ letters123letters"), (None, "nobody Nobody")]
    docs += [(1000 + n, "wonderful spelling of colourful letters") for n in range(300)]
    expected = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 17 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            expected[run] += 1
    for least, count in ((1, 1), (6, 5)):
        found = spelling.corpus_words(table(spark, docs), min_chars=least, min_count=count, slip=17).collect()
        assert sorted((r.word, r.n) for r in found) == sorted((w, n) for w, n in expected.items() if len(w) >= least and n >= count)
    assert spelling.corpus_words(empty(spark)).count() == 0
    assert spelling.corpus_words(table(spark, [(1, "same Same")]), min_chars=1, min_count=1, slip=0).collect()[0].n == 2


# ---- alignment -----------------------------------------------------------------------------------------------------


def plain_alignment(text):
    """Ids by the libraries on the whole text, groups and links by loops over all bytes."""
    aligner = alignment.PairAligner.shared(*alignment.default_tokenizers())
    if not text:
        return None
    ids = [aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)]
    owner, ends = [], []
    for tokens, known in zip(ids, (aligner.bytes_a, aligner.bytes_b)):
        if b"".join(known[n] for n in tokens) != (" " + text).encode():
            return None
        owner.append([at for at, n in enumerate(tokens) for _ in known[n]])
        total, found = 0, set()
        for n in tokens:
            total += len(known[n])
            found.add(total)
        ends.append(found)
    cuts = sorted(ends[0] & ends[1])
    groups, start = [], 0
    for end in cuts:
        sides = [",".join(str(ids[k][n]) for n in sorted(set(owner[k][start:end]))) for k in (0, 1)]
        groups.append("|".join(sides))
        start = end
    links = [(ids[0][a], ids[1][b]) for a, b in set(zip(*owner))]
    return len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


ODD = [
    "It's  a   test.\n\n  Indented\ttabs \r\n windows\r\nlines; x);\r\ny",
    "<|endoftext|> <s> </s> <unk> <0x0A> plain",
    "naïve éàü 日本語テキスト 한국어 ﬁ１ 😀👩‍👩‍👧 ​ nbsp　wide   line",
    "a\x1cb \x1f c\x85d",
    "under▁line",
    " leading",
    "trailing  ",
    "\n",
    " ",
    "\r\n",
    "x\r",
    "\x00\x01",
    "ab" * 4000,
    "http://x.y/z?a=b&c=d#e " * 40,
    "12345 6789 3.14 -- ... ... !!!??? ((())) {}[]",
    "word;\r more);\r\n  \rx  \r \r",
    "́combining é ",
]


@pytest.mark.parametrize("near", [16, 1])
def test_alignment(spark, near, monkeypatch):
    monkeypatch.setattr(alignment, "NEAR", near)
    monkeypatch.setattr(alignment, "SLICE", 4000)
    docs = TEXTS + [(200 + n, t) for n, t in enumerate(ODD)] + [(300, ODD[0]), (300, ODD[0]), (None, ODD[0])]
    plain = [(doc, plain_alignment(text)) for doc, text in docs]
    count = collections.Counter(link for _, p in plain if p for link in p[3])
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    expected = {}
    for doc, p in plain:
        row = (0, 0, 0, 0, 0, 0, "") if p is None else (p[0], p[1], p[2], len(p[3]), sum(count[x] == best[x[1]] for x in p[3]), sum(count[x] for x in p[3]), p[4])
        expected.setdefault(doc, []).append(row)
    for frequent in (1 << 18, 40, 1):
        found = by_id(alignment.alignment_scores(table(spark, docs), frequent=frequent), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert alignment.alignment_scores(empty(spark)).count() == 0
    assert any(p is None and t for (_, p), (_, t) in zip(plain, docs)) and max(len(p[3]) for _, p in plain if p) > 3000


@pytest.mark.parametrize("near", [16, 1])
def test_leaf_groups(near, monkeypatch):
    monkeypatch.setattr(alignment, "NEAR", near)
    chance = np.random.default_rng(3)
    for _ in range(200):
        sides, bounds, base = ([], []), ([0], [0]), 0
        for _ in range(chance.integers(0, 6)):
            size = int(chance.integers(0, 60))
            for side, bound in zip(sides, bounds):
                if size:
                    inner = chance.choice(np.arange(1, size + 1), chance.integers(1, size + 1), replace=False)
                    side += sorted({*(base + inner).tolist(), base + size})
                bound.append(len(side))
            base += size
        a, b = (np.array(side, np.int64) for side in sides)
        groups = alignment.leaf_groups(a, b, np.array(bounds[0]), np.array(bounds[1])).tolist()
        assert [a[g[1] - 1] for g in groups] == [b[g[3] - 1] for g in groups] == sorted({*sides[0]} & {*sides[1]})
        assert all((x[1], x[3]) == (y[0], y[2]) for x, y in zip(groups, groups[1:]))
        inside = lambda ends, n: (ends[n - 1] if n else 0, ends[n])
        links = sorted(zip(*(x.tolist() for x in alignment.overlaps(a, b))))
        assert links == [(x, y) for x in range(len(a)) for y in range(len(b)) if max(inside(a, x)[0], inside(b, y)[0]) < min(inside(a, x)[1], inside(b, y)[1])]


def test_engine_of_ranks_agrees():
    aligner = alignment.PairAligner.shared(*alignment.default_tokenizers())
    assert aligner.ranks is not None
    for text in [t for _, t in TEXTS if t] + [t for t in ODD if t]:
        assert aligner.ids_a(text) == aligner.a.encode(" " + text, add_special_tokens=False).ids
