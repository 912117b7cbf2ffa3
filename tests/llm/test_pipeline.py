"""Every stage of the pipeline against plain loops over what the stage before it kept."""

import collections
import random
import zlib

import numpy as np
import pytest
from test_llm import WORD, lower, similar_roots

from timeloom.llm import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk long, batch string, keep boolean"
KEY = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))


def corpus():
    """Unlike documents, copies, near copies, boilerplate of many documents and of one host, junk, nulls, empties,
    repeated rows and one very long text."""
    chance = random.Random(17)
    said = lambda n: " ".join(f"w{chance.randrange(4000)}" for _ in range(n))
    rows = [(n, said(chance.randint(20, 120)), f"h{n % 3}") for n in range(40)]
    rows += [(40 + n, said(40) + "\nA Line of  Twelve documents \n" + said(20), f"h{n % 3}") for n in range(12)]
    shared = said(60)
    rows += [(60 + n, shared + f"\nonly {n} x y", "site") for n in range(25)]  # little is left without the site's line
    copy, near = said(100), said(150).split()
    rows += [(100 + n, copy, f"h{n % 3}") for n in range(6)]
    for n in range(5):
        words = list(near)
        words[7 * n] = f"changed{n}"
        rows.append((110 + n, " ".join(words), "h1"))
    rows += [(120, None, "h0"), (121, "", "h0"), (122, " \n\t ", "h0"), (123, "too short", "h0"), (124, "same same same same " * 20, "h0"), (125, said(6000), "h2"), (126, said(30), None)]
    rows += [(3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (130, "A line of  twelve DOCUMENTS\n" + said(30), "h0")]
    return [(n, t, "en", host, len(t or ""), 7, "x", True) for n, t, host in rows]


def plain_quality(rows):
    hosts = collections.defaultdict(set)
    for _, text, _, host, *_ in rows:
        for line in {KEY(x) for x in (text or "").split("\n")} - {""}:
            hosts[host or "", line].add(text)
    kept = []
    for row in rows:
        words = WORD.findall(row[1] or "")
        count = collections.Counter(tuple(words[n : n + 5]) for n in range(len(words) - 4))
        inside = {n + k for n in range(len(words) - 4) if count[tuple(words[n : n + 5])] > 1 for k in range(5)}
        common = sum(len(WORD.findall(x)) for x in (row[1] or "").split("\n") if KEY(x) and len(hosts[row[3] or "", KEY(x)]) > 20)
        left = len(words) - common
        depleted = common > 0 and (left < 10 or 100 * left < 20 * len(words))
        if len(words) >= 10 and 100 * len(inside) <= 20 * len(words) and not depleted:
            kept.append(row)
    return kept


def plain_lines(rows):
    holders = collections.defaultdict(set)
    for n, text, *_ in rows:
        for line in text.split("\n"):
            if KEY(line):
                holders[KEY(line)].add((n, text))
    out = []
    for row in rows:
        kept = [x for x in row[1].split("\n") if not KEY(x) or len(holders[KEY(x)]) < 10 or min(holders[KEY(x)])[0] == row[0]]
        text = "\n".join(kept)
        out.append((row[0], text, *row[2:4], len(text), *row[5:]))
    return out


def plain_near_duplicates(rows):
    first = {n: row for row in reversed(rows) for n in [row[0]]}
    root = similar_roots([(n, row[1]) for n, row in first.items()])
    return [row for n, row in first.items() if root[n] == n]


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(n, int(n % 4 > 0), int(n % 11 == 0)) for n in range(126)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    rows = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, loops in (("quality", plain_quality), ("lines", plain_lines), ("near_duplicates", plain_near_duplicates)):
        given, rows = rows, loops(rows)
        docs = stages[name](spark, docs, folder)
        assert docs.columns == SCHEMA_COLUMNS and plain(docs) == sorted(rows, key=repr), name
        assert rows != given
        docs = spark.createDataFrame(rows, SCHEMA)
    ids = {row[0] for row in rows}
    assert {40, 110, 100} <= ids and not ids & {101, 111, 60, 84, 120, 121, 122, 123, 124} and {125, 126} <= ids
    mixed = stages["mixing"](spark, docs, folder)
    kept = plain(mixed)
    assert mixed.columns == SCHEMA_COLUMNS and kept and set(kept) <= set(rows) and kept == plain(stages["mixing"](spark, docs, folder))
    docs = spark.createDataFrame(kept, SCHEMA)
    packed = stages["packing"](spark, docs, folder).collect()
    coder = tokens.WordIds(tokens.default_vocabulary())
    pieces, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        filled[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == {row[0] for row in kept}
    for row in kept:
        ids = coder.encoded(row[1]) + np.array([1], "<u4").tobytes()
        cut = [ids[n : n + 4 * 4096] for n in range(0, len(ids), 4 * 4096)]
        assert sorted(pieces[row[0]]) == [(n, n * 4096, len(part) // 4, zlib.crc32(part)) for n, part in enumerate(cut)]
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(length for own in filled.values() for _, length in own)
    assert len(filled) <= -(-total // 4096) + 1


SCHEMA_COLUMNS = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]


def test_stages_of_an_empty_table(spark, folder):
    import corpus_pipeline

    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_run_on_the_smallest_tables(spark):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len({r.doc_id for r in packed}) <= 200
