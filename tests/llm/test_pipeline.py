"""The pipeline, stage by stage, against plain versions of the same decisions."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from cuespan.llm.mixing import targets


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "123 456", "en", "src0", 7)], docs.schema)
    docs = docs.union(junk)
    rows = {r.doc_id: r for r in docs.collect()}

    first = P.STAGES[0][1](spark, docs, sf)
    assert first.columns == P.COLUMNS
    kept = {r.doc_id for r in first.collect()}
    assert set(rows) - kept == {10**6, 10**6 + 1}  # only what has no letter goes

    second = P.STAGES[1][1](spark, first, sf)
    got = {r.doc_id for r in second.collect()}
    last = {}
    for i in sorted(kept):
        last[rows[i].text] = i
    assert got == set(last.values())

    third = P.STAGES[2][1](spark, second, sf)
    sets = {i: shingles(rows[i].text) for i in got}
    low = {i: i for i in got}
    links = [(a, b) for a, b in itertools.combinations(sorted(got), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in got:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    near = {r.doc_id for r in third.collect()}
    assert near == {i for i in got if low[i] == i}

    fourth = P.STAGES[3][1](spark, third, sf)
    assert fourth.columns == P.COLUMNS
    mixed = [r.doc_id for r in fourth.collect()]
    size = lambda i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text))
    total = {}
    for i in near:
        total["s" + rows[i].source] = total.get("s" + rows[i].source, 0) + size(i)
    goal = targets(total)
    assert set(mixed) <= near and max(map(mixed.count, set(mixed))) <= 2
    assert 0.8 <= sum(map(size, mixed)) / sum(goal.values()) <= 1.2

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.PIECES))
    fifth = P.STAGES[4][1](spark, fourth, sf).collect()
    assert sorted(r.doc_id for r in fifth) == sorted(mixed)
    for r in fifth[:40]:
        ids = library.encode(rows[r.doc_id].text)
        assert list(r.piece_ids) == ids and r.n_pieces == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_null_repeated_and_clashing_ids(spark):
    """Each stage decides by row: every id comes with a text of its own, whole lines of letters."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(60)
    texts = list(dict.fromkeys(r.text for r in docs.collect() if r.lang == "en"))[:6]
    alone, twice, left, right, copy, null_copy = texts
    near = right + " more"
    extra = [
        (None, alone), (5_000_000, twice), (5_000_000, twice), (5_000_001, left), (5_000_001, right), (5_000_002, near),
        (5_000_003, copy), (5_000_001, copy), (None, null_copy), (5_000_004, null_copy), (None, None), (None, "!"),
    ]
    rows = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in extra], docs.schema)
    bag = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    order = lambda x: sorted(x, key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    others = docs.where(~docs.text.isin(texts))
    known = {r.doc_id for r in others.collect()}
    own = lambda df: [x for x in bag(df) if x[0] not in known]
    first = P.STAGES[0][1](spark, others.union(rows), sf)
    assert own(first) == order(extra[:-2])

    second = P.STAGES[1][1](spark, rows.where("length(text) > 1"), sf)
    unique = [(None, alone), (5_000_000, twice), (5_000_001, left), (5_000_001, right), (5_000_002, near), (5_000_003, copy), (5_000_004, null_copy)]
    assert second.columns == P.COLUMNS and bag(second) == order(unique)

    third = P.STAGES[2][1](spark, second, sf)
    assert third.columns == P.COLUMNS and bag(third) == order([x for x in unique if x[1] != near])
    # Alone, the stage drops repeated rows and null copies too.
    third_alone = P.STAGES[2][1](spark, rows.where("length(text) > 1"), sf)
    assert bag(third_alone) == order([x for x in unique if x[1] not in (near, copy)] + [(5_000_001, copy)])

    # One source: no row above twice its words, 1.5 times all words; each row comes at least once.
    fourth = P.STAGES[3][1](spark, third, sf)
    assert fourth.columns == P.COLUMNS and set(bag(fourth)) == set(bag(third)) and max(map(bag(fourth).count, bag(fourth))) <= 2
    both = P.STAGES[3][1](spark, rows.where("doc_id = 5000000"), sf)
    assert 2 <= both.count() <= 4

    fifth = P.STAGES[4][1](spark, fourth, sf).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.PIECES))
    ids = lambda x: (x[0] is None, x[0] or 0, list(x[1]))
    assert sorted(((r.doc_id, r.piece_ids) for r in fifth), key=ids) == sorted(((i, library.encode(t)) for i, t in bag(fourth)), key=ids)


def test_empty_tables_extra_columns_and_blank_texts(spark):
    """Stages read the columns of documents only, take tables without rows, and say what becomes of texts without words."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 12")
    clash = {c: F.lit("x") for c in ("_key", "_row", "_hash", "_rows", "_times", "_id", "component_id", "kept", "size", "taken", "text_sha256", "lang_pred", "score")}
    none = docs.where("false").withColumns(clash)
    for name, stage in P.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0 and (out.columns == P.COLUMNS or name == "pieces")
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n", "en", "a", 2), (4, "one two three four five six", "en", "a", 27)], docs.schema).withColumns(clash)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(P.exact_stage(spark, blank, sf)) == [2, 3, 4]  # null and empty are equal
    assert ids(P.near_stage(spark, blank, sf)) == [1, 2, 3, 4]  # no words, no near-duplicates
    assert set(ids(P.mixing_stage(spark, blank, sf))) == {4}  # no words, nothing to take
    pieces = {r.doc_id: r.n_pieces for r in P.pieces_stage(spark, blank, sf).collect()}
    assert pieces[1] == pieces[2] == 0 < pieces[4]
