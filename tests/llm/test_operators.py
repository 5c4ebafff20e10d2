"""The operators against brute force on small, awkward tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cuespan.llm import chunks, common, embedding_dedup, exact_dedup, language_id, minhash_dedup, mixing, pieces, sharding, suffix_dedup, token_store, warc

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
# Extra columns have names that the operators use within.
SCHEMA = "doc_id bigint, text string, lang string, source string, _key string, _hot string, size string, digest string, node string, piece_ids string, lang_pred string, score string, ids_crc32 string, _file string"


def words(rng, n, vocabulary="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron".split()):
    return " ".join(rng.choice(vocabulary) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    long, base = words(rng, 4000), words(rng, 120)
    out = [None, "", " \n\t", "a", "é ß 日本 \U0001f642", long, long, base, base, base.replace("alpha", "ALPHA"), "one two three four", "ONE two\tthree four", "word's  don't\n\n<|endoftext|> 12,345.67 ▁x", "Der Hund läuft. 3 x"]
    for i in range(30):  # near copies of the base, some closer than others
        parts = base.split()
        for _ in range(rng.randint(0, 9)):
            parts[rng.randrange(len(parts))] = f"edit{rng.randint(0, 999)}"
        out.append(" ".join(parts))
    return out + [words(rng, rng.randint(3, 60)) + " " + base[:200] for _ in range(10)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s2", None][i % 4], *["x"] * 10) for i, t in enumerate(texts)]
    rows.append((len(texts), *rows[7][1:]))
    return spark.createDataFrame([*rows, rows[9]], SCHEMA)  # the last row repeats one


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=lambda r: tuple((x is None, x) for x in r))


def test_exact_dedup(spark, docs, empty):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = []
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        want.append((i, max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest()))
    assert by_id(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_keeps_its_index(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    exact_dedup.exact_dedup(docs.where("doc_id < 8"), index).collect()
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    n = again.rows().count()
    out = exact_dedup.exact_dedup(docs, again)
    assert out.where("doc_id = 8").first().keep_id == 7  # the text of 8 came with 7
    assert again.rows().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count() > n


def test_exact_dedup_forgets_its_own_index(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.exact_dedup(docs).count() == docs.count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_no_python_in_exact_dedup(spark, docs):
    assert "Python" not in exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "same"), (None, "same"), (3, "x")], "doc_id bigint, text string").withColumn("source", F.lit(None).cast("string"))
    assert by_id(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept") == [(3, 3, 1, True), (None, None, 2, True), (None, None, 2, True)]
    assert minhash_dedup.near_groups(df).count() == sharding.interleave_shards(df, 2).count() == mixing.mix(df)["documents"].count() == suffix_dedup.repeated_spans(df).count() == token_store.token_report(df, BYTE_BPE).count() == 3


def test_sharding(spark, docs, empty):
    out = sharding.interleave_shards(docs, 4).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(out) == docs.count()
    for _, shard in out.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    counts = out.fillna({"source": "null"}).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 2  # each source spread over the shards
    rows = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(rows[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id]) for r in out.itertuples())
    assert by_id(sharding.interleave_shards(docs, 4), "doc_id", "shard", "slot") == sorted(map(tuple, out[["doc_id", "shard", "slot"]].values.tolist()))
    assert sharding.interleave_shards(empty).count() == 0


def test_mixing(spark, docs, empty):
    parts = mixing.mix(docs, block=8, slots=16)
    out = parts["documents"].toPandas()
    again = mixing.mix(docs, block=8, slots=16)["documents"].toPandas()
    assert sorted(out.taken) == sorted(again.taken) and len(out) == docs.count()
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert all(r["size"] == sizes[r.doc_id] and r.taken <= 2 * r["size"] for _, r in out.iterrows())
    for _, s in out.fillna({"source": "~"}).groupby("source"):
        assert abs(s.taken.sum() - s.target.iloc[0]) <= 16
    slots = parts["slots"].toPandas()
    assert not slots.duplicated(["shard", "slot"]).any() and not slots.duplicated(["_stratum", "block", "epoch"]).any()
    assert mixing.mix(empty)["documents"].count() == 0


def test_mixing_targets():
    goal = mixing.targets({"sa": 100, "sb": 1000, "sc": 10, "n": 400})
    assert list(goal) and goal["sc"] == 20 and abs(sum(goal.values()) - 1.5 * 1510) < 1e-9
    assert goal["sa"] == 200 and goal["sb"] <= 2000 and goal["n"] <= 800


def test_permutation():
    for n in (1, 2, 3, 10, 255, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))


def test_warc(spark, empty, tmp_path):
    big = "ä" * 60
    rows = [(5, "u", big), (3, None, big), (9, "http://x/\r\ny", big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (None, "u", "z" * 200), (3, None, big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("_hot", F.lit(2))
    manifest = warc.write_warc(warc.assign_records(pages), str(tmp_path / "w"))
    back = by_id(warc.read_warc(manifest), "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if h == html and j is not None]
        role = i is not None and len(body) >= 100 and i != min(same)
        want.append((i, "revisit" if role else "response", min(same) if role else None, len(body), hashlib.sha256(body).hexdigest(), None if role else body))
    assert [r[:5] + (None if r[5] is None else bytes(r[5]),) for r in back] == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.warc_round_trip(none).count() == 0


def test_warc_damage_is_found():
    import gzip

    record = warc.record_bytes(1, "u", b"payload" * 50, hashlib.sha256(b"payload" * 50).hexdigest(), None)
    head, block = warc.parse_record(iter([record]))
    assert block.endswith(b"payload") and head["warc-type"] == "response"
    for bad in (record.replace(b"payload", b"paYload", 1), record[:-3], record + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(iter([bad]))
    data = gzip.compress(record) + gzip.compress(record)
    assert [warc.parse_record(m)[1] for m in warc.members(data[i : i + 7] for i in range(0, len(data), 7))] == [block, block]
    with pytest.raises(ValueError):
        list(map(warc.parse_record, warc.members([data[:-5]])))


def test_tokens(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = sorted([(r.doc_id, r.text or "") for r in docs.collect()])
    at, want = 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert by_id(token_store.token_report(docs, BYTE_BPE), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_store.token_report(empty, BYTE_BPE).count() == 0
    path = token_store.write_tokens(docs, BYTE_BPE, str(tmp_path / "t"), 2, files=3)
    some = token_store.read_tokens(spark, path, 10, 12)
    assert by_id(some, "doc_id", "n_tokens") == [(i, n) for i, _, n, _ in want if 10 <= i <= 12]
    assert "PushedFilters: [IsNotNull(doc_id)" in some._jdf.queryExecution().executedPlan().toString()
    assert by_id(token_store.document_starts(spark, path), "doc_id", "start") == [(i, s) for i, s, _, _ in want]


def test_pieces(spark, docs, empty, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = ["  two  spaces ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x\0y", "Привет мир", "ﬁ ̀e", "1.000.000", "tab\tline\nend\n"]
    df = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(1000 + i, t, "o") for i, t in enumerate(odd)], "doc_id bigint, text string, source string"))
    out = pieces.decode_pieces(pieces.encode_pieces(df, PIECES), PIECES).collect()
    for r in out:
        assert list(r.piece_ids) == library.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert all(r.round_trip for r in pieces.piece_report(df, PIECES).collect())
    assert pieces.piece_report(empty, PIECES).count() == 0


def test_suffix_matcher():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abc") for _ in range(400))
    patterns = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 20))) for _ in range(80)} | {data[5:30], data[100:118]})
    piece, at = pieces.SuffixMatcher(patterns).edges(np.frombuffer(data + b"\0", np.uint8))
    want = {(k, i) for k, p in enumerate(patterns) for i in range(len(data)) if data.startswith(p, i)}
    assert set(zip(piece.tolist(), at.tolist())) == want and len(piece) == len(want)


def test_language_forward_pass_sums_all_segmentations():
    own = pieces.PieceEncoder(pieces.PieceTables(open(PIECES, "rb").read()))
    rng = np.random.default_rng(5)
    model = language_id.LanguageModel(["a", "b"], np.log(rng.random((2, len(own.t.text))) + 1e-9))
    scorer = language_id.WordScorer(own, model)
    known = {own.t.text[i]: np.exp(model.log_p[:, i]) for i in own.t.matched}
    for word in ("the", " house", "quizzical", "ß日x"):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[start:i])
                    start = i
            if all(p in known or len(p) == 1 for p in parts):
                total += np.prod([known.get(p, np.full(2, language_id.BARE ** len(p.encode()))) for p in parts], axis=0)
        assert np.allclose(scorer.forward([word.encode()])[0], np.log(total))
    long = ("ab" * 4000).encode()
    assert np.isfinite(scorer.forward([long])).all()
    rare = language_id.LanguageModel(["a", "b"], np.full((2, len(own.t.text)), np.log(1e-35)))  # every piece is next to impossible
    assert np.isfinite(language_id.WordScorer(own, rare).forward([long, b"ab" * 30, "\u65e5".encode() * 900])).all()


def test_language_id(spark, docs, empty):
    out = by_id(language_id.identify_languages(docs, PIECES), "doc_id", "held_out", "lang_pred", "score")
    assert len(out) == docs.count()
    for i, held, lang, score in out:
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0) and lang in ("en", "de", "und") and 0 <= score <= 1
    assert [lang for i, _, lang, _ in out if i in (0, 1, 2)] == ["und"] * 3
    assert language_id.identify_languages(empty, PIECES).count() == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    right = language_id.identify_languages(table, PIECES).join(table, "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95


def component_of(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_near_groups(spark, docs, empty):
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = component_of(sets, links)
    want = {(i, len(s), low[i], low[i] == i) for i, s in sets.items()}
    got = by_id(minhash_dedup.near_groups(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert set(got) == want and len(got) == docs.count()
    assert minhash_dedup.near_groups(empty).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 300)]
    low = component_of({x for e in edges for x in e}, edges)
    got = dict(by_id(common.components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "component"))
    assert got == {x: c for x, c in low.items() if x in got} and all(x in got for a, b in edges if a != b for x in (a, b))


def test_repeated_spans(spark, docs, empty):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    rows += [(2000, b"-" * 300), (2001, b"x" + b"-" * 200 + b"y"), (2002, b"-" * 49)]
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    want = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    more = spark.createDataFrame([(i, t.decode()) for i, t in rows[-3:]], "doc_id bigint, text string")
    got = suffix_dedup.repeated_spans(docs.select("doc_id", "text").union(more), file_bytes=20000)
    assert by_id(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_hot_anchor(spark, tmp_path):
    """A line in every document among differing text: no bucket holds its segments, and the result stays whole."""
    rng = random.Random(9)
    line = words(rng, 12)
    rows = [(i, f"{words(rng, 12)} {line} {words(rng, 12)}") for i in range(400)] + [(None, line), (7, line + line)]
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(10**9 if i is None else i, first.get(t[k : k + 50], 10**9))
    want = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < (10**9 if i is None else i):
                gone[k : k + 50] = [True] * 50
        want.append((i, sum(gone)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (20, 10**6):
        assert by_id(suffix_dedup.repeated_spans(df, file_bytes=20000, most=most), "doc_id", "n_removed") == sorted(want, key=lambda r: tuple((x is None, x) for x in r))

    # What is dealt: all segments of the line's edges to one bucket, or their windows to many.
    path = str(tmp_path / "part.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}), path)
    text = suffix_dedup.TextFile(path)
    keys, _, times, place = text.distinct_anchors(16)
    assert times.max() > 300 and times.sum() == len(place)
    hot = text.segments(times > 20, times > 20, place, 16)
    assert (hot[2] == 1).all() and (hot[5] >= 16).all() and np.bincount(hot[5])[16:].max() < 2 * np.bincount(hot[5])[16:].mean()


def test_bwt_and_lcp():
    rng = random.Random(1)
    for _ in range(40):
        strings = [bytes(rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        sizes = np.array([len(s) for s in strings])
        order, first, lcp = suffix_dedup.bwt_lcp(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes), sizes)
        bwt = np.zeros(len(order), int)
        bwt[order] = np.repeat(np.arange(256), np.diff(first))
        table = sorted(((*s[i:], 0), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert bwt.tolist() == [strings[k][i - 1] if i else 0 for _, k, i in table]
        common_ = [0] + [next(n for n, (x, y) in enumerate(itertools.zip_longest(a[:-1], b[:-1])) if x != y or x is None) if a[:-1] != b[:-1] else len(a) - 1 for (a, _, _), (b, _, _) in zip(table, table[1:])]
        assert lcp.tolist() == common_


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    rows = [(i, i % 3, (base[i % 60] + rng.normal(scale=0.03, size=16) * (i >= 60)).tolist()) for i in range(400)]
    rows += [(500, 0, None), (501, 0, [0.0] * 16), (502, 0, [float("nan")] * 16), (503, None, rows[0][2]), (504, 0, [None] + [1.0] * 15), (505, 0, []), (506, 0, [1.0, 2.0]), (507, 0, [2.0, 4.0]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("lists", F.lit(1)).withColumn("n", F.lit(1))
    good = {i: (lab, np.array(v)) for i, lab, v in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.98]
    got = {r[0]: r[1:] for r in by_id(embedding_dedup.near_vectors(df), "vec_id", "n_links", "component_id", "kept")}
    count = sum(n for n, _, _ in got.values())
    assert 0.9 <= count / (2 * len(links)) <= 1 and set(got) == {r[0] for r in rows}
    exact = {r[0]: r[1:] for r in by_id(embedding_dedup.near_vectors(df, pivots=4), "vec_id", "n_links", "component_id", "kept")}  # one list: everything is compared
    low = component_of({r[0] for r in rows}, links)
    degree = {i: sum(i in e for e in links) for i in low}
    assert exact == {i: (degree[i], low[i], low[i] == i) for i in low}
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_lookup_join_serves_hot_and_cold_keys(spark):
    rows = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 4000 as string)) as k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    out = common.lookup_join(rows, common.materialize(groups), "k", "n", "id")
    want = rows.join(groups, "k")
    assert out.count() == 9000 and out.select("id", "k", "n", "low").exceptAll(want.select("id", "k", "n", "low")).count() == 0


def test_running_sums(spark):
    df = spark.range(500).selectExpr("id % 3 as p", "id", "cast(id % 7 as bigint) as v").withColumn("h", common.hash60(1, "id"))
    out = common.running_before(df, "p", "h", ["id"], "v", "before", bits=4).collect()
    for p in range(3):
        total = 0
        for r in sorted((r for r in out if r.p == p), key=lambda r: (r.h, r.id)):
            assert r.before == total
            total += r.v


def test_scratch_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Cluster)


def test_slices_keep_long_rows_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    assert [s.num_rows for s in chunks.slices(batch, "text", 12)] == [2, 1, 2]


def test_special_tokens_in_a_text(spark):
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b", " <|endoftext|> x  <|endoftext|>", "<|endoftext|", "<|endoftext|><|endoftext|>\n y", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for switch in (False, True):
        tokenizer = Tokenizer.from_file(BYTE_BPE)
        tokenizer.encode_special_tokens = switch
        got = {r.doc_id: list(r.tokens) for r in token_store.encode_tokens(df, BYTE_BPE, special_as_text=switch).collect()}
        assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_scratch_tables_go(spark):
    made = []
    with common.kept_tables(made):
        first = common.materialize(spark.range(5))
        second = common.materialize(first.selectExpr("id + 1 as id"))
        common.discard(first)
    assert made == [second] and second.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound|does not exist"):
        first.collect()
    common.discard(second)


def test_near_groups_leaves_two_tables(spark, docs):
    made = []
    with common.kept_tables(made):
        out = minhash_dedup.near_groups(docs)
    assert len(made) == 2 and out.count() == docs.count()


def test_mixing_against_a_plain_mix(spark, docs):
    """Sizes, targets, draws, permutations and taken words again, by loops over all rows."""
    block, slots, seed = 8, 16, 42
    parts = mixing.mix(docs, block=block, slots=slots, seed=seed)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda i: int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(size(t) for _, t, s in rows if s == n) for n in names]

    # 150 % of all words by weight, again and again without the sources that are full.
    goal, free, left = {}, list(range(len(names))), 1.5 * sum(totals)
    while free:
        unit = left / sum([5, 2, 1][i % 3] for i in free)
        full = [i for i in free if unit * [5, 2, 1][i % 3] > 2 * totals[i]]
        for i in full or free:
            goal[i] = 2 * totals[i] if full else unit * [5, 2, 1][i % 3]
            left -= goal[i] if full else 0
        free = [i for i in free if i not in full] if full else []
    blocks = [-(-n // block) for n in totals]
    quota = [min(2 * b, int(goal[i] / totals[i] * b + 0.5)) for i, b in enumerate(blocks)]
    rng, rest, drawn, uses = np.random.default_rng(seed), list(quota), [0] * len(names), {}
    while sum(rest):
        want, count = min(slots, sum(rest)), [0] * len(names)
        while sum(count) < want:
            open_ = np.array([a - b for a, b in zip(rest, count)])
            more = rng.multinomial(want - sum(count), open_ / open_.sum())
            count = [min(a, b + int(m)) for a, b, m in zip(rest, count, more)]
        for i, c in enumerate(count):
            for j in range(drawn[i], drawn[i] + c):  # every block of a source once, then again
                at = int(mixing.permute(np.array([j % blocks[i]]), blocks[i], seed + 104729 * (i + 1))[0])
                uses[i, at] = uses.get((i, at), 0) + 1
            drawn[i] += c
            rest[i] -= c
    taken, place = [], [0] * len(names)
    for d, t, s in sorted(rows, key=lambda r: (key(r[0]), r[0] is None, r[0] or 0, size(r[1]))):
        i = names.index(s)
        taken.append((d, size(t), totals[i], sum(uses.get((i, w // block), 0) for w in range(place[i], place[i] + size(t)))))
        place[i] += size(t)
    got = [(r.doc_id, r["size"], r.source_size, r.taken, r.target, r.source) for r in parts["documents"].collect()]
    assert sorted(g[:4] for g in got) == sorted(taken)
    assert all(abs(g[4] - goal[names.index(g[5])]) < 1e-6 for g in got)


def test_language_id_against_whole_texts(spark, docs):
    """Counts by the library, and each whole text summed over all its segmentations, byte by byte."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tables = pieces.PieceTables(open(PIECES, "rb").read())
    some = docs.where("length(text) < 700 or text is null")
    rows = [(r.doc_id, r.text, r.lang) for r in some.collect()]
    counts = {lang: np.zeros(len(tables.text)) for lang in ("de", "en")}
    for i, t, lang in rows:
        if t is not None and lang and zlib.crc32(str(i).encode()) % 5:
            np.add.at(counts[lang], library.encode(t), 1)
    log_p = {}
    for lang, c in counts.items():
        c[tables.matched] += 0.5
        log_p[lang] = {tables.text[k]: np.log(c[k] / c[tables.matched].sum()) for k in tables.matched}

    def total(text, p):
        data, longest = (" " + text.replace("▁", " ")).encode() if text else b"", max(len(k.encode()) for k in p)
        known = {k.encode(): v for k, v in p.items()}
        alpha = [0.0] + [-np.inf] * len(data)
        heads = [k for k in range(len(data)) if data[k] & 0xC0 != 0x80] + [len(data)]
        for a, b in zip(heads, heads[1:]):  # letters without a piece go byte by byte
            for e in range(a + 1, b + 1):
                ways = [alpha[s] + known[data[s:e]] for s in range(max(0, e - longest), e) if data[s:e] in known]
                if data[a:b] not in known:
                    ways.append(alpha[e - 1] + np.log(language_id.BARE))
                if ways:
                    alpha[e] = np.logaddexp.reduce(ways)
        return alpha[-1]

    got = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.identify_languages(some, PIECES).collect()}
    want = set()
    for i, t, _ in rows:
        if t is None or not re.search(r"[^\W\d_]", t):
            want.add((i, "und", 0.0))
            continue
        logs = np.array([total(t, log_p[lang]) for lang in ("de", "en")])
        want.add((i, ("de", "en")[int(logs.argmax())], round(float(1 / np.exp(logs - logs.max()).sum()), 6)))
    assert got == want


def test_texts_longer_than_a_slice(spark):
    """A row beyond every slice size, among short ones, in each operator over texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(11)
    long = words(rng, 700_000)
    assert len(long) > chunks.SLICE_BYTES
    texts = ["short one", long, None, long + " tail of it"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    ids = [[*Tokenizer.from_file(BYTE_BPE).encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert by_id(token_store.token_report(df, BYTE_BPE), "doc_id", "n_tokens", "ids_crc32") == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {r.doc_id: zlib.crc32(np.array(r.piece_ids).tobytes()) for r in pieces.encode_pieces(df, PIECES).select("doc_id", "piece_ids").collect()} == {i: zlib.crc32(np.array(library.encode(t or ""), np.array([0]).dtype).tobytes()) for i, t in enumerate(texts)}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    assert by_id(minhash_dedup.near_groups(df), "doc_id", "n_shingles", "component_id") == [(0, 1, 0), (1, len(sets[1]), 1), (2, 0, 2), (3, len(sets[3]), 1)]
    removed = by_id(suffix_dedup.repeated_spans(df), "doc_id", "n_bytes", "n_removed")
    assert [r[1] for r in removed] == [len((t or "").encode()) for t in texts] and removed[3][2] >= len(long) and removed[1][2] < len(long) // 2
    assert [r[1] for r in by_id(mixing.mix(df)["documents"], "doc_id", "size")] == [len((t or "").split()) for t in texts]
    assert [r[1] for r in by_id(language_id.identify_languages(df, PIECES), "doc_id", "lang_pred")] == ["en", "en", "und", "en"]


def test_token_files_can_be_read_selectively(spark, docs, tmp_path):
    """Footers: ids and counts are delta encoded, tokens by dictionary, all with page indexes; row groups stay small."""
    many = spark.range(6000).selectExpr("id as doc_id", "concat('word ', id % 97, ' of text number ', id) as text")
    path = token_store.write_tokens(many, BYTE_BPE, str(tmp_path / "t"), 2, files=2)
    found = sorted((tmp_path / "t").glob("*.parquet"))
    assert len(found) == 2
    last = -1
    for file in found:
        meta = pq.ParquetFile(file).metadata
        columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        for name in ("doc_id", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and not columns[name].has_dictionary_page
        tokens = next(c for n, c in columns.items() if n.startswith("tokens"))
        assert tokens.has_dictionary_page and "RLE_DICTIONARY" in tokens.encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        ids = pq.read_table(file, columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in token_store.read_tokens(spark, path, with_tokens=False)._jdf.queryExecution().executedPlan().toString()


def test_null_and_repeated_ids_everywhere(spark):
    """Ids decide nothing about texts: every row comes back, null ids and repeated ones too."""
    df = spark.createDataFrame([(None, "the same words in a row here"), (None, None), (7, "the same words in a row here"), (7, "the same words in a row here"), (7, "other words")], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    assert [r[1] for r in by_id(language_id.identify_languages(df, PIECES), "doc_id", "lang_pred")] == ["en"] * 3 + ["en", "und"]
    assert pieces.piece_report(df, PIECES).count() == 5
    near = by_id(minhash_dedup.near_groups(df), "doc_id", "n_shingles", "component_id", "kept")
    assert near == [(7, 1, 7, True), (7, 3, 7, True), (7, 3, 7, True), (None, 0, None, True), (None, 3, 7, False)]  # seven words have three shingles
    vectors = spark.createDataFrame([(None, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.001])], "vec_id bigint, label int, embedding array<double>")
    assert by_id(embedding_dedup.near_vectors(vectors), "vec_id", "n_links", "component_id") == [(1, 1, 1), (2, 1, 1), (None, 0, None)]
