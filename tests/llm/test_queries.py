"""The registered corpus queries over the smallest tables: against DuckDB, the
tiktoken library or plain versions; and the pipeline, stage by stage."""

import base64
import hashlib
import itertools
import random
import tracemalloc
import zlib
from types import SimpleNamespace

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pitwise.llm import byte_bpe, decontamination, jaccard_join, pii, quality_rules, queries
from pitwise.llm.byte_bpe import Tokenizer
from pitwise.llm.tables import settle, table
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import CLASHING
from tools.compare import TABLES, digest


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]


def test_registered_names():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "decontamination", "pii", "byte_bpe"]


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, duck, key):
    got, want = queries.QUERIES[key](spark, SF_SMALL).toPandas(), duck.execute(queries.ORACLES[key]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and digest(got, 6)[0] == digest(want, 6)[0]


def test_pii_query_matches_the_patterns(spark):
    got = {r.doc_id: r for r in queries.op2_pii_anchors(spark, SF_SMALL).collect()}
    rows = texts(spark)
    assert len(got) == len(rows)
    for i, t in rows:
        spans = brute.base_spans(t)
        assert got[i].base_sha256 == brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in spans) for k in pii.BASE]


def ids_of(encoding, text):
    return encoding.encode_ordinary(text or "")


def test_bpe_query_matches_the_library(spark, encoding):
    got = {r.doc_id: r for r in queries.op4_byte_bpe(spark, SF_SMALL).collect()}
    for i, t in texts(spark):
        ids = ids_of(encoding, t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == brute.sha(",".join(map(str, ids)))
        assert got[i].decoded_sha256 == brute.sha(t or "")


@pytest.mark.parametrize("bound", [0, 1 << 17])
def test_bpe_of_odd_texts(spark, docs, encoding, bound):
    """With every piece folded in place, and with a table of the frequent ones."""
    rows = [(1, None), (2, ""), (3, " "), (4, "  a\n\n b's  \t"), (5, "é😀 ñandú ½ Ⅷ 漢字かな"), (6, "x" * 700), (7, " " * 300 + "y"), (8, "the the the"), (8, "the the the"),
            (None, "<|endoftext|>  z"), (9, "\x00\x1f\x85"), (10, "don't they'll 12345 ...!!!")]
    t = Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = t.decode(t.encode(docs(rows, CLASHING), bound)).collect()
    want = sorted((str(i), ",".join(map(str, ids_of(encoding, x))), (x or "").encode()) for i, x in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want
    assert t.encode(docs([]), bound).count() == 0


def test_heap_merge_equals_the_library(encoding):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = dict(byte_bpe.read_ranks(path))
    rng = random.Random(4)
    for n, letters in ((1, "a"), (2, "ab"), (65, "x"), (300, "ab"), (3000, "etaoinshr"), (700, "é漢a"), (20_000, "abcdefghijklmnopqrstuvwxyz")):
        piece = "".join(rng.choice(letters) for _ in range(n))
        assert byte_bpe.heap_merge(piece.encode(), ranks) == encoding.encode_ordinary(piece)


def test_bpe_of_long_pieces(spark, docs, encoding):
    """Pieces about the length at which the fold gives way to the heap, in
    lumps of few pieces, and one run of 100,000 letters."""
    rng = random.Random(8)
    rows = [(n, " ".join("".join(rng.choice("aeionst") for _ in range(n)) for _ in range(3)) + " the end") for n in (62, 63, 64, 65, 66)]
    rows += [(1, "é" * 33 + " " + "漢" * 22), (2, "".join(rng.choice("aeionst") for _ in range(100_000)))]
    t = Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {i: ",".join(map(str, ids_of(encoding, x))) for i, x in rows}
    for bound in (0, 100):
        assert {r.doc_id: r.ids for r in t.encode(docs(rows), bound).collect()} == want


def test_texts_are_cut_alike_by_both_libraries(encoding):
    """Python's own expressions, with the classes spelt out, cut at every
    character as the regex library does, by whose pattern the library cuts."""
    cut, own = regex.compile(public_tokenizers.PATTERN), byte_bpe.spelt_out(public_tokenizers.PATTERN)
    for c in map(chr, [*range(0xD800), *range(0xE000, 1 << 16)]):
        text = f"a{c}b 1{c} {c}{c}  {c}'s"
        assert own.findall(text) == cut.findall(text)
    both = byte_bpe.Cut(public_tokenizers.PATTERN)
    for text in ("é😀 ñ  𝼀𝼀b ½", "\x1c \x1f\x85\u3000 x", "漢字 \u0660a"):
        assert [p for lump in both.lumps(text) for p in lump] == cut.findall(text)
    assert all(byte_bpe.spelt_out(p) is None for p in (r"(?i:a)", r"\w+", "a.", r"[^\S]", r"\P{L}"))


def test_bpe_counts_every_piece_once(spark, docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LUMP", 3)
    texts_of = ["a b c a a d", "a b", None, "", "x" * 65]
    cut = regex.compile(public_tokenizers.PATTERN)
    assert [p for lump in byte_bpe._lumps(cut, texts_of[0]) for p in lump] == cut.findall(texts_of[0])
    assert list(byte_bpe._lumps(cut, None)) == []
    t = Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r["key"]: r["n"] for r in t.counted(docs(list(enumerate(texts_of)))).collect()}
    assert got == {"a": 2, " a": 2, " b": 2, " c": 1, " d": 1}


def test_folded_words_are_found_in_columns_and_only_by_their_keys(monkeypatch):
    words = {f" w{'é' * (i % 3)}{i}": f"{i},{i + 1}" for i in range(1000)}
    table = pa.Table.from_batches([pa.RecordBatch.from_pydict({"key": k, "value": list(map(words.get, k))}) for k in ([*words][:10], [*words][10:400], [*words][400:])])
    asked = [*words, "", " w", " absent", *words]
    monkeypatch.setattr(byte_bpe, "HOT", 10)
    for h in (hash, lambda s: hash(s) % 700, lambda s: 1):
        monkeypatch.setattr(byte_bpe, "hash", h, raising=False)
        found = list(map(words.get, asked))
        assert byte_bpe.Words(table).ids(asked) == (found, [i for i, x in enumerate(found) if x is None])
    empty = byte_bpe.Words(table.slice(0, 0))
    assert empty.ids(["a"]) == ([None], [0]) and empty.ids([]) == ([], [])


@pytest.mark.parametrize("lump", [1, 3, 1 << 16])
def test_parts_of_texts_cut_together_or_in_lumps(monkeypatch, lump):
    monkeypatch.setattr(byte_bpe, "LUMP", lump)
    cut = byte_bpe.Cut(r"[a-z]+| ")
    words = byte_bpe.Words(pa.table({"key": ["a", " ", "bb"], "value": ["1", "2", "3,4"]}))
    texts = ["a x a", None, "", "x", "x y", "bb a bb", "a" * 65 + " bb", "a\U0001f600 x"]
    parts = [[("1,2", "x"), ("2,1", None)], [], [], [(None, "x")], [(None, "x"), ("2", "y")], [("3,4,2,1,2,3,4", None)], [(",".join(["7"] * 65) + ",2,3,4", None)], [("1,2", "x")]]
    offsets, before, rest = byte_bpe._parts(cut, texts, words, SimpleNamespace(value={b"a": 7}))
    both = list(zip(before, rest, strict=True))
    assert [both[i:j] for i, j in itertools.pairwise(offsets)] == parts


def test_folded_words_take_less_memory_than_a_dict(monkeypatch):
    n = 1 << 18
    monkeypatch.setattr(byte_bpe, "HOT", n >> 2)  # as 2**18 of 2**20
    table = pa.table({"key": [f" word{i}" for i in range(n)], "value": [f"{i},{i},{i}" for i in range(n)]}).combine_chunks()
    table = pa.Table.from_batches(table.to_batches(max_chunksize=10_000))
    words = byte_bpe.Words(table)
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        assert words.ids([" word0", f" word{n - 1}"])[0] == ["0,0,0", f"{n - 1},{n - 1},{n - 1}"]
        taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert taken < 100 * n


def test_a_fold_keeps_its_state_in_one_array(spark):
    t = Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = spark.createDataFrame([(" zzzaazzaaqx",), ("é",), ("a",)], "key string").select("key", *t._tables())
    text = rows.select(t._ids(F.col("key")).alias("ids"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in text and "flatten" not in text


def test_classifier_query_on_its_held_out_fold(spark):
    got = queries.op1_quality_classifier(spark, SF_SMALL)
    labels = table(spark, SF_SMALL, "labels").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == table(spark, SF_SMALL, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)


def test_quality_query_keeps_labelled_documents(spark):
    got = queries.op8_quality_rules(spark, SF_SMALL).join(table(spark, SF_SMALL, "labels").select("doc_id", "quality"), "doc_id").collect()
    base = {i: brute.base_counts(t) for i, t in texts(spark)}
    for r in got:
        n, chars, symbols, dup, again = base[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_quality_rules_keep_clean_documents_left_out_of_the_target(spark):
    """The target holds clean labels of two folds of three; those of the third stay as well, and labelled-bad ones go."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    trusted = spark.createDataFrame([(i,) for i, q in labels.items() if q == 1 and fold(i) != 1], "doc_id long")
    got = {r.doc_id: r for r in quality_rules.judge_quality(table(spark, sf, "documents"), trusted).collect()}
    share = lambda rows: sum(r.kept for r in rows) / len(rows)
    passed = lambda q, left: [got[i] for i, v in labels.items() if v == q and (left is None or (fold(i) == 1) == left) and i in got and not got[i].base_failed]
    assert share(passed(1, True)) >= 0.97 and share(passed(1, False)) >= 0.99 and share(passed(0, None)) <= 0.1


def test_pipeline_stages_take_effect(spark, encoding):
    docs = table(spark, SF_SMALL, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    left, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        left = settle(stage(spark, left, SF_SMALL), "test-pipeline")
        kept[name] = left
        if name != "byte_bpe":
            assert left.columns == docs.columns and [t for _, t in left.dtypes] == [t for _, t in docs.dtypes]
    rows = {n: [(r.doc_id, r.text) for r in df.collect()] for n, df in kept.items() if n != "byte_bpe"}
    components = brute.near_duplicates(rows["quality_classifier"], 5, 80)
    assert {i for i, _ in rows["jaccard_join"]} == {c for _, _, c in components}
    clean = {r[0] for r in brute.contaminated(rows["jaccard_join"], bench) if not r[5]}
    assert {i for i, _ in rows["decontamination"]} == clean
    assert all(t == pii.redact(dict(rows["decontamination"])[i], pii.find_spans(dict(rows["decontamination"])[i])) for i, t in rows["pii"])
    assert not any(brute.base_spans(t) for _, t in rows["pii"])
    assert kept["pii"].where(F.length("text") != F.col("n_chars")).count() == 0
    final = {r.doc_id: r.ids for r in kept["byte_bpe"].collect()}
    assert final == {i: ",".join(map(str, ids_of(encoding, t))) for i, t in rows["pii"]}
    ran = corpus_pipeline.run(spark, SF_SMALL)
    assert {r.doc_id: hashlib.sha256(r.ids.encode()).hexdigest() for r in ran.collect()} == {r.doc_id: r.ids_sha256 for r in kept["byte_bpe"].collect()}


def test_empty_documents(spark, docs):
    empty = docs([])
    bench = table(spark, SF_SMALL, "benchmark")
    assert jaccard_join.near_duplicates(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.drop_contaminated(empty, bench).count() == 0
    from pitwise.llm import license_scan, substring_dedup

    assert substring_dedup.remove_repeats(empty).count() == 0
    assert license_scan.scan(empty).count() == 0 and pii.find_pii(empty).count() == 0
