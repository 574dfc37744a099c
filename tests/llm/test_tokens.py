"""op2, op6 and op9 against the tokenizers library itself."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import bpe, catalogue, packing, shards
from strata.llm.tokens import ByteEncoder, WordEncoder, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
TEXTS = ["", None, "a", " a", "a ", "a  b", "a\n b", "a\n \nb", "  ", "don't 'll", "É é ß İ ǅ", "<|endoftext|>", "x <|endoftext|> y", "word " * 3000, "nospace" * 4000, "😀 中文 a", "\x1c a\x85b", "a b", "same text here", "same text here"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "ids") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, ids string")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


PARTS = st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "1", "é", "É", "İ", "Σ", "́", "\x1c", "\x85", "　", "<|endoftext|>", "😀", "-", ".", "<|", "Zz"]), max_size=12).map("".join)
BYTES, WORDS = ByteEncoder(BYTE), WordEncoder(WORD)
CHUNKED = bpe.ChunkEncoder(BYTES.encode)


@settings(max_examples=400, deadline=None)
@given(PARTS, st.lists(st.integers(0, 40), max_size=4))
def test_encoders_are_exact(text, cuts):
    for e in (BYTES, WORDS):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids
    raw = text.encode()
    at = sorted({c for c in cuts if 0 < c < len(raw) and raw[c] & 0xC0 != 0x80})
    for _ in range(3):  # the second time its chunks have been seen, the third they are kept
        assert CHUNKED.encode(raw, at) == BYTES.encode(text)


def test_chunks_are_reused(spark):
    one = " ".join(f"w{i * i % 9973}" for i in range(4000))
    chunked = bpe.ChunkEncoder(BYTES.encode)
    for t in (one, "other start " + one, "third " + one, one):
        raw = t.encode()
        cuts = bpe.content_cuts(np.frombuffer(raw, np.uint8)).tolist()
        assert len(cuts) > 10
        assert chunked.encode(raw, cuts) == BYTES.encode(t)
    assert chunked.reused > 20


def test_old_chunks_make_room():
    """However many chunks come, those that come again later are kept then; what is kept has a bound."""
    chunked = bpe.ChunkEncoder(BYTES.encode, kept=20)
    for start in range(0, 40_000, 1000):
        text = " ".join(f"w{i}" for i in range(start, start + 1000))
        raw, before = text.encode(), chunked.reused
        cuts = bpe.content_cuts(np.frombuffer(raw, np.uint8)).tolist()
        for _ in range(3):
            assert chunked.encode(raw, cuts) == BYTES.encode(text)
        assert chunked.reused > before
        assert len(chunked.kept.young) <= 20 and len(chunked.kept.old) <= 20


def pairs(text):
    """An encoder that joins a piece with an equal one before it, so that cuts at blanks aren't exact."""
    out, found = [], re.findall(r" ?[^ ]+| +", text)
    while found:
        n = 2 if len(found) > 1 and found[0] == found[1] else 1
        out.append(zlib.crc32("".join(found[:n]).encode()).to_bytes(4, "little"))
        del found[:n]
    return b"".join(out)


def test_joints_grow_until_both_sides_agree():
    rng, widened = random.Random(3), 0
    for _ in range(400):
        chunks = [" ".join(rng.choice("ab") for _ in range(rng.randrange(5, 12))) for _ in range(4)]
        own = bpe.ChunkEncoder(pairs)
        for _ in range(6):
            way = [rng.choice(chunks) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 8))]
            text, at = "".join(way).encode(), np.cumsum([len(x) for x in way]).tolist()[:-1]
            assert own.encode(text, at) == pairs(text.decode())
        widened += own.widened
    assert widened > 100


def test_frequent_chunks_are_shared(spark):
    shared = " ".join(f"s{i * i % 9973}" for i in range(1500))
    rows = [(i, f"start {i} " + shared + f" end {i}", None) for i in range(20)] + [(99, None, 1), (100, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int")
    found = bpe.frequent_chunks(df, n=5)
    assert len(found) == 5 and all(c.decode() in shared for c in found)
    own = bpe.ChunkEncoder(BYTES.encode, bpe.frequent_chunks(df))
    raw = rows[3][1].encode()
    assert own.encode(raw, bpe.content_cuts(np.frombuffer(raw, np.uint8)).tolist()) == BYTES.encode(rows[3][1]) and own.reused > 5  # in the first text that it sees
    got = {r.doc_id: r.ids for r in bpe.encode(df, BYTE).collect()}
    assert got == {i: ids_of(BYTE, t) for i, t, _ in rows}
    assert bpe.frequent_chunks(df.limit(0)) == [] and bpe.frequent_chunks(df.limit(1)) == []


def test_op9_rows_pass_through(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    rows = bpe.decode(bpe.encode(df, BYTE), BYTE).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == [(0, "a b"), (0, "a b"), (1, ""), (1, "a b"), (1, "a b")]


def test_op9_round_trip(spark, docs):
    both = bpe.decode(bpe.encode(docs, BYTE).selectExpr("*", "'x' AS decoded", "1 AS key"), BYTE)
    rows = {r.doc_id: r for r in both.collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i].ids == ids_of(BYTE, t) and rows[i].decoded == (t or "")
    assert bpe.decode(bpe.encode(docs.limit(0), BYTE), BYTE).count() == 0


def test_op9_on_a_table(spark):
    tok = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = catalogue.op9_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op6_shards(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/s"
    more = docs.union(spark.createDataFrame([(None, "null key", "en", ""), (3, "again", "en", ""), (-5, "negative", "en", "")], docs.schema))
    shards.write(more, BYTE, folder, 0, shard_ids=2000)
    rows = shards.read(spark, folder).collect()
    assert len(rows) == len(TEXTS) + 3
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keys = [r.doc_id for r in rows]
    assert keys == [None, -5, *sorted([*range(len(TEXTS)), 3])]
    got = {(r.doc_id, r.occurrence): np.frombuffer(r.ids, "<u4").tolist() for r in rows}
    for i, t in enumerate(TEXTS):
        assert got[i, 0] == [*ids_of(BYTE, t), 0]
    assert got[3, 1] == [*ids_of(BYTE, "again"), 0]
    asked = [None, -5, 3, 7, 123456789, -6]
    found = shards.get(spark, folder, asked)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found.collect()} == {k: got[k, 0] for k in (None, -5, 3, 7)}
    assert len(found.inputFiles()) <= len(spark.read.parquet(folder + "/shards").inputFiles())
    assert [(r.doc_id, r.n_tokens) for r in shards.get(spark, folder, asked, 1).collect()] == [(3, len(got[3, 1]))]
    assert shards.get(spark, folder, []).count() == shards.get(spark, folder, [10**12]).count() == 0
    raw = spark.read.schema(shards.SCHEMA).parquet(folder + "/shards").collect()
    for r in raw:
        s = shards.Shard(r.asDict())
        assert sorted(s.find(s.keys, s.nulls, s.occurrences)) == list(range(r.n_docs))  # minimal and perfect
        assert s.get(123456789) is None
    shards.write(docs.limit(0), BYTE, folder + "0", 0)
    assert shards.read(spark, folder + "0").count() == 0 and shards.get(spark, folder + "0", [1]).count() == 0


def test_a_lookup_reads_one_bucket_and_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "INDEX_KEYS", 50)
    folder = f"file://{tmp_path}/s"
    shards.write(spark.range(3000).selectExpr("id * 3 AS doc_id", "'word ' || id AS text"), BYTE, folder, 0, shard_ids=500)
    assert len(spark.read.parquet(folder + "/directory").select("bucket").distinct().collect()) > 40
    assert len(spark.read.parquet(folder + "/shards").select("part").distinct().collect()) > 2
    for k in (0, 1500 * 3, 2999 * 3):
        one = shards.get(spark, folder, [k, k + 1])
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(part" in plan or "part" in plan.split("PartitionFilters")[1][:60]
        assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in one.collect()] == [(k, [*ids_of(BYTE, f"word {k // 3}"), 0])]


def test_equal_hashes_get_another_seed(monkeypatch):
    plain = shards.key_hashes
    monkeypatch.setattr(shards, "key_hashes", lambda k, n, o, seed=0: plain(k, n, o, seed) if seed else plain(k, n, o, seed) * np.uint64(0))
    keys, nulls, number = np.arange(100), np.zeros(100, bool), np.zeros(100, np.uint32)
    row = shards.Index.build(keys, nulls, number, np.zeros(100, shards.PLACE))
    assert row["seed"] == 1 and sorted(shards.Index(row, shards.PLACE).find(keys)) == list(range(100))


def test_op6_on_a_table(spark):
    tok, at = Tokenizer.from_file(BYTE), 0
    rows = {r.doc_id: r for r in catalogue.op6_token_shards(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 0]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def check_pieces(rows, ids):
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_seq[r.sequence_id].append(r)
        assert r.length > 0
    assert of_doc.keys() == ids.keys()
    for d, own in of_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    pad = 0
    for own in of_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    return pad


def test_op2_on_a_table(spark):
    tok = Tokenizer.from_file(WORD)
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert check_pieces(catalogue.op2_packing(spark, "/root/testdata/sf0.001").collect(), ids) == 0


def test_op2_edges(spark, docs):
    out = packing.pack_documents(docs, WORD, 2, group_tokens=5000).selectExpr("*", "crc32(ids) ids_crc32").collect()
    assert check_pieces(out, {i: [*ids_of(WORD, t), 2] for i, t in enumerate(TEXTS)}) == 0
    assert packing.pack_documents(docs.limit(0), WORD, 2).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_pack_holds_each_token_once(lengths):
    windows, left = packing.pack([(i, 0, n) for i, n in enumerate(lengths)])
    assert not left
    spans = defaultdict(list)
    for size, pieces in windows:
        assert sum(p[2] for p in pieces) == size and size & (size - 1) == 0 and size <= 4096
        for d, s, n in pieces:
            spans[d].append((s, s + n))
    for i, n in enumerate(lengths):
        own = sorted(spans[i])
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    groups = packing.step_groups(windows, 8192)
    assert all(sum(windows[i][0] for i, g in enumerate(groups) if g == k) <= 8192 for k in set(groups))


def test_step_groups_are_of_equal_size_and_even_cost():
    rng = random.Random(2)
    windows = [(4096, [(0, 0, n), (1, 0, 4096 - n)]) for n in (rng.randrange(1, 4096) for _ in range(64 * 3 + 7))]
    groups = packing.step_groups(windows)
    held = [groups.count(g) for g in range(4)]
    assert sorted(held) == [7, 64, 64, 64] and len(set(groups)) == 4
    cost = [sum(sum(p[2] ** 2 for p in w[1]) for w, x in zip(windows, groups) if x == g) for g in range(4) if groups.count(g) == 64]
    assert max(cost) < 1.02 * min(cost)
    assert packing.step_groups(windows[:5]) == [0] * 5 and packing.step_groups([]) == []


def test_op2_repeats_and_nulls(spark):
    """Rows that repeat, ids that repeat with other texts, and null ids: each row's ids are packed once."""
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "f"), (None, "f"), (2, None)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORD, 2).collect()
    want = sorted((str(k), x) for k, t in rows for x in [*ids_of(WORD, t), 2])
    assert sorted((str(r.doc_id), int(x)) for r in out for x in np.frombuffer(r.ids, "<u4")) == want
    assert sum(r.length for r in out) == len(want)


@pytest.mark.parametrize("encoder", [BYTES, WORDS], ids=["bytes", "words"])
def test_encoders_are_exact_over_the_vocabulary(encoder):
    """Texts of tokens from the whole vocabulary, glued and apart, with marks, digits, case and white space between."""
    rng = random.Random(7)
    tokens = [encoder.library.decode([i]) for i in range(encoder.library.get_vocab_size())]
    marks = [" ", " ", " ", "", ".", ", ", "\n", "'s ", "...", "!?) ", " 12", "$$$ ", '"', "  ", "\t", "-", "’", "é", "%", ".\nA"]
    order = tokens * 2
    rng.shuffle(order)
    texts, at = [], 0
    while at < len(order):
        n = rng.randrange(1, 12)
        texts.append("".join(t.upper() + m if rng.random() < 0.05 else t + m for t, m in zip(order[at : at + n], rng.choices(marks, k=n))))
        at += n
    for begin in range(0, len(texts), 2000):
        some = texts[begin : begin + 2000]
        for t, found in zip(some, encoder.library.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == found.ids, t
