"""The pipeline against brute force, stage by stage and as a whole."""

import zlib

import numpy as np
import pytest
from test_repeats import classes, removed
from tokenizers import Tokenizer

import corpus_pipeline as cp
from strata.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == list(cp.COLUMNS)
        out.append(docs.collect())
    return out


def test_language_keeps_clean_documents(spark, stages):
    kept = {r.doc_id for r in stages[1]}
    gone = [r for r in stages[0] if r.doc_id not in kept]
    assert len(gone) < 0.05 * len(stages[0])
    odd = spark.createDataFrame([(1, "1234 5678 !!", "en", "x", 12), (2, None, "en", "x", 0), (3, "漢字 仮名 " * 50, None, "x", 0)] + [tuple(r) for r in stages[0]], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert {1, 2, 3} & {r.doc_id for r in cp.language_id(spark, odd.where("doc_id > 3 OR n_chars < 13"), SF).where("source = 'x'").collect()} == set()


def test_one_of_each_group_stays(stages):
    want = {d for d, _, c in classes([(r.doc_id, r.text) for r in stages[1]], 5, 8, 10) if d == c}
    assert {r.doc_id for r in stages[2]} == want
    assert len(stages[2]) < len(stages[1])
    before = {r.doc_id: r for r in stages[1]}
    assert all(r == before[r.doc_id] for r in stages[2])


def test_repeated_passages_go(stages):
    docs = [(r.doc_id, r.text) for r in stages[2]]
    want = {docs[i][0]: (v[2] if v[1] else docs[i][1]) for i, v in removed(docs, 20).items() if not v[1] or v[1] < v[0]}
    assert {r.doc_id: r.text for r in stages[3]} == want
    assert any(len(want[k]) < len(t) for k, t in docs if k in want)


def test_run_packs_every_token_of_what_is_left(spark, stages):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = cp.run(spark, SF).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).append(r)
    assert ids.keys() == {r.doc_id for r in stages[3]}
    for r in stages[3]:
        whole = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, cp.END_ID], "<u4").tobytes()
        assert b"".join(p.ids for p in ids[r.doc_id]) == whole and [p.start for p in ids[r.doc_id]] == list(np.cumsum([0, *(p.length for p in ids[r.doc_id])])[:-1])
        assert zlib.crc32(whole)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_duplicates_go_by_row(spark):
    """A repeated doc_id drops neither a distinct text nor keeps a copy."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(3, a), (7, a + " end"), (7, b), (8, c), (8, c), (8, c.upper()), (9, b + " end"), (10, ""), (10, ""), (10, "10 10"), (None, a), (None, a)]
    frame = spark.createDataFrame([(k, t, "en", "x", len(t)) for k, t in docs], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = sorted((r.doc_id or 0, r.text) for r in cp.near_duplicates(spark, frame, SF).collect())
    assert got in [sorted([(3, a), (7, b), (8, x), (10, ""), (10, ""), (10, "10 10"), (0, a), (0, a)]) for x in (c, c.upper())]


def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark):
    """Each stage on rows with nulls in every column, repeated rows and ids, one very long text and columns of names used inside."""
    english = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND length(text) > 400").orderBy("doc_id").limit(12).collect()]
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(english)]
    rows += [(20, " ".join(f"the word {i} of it" for i in range(60_000)), "en", "long", 1)]
    rows += [rows[0], rows[0], (0, english[1] + " and more of the same", None, None, None), (None, english[2], None, None, None), (30, None, None, None, None), (None, None, None, None, None), (31, "", "en", "", 0)]
    names = ("part", "key", "n", "a", "b", "rep", "id", "kept", "n_words", "n_removed", "spans", "score", "lang_pred", "carry0", "found", "own")
    docs = spark.createDataFrame([(*r, *[1] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    docs = docs.select(*names[:8], *cp.COLUMNS, *names[8:])
    plain = spark.read.parquet(f"{SF}/documents.parquet").schema
    now = docs
    for name, stage in cp.STAGES:
        out = stage(spark, now, SF).collect()
        if name == "packing":
            break
        assert all(r.__fields__ == list(cp.COLUMNS) for r in out)
        held = sorted((str(r.doc_id), len(r.text or "")) for r in out)
        if name == "language ID":
            assert {r.doc_id for r in out} == {*range(12), 20, None} and len(out) == 17
        elif name == "n-gram Jaccard join":  # one of each repeated row; null ids stay
            assert [k for k, _ in held].count("0") in (1, 2) and [k for k, _ in held].count("None") == 1
        now = spark.createDataFrame([tuple(r) for r in out], plain).selectExpr("*", "1 AS part", "'x' AS key", "2 AS n", "3 AS kept")
    packed = {}
    for r in out:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    left = now.collect()
    assert packed.keys() == {r.doc_id for r in left} and 20 in packed
