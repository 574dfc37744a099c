"""op4, op8 and op10 against brute force, with edge cases."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import catalogue, chat, langid, warc

SF = "/root/testdata/sf0.01"


def oracle(sql):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(sql)
    return [x[0] for x in cur.description], cur.fetchall()


def test_op4_equals_its_sql(spark):
    names, want = oracle(warc.ORACLE)
    got = [tuple(r[n] for n in names) for r in catalogue.op4_revisits(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


RECORDS = "record_id long, url string, ts long, type string, status int, payload_digest string, headers map<string,string>, host string"


def test_revisits_edges(spark):
    rows = [
        (1, "http://www.A.org/x/", 10, "response", 200, "d1", {"ETag": '"e1"', "Content-Type": "text/html", "Server": "one"}, ""),
        (2, "https://a.org/x?utm_source=q#frag", 20, "response", 206, "d2", {}, ""),
        (3, "https://a.org/x", 20, "revisit", 304, None, {"etag": 'W/"e1"', "content-type": "nope", "Server": "two", "Age": "1"}, ""),
        (4, "a.org:443/x", 30, "revisit", 200, "d1", None, ""),
        (5, "http://a.org/x", 30, "revisit", 200, "other", None, ""),
        (6, "http://a.org/x", 5, "revisit", 304, None, {}, ""),
        (7, "http://a.org/x", 30, "revisit", 304, None, {"Last-Modified": "x"}, ""),
        (8, None, 30, "revisit", 304, None, None, ""),
        (9, "http://a.org/x", None, "revisit", 304, None, None, ""),
        (10, "http://a.org/y?b=1&a=2", 1, "response", 200, None, {"Last-Modified": "m"}, ""),
        (11, "http://m.a.org/y/?a=2&b=1&ref=z", 1, "revisit", 304, None, {"last-modified": "m"}, ""),
        (11, "http://m.a.org/y/?a=2&b=1&ref=z", 1, "revisit", 304, None, {"last-modified": "n"}, ""),
        (12, "http://a.org/y?b=1&a=2", 1, "response", 200, None, {"Last-Modified": "m"}, ""),
        (13, "http://a.org/x", 30, "request", None, None, None, ""),
    ]
    by = {(r.record_id, r.outcome): r for r in warc.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert by[3, "resolved"].headers == {"etag": 'W/"e1"', "content-type": "text/html", "server": "two", "age": "1"}
    assert {k for k in by} == {(3, "resolved"), (4, "resolved"), (5, "digest_mismatch"), (6, "no_response"), (7, "unvalidated"), (8, "no_response"), (9, "no_response"), (11, "resolved"), (11, "modified")}
    assert by[11, "resolved"].refers_to == 10
    assert warc.resolve(spark.createDataFrame([], RECORDS)).count() == 0


def test_one_url_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(i, "http://hot.org/", rng.randrange(500), rng.choice(["response", "revisit"]), 200, str(rng.randrange(3)), {}, "") for i in range(2000)]
    rows += [(5000 + i, f"http://c{i}.org/", 1, "revisit", 304, None, {}, "") for i in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.record_id: (r.refers_to, r.outcome) for r in warc.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    full = sorted((r[2], r[0], r[5]) for r in rows if r[3] == "response")
    for r in rows:
        if r[3] == "revisit":
            before = [f for f in full if f[:2] < (r[2], r[0])] if r[0] < 5000 else []
            want = (before[-1][1], "resolved" if before[-1][2] == r[5] else "digest_mismatch") if before else (None, "no_response")
            assert got[r[0]] == want


def test_op8_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalogue.op8_language(spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98


def test_op8_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 30, "en"), (2, "der Hund und die Katze " * 30, "de"), (3, None, "en"), (4, "", "de"), (5, "1234 !!", "en"), (6, "a", None), (7, "DER HUND und", None), (8, "中文", None), (9, "the " * 50_000, None)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[7][0] == "de" and got[9][0] == "en"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6] == ("en", 0.0) and got[8] == ("en", 0.0)
    assert langid.train(docs, F.lit(False)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
    clash = langid.predict(docs.withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("gram", F.lit(2)), model)
    assert clash.columns == ["doc_id", "text", "lang", "key", "gram", "lang_pred", "score"] and clash.where("doc_id = 1").first().lang_pred == "en"


def by_hand(docs, teach):
    """op8 by definition, with sets for the filter: n-grams of four bytes with one blank at most."""
    def grams_of(text):
        b = bytearray(b" " + (text or "").encode() + b" ")
        for i, c in enumerate(b):
            if 65 <= c <= 90 or (i and b[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97):
                b[i] = c + 32
            elif c < 128 and not 97 <= c <= 122:
                b[i] = 32
        found = [bytes(b[i : i + 4]) for i in range(len(b) - 3)]
        return [g for g in found if g.count(b" ") <= 1]

    counts, rows = {}, {}
    for key, text, lang in docs:
        if teach(key) and lang is not None and text:
            rows[lang] = rows.get(lang, 0) + 1
            of = counts.setdefault(lang, {})
            for g in grams_of(text):
                of[g] = of.get(g, 0) + 1
    own = {k: {g for g, n in of.items() if n > 1 and n >= sum(of.values()) * langid.MIN_SHARE} for k, of in counts.items()}
    default = min(rows, key=lambda k: (-rows[k], k))
    out = {}
    for key, text, _ in docs:
        found = grams_of(text)
        shares = {k: sum(g in own[k] for g in found) / max(len(found), 1) for k in sorted(own)}
        best = max(shares, key=lambda k: shares[k])
        letters = any(map(str.isalpha, text or ""))
        out[key] = ((best if shares[best] > 0 else default) if letters else "und", shares[best] if letters else 0.0, shares)
    return out


def test_op8_equals_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = by_hand(docs, lambda key: zlib.crc32(str(key).encode()) % 3 != 1)
    rows = catalogue.op8_language(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        lang, score, shares = want[r.doc_id]
        assert abs(r.score - score) < 0.02  # false positives of the filter, corrected
        assert r.lang_pred == lang or abs(shares[r.lang_pred] - score) < 0.02
    assert np.mean([r.lang_pred == want[r.doc_id][0] for r in rows]) > 0.99


def test_labels_without_text_teach_nothing(spark):
    docs = spark.createDataFrame([(i, None, "aa") for i in range(9)] + [(20, "der Hund und die Katze " * 9, "de"), (20, "der Hund und die Katze " * 9, "de"), (None, "中文", "de"), (21, "中文", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert model.languages == ["de"]
    rows = langid.predict(docs, model).collect()
    assert len(rows) == 13 and {r.lang_pred for r in rows} == {"und", "de"}
    assert langid.train(docs.where("text IS NULL"), F.lit(True)) is None


def test_filter_returns_all_languages_and_corrects(spark):
    rng = np.random.default_rng(1)
    own = {f"l{i:02}": rng.integers(0, 1 << 32, 3000, dtype=np.uint32) for i in range(20)}
    shared = rng.integers(0, 1 << 32, 500, dtype=np.uint32)
    f = langid.LanguageFilter.build({k: np.concatenate([v, shared]) for k, v in own.items()}, "l00", 17)
    assert (f.masks(shared) == (1 << 20) - 1).all()
    for i, k in enumerate(sorted(own)):
        assert ((f.masks(own[k]) >> np.uint32(i)) & np.uint32(1)).all()
    others = rng.integers(0, 1 << 32, 200_000, dtype=np.uint32)
    measured = np.array([((f.masks(others) >> np.uint32(i)) & np.uint32(1)).mean() for i in range(20)])
    assert np.allclose(measured, f.rates, atol=1e-3)


def cheapest(roles):
    """The least cost over all choices of action for each turn."""
    best = None
    for way in itertools.product(range(len(chat.ACTIONS)), repeat=len(roles)):
        state, cost = chat.START, 0
        for k, r in zip(way, roles):
            _, a, b, c = chat.ACTIONS[k]
            if a != state:
                break
            state, cost = b, cost + c + (0 if r in (0, b) else chat.RELABEL)
        else:
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("roles", list(itertools.product(range(4), repeat=3)))
def test_repair_is_cheapest(roles):
    found = chat.solve_block(list(roles), chat.START, None)
    cost, state = 0, chat.START
    for k, r in zip(found, roles):
        _, a, b, c = chat.ACTIONS[k]
        assert a == state
        state, cost = b, cost + c + (0 if r in (0, b) else chat.RELABEL)
    assert cost == cheapest(roles) == chat.reduce_block(list(roles))[chat.START].min()


def legal_and_rendered(rows):
    """Checks a conversation's repaired turns against the automaton, turn by turn, and gives its text and cost."""
    state, text, cost = chat.START, "", 0
    for r in rows:
        name, body = r.action.removesuffix("_relabel"), (r.text or "").replace("<|", "<\\|")
        own = {"human": "user", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant", "developer": "system"}.get((r.role_in or "").strip().lower(), (r.role_in or "").strip().lower())
        after = chat.ROLES.index(r.role_out) + 1
        if name.startswith("insert_"):
            between = chat.ROLES.index(name.removeprefix("insert_")) + 1
            assert (state, between) in chat.LEGAL and (between, after) in chat.LEGAL
            text += ("<|end|>\n" if text else "") + f"<|{chat.ROLES[between - 1]}|>\n<|end|>\n<|{r.role_out}|>\n" + body
            cost += chat.INSERT
        elif name == "merge":
            assert state == after
            text += "\n\n" + body
            cost += chat.MERGE
        else:
            assert name == "keep" and (state, after) in chat.LEGAL
            text += ("<|end|>\n" if text else "") + f"<|{r.role_out}|>\n" + body
        relabelled = own in chat.ROLES and own != r.role_out
        assert relabelled == r.action.endswith("_relabel") or own not in chat.ROLES
        cost += chat.RELABEL * relabelled
        assert r.cost == (chat.INSERT if name.startswith("insert_") else chat.MERGE if name == "merge" else 0) + chat.RELABEL * relabelled
        state = after
    return text, cost


def least_cost(roles):
    """The least cost over all sequences of output roles and insertions, by search over whole conversations of a few states."""
    best = {chat.START: 0}
    for role in roles:
        after = {}
        for state, cost in best.items():
            for r in (1, 2, 3):
                more = 0 if role in (0, r) else chat.RELABEL
                ways = ([0] if (state, r) in chat.LEGAL else []) + ([chat.MERGE] if state == r else []) + [chat.INSERT for b in (2, 3) if (state, b) in chat.LEGAL and (b, r) in chat.LEGAL and (state, r) not in chat.LEGAL]
                for w in ways:
                    after[r] = min(after.get(r, 1 << 30), cost + w + more)
        best = after
    return min(best.values())


def test_op10_table_is_legal_cheapest_and_rendered(spark):
    """Every conversation of a table: the automaton, the costs, the roles and the rendered text, all worked out here."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    out = catalogue.op10_chat(spark, SF)
    rows = out.join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"]).orderBy("conv_id", "position").collect()
    assert len(rows) == turns.count()
    numbers = {"system": 1, "user": 2, "assistant": 3}
    for _, own in itertools.groupby(rows, key=lambda r: r.conv_id):
        own = list(own)
        assert [r.position for r in own] == list(range(len(own)))
        text, cost = legal_and_rendered(own)
        assert text == "".join(r.rendered for r in own)
        assert cost == least_cost([numbers.get((r.role_in or "").strip().lower(), 0) for r in own])


def test_blocks_by_bytes(spark):
    """Long texts close a block early; one text beyond the limit is a block of its own; nothing changes but that."""
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "x"]), "y" * rng.choice([1, 10, 900, 5000])) for c, n in ((1, 300), (2, 1), (None, 90)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = rows_of(chat.repair(df)), rows_of(chat.repair(df, block_bytes=2000))
    assert whole == cut or [(r[:3], r[5]) for r in whole] != [] and all(sum(r[5] for r in whole if r[0] == c) == sum(r[5] for r in cut if r[0] == c) for c in (1, 2, None))
    assert [r[:3] for r in whole] == [r[:3] for r in cut]


def rows_of(df):
    return [(r.conv_id, r.turn, r.position, r.action, r.role_out, r.cost, r.rendered) for r in df.orderBy("conv_id", "position").collect()]


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string, block string"
    rows = [
        (1, 0, "assistant", "hi", ""), (1, 1, "assistant", None, ""), (1, 2, " Human ", "q <|user|> x", ""), (1, 3, "user", "more", ""),
        (2, 0, "system", "s", ""), (2, 1, "system", "t", ""), (2, 2, "assistant", "a", ""),
        (3, 0, None, "?", ""), (3, 0, None, "?", ""), (3, None, "tool", "first", ""),
        (None, 0, "user", "u", ""), (None, 1, "gpt", "v" * 200_000, ""),
    ]
    out = rows_of(chat.repair(spark.createDataFrame(rows, schema)))
    text = {c: "".join(r[6] for r in out if r[0] == c) for c in (1, 2, 3, None)}
    assert text[1] == "<|user|>\n<|end|>\n<|assistant|>\nhi\n\n<|end|>\n<|user|>\nq <\\|user|> x\n\nmore"
    assert text[2] == "<|system|>\ns\n\nt<|end|>\n<|user|>\n<|end|>\n<|assistant|>\na"
    assert [r[4] for r in out if r[0] == 3][0] in ("system", "user") and sum(r[5] for r in out if r[0] == 3) == 0
    assert text[None].startswith("<|user|>\nu<|end|>\n<|assistant|>\nvvv")
    assert chat.repair(spark.createDataFrame([], schema)).count() == 0


def test_long_conversations_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "x", "assistant"]), f"t{t}") for c, n in ((1, 700), (2, 3), (3, 65), (4, 64)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = rows_of(chat.repair(df)), rows_of(chat.repair(df, block=16))
    by = lambda out: {c: sum(r[5] for r in out if r[0] == c) for c in (1, 2, 3, 4)}
    assert by(whole) == by(cut) and [r[:3] for r in whole] == [r[:3] for r in cut]
    numbers = {"system": 1, "user": 2, "assistant": 3, "x": 0}
    for c in (1, 2, 3, 4):
        assert by(whole)[c] == chat.reduce_block([numbers[r[2]] for r in rows if r[0] == c])[chat.START].min()
    costs = {r.conv_id: (r.n_turns_in, r.cost) for r in chat.conversation_costs(chat.repair(df, block=16)).collect()}
    assert costs[1] == (700, by(whole)[1])


def test_op10_on_a_table(spark):
    out = rows_of(catalogue.op10_chat(spark, "/root/testdata/sf0.001"))
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    assert [(r[0], r[1]) for r in out] == [(t.conv_id, t.turn) for t in turns]
    numbers = {"system": 1, "user": 2, "assistant": 3}
    for c in {t.conv_id for t in turns}:
        roles = [numbers.get(t.role, 0) for t in turns if t.conv_id == c]
        assert sum(r[5] for r in out if r[0] == c) == chat.reduce_block(roles)[chat.START].min()


def test_more_languages_than_a_word_of_the_masks(spark):
    """150 labels, each with words of its own: as many as dirty or regional tags may be."""
    def words(i, start):
        return " ".join("".join("bcdfghjklm"[int(x)] + "aeiou"[(i + j) % 5] for j, x in enumerate(f"{i:03d}{n:02d}")) for n in range(start, start + 20))

    rows = [(i * 4 + j, words(i, 10 * j), f"x{i:03d}") for i in range(150) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.col("doc_id") % 4 != 1)
    assert len(model.languages) == 150 and len(model.rows) == 3
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    assert sum(r.lang_pred == r.lang for r in got) > 0.9 * len(rows)
    assert {r.lang_pred for r in got} == set(model.languages)
