"""Chat windows, line templates, near-duplicates: brute force, round trips and edge cases."""

import hashlib
import random
import re
from itertools import combinations

import duckdb
import pytest
import xxhash

from tideline.llm import chat, linededup, neardup

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"
EDGES = [
    (1, None, "en", "src1", None), (2, "", None, None, 0), (None, "a null id here", "en", None, 1), (3, " \t\n\x0b ", "fr", "src1", 4),
    (4, "same text twice over again", "en", "src1", 9), (4, "same text twice over again", "en", "src1", 9), (5, "one", "en", "src2", 3), (6, "x" * 200_000, "en", "src2", 0),
]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def digests(rows):
    turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
    loss = "".join(t for r, t in rows if r == "assistant")
    return len(rows), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_escape_round_trip_and_no_control_string_inside():
    rng = random.Random(1)
    pieces = ["###", "#", "\\", "</turn>", "\n", "### assistant: ", "a", ":", "<", "/turn>", "é", " "]
    for _ in range(500):
        role, text = ("".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(2))
        inner = chat.escape(text)
        assert "###" not in inner and "</turn>" not in inner and chat.unescape(inner) == text
        assert chat.parse(chat.render(role, text) * 2) == [(role, text)] * 2


def test_windows_hold_the_budget_the_system_turn_and_masked_history(spark):
    rng = random.Random(2)
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, i, "user" if i % 2 else "assistant", " ".join(["word"] * rng.randrange(1, 60))) for i in range(1, 120)]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "long " * 900), (2, 2, "user", "ok"), (2, 3, "assistant", "fine")]
    windows = chat.format_conversations(conversations(spark, rows), budget=200, history=50, block=16).orderBy("conv_id", "window").collect()
    seen = {1: [], 2: []}
    for w in windows:
        turns = chat.parse(w.text)
        assert w.tokens <= 200 or (w.over_budget and len(turns) == 1)
        if w.conv_id == 1:
            assert turns[0] == ("system", "be brief")
        own = turns[w.n_context :]
        seen[w.conv_id] += own
        assert [chat.unescape(w.text[s.start : s.end]) for s in w.loss] == [t for r, t in own if r == "assistant"]
    assert seen[1] == [(r, t) for _, _, r, t in rows if _ is not None][:120] and len(seen[2]) == 4
    assert sum(w.n_context > 1 for w in windows if w.conv_id == 1) > 5


def test_chat_edges(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (7, None, None, "x"), (7, 1, "assistant", ""), (7, 1, "assistant", "b"), (7, 1, "assistant", "b"), (8, 0, "system", "only")]
    frame = conversations(spark, rows).selectExpr("*", "1 AS tokens", "'y' AS window", "2 AS k", "3 AS shown")
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(chat.format_conversations(frame)).collect()}
    assert found[None] == digests([("user", "a"), ("assistant", "")])
    assert found[7] == digests([("", "x"), ("assistant", ""), ("assistant", "b"), ("assistant", "b")])
    assert found[8] == digests([("system", "only")])
    assert chat.conversation_digests(chat.format_conversations(conversations(spark, []))).count() == 0


def test_very_long_turn_of_control_strings(spark):
    long = "\\\\### Assistant: </turn> ok # ## \\\\\n" * 40_000
    rows = [(1, 0, "system", "### </turn>"), (1, 1, "user", long), (1, 2, "assistant", long), (1, 3, "user", "x"), (1, 4, "assistant", "</turn>" * 3)]
    found = chat.conversation_digests(chat.format_conversations(conversations(spark, rows))).first()
    assert (found.n_turns, found.turns_sha256, found.loss_chars, found.loss_sha256) == digests([(r, t) for _, _, r, t in rows])


def test_op1_reads_back_every_conversation(spark):
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op1(spark, SF).collect()}
    by = {-7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]}
    for c, n, r, t in duckdb.sql(f"SELECT * FROM '{SF}/conversations.parquet'").fetchall():
        by.setdefault(c, []).append((n, r, t))
    assert found == {c: digests([(r, t) for _, r, t in sorted(turns)]) for c, turns in by.items()}


def dropped_by_hand(docs, lead=2, least=3):
    """For each row the numbers of its lines to drop."""
    keys, firsts = [], {}
    for doc_id, text, *_ in docs:
        doc, own = (2**63 - 1 if doc_id is None else doc_id), {}
        for i, line in enumerate((text or "").split("\n")):
            t = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
            n, w = len(t), len(t) // 5
            if n >= least:
                own[i] = {(n, n, *t)} if n < 5 else {(n, at, *t[:at], *t[at + w :]) for at in range(lead, n, max(w, 1))}
                for k in own[i]:
                    firsts[k] = min(firsts.get(k, doc), doc)
        keys.append((doc, own))
    return [sorted(i for i, ks in own.items() if any(firsts[k] < doc for k in ks)) for doc, own in keys]


LOGS = [
    (10, "user 17 logged in from host7 at noon\nalpha beta gamma delta epsilon zeta\nshort line", "en", "s", 1),
    (11, "user 99 logged in  from host3 at noon\nalpha beta gamma OTHER epsilon zeta\nshort line", "en", "s", 1),
    (9, "nothing here recurs at all today\nuser 5 logged in from h1 at night", "en", "s", 1),
    (12, "ALPHA beta gamma delta epsilon zeta\nalpha beta one two epsilon zeta", "en", "s", 1),
]


def test_line_templates_against_brute_force(spark):
    rows = LOGS + EDGES
    found = linededup.with_dropped(spark.createDataFrame(rows, DOC)).select("row.doc_id", "row.text", "dropped").collect()
    by_hand = sorted((r[0] is None, r[0] or 0, r[1] or "", d) for r, d in zip(rows, dropped_by_hand(rows), strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", list(r.dropped or [])) for r in found) == by_hand
    # a variable number, and a variable word within a fifth; two words apart are another template
    assert dict((r.doc_id, list(r.dropped or [])) for r in found)[11] == [0, 1]


def test_lines_are_dropped_and_other_columns_stay(spark):
    frame = spark.createDataFrame(LOGS + EDGES, DOC).selectExpr("*", "1 AS line", "'k' AS dropped", "2 AS doc", "3 AS dh", "'t' AS template", "4 AS n", "5 AS shown")
    out = linededup.drop_recurring_lines(frame)
    assert out.columns == frame.columns and out.count() == len(LOGS + EDGES)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[9] == LOGS[2][1] and texts[10] == LOGS[0][1].split("\n", 1)[1] and texts[11] == "short line" and texts[1] is None and texts[2] == "" and texts[4] == EDGES[4][1]
    assert linededup.drop_recurring_lines(frame.limit(0)).count() == 0


def test_line_oracle_on_edges(spark):
    rows = [r for r in LOGS + EDGES if r[1] is not None and r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = sorted((r[0], r[3]) for r in con.execute(linededup.OP2_SQL).fetchall())
    got = linededup.with_dropped(spark.createDataFrame(rows, DOC)).selectExpr("row.doc_id", "array_join(dropped, ',') AS d").collect()
    assert sorted((r.doc_id, r.d or "") for r in got) == want


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints_in_chunks(monkeypatch):
    text = "Ünicode ÄB Stays " + " ".join(f"w{i % 37}" for i in range(3000))
    want = fingerprint(text)
    for chunk in (7, 1000, 1 << 20):
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        assert neardup.simhash(text) & (2**64 - 1) == want
    assert neardup.simhash(None) == neardup.simhash(" \n") == 0 and neardup.simhash("Two words") & (2**64 - 1) == fingerprint("two words")


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("crowded", [0, 3, 48])
def test_links_keep_every_connection(spark, crowded):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    for _ in range(150):  # a crowd around one fingerprint, and a chain
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    for i in range(20):
        prints.add((centre >> 1) ^ ((1 << (2 * i)) - 1))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.u, r.v) for r in neardup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowded).collect()}
    near = [(a, b) for a, b in combinations(sorted(signed), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert got <= set(near) and closure(got, signed) == closure(near, signed)
    found = neardup.components(spark.createDataFrame(sorted(got), "u long, v long")).collect()
    want = closure(near, signed)
    assert {r.node: r.root for r in found} == {n: r for n, r in want.items() if any(n in p for p in near)}


def test_near_duplicates_and_keep_one_on_edges(spark):
    frame = spark.createDataFrame(EDGES, DOC).selectExpr("*", "1 AS fp", "'k' AS key", "2 AS root", "3 AS component_id", "'r' AS row")
    found = neardup.near_duplicates(frame).collect()
    assert len(found) == len(EDGES)
    got = {(r.doc_id, r.component_id) for r in found}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)} <= got and (None, None) in got
    kept = neardup.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert neardup.keep_one(frame.limit(0)).count() == 0


def test_op3_against_all_pairs(spark):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in neardup.op3(spark, SF).collect()}
    prints = {d: fingerprint(t) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    near = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = closure(near, sorted(prints))
    assert got == {d: (p, roots[d]) for d, p in prints.items()}
