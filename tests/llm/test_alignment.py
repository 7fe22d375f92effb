"""Token alignment against whole tokenisation by the libraries and a comparison byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tideline.llm import alignment
from tideline.llm.common import tokenizer, vocabulary
from tideline.llm.wordcache import _byte_names

ODD = [
    "plain words here", " leading", "trailing ", "  two  spaces   three", "tab\there\n\nand  lines \n x", "<s></s><|endoftext|> <unk> <0x41> <0x0A>", "é ﬁ ① 한국어 日本語 \U0001f600\U0001f600 x",
    "a\x00b", " no break　", "it's we're DON'T 'll", "▁ piece mark ▁▁x", "", None, " ", "\n", "x" * 3000, "12345 67,890.12 -- ... !!!", "\x1c\x1d \x85 y", "𐍈 ḿ́ ʼn",
]


def by_hand(rows):
    """The columns of the contract, from the whole token lists of whole texts."""
    from sentencepiece import SentencePieceProcessor

    a_model, b_model = tokenizer(vocabulary("byte_bpe_50k.json")), SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    byte_of = {c: b for b, c in _byte_names().items()}
    spell_a = lambda i: bytes(byte_of[c] for c in a_model.id_to_token(i))
    spell_b = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(map(spell_a, a)) != want or b"".join(map(spell_b, b)) != want:
            docs.append((doc_id, [], [], None, None))
            continue
        owner_a = [i for i, t in enumerate(a) for _ in spell_a(t)]
        owner_b = [j for j, t in enumerate(b) for _ in spell_b(t)]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        ends = lambda owner: {n + 1 for n in range(len(owner)) if n + 1 == len(owner) or owner[n] != owner[n + 1]}
        groups, start = [], 0
        for end in sorted(ends(owner_a) & ends(owner_b)):
            ids = lambda owner, tokens: ",".join(str(tokens[i]) for i in dict.fromkeys(owner[start:end]))  # noqa: B023, E731
            groups.append(f"{ids(owner_a, a)}|{ids(owner_b, b)}")
            start = end
        pairs = [(a[i], b[j]) for i, j in links]
        count.update(pairs)
        docs.append((doc_id, a, b, groups, pairs))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, a, b, groups, pairs in docs:
        if groups is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(count[p] == most[p[1]] for p in pairs)
            out.append((doc_id, len(a), len(b), len(groups), len(pairs), best, sum(count[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts(rng):
    words = ["the", "of", "straße", "co-op", "x1", "élan,", "Überraschung", "können.", "A", "ñandú", "\n", "\t", "  ", "thtion", "…", "foo_bar(baz)"]
    return [*ODD, *(rng.choice(["", " "]).join(rng.choice(words) + " " * rng.randrange(2) for _ in range(rng.randrange(1, 200))) for _ in range(80))]


@pytest.mark.parametrize("few", [50_000, 20])
def test_whole_query_against_brute_force(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(alignment, "FEW", few)
    rows = list(enumerate(texts(random.Random(4)))) + [(None, "null id here"), (None, None), (3, "repeated row"), (3, "repeated row")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'p' AS pairs", "2 AS n", "3 AS times")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op13(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert order(map(tuple, got)) == order(by_hand(rows))


def test_stretches_and_forgotten_windows_change_nothing(monkeypatch):
    rng = random.Random(6)
    whole = [" ".join(filter(None, texts(rng))).replace("▁", "") * 3, *ODD]
    known = alignment.remembered(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    known.forget()
    plain = lambda rows: [tuple(x.tolist() if hasattr(x, "tolist") else x for x in r) for r in rows]
    want = plain(alignment.aligned(whole, known, True))
    assert want[0][0] > 1000
    monkeypatch.setattr(alignment, "STRETCH", 300)
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    monkeypatch.setattr(alignment, "LARGEST", 40)
    assert plain(alignment.aligned(whole, known, True)) == want
    known.forget()


def test_groups_spell_the_text(spark):
    text = "Überraschung of the  straße, 12 x\n\nthtion"
    made = alignment.align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep_groups=True).first()
    assert hashlib.sha256(made.groups.encode()).hexdigest() == made.groups_sha256
    known = alignment.remembered(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    for side, vocabulary_side in ((0, known.left), (1, known.right)):
        ids = [int(i) for g in made.groups.split(";") for i in g.split("|")[side].split(",")]
        assert b"".join(vocabulary_side.tokens[i] for i in ids).decode() == " " + text


def test_long_text_and_empty_table(spark, tmp_path):
    rows = [(1, "long words of a text, " * 60_000), (2, "y" * 300_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = alignment.op13(spark, f"{tmp_path}/a").select(*COLUMNS).collect()
    assert order(map(tuple, got)) == order(by_hand(rows))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert alignment.op13(spark, f"{tmp_path}/b").collect() == []


def test_words_met_before_are_not_encoded_again():
    known = alignment.Windows(alignment.byte_level(vocabulary("byte_bpe_50k.json")), alignment.pieces(vocabulary("piece_bpe_32k.model")))
    seen = []
    for side in (known.left, known.right):
        side.encode = lambda text, whole=side.encode: seen.append(len(text)) or whole(text)
    text = "Überraschung of the straße, 12 co-op " * 200
    first = alignment.aligned([text.strip()], known, True)
    again = alignment.aligned(["the straße, of 12 co-op"], known, True)
    assert sum(seen) < 200 and first[0][0] > 1000 and again[0][0] > 5
    # odd words beside known ones: spaces in a row, a piece mark, a long word
    for odd in ("of  the", " of", "of ", "a▁b of", "▁▁", "of " + "thtion" * 40 + " the", "x" * 65, "x\n\ny of"):
        fresh = alignment.Windows(known.left, known.right)
        assert [r[:5] for r in alignment.aligned([odd, "of the"], known)] == [r[:5] for r in alignment.aligned([odd], fresh) + alignment.aligned(["of the"], fresh)]
    assert alignment.aligned(["a▁b of", "of▁ the"], known)[0][0] == 0
