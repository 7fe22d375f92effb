"""Lexicon counts: what belongs to a word, by hand and against the oracle SQL."""

import duckdb

from tideline.plans import ORACLE, QUERIES

# text -> positive, negative hits
CASES = [
    ("sell, gain and LOSS", 1, 2), ("con sellóta de", 0, 0), ("ósell gainñ", 0, 0), ("Sellе", 0, 0), ("gaiń seĺl loss", 0, 1), ("RİSK risk", 0, 1), ("gain١ loss_ 1sell", 0, 0),
    ("«gain» — ‘loss’ …sell。", 1, 2), ("gain-loss 'sell' gain-ñ", 0, 1), ("́gain", 1, 0), ("", 0, 0), ("日本gain日本 ﬁne", 0, 0), ("Key gain\n\tprofit", 2, 0),
]


def test_words_end_where_letters_of_any_script_end(spark, tmp_path):
    rows = [(i, text, "en", f"s{i % 3}", len(text)) for i, (text, _, _) in enumerate(CASES)] + [(99, None, "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for name, columns in (("lexicon_sentiment", "doc_id pos neg score"), ("weighted_sentiment", "source n score confidence")):
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns.split()).collect()]
        want = con.execute(f"SELECT {columns.replace(' ', ', ')} FROM ({ORACLE[name]})").fetchall()
        assert sorted(got, key=key) == sorted(want, key=key)
        if name == "lexicon_sentiment":
            assert {r[0]: r[1:3] for r in got if r[0] != 99} == {i: case[1:] for i, case in enumerate(CASES)}
