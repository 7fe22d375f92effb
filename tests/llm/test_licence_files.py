"""Complete licence files, with and without title lines."""

from pathlib import Path

from tideline.llm import licenses

OWNER = "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n"


def test_complete_licence_files(spark):
    folder = Path(licenses.__file__).parent / "licence_texts"
    bare = dict(licenses.TEXTS) | {"BSD-2-Clause": licenses._BSD + licenses._AS_IS, "BSD-3-Clause": licenses._BSD + licenses._NO_NAMES + licenses._AS_IS}
    cases = [(i, OWNER + text) for i, text in bare.items()]
    cases += [(i, f"{title}\n\n{OWNER}{text}") for i, text in bare.items() for title in licenses.TITLES[i]]
    cases += [(i, (folder / f"{i}.txt").read_text()) for i in licenses.FILES]
    cases += [(i, "\n".join((folder / f"{i}.txt").read_text().lstrip().split("\n")[n:])) for i, n in (("GPL-3.0", 2), ("CC0-1.0", 1))]
    cases.append(("Apache-2.0", (folder / "Apache-2.0.txt").read_text().split("END OF TERMS")[0]))
    cases.append((None, (folder / "GPL-2.0.txt").read_text() + "\nand more"))
    frame = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.whole for r in licenses.scan(frame).collect()}
    assert got == {i: name for i, (name, _) in enumerate(cases)}
    assert {name for name, _ in cases} >= {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", *licenses.FILES}


def test_query_and_oracle_agree_on_whole_files(spark, tmp_path):
    import duckdb

    texts = [t for _, t in licenses.whole_texts()]
    rows = [(i, OWNER * (i % 2) + t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "This work is licensed under the MIT License\n" + texts[5]), (1003, texts[3] + " more")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, digest, whole, licenses FROM ({licenses.OP10_SQL})").fetchall())
    got = sorted(tuple(r) for r in licenses.op10(spark, str(tmp_path)).select("doc_id", "digest", "whole", "licenses").collect())
    assert got == want
    assert sum(r[2] is not None for r in got) >= len(texts)
