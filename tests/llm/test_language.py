import zlib

from docloom.llm.language import identify_languages, op6_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = op6_language_id(spark, sf).collect()
    assert len(out) == len(true) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(20 + i, "der Hund und die Katze", "de") for i in range(20)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 !?", "de"), (None, "the the", "en"), (103, "x" * 200_000, "en"), (104, "the cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'z' as score")
    out = {r.doc_id: r for r in identify_languages(df).collect()}
    assert [out[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and out[104].lang_pred == "en" and not out[None].held_out
    none = identify_languages(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert identify_languages(df.where("false")).collect() == []
    one = identify_languages(df.where("lang = 'en'")).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}
