"""Words that touch letters outside of ASCII, against the SQL."""

import duckdb

from marginalia.plans import language


def test_term_spellings_beside_other_letters(spark, tmp_path):
    texts = ["Wi-Fiñ and WiFiл went. Wi-Fi went.", "ñWi-Fi, éWiFi and Ünder-Wood, Underwoodé. Heerñ Enst and Heer\x0bEnst", "Heer Enst and Heerenst; HeerEnst’s ĸHeerEnst 5Wi-Fi _WiFi"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(language.ORACLES["term_spellings"])
    got = language.QUERIES["term_spellings"](spark, str(tmp_path)).select(*want.columns)
    rows = sorted(want.fetchall())
    assert rows and sorted(map(tuple, got.collect())) == rows
