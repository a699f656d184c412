"""The registered queries themselves: against SQL on the given tables, and on a table of odd rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3": "page_id url text n_chars",
    "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op5": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6": "doc_id start n_tokens ids_crc32",
    "op7": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8": "doc_id held_out lang_pred score",
    "op9": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10": "doc_id n_shingles component_id kept",
}
#: Columns that hold what the operators use inside; none of them may matter.
CLASH = ("block", "part", "key", "id", "component", "comp", "host", "rank", "score", "kept", "held", "row", "slot", "task", "next_text", "length", "text_hash", "level")


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    both = [([r[k] for k in order if not isinstance(r[k], float)], [r[k] for k in order if isinstance(r[k], float)]) for r in rows]
    return sorted(both, key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    got, found = plain(df.columns, [tuple(r) for r in df.collect()]), con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = plain(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns) and len(got) == len(want)
    assert all(x[0] == y[0] and all(math.isclose(p, q, abs_tol=1e-9) for p, q in zip(x[1], y[1], strict=True)) for x, y in zip(got, want))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated ids, nulls in every column, repeated rows, ties, long texts and words, names that clash."""
    base = " ".join(f"word{k} of the text" for k in range(40))
    data = [(None, base, None, None, None), (None, None, "en", "s", 1), (1, base, "en", "s", 1), (1, base, "en", "s", 1), (1, base + " more", "fr", None, 2),
            (2, "", "en", "s", 0), (3, " \n\t\n", None, "s", 3), (4, "w" * 300_000, "fr", "s", 1), (5, "a b c d e f g h i j k " * 5000, "fr", "s", 1), (6, base, None, "s", None), (7, "über ça 中文 \U0001f642", "fr", "s", 9)]
    at = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("x") for c in CLASH}).coalesce(2).write.parquet(f"{at}/documents.parquet")
    html = f"<article><p>{base}</p></article>"
    pages = [(None, None, None), (1, "http://a/1", html), (1, "http://a/1", html), (2, None, html), (3, "http://a/3", ""), (4, "http://a/4", "<p>" + "x" * 300_000), (5, "no url", "<article><p>one</p><p>two")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASH if c != "text"}).withColumn("text", F.lit(1)).write.parquet(f"{at}/pages.parquet")
    docs.limit(0).write.parquet(f"{at}/none/documents.parquet")
    spark.read.parquet(f"{at}/pages.parquet").limit(0).write.parquet(f"{at}/none/pages.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    columns = COLUMNS[name.split("_")[0]].split()
    got = QUERIES[name](spark, odd)
    assert [c for c in got.columns if c in columns] == columns
    rows = got.collect()
    source = spark.read.parquet(f"{odd}/{'pages' if name.startswith('op3') else 'documents'}.parquet")
    first = columns[0]
    if name.startswith("op5"):
        rows = [r for r in rows if r.piece == 0]
    assert sorted(str(r[first]) for r in rows) == sorted(str(r[first]) for r in source.select(first).collect())
    assert QUERIES[name](spark, f"{odd}/none").count() == 0


def test_held_out_rows(spark, odd):
    import zlib

    for name, of, at in (("op1_suffix_tree", 7, 2), ("op8_rank_order_language", 5, 0)):
        for r in QUERIES[name](spark, odd).collect():
            assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % of == at)
