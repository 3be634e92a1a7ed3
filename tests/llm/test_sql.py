"""The SQL of the text operators against their queries: on a small planted table, and on the smallest test tables."""

import os

import duckdb
import pytest

from waymark.llm import license_scan, queries

D = "/root/testdata/sf0.001"
NAMES = sorted(queries.oracle_sql())
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    base = [f"word{i}" for i in range(60)]
    near = [*base[:57], "x", "y"]
    texts = [" ".join(base), " ".join(near), " ".join(base).upper(), " ".join([*near[3:], "z"]), "one two three", "One\ttwo  three", "", None, " \n", "a b c d e", "a b c d e f",
             "Copyright 2021 A. Person\n" + license_scan._MIT, "Title\nReleased under the MIT licence!\nThis work is licenced under CC BY-NC 4.0\nbody", license_scan._APACHE_NOTICE.lower(),
             "Licensed under the GNU General Public Licence, v3.", "we licence nothing, v 2"]
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[7], (None, texts[0], None, None, None), (None, None, None, None, None)]


def same(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'' if os.path.isfile(folder + '/documents.parquet') else '/*.parquet'}'")
    rel = con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    rows = df.select(order).collect()
    assert sorted(repr(tuple(r)) for r in rows) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    return rows


@pytest.mark.parametrize("name", NAMES)
def test_planted(spark, tmp_path, name):
    spark.createDataFrame(planted(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = same(spark, str(tmp_path), name)
    if name == "op5_license_scan":
        assert {r.doc_id: (r.licence, r.line_licences) for r in rows if r.licence or r.line_licences} == {
            11: ("MIT", ""), 12: (None, "CC-BY-NC-4.0,MIT"), 13: ("Apache-2.0", ""), 14: ("GPL-3.0", "GPL-3.0"),
        }
    if name == "op1_ngram_jaccard_join":
        assert {r.doc_id: r.component_id for r in rows if r.doc_id in (0, 1, 2, 3, 4, 5, 9, 10)} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 9: 9, 10: 10}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_smallest_tables(spark, name):
    same(spark, D, name)
