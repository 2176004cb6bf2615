from pyspark.sql import functions as F

from probity.llm.lines import drop_boilerplate, host_of


def test_rules(make):
    docs = [(i, f"Menu \nunique {i}\nShared", "en", "a") for i in range(12)]
    docs += [(100 + i, f"other {i}\nMenu", "en", "b") for i in range(9)]
    docs += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "Menu\n\nMenu\r", "en", "a")]
    docs += [(300 + i, f"Footer\n{i}", "en", None) for i in range(10)]
    df = make(docs)
    out = drop_boilerplate(df, ratio=0.5, min_pages=10)
    assert set(df.columns) <= set(out.columns)
    got = {r.doc_id: (r.text, r["_n_lines"], r["_n_dropped"]) for r in out.collect()}
    assert len(got) == len(docs)
    assert got[3] == ("unique 3", 3, 2)
    assert got[104] == ("other 4\nMenu", 2, 0)
    assert got[200] == (None, 0, 0)
    assert got[201] == ("", 1, 0)
    assert got[202] == ("", 3, 2)
    assert got[305] == ("5", 2, 1)


def test_small_hosts(make):
    """On hosts of 9 and 50 pages the ratio decides; lines of a page and its one copy stay."""
    docs = [(i, f"Menu\nbody {i // 2}", "en", "nine") for i in range(9)]
    docs += [(100 + i, f"Footer\nbody {i}" if i < 3 else f"Rare\nbody {i}" if i < 5 else f"body {i}", "en", "fifty") for i in range(50)]
    got = {r.doc_id: r.text for r in drop_boilerplate(make(docs)).collect()}
    assert [got[i] for i in range(9)] == [f"body {i // 2}" for i in range(9)]
    assert [got[100], got[102], got[103], got[104], got[149]] == ["body 0", "body 2", "Rare\nbody 3", "Rare\nbody 4", "body 49"]


def test_empty(make):
    assert drop_boilerplate(make([(1, "a")]).where("false")).count() == 0


def test_columns_of_the_same_names_stay(make):
    df = make([(i, f"Menu\n{i}") for i in range(4)]).selectExpr("*", "'a' AS _n_lines", "'b' AS _n_dropped")
    out = drop_boilerplate(df)
    assert {(r["_n_lines"], r["_n_dropped"], r["_n_lines_"], r["_n_dropped_"], r.text) for r in out.collect()} == {("a", "b", 2, 1, str(i)) for i in range(4)}


def test_sites_of_addresses(spark):
    urls = [("https://A.example:8080/x?y", "u1"), ("http://me@a.example/z#k", "u2"), ("ftp://b.example", "u3"), ("no address", "u4"), (None, "u5")]
    df = spark.createDataFrame(urls, "url string, id string").withColumn("host", host_of(F.col("url")))
    assert [r.host for r in df.orderBy("id").collect()] == ["a.example", "a.example", "b.example", None, None]


def test_pages_by_host(spark):
    rows = [(i, f"http://{'big' if i < 40 else 'small'}.example/{i}", "Home | About\npage " + str(i)) for i in range(44)]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string").withColumn("host", host_of(F.col("url")))
    assert {r.text for r in drop_boilerplate(pages, "host").collect()} == {f"page {i}" for i in range(44)}
