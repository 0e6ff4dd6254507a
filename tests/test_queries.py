"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quire import constants as C
from quire.operators import catalogue as K

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {n: s for n, s in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    clean = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr([clean(v) for v in r]) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    ours, theirs = entry.queries()[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 50


def test_script_property_attaches_whole_sources(spark, duck, sf_dir, tmp_path):
    """Documents get the links of all items of their source with their id, however far apart; null sources and ids get none."""
    found = {r.pos: r.links for r in entry.queries()["script_property"](spark, sf_dir).collect() if r.links}
    assert len(found) == duck.execute(f"SELECT count(links) FROM ({ORACLES['script_property']})").fetchone()[0] > 0
    made = [(i, None if i % 13 == 0 else f"s{i % 2}") for i in range(4000)]
    spark.createDataFrame(made, "doc_id long, source string").selectExpr("*", "'en' AS lang", "'' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    links = {}
    for i, source in made:
        if i % 7 >= 5 and i % 4 and i % 18 in (3, 5) and source:
            name = f"Text/file_{i}" + (".css" if i % 18 == 3 else ".js")
            links.setdefault((source, i % 50), []).append(f"stylesheet|{name}|text/css" if i % 18 == 3 else f"|{name}|text/javascript")
    own = lambda i, source: links.get((source, i % 50)) if i % 4 else None
    expected = {i: (source, own(i, source) and ";".join(own(i, source)), own(i, source) and int(any("javascript" in x for x in own(i, source)))) for i, source in made if i % 7 in (3, 4)}
    assert max(len(x) for x in links.values()) > 3
    out = entry.queries()["script_property"](spark, str(tmp_path)).collect()
    assert len(out) == len(expected) and {r.pos: (r.book, r.links, r.scripted) for r in out} == expected


def test_attach_deals_documents_of_one_id_to_several_tasks(spark, monkeypatch):
    """The rows are those of one task; neither an id with many links, one with many documents, nor documents without an id stay in one."""
    documents = spark.createDataFrame([("b", i, (None, "many", "plain", "few")[i % 4] if i < 396 else "few") for i in range(400)] + [(None, i, "many") for i in range(400, 500)], "book string, pos long, id string")
    attached = spark.createDataFrame([("b", "many", f"{i}.css", C.STYLE, i) for i in range(50)] + [("b", "few", "a.js", C.SCRIPT, 1), ("b", "few", "a.png", C.IMAGE, 2)], "book string, id string, file_name string, item_type int, seq long")
    assert K.LINK_BYTES >= 1 << 20 and K.LINK_ROWS >= 1000
    whole = sorted(map(repr, K.attach(documents, attached).collect()))
    assert len(whole) == 500
    monkeypatch.setattr(K, "LINK_BYTES", 10_000)
    monkeypatch.setattr(K, "LINK_ROWS", 20)
    out = K.attach(documents, attached)
    assert sorted(map(repr, out.collect())) == whole
    rows = out.selectExpr("*", "spark_partition_id() AS task").collect()
    assert {r.id for r in rows if r.links} == {"many", "few"} and all(len(r.links) == 50 and r.scripted == 0 for r in rows if r.book and r.id == "many")
    for book, key in (("b", "many"), ("b", "plain"), ("b", None), (None, "many")):
        assert len({r.task for r in rows if (r.book, r.id) == (book, key)}) > 1
