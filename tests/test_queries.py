import pytest

from paperweave.plans.oracles import SQL
from paperweave.plans.queries import QUERIES
from tests.compare import DATA, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_edit_distance_links_cover_references_without_an_earlier_link(spark):
    links = QUERIES["edit_distance_links"](spark, DATA)
    unresolved = spark.read.parquet(f"{DATA}/bib_refs.parquet").where("cited_urn is null").select("peer", "citing_urn", "ref_pos")
    assert links.join(unresolved, ["peer", "citing_urn", "ref_pos"], "left_semi").count() > 0
