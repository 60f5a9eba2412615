import duckdb
import pytest

from helixframe import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["variant_stats", "h2_mom", "association", "ldsc_rg", "cohort_split", "nearest_event", "log_parse", "incremental_state", "kinship_matrix", "h2_mom_epochs", "ldsc_rg_latents", "ldsc_gencov_annotations", "sumstats_of_state", "two_runs", "log_split_parse", "composite_loss", "variance_explained", "readouts_of_state", "rg_of_state", "epoch_after", "ldsc_summary", "decoder_inputs", "ordered_reindex"])
def test_same_rows_as_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(map(tuple, df.collect())) == plain(want)


def test_sql_names_are_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
