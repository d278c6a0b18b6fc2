"""Every query that SQL can express, against its SQL on the smallest tables."""

import compare
import pytest

from tidewater.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, con, name):
    assert compare.difference(spark, con, SF, catalog.QUERIES[name], catalog.SQL[name]) is None


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """A function of a table's name and SELECT: the folder of the smallest tables with that one replaced."""

    def make(table, sql):
        folder = tmp_path_factory.mktemp("grown")
        for t in compare.BASE:
            if t != table:
                (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        compare.duck(SF).execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        return str(folder)

    return make


def _differs(spark, sf, name):
    return compare.difference(spark, compare.duck(sf), sf, catalog.QUERIES[name], catalog.SQL[name])


#: Customers of the keys of large tables: ref 196604 is torn, and its fixup word is 0xFFFF.
LARGE_KEYS = "SELECT * REPLACE (c_custkey + 195600 AS c_custkey) FROM customer WHERE c_custkey < 20"


@pytest.mark.parametrize("name", ["mft_record_parse", "mft_record_stream"])
def test_records_of_large_numbers(spark, grown, name):
    assert _differs(spark, grown("customer", LARGE_KEYS), name) is None


@pytest.mark.parametrize("odd", ["c_custkey + 4294966280 AS c_custkey", "CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS c_custkey", "'' AS c_name"])
def test_streams_of_numbers_past_32_bits_null_ones_and_empty_names(spark, grown, odd):
    assert _differs(spark, grown("customer", f"SELECT * REPLACE ({odd}) FROM customer WHERE c_custkey < 60"), "mft_record_stream") is None


def test_streams_have_the_types_of_their_sql(spark, con):
    spark_types = {"BIGINT": "bigint", "INTEGER": "int"}
    want = [(name, spark_types[kind]) for name, kind, *_ in con.execute(f"DESCRIBE {catalog.SQL['mft_record_stream']}").fetchall()]
    assert catalog.QUERIES["mft_record_stream"](spark, SF).dtypes == want


@pytest.mark.parametrize("names", ["c_name", "'twin'"])
def test_guarded_walk_of_large_numbers_and_equal_names(spark, grown, names):
    sql = LARGE_KEYS.replace(" AS c_custkey)", f" AS c_custkey, {names} AS c_name, CAST(c_custkey % 3 AS INTEGER) AS c_nationkey)")
    assert _differs(spark, grown("customer", sql), "guarded_path_walk") is None


def test_durations_of_large_numbers(spark, grown):
    assert _differs(spark, grown("documents", "SELECT * REPLACE (doc_id + 3600 AS doc_id) FROM documents"), "parse_duration") is None


def test_tree_scan_of_more_rows_than_are_sampled(spark, grown):
    sql = "SELECT * REPLACE (doc_id + 200 * k AS doc_id) FROM documents, range(200) r(k)"
    assert _differs(spark, grown("documents", sql), "tree_scan") is None


def test_stored_chunks_of_documents_with_one_id(spark, grown):
    sql = "SELECT * REPLACE (CASE WHEN doc_id > 2 THEN doc_id // 2 END AS doc_id) FROM documents WHERE doc_id < 60"
    assert _differs(spark, grown("documents", sql), "store_verify_bytes") is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
