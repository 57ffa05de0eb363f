"""Queries against their SQL on rows where rounding, order or chance decide."""

import random
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle_check import compare
from veritab.plans import load_all

REGISTRY = load_all()


def _connect(folder, tables):
    con = duckdb.connect()
    con.execute("SET threads=1")
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet{'/*.parquet' if (folder / f'{name}.parquet').is_dir() else ''}'")
    return con


def _lines(rows):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]
    return pa.table({c: list(v) for c, v in zip(cols, zip(*rows, strict=True), strict=True)})


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Suppliers whose mean discount is 0.051 or 0.046 to the last digit, their lines over two files."""
    folder, rng, files = tmp_path_factory.mktemp("tied"), random.Random(5), ([], [])
    (folder / "lineitem.parquet").mkdir()
    for supplier in range(1, 121):
        total, values = rng.choice([510, 460]), [rng.randrange(11) for _ in range(100)]
        while sum(values) != total:
            at = rng.randrange(100)
            values[at] = min(10, max(0, values[at] + (1 if sum(values) < total else -1)))
        for i, v in enumerate(values):
            files[i >= 50].append((supplier * 1000 + i, i, supplier, 1, 50.0, 10.0, v / 100, datetime(1999 - supplier % 2, 5, 1)))
        files[0].append((supplier * 1000 + 500, 1, supplier, 1, 50.0, 10.0, 0.09, datetime(1996, 5, 1)))
    for i, rows in enumerate(files):
        pq.write_table(_lines(rows), folder / "lineitem.parquet" / f"part-{i}.parquet")
    keys = list(range(1, 121))
    pq.write_table(pa.table({"s_suppkey": keys}), folder / "supplier.parquet")
    return folder


@pytest.mark.parametrize("name", ["c12_regularities", "d41_knowledge_lookups", "f14_version_update", "f15_keep_revise_retire", "f16_open_questions"])
def test_means_on_a_bound_follow_the_stored_order(spark, tied, name):
    note, ok = compare(spark, _connect(tied, ["lineitem", "supplier"]), name, REGISTRY.QUERIES[name], REGISTRY.ORACLES[name], str(tied))
    assert ok or note == "rows=0", note


@pytest.mark.parametrize("name", ["e13_prediction_divergence", "e14_acquisition_plan", "e14_unbudgeted_plan", "c9_plan_catalogue"])
def test_costs_round_as_in_sql(spark, tmp_path, name):
    """Prices whose thousandth lies halfway between two cents only in print."""
    prices = [k + 5.0 for k in range(100_000, 180_000, 10)]
    odd = [p for p in prices if round(p / 1000 * 100 + 1e-13, 9) % 1 == 0.5][:4000]
    odd = odd + [p + 5 for p in odd]
    orders = pa.table({"o_orderkey": list(range(len(odd))), "o_custkey": [1] * len(odd), "o_totalprice": odd, "o_orderstatus": ["O"] * len(odd)})
    pq.write_table(orders, tmp_path / "orders.parquet")
    day = datetime(1999, 1, 1)
    pq.write_table(_lines([(o, 1, 1, n, 30.0, 100.0 * n, 0.0, day) for o in range(len(odd)) for n in (1, 2)]), tmp_path / "lineitem.parquet")
    note, ok = compare(spark, _connect(tmp_path, ["orders", "lineitem"]), name, REGISTRY.QUERIES[name], REGISTRY.ORACLES[name], str(tmp_path))
    assert ok, note


def test_quotes_meant_for_nowhere_are_found_nowhere(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": [5, 6], "text": ["abzq abzq abzq abzq abzq abzq abzq", "one two three four"]}), tmp_path / "documents.parquet")
    note, ok = compare(spark, _connect(tmp_path, ["documents"]), "c6", REGISTRY.QUERIES["c6_quote_location"], REGISTRY.ORACLES["c6_quote_location"], str(tmp_path))
    assert ok, note
