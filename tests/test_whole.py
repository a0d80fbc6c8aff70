"""Registered queries by brute force over all their rows."""

from collections import defaultdict

from parcelyn.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_price_history_report_has_all_parts(spark):
    seen, photos = defaultdict(list), defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect():
        seen[r.l_partkey].append((r.l_shipdate, float(r.l_extendedprice / r.l_quantity // 1)))
        photos[r.l_partkey].add(r.l_suppkey)
    parts = {r.p_partkey for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    due = set()
    for k, rows in seen.items():
        rows.sort()
        changes = {(str(b[0])[:10], a[1], b[1]) for a, b in zip(rows, rows[1:]) if a[1] != b[1]}
        if changes and k in parts:
            due.add((k, len(photos[k]), len(changes)))
    assert any(k % 20 for k, _, _ in due)
    assert {tuple(r)[:3] for r in catalogue.QUERIES["price_history_report"](spark, SMALL).collect()} == due
