"""Registered queries against their SQL on the smallest tables. All of them: tests/oracle_check.py."""

import pytest
from oracle_check import compare, database

import __spark_entry__ as registered
from conftest import SF_DIR
from podweave.plans.oracle import ORACLE
from podweave.plans.queries import QUERIES

# One query per group of operators; the others run in tests/oracle_check.py.
HERE = ["volume_by_namespace", "malformed_lines", "parsed_documents", "ns_from_rfc3339", "events_enriched",
        "event_batches_per_read", "document_batch_contents", "admitted_hot_stream", "batch_registration_asof",
        "rendered_lines", "damaged_frames", "pipeline_verdicts", "file_offsets", "pipeline_quarantine", "capture_roundtrip",
        "ns_from_months", "registration_asof_ties", "known_tags",
        "own_format", "growing_registry", "batches_sent", "admitted_default_burst", "renamed_stream", "capture_split"]


@pytest.mark.parametrize("name", HERE)
def test_query(spark, name):
    assert compare(spark, database(SF_DIR), name, SF_DIR) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
