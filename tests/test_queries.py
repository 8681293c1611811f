"""Registered queries against their SQL; all of them with ALL_QUERIES=1, else one per family."""

import os

import pytest
from oracle import compare, database, entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAMILIES = [
    "path_parts", "human_size", "file_flags", "type_group", "code_likeness", "select_files",
    "select_files_user_lists", "gitignore_join", "detect_repo_type", "directory_tree",
    "skip_counts", "rank_by_score", "priority_cap", "largest_files", "score_files",
    "size_budget", "token_budget", "strip_comments", "summarize_long_code",
    "redact_credentials", "credential_findings", "pack_document", "dry_run_summary",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FAMILIES


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    from repoweave.plans import oracles, queries

    assert set(queries.QUERIES) == set(oracles.build()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["repo_id", "files", "bytes", "document"]
