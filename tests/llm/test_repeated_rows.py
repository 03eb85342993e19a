"""Rows repeated with id and text hold the same secrets as one row, at the same places."""

import pytest

from ledgerwatch.llm import secret_scan


@pytest.mark.parametrize("copies", [1, 2, 5])
@pytest.mark.parametrize("doc_id", [1, None])
def test_two_secrets_in_repeated_rows(docs_of, doc_id, copies):
    text = "a password=abcdefghijkl1 b 0123456789abcdef01 c token: mnopqrstuvwx2"
    df = docs_of([(doc_id, text)] * copies + [(2, text + " "), (3, "plain")], extra=False)
    found = sorted((r.doc_id or 0, r.n_assign, r.n_hex, r.spans) for r in secret_scan.secret_scan(df).collect())
    spans = "assign:2:24,hex:27:45,assign:48:68"
    assert found == sorted([(doc_id or 0, 2, 1, spans)] * copies + [(2, 2, 1, spans), (3, 0, 0, "")])
