"""Templates of under five words are found inside documents of any length, as runs of whole words."""

from collections import Counter

from ledgerwatch.llm import license_scan, queries
from ledgerwatch.llm.common import documents


def test_short_notices(docs_of, spark):
    long_text = "some words " * 300
    rows = [
        (1, f"{long_text} All rights\nreserved. {long_text}"),
        (2, "all RIGHTS reserved"),
        (3, f"/* SPDX-License-Identifier: MIT */ {long_text}"),
        (4, f"{long_text} all rights are reserved; spdx license mit identifier"),
        (5, f"unreserved all rights {long_text} all rights"),
        (6, "All rights reserved. Released under the MIT License. All rights reserved."),
        (6, "All rights reserved. Released under the MIT License. All rights reserved."),
        (7, None),
        (None, "end: copyleft"),
        (8, "reserved"),
    ]
    one = spark.createDataFrame([("one-word", "Copyleft")], "license string, template string")
    found = license_scan.license_scan(docs_of(rows), license_scan.registered_templates(spark).unionByName(one)).collect()
    expected = [(1, "all-rights-reserved"), (2, "all-rights-reserved"), (3, "mit-spdx"), (None, "one-word")]
    expected += [(6, "all-rights-reserved"), (6, "mit")] * 2
    assert Counter((r.doc_id, r.license) for r in found) == Counter(expected)
    assert {r.containment for r in found} == {1.0}
    assert license_scan.license_scan(docs_of(rows), one).count() == 1


def test_planted_lines(spark, folder):
    folder = folder.replace("sf0.001", "sf0.1")
    planted = {r.doc_id for r in documents(spark, folder).where("text rlike '(?i)\\\\ball rights reserved\\\\b'").collect()}
    found = Counter((r.doc_id, r.license) for r in queries.op6_license_scan(spark, folder).collect())
    lines = {k for k, name in found if name == "all-rights-reserved"}
    print(len(planted), len(lines), len(found))
    assert planted and lines == planted
