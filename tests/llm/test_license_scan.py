"""Copies of known texts in other dress, and what must not match."""

from pathlib import Path

from faultline.llm import license_scan, license_texts


def dressed(text):
    """Another layout, other case, comment marks, a copyright line, British spelling."""
    lines = [" * " + line for line in text.replace("license", "licence").upper().split("\n")]
    return "/*\n * Copyright (c) 2020 Someone\n * All rights reserved.\n" + "\n".join(lines) + "\n */"


def test_known_texts_in_other_dress(spark):
    rows = [(i, dressed(body), name) for i, (name, body) in enumerate(license_texts.KNOWN)]
    rows += [(100 + i, body + " and more", None) for i, (_, body) in enumerate(license_texts.KNOWN)] + [(200, None, None), (201, "", None), (202, "...", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license string")
    got = {r.doc_id: r.license for r in license_scan.scan(docs.drop("license"), license_scan.known_digests(spark)).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_licences_in_full(spark):
    full = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(name, Path("/usr/share/common-licenses", file).read_text()) for file, name in full.items()]
    rows += [("GPL-3.0-only", rows[2][1].split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS"), ("none", rows[2][1][:9_000])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for r in license_scan.scan(docs, license_scan.known_digests(spark)).collect():
        assert r.license == (None if r.doc_id == "none" else r.doc_id)


def test_odd_rows(spark, odd_documents, no_documents):
    known = license_scan.known_digests(spark, [("nothing", ""), ("ours", "Alpha, beta; GAMMA delta epsilon.")])
    got = sorted((str(r.doc_id), r.license) for r in license_scan.scan(odd_documents, known).collect() if r.license)
    assert got == [("1", "ours"), ("2", "ours"), ("2", "ours")]
    assert license_scan.scan(odd_documents, known).count() == 10 and license_scan.scan(no_documents, known).count() == 0
