"""Whole licences, and headers in comments."""

from strandweave.llm import license_scan


def test_whole_licences_and_comments(spark):
    own = dict(license_scan.whole_texts()[:13])
    assert len(own) == 13
    header = "Copyright (c) 2020 Someone\n" + license_scan.MIT.removeprefix("MIT License\n")
    rows = [*own.items(), *((f"MIT {m}", "".join(f"{m}{x}\n" for x in header.split("\n"))) for m in ("# ", " * ", "// "))]
    rows += [("BSD-3-Clause x", "BSD 3-Clause License\n\nCopyright (c) 2021, A\nAll rights reserved.\n\n" + own["BSD-3-Clause"])]
    docs = [(k, t) for k, (_, t) in enumerate(rows)] + [(99, "# Copyright 2020\nno licence"), (100, "# Copyright 2020")]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: n.split(" ")[0] for k, (n, _) in enumerate(rows)} | {99: None, 100: None}
