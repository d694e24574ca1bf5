from test_text import brute_licenses

from tripspark.llm import license_scan

FILLER = "other words that come before and after the notice " * 12
SEEN = {
    "This work is licensed under the GNU General Public License, version 2": {"GPL-2.0"},
    "This work is licensed under the GNU General Public License, version 3": {"GPL-3.0"},
    "This work is licensed under the GNU General Public License, version 2, and later that work is licensed under the GNU General Public License, version 3": {"GPL-2.0", "GPL-3.0"},
    "This work is licensed under the GNU Lesser General Public License, version 3": {"LGPL-3.0"},
    "This work is licensed under the GNU Lesser General Public License, version 2.1": {"LGPL-2.1"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"MPL-2.0"},
    "Licensed under CC BY-SA 4.0": {"CC-BY-SA-4.0"},
    "# SPDX-License-Identifier: GPL-2.0-or-later": {"GPL-2.0-or-later"},
    "CC0 1.0 Universal": {"CC0-1.0"},
}


def test_common_notices_and_their_versions(spark):
    docs = [(i, f"{FILLER}{t} {FILLER}") for i, t in enumerate(SEEN)]
    got = license_scan.license_scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    for i, (text, want) in enumerate(SEEN.items()):
        assert {r.license for r in got if r.doc_id == i} == want, text


def test_no_template_is_taken_for_another_version():
    by_id = {tid: name for tid, name, _ in license_scan.TEMPLATES}
    assert len(by_id) == len(license_scan.TEMPLATES)
    for tid, name, body in license_scan.TEMPLATES:
        found = set(brute_licenses(body))
        assert tid in found and not any(license_scan.family(by_id[x]) == license_scan.family(name) is not None and by_id[x] != name for x in found), (tid, found)


def test_many_templates_are_joined_without_a_broadcast(spark, odd, monkeypatch):
    docs = spark.createDataFrame([(i, f"{FILLER}{t} {FILLER}") for i, t in enumerate(SEEN)] + [(None, "Released under the MIT License")] * 2, "doc_id bigint, text string").selectExpr("*", "'a' AS template_id", "1 AS x", "2 AS start", "'b' AS license")
    want = sorted(map(str, license_scan.license_scan(docs).collect()))
    assert len([x for x in want if "doc_id=None" in x]) == 1  # rows that repeat an id, a null one too, are one document
    monkeypatch.setattr(license_scan, "BROADCAST_WORDS", 0)
    assert sorted(map(str, license_scan.license_scan(docs).collect())) == want
    assert license_scan.license_scan(odd).count() == 0


def test_bands_retrieve(spark):
    # no bands, no windows: a template without its band shingles is found nowhere
    docs = spark.createDataFrame([(1, "Released under the MIT License")], "doc_id bigint, text string")
    table, keys, widths, words = license_scan.template_tables(spark, license_scan.TEMPLATES, 0.8, 0.9999)
    assert keys.count() < table.selectExpr("sum(size(t))").first()[0]  # fewer keys than shingles
    real = license_scan.template_tables
    try:
        license_scan.template_tables = lambda *a: (table, keys.where("false"), widths, words)
        assert license_scan.license_scan(docs).count() == 0
    finally:
        license_scan.template_tables = real
    assert license_scan.license_scan(docs).count() == 1


def test_whole_licences_are_found_in_long_texts(spark):
    bodies = {tid: body for tid, _, body in license_scan.TEMPLATES if tid.endswith("-body")}
    docs = [(i, f"{FILLER * 20}\n{body}\n{FILLER * 20}") for i, body in enumerate(bodies.values())]
    docs += [(10 + i, FILLER + " ".join(w for k, w in enumerate(body.split()) if k % 60) + FILLER) for i, body in enumerate(bodies.values())]  # a word in 60 is missing
    got = license_scan.license_scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    for i, tid in enumerate(bodies):
        assert {tid} <= {r.template_id for r in got if r.doc_id == i} and {tid} <= {r.template_id for r in got if r.doc_id == 10 + i}


def test_many_templates_are_joined_slim(spark, odd, monkeypatch):
    """Where the templates are not broadcast no array of a document's shingles stands beside a single one, and the answer is the same."""
    import re

    from pyspark.sql import functions as F

    from tripspark.llm import license_scan as module

    text = odd.where("doc_id = 100").first().text
    templates = [*module.TEMPLATES[:6], ("t", "own", text), ("u", "own", " ".join(text.split()[20:70]))]
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = rows(module.license_scan(odd, templates))
    monkeypatch.setattr(module, "BROADCAST_WORDS", 0)
    got = module.license_scan(odd, templates)
    assert rows(got) == want and want
    few = spark.createDataFrame([(1, [5, 6, 7])], "doc_id bigint, s array<bigint>")
    keys = spark.createDataFrame([(6, "t", 2, 3)], "x bigint, template_id string, size int, bands int")
    plan = module.windows_by_row(few, keys, F.col("pos").alias("start"))._jdf.queryExecution().optimizedPlan().toString()
    explodes = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert len(explodes) == 1 and re.search(r"posexplode\(s#\d+\), \[\d+\]", explodes[0]), plan  # the array ends there
