"""The operators that are DataFrame projections and joins: rules, licences, URLs, shards, personal data."""

from collections import Counter

import rows as R
from pyspark.sql import functions as F

from runlens.llm import licenses, pii, quality, shards, url_filter


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ledger_equals_brute_force(spark):
    docs = R.documents(spark)
    got = sorted((r.doc_id or 0, *(r[n] for n in R.quality(""))) for r in quality.ledger(docs).collect())
    want = sorted((i or 0, *R.quality(t).values()) for i, t in R.DOCS)
    assert got == want


def test_ledger_is_one_projection(spark):
    text = plan(quality.ledger(R.documents(spark)))
    assert "Exchange" not in text and "Python" not in text


def test_policies_and_ablation(spark):
    texts = ["word " * 60 + "end", "short", " ".join(f"a{i}" for i in range(60)), "SHOUT" + " SHOUT" * 3]
    entries = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = {r.doc_id: r.kept for r in quality.apply_policy(entries, quality.STANDARD).collect()}
    assert kept == {0: False, 1: False, 2: False, 3: False}  # the third has few letters
    base = {r.doc_id: r.kept for r in quality.apply_policy(entries, quality.BASE).collect()}
    assert base == {0: False, 1: False, 2: True, 3: False}
    found = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(entries, quality.STANDARD).collect()}
    assert found["short"] == (2, 1) and found["few_letters"] == (1, 1) and found["repeated_lines"] == (0, 0)
    rows = quality.apply_policy(entries, quality.STANDARD).collect()
    for name, (n_failed, n_only) in found.items():
        bit = next(1 << r.bit for r in quality.RULES if r.name == name)
        assert n_failed == sum(bool(r.fail_bits & bit) for r in rows)
        assert n_only == sum(r.fail_bits == bit for r in rows)


def test_keep_gives_all_columns_back(spark):
    docs = R.documents(spark)
    kept = quality.keep(docs, quality.BASE)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, None])


def test_empty_tables(spark):
    none = R.documents(spark, [])
    assert quality.ledger(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert shards.shard(none).count() == 0
    assert pii.find(none).count() == 0


def test_licences(spark):
    mit = [licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")]
    texts = [
        "\n".join(mit),
        "Intro. Released under the MIT License. More.\nAll rights reserved.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "no licence here",
        None,
        "ALL RIGHTS RESERVED! released   under the mit license;",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.sentences, r.licences) for r in licenses.scan(docs).collect()}
    assert got[0] == (["mit-grant", "mit-notice", "mit-warranty", "mit-liability"], ["MIT"])
    assert got[1] == (["mit-released", "all-rights"], ["MIT", "all-rights-reserved"])
    assert got[2] == (["apache-header", "apache-comply", "apache-obtain"], ["Apache-2.0"])
    assert got[3] == ([], []) and got[4] == ([], [])
    assert got[5] == (["all-rights", "mit-released"], ["MIT", "all-rights-reserved"])
    assert "Exchange" not in plan(licenses.scan(docs))


def test_every_known_sentence_has_a_mark():
    import re

    for name, text in licenses.SENTENCES.items():
        assert re.search(licenses.MARKS, text), name


def test_url_rules_and_list(spark):
    urls = [
        "http://WWW.Example.com/en/a",
        "http://example.com/en/x?y",
        "https://a.b.example.com/de/",
        "http://xexample.com/en/",
        "http://m.example.net/es/1",
        "http://spam.example.org/Page/?utm_source=x&b=2&a=1#top",
        "http://spam.example.org:80/other",
        None,
        "no scheme",
        "http://a.com?x=://b.net/es/",
        "http://example.org",
    ]
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block"}
    pages = spark.createDataFrame(
        [(i, u, "x", "x") for i, u in enumerate(urls)], "page_id long, url string, key string, block string"
    )
    listed = spark.createDataFrame([("https://www.spam.example.org/Page?a=1&b=2",), (None,), ("none",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, rules).collect()}
    assert got == {
        0: ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        1: ("example.com", "/en/x", "example.com/en/", "block"),
        2: ("a.b.example.com", "/de/", "com/", "allow"),
        3: ("xexample.com", "/en/", "com/", "allow"),
        4: ("m.example.net", "/es/1", "net/es/", "block"),
        5: ("spam.example.org", "/Page/", None, "block"),
        6: ("spam.example.org:80", "/other", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("a.com", "", None, "allow"),
        10: ("example.org", "", None, "allow"),
    }
    assert url_filter.judge(pages.limit(0), listed, rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0), {}).collect()} == {"allow"}


def test_overfull_bloom_filter_changes_nothing(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.org/p", "id").alias("url"))
    listed = pages.where("page_id % 3 = 0").select("url")
    for blocks in (16, url_filter.MAX_BLOCKS):
        got = url_filter.judge(pages, listed, {}, max_blocks=blocks)
        assert got.where("listed != (page_id % 3 = 0)").count() == 0 and got.count() == 4000


def test_bloom_filter_passes_few_others(spark):
    keys = spark.range(3000).select(F.format_string("k%d", "id").alias("key"))
    blocks = {r.block: [r[f"w{i}"] for i in range(8)] for r in url_filter.bloom(keys, 256).collect()}
    probe = spark.range(3000, 9000).select(
        url_filter._block(F.format_string("k%d", "id"), 256).alias("b"),
        *(url_filter._bit(F.format_string("k%d", "id"), i).alias(f"w{i}") for i in range(8)),
    )
    hits = sum(r.b in blocks and all(blocks[r.b][i] & r[f"w{i}"] for i in range(8)) for r in probe.collect())
    assert hits < 600


def test_shards(spark):
    texts = [(i % 37, "x" * (i * 7 % 101) + "é") for i in range(500)] + [(None, None), (5, ""), (7, "same")] + [(7, "same")] * 200
    got = shards.shard(R.documents(spark, texts), n_shards=16).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in texts)
    import zlib

    assert Counter(r.text_crc32 for r in got) == Counter(zlib.crc32((t or "").encode()) for _, t in texts)
    at = 0
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.byte_start == at
        at += r.size
    sums = Counter()
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        sums[s] = sum(r.size for r in got if r.shard == s)
    assert max(sums.values()) - min(sums.values()) <= 2 * max(r.size for r in got)
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.byte_start)]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)


def base_text(row):
    return ",".join(f"{k}:{x.s}:{x.e}" for k in pii.KINDS for x in row.base[k])


def test_base_spans_equal_brute_force(spark):
    extra = [
        "999.1.1.1.2.3.4.5 and 1.2.3.4.5 or 007.08.09.010",
        "4111111111111111 4111-1111-1111-1111 41111111111111112222 0000 0000 0000 0000 0",
        "+12345678 +1234567 +1 ((((2 +1 5 +(1) ++12345 6789",
        "a@b a@b.c a@b..c .@-.- x@y.z@w.v é@é.com_é@a.b",
        "1" * 5000 + " " + "1 " * 5000 + "+" * 3000 + "@" * 3000 + "a" * 3000 + "@b.c",
    ]
    rows = [*R.DOCS, *((100 + i, t) for i, t in enumerate(extra))]
    got = sorted((r.doc_id or 0, base_text(r)) for r in pii.find(R.documents(spark, rows)).collect())
    assert got == sorted((i or 0, R.pii(t)) for i, t in rows)
    assert any(t.count("email") > 1 for _, t in got)


def disclosing(n=12):
    """The name Zanzibar stands beside one address in many surroundings, and nowhere else."""
    words = "red green blue black white brown grey pink gold silver bronze amber violet indigo".split()
    rows = [(i, f"The {words[i]} keeper Zanzibar of {words[i + 1]} has boss@corp.example here. Zanzibar") for i in range(n)]
    rows += [(100 + i, f"The {words[i % 14]} keeper of {words[(i + 1) % 14]} has nothing here {i}") for i in range(400)]
    rows += [(600 + i, f"single{chr(97 + i)} word only{i}@other.example seen") for i in range(5)]
    return rows


def test_disclosing_terms(spark):
    rows = [*disclosing(), (700, None), (0, disclosing()[0][1])]
    found = {r.doc_id: r for r in pii.find(R.documents(spark, rows)).collect()}
    texts = dict(rows)
    for i in range(12):
        assert [x.v for x in found[i].terms] == ["Zanzibar", "Zanzibar"]
        assert all(texts[i][x.s : x.e] == x.v for x in found[i].terms)
    assert not any(found[i].terms for i in found if i >= 100)
    docs = R.documents(spark, rows)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    by = {r.doc_id: r.text for r in clean.collect()}
    assert "Zanzibar" not in by[3] and "<email>" in by[3] and "keeper" in by[3]
    assert by[120] == texts[120] and by[700] is None


def test_both_ways_to_count_terms_agree(spark):
    docs = pii._keyed(R.documents(spark, disclosing()), "doc_id", "text")
    near = pii.contexts(docs.withColumn("base", pii.base_spans(F.col("t"))))
    few = pii.disclosures(docs, near, broadcast_terms=0).collect()
    assert sorted(few) == sorted(pii.disclosures(docs, near).collect()) and few


def test_sanitise_merges_overlaps(spark):
    text = "call +4111 1111 1111 1111 or me@x.org. " + R.PII
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    clean = pii.sanitise(docs).first().text
    assert clean.startswith("call +<card> or <email>. Write to <email> or <ip>, not 10.0.256.1; card <card> é, call <phone>")
    assert clean.endswith("now. <email>@d.org <ip>.<ip> <email>")


def rare(n_docs, copies=()):
    """One address in two documents beside Quillfeather, and among other documents."""
    rows = [(i, f"some common words of document number {i} stand here") for i in range(n_docs)]
    rows += [(5001, "Ask Quillfeather about it, ann@corp.example reads this"), *copies]
    return rows


def test_terms_of_rare_entities(spark):
    second = (5002, "The words of Quillfeather here are for ann@corp.example only")
    copy = (5003, rare(0)[0][1])

    def terms(rows):
        found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(terms) > 0").collect()
        return {r.doc_id: {x.v for x in r.terms} for r in found}

    found = terms(rare(600, [second]))
    assert "Quillfeather" in found[5001] and "Quillfeather" in found[5002]
    # A copy is no second observation; one is enough among more documents only.
    assert terms(rare(600, [copy])) == {}
    assert "Quillfeather" in terms(rare(3000))[5001]
    assert not any("words" in v for v in found.values())


def test_terms_are_found_in_a_given_table(spark):
    found = pii.find(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert found.where("size(terms) > 0").count() > 0


def test_terms_go_wherever_the_entity_stands(spark):
    rows = [(i, f"some common words of document number {i} stand here") for i in range(10_000, 13_000)]
    shapes = ["ask (Quillfeather) ann@corp.example", 'to "Quillfeather": ann@corp.example!', "Quillfeather ann@corp.example"]
    rows += [(1000 + i, f"{t} {w}") for i, (t, w) in enumerate(zip(shapes, ("red", "green", "blue"), strict=True))]
    rows += [(1010 + i, f"unit B52x7 at 10.1.2.3 {w}") for i, w in enumerate(("red", "green", "blue"))]
    # Far from the entity, and with no word beside it.
    rows += [(1020, "ann@corp.example " + ". " * 60 + "Quillfeather"), (1021, "10.1.2.3 is the host " + "word " * 40 + "b52x7.")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(terms) > 0").collect()
    terms = {r.doc_id: [x.v for x in r.terms] for r in found}
    for i in (1000, 1001, 1002, 1020):
        assert terms[i] == ["Quillfeather"]
    assert "B52x7" in terms[1010] and "b52x7" in terms[1021]


def test_wrapped_licences_and_versions(spark):
    import textwrap

    every = licenses.ALL_SENTENCES

    def wrapped(*names, prefix=""):
        return "\n\n".join(
            textwrap.fill(every[n], 60, initial_indent=prefix, subsequent_indent=prefix) for n in names
        )

    gpl = ("gpl-hope", "gpl-see")
    bsd = ("bsd-redistribute", "bsd-source", "bsd-binary")
    texts = [
        "MIT License\n\nCopyright (c) 2020 X\n" + wrapped("mit-grant", "mit-notice", "mit-warranty", "mit-liability"),
        wrapped("gpl-free", *gpl, prefix=" * "),
        wrapped("gpl2-free", *gpl, prefix="# "),
        every["gpl-free"],
        wrapped(*bsd, "bsd-names"),
        wrapped(*bsd),
        "Copyright 2020 X\nAll rights reserved\nLicensed under the Apache License,\nVersion 2.0\n(the \"License\");\nyou",
        "We are not Released under the MIT\nLicense. Licensed under CC BY 4.0.\r\nmore",
        wrapped(*gpl),
        every["gpl-free"].replace("version 3", "version 2"),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.scan(docs).collect()}
    assert got == {
        0: ["MIT"],
        1: ["GPL-3.0-or-later"],
        2: ["GPL-2.0-or-later"],
        3: ["GPL-3.0-or-later"],
        4: ["BSD-3-Clause"],
        5: ["BSD-2-Clause"],
        6: ["Apache-2.0", "all-rights-reserved"],
        7: ["CC-BY-4.0"],
        8: ["GPL"],  # these sentences name no version
        9: ["GPL-2.0-or-later"],
    }


def test_every_version_sentence_has_a_mark():
    import re

    assert all(re.search(licenses.MARKS, text) for text in licenses.ALL_SENTENCES.values())


def test_every_known_sentence_is_looked_at(spark):
    import re

    for between in (" ", "\n * "):
        passed = [k for k in licenses.KNOWN if not re.search(licenses.MARKS, k.replace(" ", between).upper())]
        assert not passed
    texts = {
        "Released under the MIT.": ["MIT"],
        "Intro. Distributed under the GPLv3 or later. More": ["GPL-3.0-or-later"],
        "Copy it.\nReleased under\nCC0 1.0.": ["CC0-1.0"],
        "by X. All rights\nreserved.": ["all-rights-reserved"],
        " * Released\n *   under Creative Commons Attribution 4.0 International": ["CC-BY-4.0"],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


LICENCES = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: GPL-2.0-only\ncode": "GPL-2.0",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "",
    "This project is licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License and more.": "",
    "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
    "Licensed under CC BY-ND 3.0; use it.": "CC-BY-ND-3.0",
    "Licensed under the Mozilla Public License,\n\n v. 2.0!": "MPL-2.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General\n"
    "# Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your\n"
    "# option) any later version.\n# This library is distributed in the hope that it will be useful,\n"
    "# but WITHOUT ANY WARRANTY; without even the implied warranty.  See the GNU\n# Lesser General Public License for more details.": "LGPL-2.1-or-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL-3.0-or-later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation; either version 1, or (at your option) any later version.": "GPL-1.0-or-later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; See the GNU General Public License for more details.": "GPL",
    "This is free and unencumbered software released into the\npublic domain.": "Unlicense",
    "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "Licensed under the GNU General Public License, version 3 or later.\nReleased under the Unlicense.": "Unlicense,GPL-3.0-or-later",  # in the order of the rules
    "": "",
}


def test_further_licences_in_spark_and_sql(spark):
    import duckdb

    from runlens.llm.oracles import ORACLES

    texts = [*LICENCES, " \n ".join(LICENCES), *licenses.ALL_SENTENCES.values(), "\n\n".join(licenses.ALL_SENTENCES.values()), None]
    rows = list(enumerate(texts))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: (len(r.sentences), ",".join(r.sentences), ",".join(r.licences)) for r in found}
    assert [got[i][2] for i in range(len(LICENCES))] == list(LICENCES.values())
    db = duckdb.connect()
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cursor = db.execute(ORACLES["op4_licenses"])
    names = [c[0] for c in cursor.description]
    assert {r["doc_id"]: (r["n_sentences"], r["sentences"], r["licences"]) for r in (dict(zip(names, x, strict=True)) for x in cursor.fetchall())} == got


def test_every_form_is_found_alone(spark):
    from pyspark.sql import functions as F

    forms = list(licenses.KNOWN)
    rows = spark.createDataFrame(list(enumerate(f"License:\n{f}" for f in forms)), "doc_id long, text string")
    got = {r.doc_id: r.sentences for r in licenses.scan(rows).select("doc_id", F.col("sentences")).collect()}
    assert all(got[i] == [licenses.KNOWN[f]] for i, f in enumerate(forms))
