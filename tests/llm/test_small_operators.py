"""Licence scan, URL filter and preference pairs on rows with known answers."""

import random
import re
import time

from pyspark.sql import functions as F

from tensorloom.llm import license_scan, preference, queries, url_filter


def test_every_known_sentence_has_an_anchor():
    assert all(re.search(license_scan.ANCHOR, s) for s in license_scan.KNOWN)
    assert {i for _, seq in license_scan.RULES for i in seq} <= set(license_scan.KNOWN.values())


def test_licence_sequences(spark):
    mit = "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [(1, None, 0), (2, "", 0), (3, mit, 0), (4, "Released under the MIT License. Licensed under CC BY-NC 4.0.\nAll rights reserved.", 0), (5, "It is licensed to someone.", 0), (4, "Licensed under the Apache License, Version 2.0.\nyou may not use this file except in compliance with the License.", 0), (6, "plain words " * 20_000 + "\nAll rights reserved", 0)]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string, licence int"))
    assert out.columns == ["doc_id", "text", "licence"]
    got = sorted((r["doc_id"], r["licence"]["licences"], len(r["licence"]["identifiers"])) for r in out.collect())
    assert got == [(1, [], 0), (2, [], 0), (3, ["MIT"], 4), (4, ["Apache-2.0"], 2), (4, ["MIT", "CC-BY-NC-4.0", "Proprietary"], 3), (5, [], 0), (6, ["Proprietary"], 1)]
    assert license_scan.scan(spark.createDataFrame([], "text string")).collect() == []


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", None
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [r for r, _ in queries.URL_RULES if (host == (d := r.split("/", 1)[0]) or host.endswith("." + d)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_odd_urls(spark):
    urls = ["http://a.com/", "http://A.COM", "https://x.example.com/en/1?q#f", "https://www.example.com/en/", "https://sub.www.example.com/en/x", "http://b.net/es/1", "http://b.net/fr", "http://notexample.com/en/", "ftp://com/x", "no scheme.com/", None, "", "://net/fr/x", "http://a.com?x=/en/", "http://x.org/a://b.net/es/", "http://h.net/" + "a" * 50_000]
    model = url_filter.train([("http://good.org/a", 0), ("http://bad-spam.org/a", 1)] * 30)
    rows = [(i, u, "old") for i, u in enumerate(urls)] * 2
    out = url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, link string"), queries.URL_RULES, model).select("url", "link.*").collect()
    assert len(out) == len(rows)
    verdicts = dict(queries.URL_RULES)
    for r in out:
        assert (r["host"], r["path"], r["rule"]) == brute_rule(r["url"])
        assert r["verdict"] == (verdicts[r["rule"]] if r["rule"] else "block" if model.probability([r["url"]])[0] >= 0.5 else "allow")
    assert url_filter.judge(spark.createDataFrame([], "url string"), queries.URL_RULES, model).collect() == []


def test_trees_learn_held_out():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randrange(4, 9)))
    make = lambda y: f"http://{word()}{'-' + word() if y else ''}.{rng.choice(['org', 'net'])}/{word()}/{rng.randrange(999) if y or rng.random() < 0.5 else ''}"
    rows = [(make(k % 2), k % 2) for k in range(600)]
    model = url_filter.train(rows[:400])
    p = model.probability([u for u, _ in rows[400:]])
    assert sum((x >= 0.5) == y for x, (_, y) in zip(p, rows[400:], strict=True)) > 190
    assert 0 < url_filter.train([]).probability(["x"])[0] < 1 and url_filter.train([("http://a.org", 1)] * 8).probability([None])[0] > 0.85


def test_url_query_on_held_out_hosts(spark):
    out = queries.op3_url_filters(spark, "/root/testdata/sf0.01").where("rule IS NULL")
    spam = F.col("host").rlike("-")
    assert out.where(spam & (F.col("verdict") == "block")).count() >= out.where(spam).count() * 0.7
    assert out.where(~spam & (F.col("verdict") == "block")).count() == 0


def test_preference_pairs(spark):
    talk = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "a<|b"), (0, 3, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "other"), (2, 0, None, None), (3, 0, "", ""), (4, 1, "assistant", "x"), (4, 0, "user", "y"), (None, 0, "user", "z"), (7, None, "user", "late")]
    c = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 4, 5), (3, 6, 7)], "pair long, chosen_id long, rejected_id long")
    got = {r["pair"]: r for r in preference.format_pairs(pairs, c).collect()}
    a = got[0]
    assert a["shared"] == 2 and a["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert a["chosen"] == "<|user|>\na< |b<|end|>\n<|assistant|>\ngood<|end|>\n" and a["rejected"] == "<|user|>\nother<|end|>\n"
    s = a["chosen_mask"][0]
    assert len(a["chosen_mask"]) == 1 and a["chosen"][s["start"] : s["end"]] == "good<|end|>\n" and a["rejected_mask"] == []
    assert got[1]["shared"] == 1 and got[1]["chosen"] == got[1]["rejected"] == ""
    assert got[2]["shared"] == 0 and got[2]["prompt"] == "" and got[2]["chosen"].startswith("<|user|>\ny") and got[2]["rejected"] == ""
    assert got[3]["rejected"] == "<|user|>\nlate<|end|>\n" and len(got) == 4
    assert preference.format_pairs(pairs.limit(0), c.limit(0)).collect() == []


WRAPPED_MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
WRAPPED_BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * - Redistributions of source code must retain the above copyright notice, this
 *   list of conditions and the following disclaimer.
 * - Redistributions in binary form must reproduce the above copyright notice,
 *   this list of conditions and the following disclaimer in the documentation
 *   and/or other materials provided with the distribution.
"""
WRAPPED_GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.\r
#\r
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the rest.
"""
WRAPPED_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_wrapped_licences(spark):
    rows = [(1, WRAPPED_MIT), (2, WRAPPED_BSD), (3, WRAPPED_GPL), (4, WRAPPED_APACHE), (5, "All rights\n\nreserved. All\nrights reserved words"), (6, "a/b|c_d <all> rights\nreserved")]
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1]["identifiers"] == ["mit-title", "mit-grant", "mit-condition", "mit-warranty"] and got[1]["licences"] == ["MIT"]
    assert got[2]["identifiers"] == ["bsd-grant", "bsd-source", "bsd-binary"] and got[2]["licences"] == ["BSD-2-Clause"] and len(got[2]["rules"]) == 1
    assert got[3]["identifiers"] == ["gpl3-grant", "gpl-warranty"] and got[3]["rules"] == [4]
    assert got[4]["identifiers"] == ["apache-notice", "apache-compliance", "apache-copy"] and got[4]["rules"] == [2]
    assert got[5]["identifiers"] == got[6]["identifiers"] == []


def test_tags_and_numbered_conditions(spark):
    numbered = WRAPPED_BSD.replace(" * - ", " * 1. ", 1).replace(" * - ", " * 2. ", 1) + """ * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""
    rows = [(1, numbered), (2, "// SPDX-License-Identifier: GPL-2.0-or-later\nint main();"), (3, "# SPDX-License-Identifier: MIT\n# x"), (4, "SPDX-License-Identifier: MIT-0"), (5, "SPDX-License-Identifier: Nothing-1.0"), (6, "x " * 10**5 + "\n<!-- SPDX-License-Identifier: Apache-2.0 -->")]
    got = {r["doc_id"]: r["licence"]["licences"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: ["BSD-3-Clause"], 2: ["GPL-2.0-or-later"], 3: ["MIT"], 4: ["MIT-0"], 5: [], 6: ["Apache-2.0"]}


def test_swapped_answers(spark):
    talk = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "good"), (1, 0, "user", "ask"), (1, 1, "assistant", "bad"), (1, 2, "user", "end"), (2, 0, "user", "alone"), (2, 1, "assistant", "yes"), (4, 0, "user", "no answer"), (5, 0, "assistant", "first"), (-1, 0, "assistant", "m"), (-2, 0, "assistant", "n"), (None, 0, "user", "z")]
    c = spark.createDataFrame([(*r, "x") for r in talk], "conv_id long, turn long, role string, text string, shared string")
    got = {r["pair"]: r for r in preference.format_turns(preference.swapped_answers(c)).collect()}
    body = lambda s: [x.partition("|>\n")[2] for x in s.split("<|end|>\n") if x]
    seen = {k: (r["rejected_id"], r["shared"], body(r["prompt"]), body(r["chosen"]), body(r["rejected"])) for k, r in got.items()}
    assert seen == {
        0: (1, 3, ["hi", "hello", "more"], ["good"], ["bad"]), 1: (0, 1, ["ask"], ["bad", "end"], ["good"]), 2: (3, 1, ["alone"], ["yes"], []),
        4: (5, 1, ["no answer"], [], ["first"]), 5: (4, 0, [], ["first"], []), -1: (-2, 0, [], ["m"], ["n"]), -2: (-1, 0, [], ["n"], ["m"]),
    }
    assert preference.swapped_answers(c.limit(0)).collect() == []


def plain_probability(model, url):
    """Boosting by its definition: one tree after the other, one node after the other."""
    x = url_filter.features([url], model.odds)[0]
    total = model.start
    for nodes, leaves in zip(model.nodes, model.leaves, strict=True):
        at = 0
        for level in range(url_filter.LEVELS):
            f, cut = nodes[2**level - 1 + at]
            at = 2 * at + (x[f] > cut)
        total += leaves[at]
    return 1 / (1 + 2.718281828459045 ** -total)


def test_verdicts_against_plain_trees(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = url_filter.fit(queries.labelled_urls(pages))
    model = model if model.nodes else url_filter.train([(f"http://{'spam-' if k % 3 == 0 else ''}h{k}.org/a", int(k % 3 == 0)) for k in range(90)])
    verdicts = dict(queries.URL_RULES)
    for r in url_filter.judge(pages, queries.URL_RULES, model).collect():
        rule, p = brute_rule(r["url"])[2], plain_probability(model, r["url"])
        assert abs(r["link"]["probability"] - p) < 1e-9 and r["link"]["verdict"] == (verdicts[rule] if rule else "block" if p >= url_filter.THRESHOLD else "allow")


def test_clashing_and_long(spark):
    names = "row url p rule host path _p _rule licence link".split()
    schema = "page_id int, u string, " + ", ".join(f"{c} string" for c in names)
    model = url_filter.train([("http://good.org/a", 0), ("http://bad-spam.org/a", 1)] * 30)
    df = spark.createDataFrame([(1, "http://a.com/" + "x" * 10**6, *names)], schema)
    r = url_filter.judge(df, queries.URL_RULES, model, url="u").first()
    assert [r[c] for c in names[:-1]] == names[:-1] and r["link"]["host"] == "a.com"
    r = license_scan.scan(df.withColumn("u", F.lit("All rights reserved. " + "plain words " * 10**5)), "u").first()
    assert [r[c] for c in names if c != "licence"] == [c for c in names if c != "licence"] and r["licence"]["licences"] == ["Proprietary"]


def test_hostile_texts_are_scanned_once(spark):
    parts = ["\n*", "\n* ", ". ", "/ ", "| ", "_ ", " \n", "\n\n.", ":", "*\t\n|", "license\n-", "permission is hereby granted "]
    df = spark.createDataFrame([(k, "license " + x * 200_000) for k, x in enumerate(parts)], "doc_id int, text string")
    began = time.monotonic()
    assert all(r["n"] == 0 for r in license_scan.scan(df).select(F.size("licence.rules").alias("n")).collect())
    assert time.monotonic() - began < 60
