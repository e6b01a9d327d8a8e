import math
import re

import numpy as np
from helpers import docs_frame, odd_texts, rows

from tablewise.llm import licenses as L
from tablewise.llm import urls as U

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def pages_frame(spark, urls):
    return spark.createDataFrame([(i, u, "<html>", 1, 2) for i, u in enumerate(urls)], "page_id long, url string, html string, host int, rule int")


def brute_base(url):
    match = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (ascii_lower(match[1]), match[2]) if match else ("", "")
    fits = []
    for verdict, rule in U.RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


ODD_URLS = [
    None, "", "x", "://", "http://", "http://NET/", "http://a.net", "http://a.net/", "http://planet/x", "https://Example.NET/en/5?x#y", "http://example.net/en",
    "http://x.example.com/de/", "http://anexample.com/de/1", "http://example.com/DE/1", "ftp://u:p@b.org/fr/é?q", "http://a.org#/fr/", "http://日本.org/fr/😀", "a://b.org/fr/\nx",
    "http://casino-win.example.org/en/1", "http://" + "a" * 20000 + ".com/en/", "http://good.example.org/en/2",
]


def test_rules_equal_brute_force(spark):
    urls = ODD_URLS + [f"http://h{i}.example.{d}/{p}/{i}" for i in range(8) for d in ("net", "com", "org") for p in ("en", "de", "fr")] * 2
    found = U.judge(pages_frame(spark, urls)).collect()
    assert len(found) == len(urls)
    for row in found:
        host, path, rule, verdict = brute_base(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule), urls[row.page_id]
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")
    assert U.judge(pages_frame(spark, [])).collect() == []


def test_score_equals_brute_force(spark):
    urls = [u for u in ODD_URLS if u is None or len(u) < 100] + ["http://spam.example.org/a/1"] * 3
    urls += [f"http://{h}/" for h in ("downloads.a.org", "uploads.b.com", "alphabets.org", "my-ads.c.org", "x.bets", "poker:80", "spamless.org")]
    train = [(u, brute_base(u)[3] == "block" or bool(set(re.split("[.:-]", brute_base(u)[0])) & set(U.REJECTED_WORDS))) for u in urls]
    plain = lambda u: re.sub(r"[^a-z0./-]", "~", re.sub("[0-9]", "0", (u or "").lower()))
    code = lambda u: [31, 31] + [U.SYMBOLS.index(c) for c in plain(u)]

    def model(rejected):
        counts = [{}, {}, {}]
        for u, flag in train:
            c = code(u)
            for i in range(2, len(c)) if flag == rejected else ():
                for order in range(3):
                    key = tuple(c[i - order : i + 1])
                    counts[order][key] = counts[order].get(key, 0) + 1

        def chance(context, symbol):
            p = 1 / 32
            for order in range(3):
                before = context[len(context) - order :]
                following = [n for k, n in counts[order].items() if k[:-1] == before]
                if following:
                    p = (counts[order].get((*before, symbol), 0) + len(following) * p) / (sum(following) + len(following))
            return p

        return chance

    rows_ = U.labelled(pages_frame(spark, urls))
    assert [r.rejected for r in rows_.orderBy("page_id").collect()] == [flag for _, flag in train]
    from pyspark.sql import functions as F

    counted = rows_.select("rejected", F.explode(U.grams(U.symbols(F.col("url")))).alias("g")).groupBy("g").agg(
        F.sum((~F.col("rejected")).cast("long")), F.sum(F.col("rejected").cast("long"))).collect()
    found = rows_.select("page_id", U.score(F.col("url"), U.log_ratios([tuple(r) for r in counted])).alias("s")).collect()
    accepted, rejected = model(False), model(True)
    for row in found:
        c = code(urls[row.page_id])
        logs = [math.log(rejected(tuple(c[i - 2 : i]), c[i])) - math.log(accepted(tuple(c[i - 2 : i]), c[i])) for i in range(2, len(c))]
        assert abs(row.s - (np.mean(logs) if logs else 0)) < 1e-5


def test_threshold_parts_the_classes():
    assert U.best_threshold([]) == 0.0
    edge = U.best_threshold([(100, 50, 0), (150, 5, 0), (250, 0, 9)])
    assert 151 / 50 - 4 <= edge <= 250 / 50 - 4


def brute_licenses(text, rules):
    words = WORD.findall(ascii_lower(text))
    hits, base = [], []
    for rule in rules:
        for i in range(len(words) - rule["size"] + 1):
            if words[i + rule["before"]] == rule["keyword"] and re.search(rule["pattern"], " ".join(words[i : i + rule["size"]])):
                (base if rule["base"] else hits).append((i, -(i + rule["size"]), -rule["priority"], rule["label"]))
    kept = []
    for hit in sorted(hits):
        if not any(k[0] <= hit[0] and -k[1] >= -hit[1] and -k[2] >= -hit[2] for k in kept):
            kept.append(hit)
    starts, labels = [b[0] for b in base], {b[3] for b in base}
    best = max([0, *(-k[2] for k in kept), *([1] if base else [])])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {k[3] for k in kept})), best / L.IDENTIFIED)


def test_signatures_equal_brute_force(spark):
    texts = odd_texts() + [
        "Licensed under the Apache License, Version 2.0; Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0", "CC BY-NC 4.0", "cc by cc by",
        "GNU GENERAL PUBLIC LICENSE version 3 gnu general public license", "mit license mit license MIT LICENSE", "license", "the mit", "GNU Affero General Public License version 3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "Licensed under CC BY-NC-SA 4.0 é mit license", "mit licence " * 300, "Copyright (c) 2021 x. All rights reserved",
    ]
    rules = L.signatures()
    assert len(rules) > 200
    frame = docs_frame(spark, texts)
    report = L.license_report(frame)
    assert "from_json" not in report._jdf.queryExecution().optimizedPlan().toString()
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for row in report.collect():
        assert tuple(row[c] for c in columns) == brute_licenses(texts[row.doc_id], rules), texts[row.doc_id]
    assert L.license_report(docs_frame(spark, [])).collect() == []
    assert [r[0] for r in rows(report, "doc_id")] == sorted(range(len(texts)), key=lambda i: str((i,)))
