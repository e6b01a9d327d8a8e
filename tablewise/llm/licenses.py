"""Licences named in texts, by ordered signature rules.

A signature is a hand-written pattern over words (letters and digits, lower case) with a
keyword in it. A text is looked at only if it holds a keyword; a rule is tried only at places
of its keyword and if the text holds the rule's rarest word. Of overlapping detections, one
that lies inside another of at least its priority is suppressed.

A null or empty text has no words and no detections. Repeated rows get equal results; other
columns aren't read. Detections are made in the row where the text is, so no key is hot.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import bound, word_count, word_line

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label | identifier in words | names in words, each of a fixed number of words; the rarest word stands first in brackets.
LICENSES = """
0bsd | 0bsd | [zero] bsd zero clause licen[sc]e; [clause] zero clause bsd licen[sc]e
afl-3.0 | afl 3 0 | [academic] academic free licen[sc]e version 3 0; [academic] academic free licen[sc]e v3 0
agpl-3.0 | agpl 3 0 | [affero] gnu affero general public licen[sc]e version 3; [affero] affero general public licen[sc]e v3; [agplv3] agplv3 licen[sc]e
agpl | agpl | [affero] gnu affero general public licen[sc]e; [affero] affero general public licen[sc]e; [agpl] gnu agpl licen[sc]e
apache-1.1 | apache 1 1 | [apache] apache software licen[sc]e version 1 1; [apache] apache licen[sc]e version 1 1
apache-2.0 | apache 2 0 | [apache] apache licen[sc]e version 2 0; [apache] apache licen[sc]e 2 0; [apache] apache software licen[sc]e version 2 0; [apache] apache licen[sc]e v2 0; [apache] apache 2 0 licen[sc]e; [asl] asl 2 0 licen[sc]e
apache | apache | [apache] apache software licen[sc]e; [apache] apache style licen[sc]e
artistic-1.0 | artistic 1 0 | [artistic] artistic licen[sc]e 1 0; [artistic] artistic licen[sc]e version 1 0
artistic-2.0 | artistic 2 0 | [artistic] artistic licen[sc]e 2 0; [artistic] artistic licen[sc]e version 2 0; [artistic] perl artistic licen[sc]e
beerware | beerware | [beer] beer ware licen[sc]e; [beerware] beerware licen[sc]e
blueoak-1.0 | blueoak 1 0 0 | [oak] blue oak model licen[sc]e 1 0 0; [oak] blue oak model licen[sc]e
bsd-2-clause | bsd 2 clause | [bsd] bsd 2 clause licen[sc]e; [bsd] simplified bsd licen[sc]e; [freebsd] freebsd licen[sc]e; [bsd] two clause bsd licen[sc]e
bsd-3-clause | bsd 3 clause | [bsd] bsd 3 clause licen[sc]e; [bsd] new bsd licen[sc]e; [bsd] modified bsd licen[sc]e; [bsd] three clause bsd licen[sc]e; [bsd] revised bsd licen[sc]e
bsd-4-clause | bsd 4 clause | [bsd] bsd 4 clause licen[sc]e; [bsd] original bsd licen[sc]e; [bsd] old bsd licen[sc]e
bsd | bsd | [bsd] bsd licen[sc]e; [bsd] berkeley bsd licen[sc]e; [bsd] bsd style licen[sc]e
bsl-1.0 | bsl 1 0 | [boost] boost software licen[sc]e version 1 0; [boost] boost software licen[sc]e 1 0; [boost] boost software licen[sc]e
busl-1.1 | busl 1 1 | [business] business source licen[sc]e 1 1; [business] business source licen[sc]e
cc0-1.0 | cc0 1 0 | [cc0] cc0 1 0 universal licen[sc]e; [cc0] creative commons cc0 licen[sc]e; [cc0] cc0 licen[sc]e
cc-by-2.0 | cc by 2 0 | [creative] creative commons attribution 2 0 licen[sc]e; [attribution] creative commons attribution 2 0 generic licen[sc]e
cc-by-3.0 | cc by 3 0 | [creative] creative commons attribution 3 0 licen[sc]e; [attribution] creative commons attribution 3 0 unported licen[sc]e
cc-by-4.0 | cc by 4 0 | [creative] creative commons attribution 4 0 licen[sc]e; [attribution] creative commons attribution 4 0 international licen[sc]e
cc-by-sa-3.0 | cc by sa 3 0 | [sharealike] creative commons attribution sharealike 3 0 licen[sc]e; [sharealike] creative commons attribution sharealike 3 0 unported licen[sc]e; [alike] creative commons attribution share alike 3 0 licen[sc]e
cc-by-sa-4.0 | cc by sa 4 0 | [sharealike] creative commons attribution sharealike 4 0 licen[sc]e; [sharealike] creative commons attribution sharealike 4 0 international licen[sc]e; [alike] creative commons attribution share alike 4 0 licen[sc]e
cc-by-nc-3.0 | cc by nc 3 0 | [noncommercial] creative commons attribution noncommercial 3 0 licen[sc]e; [commercial] creative commons attribution non commercial 3 0 licen[sc]e
cc-by-nc-4.0 | cc by nc 4 0 | [noncommercial] creative commons attribution noncommercial 4 0 licen[sc]e; [noncommercial] creative commons attribution noncommercial 4 0 international licen[sc]e; [commercial] creative commons attribution non commercial 4 0 licen[sc]e
cc-by-nd-4.0 | cc by nd 4 0 | [noderivatives] creative commons attribution noderivatives 4 0 licen[sc]e; [noderivs] creative commons attribution noderivs 4 0 licen[sc]e
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | [sharealike] creative commons attribution noncommercial sharealike 4 0 licen[sc]e; [sharealike] creative commons attribution noncommercial sharealike 4 0 international licen[sc]e
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | [noderivatives] creative commons attribution noncommercial noderivatives 4 0 licen[sc]e; [noderivatives] creative commons attribution noncommercial noderivatives 4 0 international licen[sc]e
cddl-1.0 | cddl 1 0 | [cddl] cddl 1 0 licen[sc]e; [distribution] common development and distribution licen[sc]e 1 0; [distribution] common development and distribution licen[sc]e
cecill-2.1 | cecill 2 1 | [cecill] cecill free software licen[sc]e; [cecill] cecill licen[sc]e
cpal-1.0 | cpal 1 0 | [attribution] common public attribution licen[sc]e version 1 0; [attribution] common public attribution licen[sc]e
cpl-1.0 | cpl 1 0 | [common] common public licen[sc]e version 1 0; [common] common public licen[sc]e
ecl-2.0 | ecl 2 0 | [educational] educational community licen[sc]e version 2 0; [educational] educational community licen[sc]e
efl-2.0 | efl 2 0 | [eiffel] eiffel forum licen[sc]e version 2; [eiffel] eiffel forum licen[sc]e
elastic-2.0 | elastic 2 0 | [elastic] elastic licen[sc]e 2 0; [elastic] elastic licen[sc]e v2; [elastic] elastic licen[sc]e
epl-1.0 | epl 1 0 | [eclipse] eclipse public licen[sc]e 1 0; [eclipse] eclipse public licen[sc]e v1 0
epl-2.0 | epl 2 0 | [eclipse] eclipse public licen[sc]e 2 0; [eclipse] eclipse public licen[sc]e v2 0; [eclipse] eclipse public licen[sc]e version 2 0
eupl-1.2 | eupl 1 2 | [european] european union public licen[sc]e 1 2; [european] european union public licen[sc]e version 1 2; [european] european union public licen[sc]e
fdl-1.3 | gfdl 1 3 | [documentation] gnu free documentation licen[sc]e version 1 3; [documentation] gnu free documentation licen[sc]e
ftl | ftl | [freetype] freetype project licen[sc]e; [freetype] freetype licen[sc]e
gpl-1.0 | gpl 1 0 | [gnu] gnu general public licen[sc]e version 1; [gpl] gnu gpl version 1 licen[sc]e
gpl-2.0 | gpl 2 0 | [gnu] gnu general public licen[sc]e version 2; [gnu] gnu general public licen[sc]e v2; [gplv2] gplv2 licen[sc]e; [gpl] gnu gpl v2 licen[sc]e
gpl-3.0 | gpl 3 0 | [gnu] gnu general public licen[sc]e version 3; [gnu] gnu general public licen[sc]e v3; [gplv3] gplv3 licen[sc]e; [gpl] gnu gpl v3 licen[sc]e
gpl | gpl | [gnu] gnu general public licen[sc]e; [gpl] gnu gpl licen[sc]e; [gpl] gpl licen[sc]e
hpnd | hpnd | [historical] historical permission notice and disclaimer licen[sc]e
icu | icu | [icu] icu licen[sc]e; [unicode] unicode icu licen[sc]e
ijg | ijg | [jpeg] independent jpeg group licen[sc]e; [ijg] ijg licen[sc]e
ipl-1.0 | ipl 1 0 | [ibm] ibm public licen[sc]e version 1 0; [ibm] ibm public licen[sc]e
isc | isc | [isc] isc licen[sc]e; [isc] isc style licen[sc]e; [internet] internet systems consortium licen[sc]e
lgpl-2.1 | lgpl 2 1 | [lesser] gnu lesser general public licen[sc]e version 2 1; [lesser] gnu lesser general public licen[sc]e v2 1; [lgplv2] lgplv2 1 licen[sc]e
lgpl-3.0 | lgpl 3 0 | [lesser] gnu lesser general public licen[sc]e version 3; [lesser] gnu lesser general public licen[sc]e v3; [lgplv3] lgplv3 licen[sc]e
lgpl | lgpl | [lesser] gnu lesser general public licen[sc]e; [library] gnu library general public licen[sc]e; [lgpl] gnu lgpl licen[sc]e
libpng | libpng 2 0 | [libpng] libpng licen[sc]e version 2; [libpng] libpng licen[sc]e
lppl-1.3 | lppl 1 3c | [latex] latex project public licen[sc]e version 1 3; [latex] latex project public licen[sc]e
mit | mit | [mit] mit licen[sc]e; [expat] expat licen[sc]e; [mit] mit style licen[sc]e; [x11] mit x11 licen[sc]e
mit-0 | mit 0 | [attribution] mit no attribution licen[sc]e
mpl-1.1 | mpl 1 1 | [mozilla] mozilla public licen[sc]e version 1 1; [mozilla] mozilla public licen[sc]e 1 1
mpl-2.0 | mpl 2 0 | [mozilla] mozilla public licen[sc]e version 2 0; [mozilla] mozilla public licen[sc]e 2 0; [mozilla] mozilla public licen[sc]e v 2 0
mpl | mpl | [mozilla] mozilla public licen[sc]e
ms-pl | ms pl | [microsoft] microsoft public licen[sc]e
ms-rl | ms rl | [reciprocal] microsoft reciprocal licen[sc]e
ncsa | ncsa | [illinois] university of illinois ncsa open source licen[sc]e; [ncsa] ncsa licen[sc]e
odbl-1.0 | odbl 1 0 | [database] open database licen[sc]e; [odbl] odbl licen[sc]e
odc-by-1.0 | odc by 1 0 | [commons] open data commons attribution licen[sc]e
ofl-1.1 | ofl 1 1 | [sil] sil open font licen[sc]e version 1 1; [sil] sil open font licen[sc]e 1 1; [font] sil open font licen[sc]e; [font] open font licen[sc]e
openssl | openssl | [openssl] openssl licen[sc]e; [ssleay] original ssleay licen[sc]e
osl-3.0 | osl 3 0 | [osl] osl 3 0 licen[sc]e; [open] open software licen[sc]e version 3 0; [open] open software licen[sc]e v 3 0
pddl-1.0 | pddl 1 0 | [dedication] public domain dedication and licen[sc]e
php-3.01 | php 3 01 | [php] php licen[sc]e version 3 01; [php] php licen[sc]e
postgresql | postgresql | [postgresql] postgresql licen[sc]e
psf-2.0 | psf 2 0 | [python] python software foundation licen[sc]e; [psf] psf licen[sc]e
python-2.0 | python 2 0 | [python] python licen[sc]e 2 0; [python] python licen[sc]e
qpl-1.0 | qpl 1 0 | [public] q public licen[sc]e version 1 0; [public] q public licen[sc]e
rpl-1.5 | rpl 1 5 | [reciprocal] reciprocal public licen[sc]e 1 5; [reciprocal] reciprocal public licen[sc]e
ruby | ruby | [ruby] ruby licen[sc]e
sspl-1.0 | sspl 1 0 | [server] server side public licen[sc]e version 1; [server] server side public licen[sc]e
unlicense | unlicense | [unlicense] the unlicense licen[sc]e
upl-1.0 | upl 1 0 | [universal] universal permissive licen[sc]e version 1 0; [universal] universal permissive licen[sc]e
vim | vim | [vim] vim licen[sc]e
w3c | w3c | [w3c] w3c software licen[sc]e; [w3c] w3c software notice and licen[sc]e
wtfpl | wtfpl | [wtfpl] wtfpl licen[sc]e; [want] do what the fuck you want to public licen[sc]e
x11 | x11 | [x11] x11 licen[sc]e
zlib | zlib | [zlib] zlib licen[sc]e; [libpng] zlib libpng licen[sc]e
zpl-2.1 | zpl 2 1 | [zope] zope public licen[sc]e version 2 1; [zope] zope public licen[sc]e
"""
#: label | keyword | rarest word | priority | pattern; sentences that state or grant without a licence's name.
NOTICES = """
all-rights-reserved | rights | reserved | 1 | all rights reserved
copyright-notice | copyright | copyright | 1 | copyright c (?:19|20)[0-9][0-9]
mit | granted | permission | 3 | permission is hereby granted free of charge to any person obtaining a copy
isc | hereby | granted | 3 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution | binary | 3 | redistribution and use in source and binary forms with or without modification are permitted
unlicense | unencumbered | unencumbered | 3 | this is free and unencumbered software released into the public domain
public-domain | domain | domain | 2 | released into the public domain
public-domain | domain | domain | 2 | dedicated to the public domain
gpl | redistribute | redistribute | 2 | this program is free software you can redistribute it and or modify it
apache-2.0 | compliance | compliance | 3 | you may not use this file except in compliance with the license
wtfpl | want | want | 2 | do what the fuck you want to
proprietary | proprietary | confidential | 2 | proprietary and confidential
"""
IDENTIFIED, STATED, NAMED = 4, 3, 2
RULE = "label string, keyword string, rare string, before int, size int, priority int, base boolean, pattern string"


def _rule(label: str, rare: str, priority: int, pattern: str, keyword: str, base: bool = False) -> dict:
    """A rule for each keyword; what a keyword's word may be is written out in the pattern."""
    words = pattern.split(" ")
    before = next(i for i, w in enumerate(words) if w in (keyword, "licen[sc]e") and keyword in (w, "license", "licence"))
    return {"label": label, "keyword": keyword, "rare": rare, "before": before, "size": len(words), "priority": priority, "base": base, "pattern": f"^{pattern}$"}


def signatures() -> list[dict]:
    """All rules; their order is that of the tables, with identifiers before statements before names."""
    identified, stated, named = [], [], []
    for line in LICENSES.strip().splitlines():
        label, identifier, names = (x.strip() for x in line.split("|"))
        rare = max(identifier.split(" "), key=len)
        identified.append(_rule(label, rare, IDENTIFIED, f"spdx licen[sc]e identifier {identifier}", "spdx"))
        for form in ("licensed under {}", "licensed under the {}", "licensed under a {}", "released under {}", "released under the {}"):
            stated.append(_rule(label, rare, STATED, form.format(identifier), form.split(" ")[0]))
        for name in names.split(";"):
            word, pattern = name.strip()[1:].split("] ")
            for keyword in ("license", "licence"):
                named.append(_rule(label, word, NAMED + ("0" <= label[-1] <= "9"), pattern, keyword))
    noticed = [_rule(label, rare, int(priority), pattern, keyword) for label, keyword, rare, priority, pattern in ([x.strip() for x in line.split("|", 4)] for line in NOTICES.strip().splitlines())]
    base = [_rule(label, phrase.split(" ")[0], 1, phrase, "cc" if phrase == "cc by" else "license", True) for phrase, label in BASE.items()]
    return [*identified, *stated, *named, *noticed, *base]


def detections(line: Column, rules: list[dict]) -> Column:
    """All places where a rule fits a ``word_line``: structs of begin, end (negative, for order), priority (negative), label, base."""
    table = F.from_json(F.lit(json.dumps(rules)), f"array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>")
    keywords = sorted({r["keyword"] for r in rules})

    def fitting(words: Column, possible: Column, place: Column) -> Column:
        def fits(r: Column) -> Column:
            begin = place - r["before"]
            inside = (begin >= 0) & (begin + r["size"] <= F.size(words))
            read = F.array_join(F.slice(words, F.greatest(begin, F.lit(0)) + 1, r["size"]), " ")
            return (F.get(words, place) == r["keyword"]) & inside & F.rlike(read, r["pattern"])

        begin = lambda r: place - r["before"]
        return F.transform(F.filter(possible, fits), lambda r: F.struct(
            begin(r).alias("begin"), (-(begin(r) + r["size"])).alias("back"), (-r["priority"]).alias("rank"), r["label"].alias("label"), r["base"].alias("base")))

    def all_fitting(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(keywords))
        return bound(F.filter(table, lambda r: F.array_contains(words, r["rare"])), lambda possible: F.flatten(
            F.transform(places, lambda place: fitting(words, possible, place))))

    held = F.rlike(line, F.lit(rf"(?:^| )(?:{'|'.join(keywords)})(?: |$)"))
    kind = "array<struct<begin:int,back:int,rank:int,label:string,base:boolean>>"
    return F.when(held, bound(F.split(line, " "), all_fitting)).otherwise(F.array().cast(kind)).cast(kind)


def unsuppressed(found: Column) -> Column:
    """Labels and highest priority of the detections that no other of at least their priority contains."""
    start = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"), F.array(*[F.lit(-1)] * IDENTIFIED).alias("reach"))

    def step(state: Column, hit: Column) -> Column:
        kept = F.struct(
            F.array_union(state["labels"], F.array(hit["label"])).alias("labels"), F.greatest(state["best"], -hit["rank"]).alias("best"),
            F.transform(state["reach"], lambda r, i: F.when(i < -hit["rank"], F.greatest(r, -hit["back"])).otherwise(r)).alias("reach"))
        return F.when(F.get(state["reach"], -hit["rank"] - 1) >= -hit["back"], state).otherwise(kept)

    return F.aggregate(F.array_sort(F.filter(found, lambda h: ~h["base"])), start, step)


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: places of the base phrases, labels of these and of the rules, and the strength of the best rule."""
    lines = docs.select("doc_id", word_line(F.col("text")).alias("_line"))
    found = lines.select("doc_id", word_count(F.col("_line")).alias("n_words"), detections(F.col("_line"), signatures()).alias("_found"))
    base = F.filter("_found", lambda h: h["base"])
    judged = found.select("doc_id", "n_words", base.alias("_base"), unsuppressed(F.col("_found")).alias("_kept"))
    starts = F.transform("_base", lambda h: h["begin"].cast("long"))
    labels = F.array_distinct(F.transform("_base", lambda h: h["label"]))
    return judged.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.col("_kept.labels"))), ",").alias("labels"),
        (F.greatest(F.col("_kept.best"), (F.size("_base") > 0).cast("int")) / IDENTIFIED).alias("score"))
