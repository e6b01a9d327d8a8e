"""The pipeline's stages on a small fixture, each against a plain version of it."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import DOCS
from pyspark.sql import functions as F
from test_decontaminate import words_of

from tablewise.llm import language
from tablewise.llm.pretokens import rank_table

LANGUAGES = {"en": "the of and to in that is was for with", "de": "der die und das nicht ein ist mit von zu"}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture():
    rng = random.Random(11)

    def text(lang, n):
        common = LANGUAGES[lang].split()
        letters = "aeiourstn" if lang == "en" else "äöüßkzch"
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))

    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append([3 * i, text(lang, rng.randint(80, 200)), lang])
    bench = [(i, text("en", rng.choice([5, 30]))) for i in range(6)]
    shared = text("en", 40)
    rows += [[1000, rows[4][1], "en"], [1001, rows[5][1].replace(" ", "  "), "en"], [1002, rows[7][1].rsplit(" ", 2)[0] + " changed end", "en"]]
    rows += [[1010 + i, f"{text('en', 60)} {shared} {text('en', 60)}", "en"] for i in range(5)]
    rows += [[1020 + i, f"{text('de', 60)} {bench[i][1].upper()} {text('de', 60)}", "de"] for i in range(6)]
    rows += [[1030, None, "en"], [1031, "", "en"], [1032, "12 34 !!", None], [1033, rows[4][1], "en"], [1033, rows[4][1], "en"], [None, text("en", 50), "en"]]
    rows += [[1040, text("de", 3000), "de"]]
    return [(i, t, lang, "src0", None if t is None else len(t)) for i, t, lang in rows], bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, bench = fixture()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def collected(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=str)


def smallest(i):
    return (i is not None, i or 0)


def brute_near(rows):
    """One row of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8: that of the smallest id."""
    rows = sorted({(r[0], r[1]): r for r in rows}.values(), key=lambda r: smallest(r[0]))
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r[1] or "")) for r in rows]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] == i]


def brute_cut(rows, length=100):
    seen, kept = set(), []
    for row in sorted(rows, key=lambda r: smallest(r[0])):
        data = (row[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        if not gone.any():
            kept.append(row)
        elif not gone.all():
            text = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
            kept.append((row[0], text, row[2], row[3], len(text)))
    return kept


def brute_clean(rows, bench, size=10):
    windows = {tuple(w[i : i + size]) for w in (words_of(t) for _, t in bench) for i in range(max(1, len(w) - size + 1)) if w}
    sizes, kept = {len(w) for w in windows}, []
    for row in rows:
        words = words_of(row[1])
        if not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1)):
            kept.append(row)
    return kept


def test_stages_equal_plain_versions(spark, folder):
    rows, bench = fixture()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]
    model = language.fit_language(language.training_sample(docs))
    predicted = language.predict_language(docs, model, "doc_id").collect()
    clear = {r.doc_id for r in predicted if r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert clear == {r[0] for r in rows} - {1030, 1031, 1032}

    found = functions["language_id"](spark, docs, folder)
    assert collected(found) == sorted([r for r in rows if r[0] in clear], key=str)
    kept = collected(found)

    found = functions["simhash_near_dedup"](spark, spark.createDataFrame(kept, DOCS), folder)
    assert collected(found) == sorted(brute_near(kept), key=str)
    kept = collected(found)
    assert {1000, 1001, 1033}.isdisjoint(r[0] for r in kept) and {1010, 1014}.issubset(r[0] for r in kept)

    found = functions["suffix_array_dedup"](spark, spark.createDataFrame(kept, DOCS), folder)
    assert collected(found) == sorted(brute_cut(kept), key=str)
    assert sum(len(r[1]) for r in collected(found)) < sum(len(r[1]) for r in kept)
    kept = collected(found)

    found = functions["benchmark_decontamination"](spark, spark.createDataFrame(kept, DOCS), folder)
    assert collected(found) == sorted(brute_clean(kept, bench), key=str)
    kept = collected(found)
    assert not {r[0] for r in kept} & set(range(1020, 1026)) and len(kept) > 50

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_table(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    wanted = []
    for row in kept:
        ids = library.encode_ordinary(row[1])
        wanted.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(row[1].encode()).hexdigest()))
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(wanted, key=str)


def test_stages_stand_clashing_names(spark, folder):
    names = ["_k1", "_k2", "_spans", "_K1_", "root", "node", "sig", "keeper", "n", "spans", "packed", "term", "window", "start"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clashing = docs.withColumns({c: F.concat(F.lit(c), F.lit("|"), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wanted = collected(stage(spark, docs, folder))
        found = stage(spark, clashing, folder)
        assert found.columns == clashing.columns and collected(found) == wanted, name
        assert all(r[c] == (None if r.doc_id is None else f"{c}|{r.doc_id}") for r in found.collect() for c in names), name
    assert corpus_pipeline.encode(spark, clashing, folder).count() == docs.count()


def test_stages_keep_columns_and_stand_empty_tables(spark, folder):
    empty = spark.createDataFrame([], DOCS).withColumns({c: F.lit(1) for c in ("_kept", "words", "list")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, empty, folder)
        assert found.columns == empty.columns and found.collect() == [], name
    assert corpus_pipeline.encode(spark, empty, folder).collect() == []
