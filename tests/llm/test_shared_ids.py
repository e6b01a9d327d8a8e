"""Repeated passages in rows that share a doc_id or have none."""

import hashlib
import random

import numpy as np
from helpers import docs_frame
from pyspark.sql import functions as F

from tablewise.llm import repeats
from tablewise.llm.common import row_key


def brute(keyed, length=100):
    """Per (_k1, _k2, text), in their order: bytes removed and digest of what stays."""
    seen, found = set(), {}
    for k1, k2, text in sorted(keyed, key=lambda r: r[:2]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        own = [data[i : i + length] for i in range(len(data) - length + 1)]
        for i, window in enumerate(own):
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        left = bytes(b for b, g in zip(data, gone) if not g)
        found[k1, k2] = (len(data), len(data) - len(left), hashlib.sha256(left).hexdigest())
    return found


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = fresh(100)
    texts = [fresh(150) + passage + fresh(90) for _ in range(3)]
    texts += [passage + fresh(400), fresh(500), fresh(40) + passage + fresh(200), fresh(30), None, passage + fresh(7), passage + fresh(300), texts[0]]
    ids = [None, None, None, 5, 5, 5, 5, 5, 9, None, None]
    docs = docs_frame(spark, texts, ids, clash=False).repartition(3)
    keyed = [tuple(r) for r in docs.select(*row_key(F.col("doc_id"), F.col("text")), "text").distinct().collect()]
    wanted = brute(keyed)
    assert sum(r[1] > 0 for r in wanted.values()) == 6
    found = repeats.repeat_report(docs).select("n_bytes", "n_removed", "kept_sha256").collect()
    copies = [wanted[k1, k2] for k1, k2, t in keyed for _ in range(2 if t == texts[0] else 1)]
    assert sorted(map(tuple, found)) == sorted(copies)
    cut = repeats.without_repeats(docs).collect()
    assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in cut) == sorted(r[2] for r in copies)
