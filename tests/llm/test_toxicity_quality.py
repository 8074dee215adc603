"""Toxicity on documents it has not learned from, and its scores and spans beside plain loops."""

import re
from itertools import product

import numpy as np

from barframe.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_recall_and_precision(spark):
    """Each asked for by itself: a scorer that calls all documents clean finds none of the toxic ones."""
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in queries.op4_toxicity(spark, SF).select("doc_id", "held_out", "predicted").collect() if r["held_out"] and r["doc_id"] in toxic]
    pairs = [(toxic[r["doc_id"]], r["predicted"]) for r in held]
    found, missed = pairs.count((1, 1)), pairs.count((1, 0))
    wrong, left_alone = pairs.count((0, 1)), pairs.count((0, 0))
    assert found + missed >= 90
    assert found >= 0.88 * (found + missed)
    assert found >= 0.85 * (found + wrong)
    assert wrong <= 0.02 * (wrong + left_alone)
    # far fewer errors than calling all clean makes
    assert 4 * (missed + wrong) <= found + missed


def test_scores_and_spans_by_plain_loops(spark):
    """Every document beside a count over all tag sequences, a product over its top tokens and a walk over its words."""
    rng = np.random.default_rng(5)
    field = toxicity.Field(rng.normal(scale=1.5, size=1 << toxicity.BITS).astype(np.float32), rng.normal(size=(2, 2)))
    words = ["ab", "Cde,", "fghij.", "ÄB", "x1y", "zz--", "42"]
    texts = [" ".join(rng.choice(words, size=n)) for n in (1, 2, 3, 5, 6, 7)] + ["", "12 34", None]
    rows = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["row"]["doc_id"]] or ""
        found = [(m.start(), m.end(), m.group()) for m in re.finditer("[a-zA-Z\x80-\U0010ffff]+", text)]
        lowered = [w.encode().lower() for _, _, w in found]
        total = np.zeros((len(found), 2))
        for tags in product((0, 1), repeat=len(found)):
            energy = sum(np.log(field.own(w)) * t for w, t in zip(lowered, tags)) + sum(field.trans[a, b] for a, b in zip(tags, tags[1:]))
            for k, t in enumerate(tags):
                total[k, t] += np.exp(energy)
        chances = [float(b / (a + b)) for a, b in total]
        clean = 1.0
        for c in sorted(chances)[-toxicity.TOP :]:
            clean *= 1 - c
        assert abs(row["score"] - (1 - clean)) < 1e-6
        runs, before = [], False
        for (a, b, _), c in zip(found, chances):
            if c >= 0.5:
                runs = [*runs[:-1], (runs[-1][0], b)] if before else [*runs, (a, b)]
            before = c >= 0.5
        assert [tuple(s) for s in row["spans"]] == runs
