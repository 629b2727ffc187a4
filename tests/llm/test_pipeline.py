"""The pipeline against a plain version of each stage's rule."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
from graphloom.llm import pieces, quality

from .test_operators import corpus, plain_fingerprint, plain_secrets


def tables(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, t in rows if t and len(t) > 60 and i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def mixed(rows):
    """How often the mix takes each doc_id, by its rule: targets by resharing, rows in order of their keys, whole epochs and then a cut."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    names = sorted(set(source.values()))
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, left, free = {}, sum(total.values()), set(names)
    while over := [s for s in free if 3 * total[s] <= left * weight[s] / sum(weight[x] for x in free)]:
        for s in over:
            target[s] = 3 * total[s]
        free -= set(over)
        left -= sum(target[s] for s in over)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out = Counter()
    for s in names:
        budget = math.floor(target[s] + 0.5)
        epochs, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for i in sorted((i for i in size if source[i] == s), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()[:15]):
            cut = max(0, min(size[i], rest))
            rest -= cut
            if size[i]:
                out[i] += math.floor((epochs * size[i] + cut) / size[i] + 0.5)
    return +out


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = tables(spark, folder, corpus())
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, rows, folder), "stage")
        before, after = rows.collect(), out.collect()
        if name != "pieces":
            assert out.columns == docs.columns
        if name == "quality":
            accepted = {r.doc_id for r in quality.classify(rows, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id in accepted)
        if name == "near_duplicates":
            prints = {plain_fingerprint(r.text) for r in after}
            assert len(prints) == len(after)
            assert not any(0 < (p ^ q).bit_count() <= 4 for p in prints for q in prints)
        if name == "secrets":
            assert len(after) == len(before) and not any(plain_secrets(r.text or "") for r in after)
        if name == "mixing":
            assert Counter(r.doc_id for r in after) == mixed([tuple(r) for r in before])
        if name == "pieces":
            back = {r.doc_id: r.text for r in pieces.decode(out).collect()}
            assert back == {r.doc_id: r.text or "" for r in before} and len(after) == len(before)
        rows = out
    assert rows.count() == corpus_pipeline.run(spark, folder).count() > 0


def test_null_and_repeated_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = corpus()[:40]
    docs = tables(spark, folder, [*rows, rows[3], rows[3], (None, "a row without an id but with words enough"), (None, None)])
    names = {"n_tokens", "ids", "doc_id"}
    out = corpus_pipeline.run(spark, folder)
    assert names <= set(out.columns) and {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}


def test_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
