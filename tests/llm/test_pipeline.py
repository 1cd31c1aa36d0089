import hashlib
import zlib
from collections import Counter

import numpy as np
from oracle import SF_SMALL
from pyspark.sql import functions as F
from test_language_id import brute_predictions
from test_mixing import brute_copies
from test_ngram_join import brute as near_brute

import corpus_pipeline
from tonelake.llm import language_id, queries


def test_run_like_brute_force(spark):
    """All stages by definition."""
    import sentencepiece

    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    told = brute_predictions([(r.text, r.lang, zlib.crc32(str(r.doc_id).encode()) % 3 != 1) for r in rows])
    docs = [(r.doc_id, r.text, r.source) for r, (lang, score) in zip(rows, told, strict=True) if lang != "und" and score >= language_id.NOISE]
    first = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"), SF_SMALL)
    assert {(r.doc_id, r.lang) for r in first.collect()} == {(r.doc_id, lang) for r, (lang, score) in zip(rows, told, strict=True) if lang != "und" and score >= language_id.NOISE}
    last = {}
    for i, t, _ in docs:
        last[t] = max(last.get(t, i), i)
    docs = [d for d in docs if last[d[1]] == d[0]]
    near = near_brute([(i, t) for i, t, _ in docs], 5, 80)
    docs = [d for d in docs if near[d[0]][1] == d[0]]
    n = Counter(s for *_, s in docs)
    named = {s: w for s, w in queries.MIX_WEIGHTS.items() if s in n}
    raw = {s: named.get(s, (1 - sum(queries.MIX_WEIGHTS.values())) / (len(n) - len(named))) for s in n}
    means = {s: raw[s] / sum(raw.values()) * len(docs) / n[s] for s in n}
    copies = brute_copies([(i, s) for i, _, s in docs], means, corpus_pipeline.MIX_SEED)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    wanted = Counter()
    for i, t, s in docs:
        ids = library.encode(t, add_bos=True, add_eos=True)
        wanted[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += copies[i, s]
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == +wanted


def test_first_stage_follows_the_prototypes(spark, docs, monkeypatch):
    rows = docs([(i, "the and of to in that is was") for i in range(9)] + [(20, "zzz qqq xxx"), (21, "of the that")])
    usual = {(r.doc_id, r.lang) for r in corpus_pipeline.identify_language(spark, rows, SF_SMALL).collect()}
    assert (21, "en") in usual
    learned = language_id.fit(rows, F.lit(True))
    monkeypatch.setattr(language_id, "fit", lambda *_: {"xx": -learned["en"]})
    assert {(r.doc_id, r.lang) for r in corpus_pipeline.identify_language(spark, rows, SF_SMALL).collect()} != usual


def test_stages_keep_columns_and_take_odd_rows(spark, docs):
    odd = docs([(1, None), (2, ""), (3, "123"), (4, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "words without an id"), (6, "x " * 50_000), (7, "one two three four five six seven eight")])
    frame = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF_SMALL)
        assert frame.columns == odd.columns, name
        frame = spark.createDataFrame(frame.collect(), frame.schema)
    assert {r.doc_id for r in corpus_pipeline.encode(spark, frame, SF_SMALL).collect()} <= {4, 5, 6, 7, None}


def test_empty(spark, docs):
    frame = docs([])
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF_SMALL)
        assert frame.count() == 0
        if frame.columns[0] == "doc_id" and "text" not in frame.columns:
            break
