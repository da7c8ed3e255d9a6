"""The corpus pipeline, stage by stage, against brute force on its own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tests.llm.test_operators import HARD, _brute, plain_targets

from marklane.llm import common
from marklane.llm.common import materialise
from marklane.llm.entry import tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    kept = materialise(corpus_pipeline.quality(spark, docs, SF))
    assert kept.columns == columns
    ids = {r["doc_id"] for r in kept.collect()}
    right = [(i in ids) == bool(q) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)

    one = materialise(corpus_pipeline.near_duplicates(spark, kept, SF))
    want = _brute([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(set(want.values()))

    mixed = materialise(corpus_pipeline.mixture(spark, one, SF))
    assert mixed.columns == columns
    sizes, most = Counter(), Counter()
    for r in one.collect():
        n = len(r["text"].encode().split())
        sizes[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    goal = plain_targets(list(sizes.items()))
    taken, whole, times = Counter(), {r["doc_id"]: r["text"] for r in one.collect()}, Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].encode().split())
        times[r["doc_id"]] += 1
        assert whole[r["doc_id"]] == r["text"] and r["n_chars"] == len(r["text"])
    assert all(abs(taken[s] - goal[s]) <= most[s] / 2 for s in goal) and max(times.values()) == 2

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = Counter(tuple(tok.encode(r["text"], add_special_tokens=False).ids) for r in mixed.collect())
    out = corpus_pipeline.tokens(spark, mixed, SF).collect()
    assert all(r["exact"] for r in out)
    assert Counter(tuple(np.frombuffer(r["ids"], "<u4").tolist()) for r in out) == texts


def test_tokens_keep_the_curriculum_order(spark):
    """Files and rows give the order of training back, whatever number of ranges it was written in."""
    from marklane.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    orders = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            mixed = materialise(corpus_pipeline.mixture(spark, docs, SF))
            assert len(mixed.inputFiles()) == int(n)
            out = corpus_pipeline.tokens(spark, mixed, SF).orderBy("file", "row").collect()
            ranked = mixing.numbered(mixing.schedule(mixing.mix(docs))).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(r["mix"]["rank"] for r in ranked) == list(range(len(ranked)))
        by_rank = sorted(ranked, key=lambda r: r["mix"]["rank"])
        assert [r["mix"]["position"] for r in by_rank] == sorted(r["mix"]["position"] for r in ranked)
        assert [r["doc_id"] for r in out] == [r["doc_id"] for r in by_rank]
        orders.append([r["doc_id"] for r in out])
    assert orders[0] == orders[1]


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows(spark):
    """Nulls, repeated rows and ids, unlike texts of one id, and columns named like those of the operators."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, words), (None, "a b c d e f g"), (50, words), (50, words), (50, "quite another text of six words"), (51, words + " more"), (52, None), (52, None)]
    docs = spark.createDataFrame([(i, t, "en", None if (i or 0) % 2 else "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("size", "target", "taken", "copy", "position", "copy_words", "_text", "_k", "_s", "_score", "mix", "fp", "group_id", "r", "s", "d")
    docs = docs.withColumns({c: F.lit("mine") for c in names})
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns
    assert kept.count((50, words)) == 1 and (50, "quite another text of six words") in kept and (None, "a b c d e f g") in kept
    assert (None, words) not in kept and all(i != 51 for i, _ in kept) and kept.count((52, None)) == 2
    for stage in (corpus_pipeline.quality, corpus_pipeline.mixture):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and all(r[c] == "mine" for r in got.collect() for c in names)
    coded = corpus_pipeline.tokens(spark, docs, SF).collect()
    assert len(coded) == len(rows) and all(r["exact"] for r in coded)


def test_batches_are_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * 10_000) for i in range(2_000)], "id long, text string").coalesce(1)
    sized = common.map_rows(rows, lambda: lambda batch: [pa.array([batch.num_rows] * batch.num_rows, pa.int64())], [common.field("n", T.LongType())])
    seen = [r["n"] for r in sized.select("id", "n").collect()]
    assert len(seen) == 2_000 and max(seen) * 10_000 < 2 * common.SLICE_BYTES
