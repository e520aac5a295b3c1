import os
import random

import pytest
from pyspark.sql import functions as F

from meterloom.llm import packing

VOCAB = packing.PackParams().tokenizer
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file")


def fills(bins, sizes):
    return [sum(sizes[i] for i in x) for x in bins]


def test_operators_keep_every_item_once():
    rnd = random.Random(2)
    p = packing.PackParams()
    sizes = [rnd.randrange(1, 3000) for _ in range(300)] + [5] * 40
    a, b = [], []
    for order, bins in ((sorted(range(len(sizes)), key=lambda i: -sizes[i]), a), (list(range(len(sizes))), b)):
        rooms = []
        packing.best_fit(order, sizes, bins, rooms, p.capacity)
        assert rooms == [p.capacity - f for f in fills(bins, sizes)]
    child, rooms = packing.crossover(packing.with_rooms(a, sizes, p), packing.with_rooms(b, sizes, p), sizes, p, rnd)
    assert sorted(i for x in child for i in x) == list(range(len(sizes)))
    assert max(fills(child, sizes)) <= p.capacity and rooms == [p.capacity - f for f in fills(child, sizes)]
    assert sorted(map(sorted, packing.decode(packing.encode(child, len(sizes))))) == sorted(map(sorted, child))


def test_evolution_beats_plain_best_fit():
    rnd = random.Random(5)
    p = packing.PackParams()
    sizes = [int(min(4095, max(200, rnd.lognormvariate(6.5, 0.7)))) for _ in range(1000)]
    bins, rooms = [], []
    packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, bins, rooms, p.capacity)
    genomes, f = packing.evolve(sizes, [], p, 1)
    best = packing.decode(genomes[0])
    assert f >= packing.fitness(rooms, p.capacity) and len(best) <= len(bins)
    assert len(best) <= -(-sum(sizes) // p.capacity) + 2
    assert sorted(i for x in best for i in x) == list(range(len(sizes)))
    assert packing.evolve(sizes, genomes, p, 2)[1] >= f


@needs_vocab
@pytest.mark.parametrize("block_items", [2048, 40])
def test_pack(spark, block_items):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(5, 900))), "x") for i in range(150)]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "word " * 9000, "x"), (1003, "same text", "x"), (1004, "same text", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, size string")
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    rows = packing.pack(df, packing.PackParams(block_items=block_items, children=10)).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            by_bin[r.container] = by_bin.get(r.container, 0) + r.n_tokens
    assert set(by_doc) == {d[0] for d in docs}
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert sum(r.n_tokens for r in parts) == sizes[d]
        assert [r.start for r in parts] == [4096 * r.piece for r in parts] and [r.piece for r in parts] == list(range(len(parts)))
        assert len(parts) == max(1, -(-sizes[d] // 4096))
    assert max(by_bin.values()) <= 4096
    assert by_doc[1000][0].container is None and by_doc[1001][0].container is None
    least = -(-sum(sizes.values()) // 4096)
    assert len(by_bin) <= least + 3


@needs_vocab
def test_equal_and_null_ids(spark):
    df = spark.createDataFrame([(1, "word " * 5000), (1, "word " * 5000), (None, "word " * 5000), (None, "word " * 5000), (None, "a"), (1, "a")], "doc_id bigint, text string")
    rows = packing.pack(df).collect()
    fill = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    n = sum(r.n_tokens for r in packing.token_counts(df).collect())
    assert sum(fill.values()) == n and max(fill.values()) <= 4096


def test_blocks_are_even_whatever_the_ids(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), F.lit(100).alias("size")).repartition(4)
    p = packing.PackParams(block_items=2000, children=1, population=2, rounds=1, islands=1)
    sizes = [r["count"] for r in packing.solve_blocks(rows, 10, 0, p).groupBy("block").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 10 and max(sizes) < 2300


@needs_vocab
def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@needs_vocab
def test_tokens_agree_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    import base64

    import tiktoken

    with open(VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = tokenizers.Tokenizer.from_file(VOCAB.replace(".tiktoken", ".json"))
    for t in ("Hello, world! It's 12 o'clock.", "naïve café – 日本語  \n\n x", "a" * 500, " "):
        assert enc.encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids
