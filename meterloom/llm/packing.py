"""Documents into containers of fixed capacity, measured in tokens of a public tokenizer.

Documents longer than a container are cut into full containers and a rest; every other document, and every rest, is one
item. Items are dealt into blocks by their place in a table, whatever their ids, so that a block holds about `block_items`
of them and at most twice as many. Each block is solved by a grouping genetic algorithm on several
islands: a genome is a set of containers, crossover injects another genome's well-filled containers whole, drops the own
containers that hold one of their items and puts the displaced items back by best fit. Between rounds the best genome of
every island moves to the next island of the block. What is left in a block's least filled containers is dealt anew, until
one block holds it all, so that unused room does not grow with the number of blocks.

The tokenizer's vocabulary file is read where the query is planned and travels to the workers.

Defined cases: a null or empty text has no tokens and comes out with a null container; equal texts are packed one by one;
rows with equal or null doc_id are packed one by one too; an empty table gives no rows; no item is ever split, dropped or put in twice.
"""

from __future__ import annotations

import base64
import hashlib
import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.session import checkpoint_dir

#: Splits text into the pieces that byte-level BPE merges within; fixed by the vocabulary file.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class PackParams:
    capacity: int = 4096
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    block_items: int = 2048
    islands: int = 2
    rounds: int = 3
    population: int = 8
    children: int = 60  # crossovers per island and round
    well_filled: float = 0.998
    task_states: int = 4  # islands that one task evolves
    open_bins: int = 2  # least filled containers of a block whose items are dealt anew
    seed: int = 17


# ---- the genetic algorithm, on one block; a genome is a list of containers, a container a list of item numbers


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], rooms: list[int], capacity: int) -> None:
    """Put items one by one into the fullest container that still has room; opens containers where none has."""
    order = sorted((r, i) for i, r in enumerate(rooms))
    for x in items:
        s = sizes[x]
        k = bisect_left(order, (s, -1))
        if k == len(order):
            bins.append([x])
            rooms.append(capacity - s)
            insort(order, (capacity - s, len(bins) - 1))
        else:
            r, i = order.pop(k)
            bins[i].append(x)
            rooms[i] = r - s
            if r > s:
                insort(order, (r - s, i))


def dominate(bins: list[list[int]], rooms: list[int], displaced: list[int], sizes: list[int]) -> list[int]:
    """Fill containers up by exchanging one item for a larger displaced one; returns what is displaced then."""
    out = sorted((sizes[i], i) for i in displaced)
    for k, x in enumerate(bins):
        room = rooms[k]
        while room and out:
            best, at, slot = 0, -1, -1
            for j, i in enumerate(x):
                s = sizes[i]
                q = bisect_left(out, (s + room + 1, -1)) - 1
                if q >= 0 and out[q][0] - s > best:
                    best, at, slot = out[q][0] - s, q, j
            if not best:
                break
            old, new = x[slot], out.pop(at)
            x[slot] = new[1]
            insort(out, (sizes[old], old))
            room -= best
        rooms[k] = room
    return [i for _, i in reversed(out)]


def fitness(rooms: list[int], capacity: int) -> float:
    """Mean squared fill: rewards full containers beside one that can be emptied."""
    f = 1.0 - np.array(rooms) / capacity
    return float((f * f).mean()) if len(f) else 1.0


Genome = tuple[list[list[int]], list[int]]  # containers, and the room that each has left


def with_rooms(bins: list[list[int]], sizes: list[int], p: PackParams) -> Genome:
    return bins, [p.capacity - sum(sizes[i] for i in x) for x in bins]


def crossover(a: Genome, b: Genome, sizes: list[int], p: PackParams, rnd: random.Random) -> Genome:
    """A child of a: some well-filled containers of b whole, a's containers without their items, the rest by best fit."""
    most = (1 - p.well_filled) * p.capacity
    good = [k for k, room in enumerate(b[1]) if room <= most] or list(range(len(b[0])))
    take = rnd.sample(good, max(1, len(good) // 2)) if len(good) > 1 else good
    child = [list(b[0][k]) for k in take]
    rooms = [b[1][k] for k in take]
    inside = {i for x in child for i in x}
    displaced: list[int] = []
    for x, room in zip(*a):
        if inside.isdisjoint(x):
            child.append(list(x))
            rooms.append(room)
        else:
            displaced += [i for i in x if i not in inside]
    # also empties a few of the worst containers, so that the displaced items have room to recombine
    worst = sorted(range(len(child)), key=lambda i: -rooms[i])[: 1 + len(child) // 50]
    for i in sorted(worst, reverse=True):
        displaced += child.pop(i)
        rooms.pop(i)
    displaced = dominate(child, rooms, displaced, sizes)
    best_fit(displaced, sizes, child, rooms, p.capacity)
    return child, rooms


def encode(bins: list[list[int]], n: int) -> bytes:
    at = np.zeros(n, np.uint32)
    for k, x in enumerate(bins):
        at[x] = k
    return at.tobytes()


def decode(data: bytes) -> list[list[int]]:
    at = np.frombuffer(data, np.uint32)
    bins: list[list[int]] = [[] for _ in range(int(at.max()) + 1)] if len(at) else []
    for i, k in enumerate(at.tolist()):
        bins[k].append(i)
    return [x for x in bins if x]


def evolve(sizes: list[int], genomes: list[bytes], p: PackParams, seed: int) -> tuple[list[bytes], float]:
    """One round on one island: the population, best first, and the best fitness."""
    rnd = random.Random(seed)
    n = len(sizes)
    pool: list[tuple[float, Genome]] = []
    for g in genomes:
        whole = with_rooms(decode(g), sizes, p)
        pool.append((fitness(whole[1], p.capacity), whole))
    while len(pool) < p.population:
        # decreasing order, loosened by a random factor that differs from genome to genome
        loose = 0.0 if not pool else rnd.choice((0.05, 0.2, 0.6))
        order = sorted(range(n), key=lambda i: -sizes[i] * (1 + loose * rnd.random()))
        bins, rooms = [], []
        best_fit(order, sizes, bins, rooms, p.capacity)
        pool.append((fitness(rooms, p.capacity), (bins, rooms)))
    for _ in range(p.children):
        a, b = rnd.sample(range(len(pool)), 2)
        child = crossover(pool[a][1], pool[b][1], sizes, p, rnd)
        f = fitness(child[1], p.capacity)
        worst = min(range(len(pool)), key=lambda i: pool[i][0])
        if f > pool[worst][0]:
            pool[worst] = (f, child)
    pool.sort(key=lambda x: -x[0])
    return [encode(bins, n) for _, (bins, _) in pool[: p.population]], pool[0][0]


# ---- on DataFrames


_ENCODINGS: dict[tuple[str, str], object] = {}


def _encoding(vocabulary: bytes, pattern: str):
    """The tokenizer of a vocabulary file; made once a process."""
    import tiktoken

    key = (hashlib.sha256(vocabulary).hexdigest(), pattern)
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def token_counts(documents: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """(doc_id, n_tokens) of the whole texts."""
    with open(params.tokenizer, "rb") as f:
        shipped = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shipped.value, params.pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


_ITEMS = "array<struct<doc_id:bigint,piece:int,size:int>>"
_STATE = f"block bigint, island int, items {_ITEMS}, genomes array<binary>, fitness double"


def _round(state: DataFrame, p: PackParams, number: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            genomes, fits = [], []
            for block, island, items, own in zip(*[b[c] for c in ("block", "island", "items", "genomes")]):
                sizes = items.values.field("size").to_pylist()
                seed = hash((p.seed, number, block.as_py(), island.as_py()))
                g, f = evolve(sizes, own.as_py() or [], p, seed)
                genomes.append(g)
                fits.append(f)
            yield pa.RecordBatch.from_arrays(
                [b["block"], b["island"], b["items"], pa.array(genomes, pa.list_(pa.binary())), pa.array(fits, pa.float64())],
                names=["block", "island", "items", "genomes", "fitness"],
            )

    return state.select("block", "island", "items", "genomes").mapInArrow(run, _STATE)


def _spread(state: DataFrame, n_tasks: int) -> DataFrame:
    """The islands of one block in different tasks. A fixed number of tasks: the rows are few and small, but each takes
    long, so tasks must not be merged by their size."""
    return state.repartition(n_tasks, "block", "island")


def _migrate(state: DataFrame, p: PackParams, n_tasks: int) -> DataFrame:
    """Every island keeps its own genomes and gets the best one of the island before it."""
    own = F.struct(F.col("island").alias("to"), F.col("items").alias("items"), F.col("genomes").alias("genomes"))
    next_island = F.pmod(F.col("island") + 1, F.lit(p.islands)).cast("int")
    guest = F.struct(next_island.alias("to"), F.lit(None).cast(_ITEMS).alias("items"), F.slice("genomes", 1, 1).alias("genomes"))
    moved = state.select("block", F.explode(F.array(own, guest)).alias("x")).select("block", F.col("x.to").alias("island"), "x.items", "x.genomes")
    return _spread(moved, n_tasks).groupBy("block", "island").agg(
        F.first("items", ignorenulls=True).alias("items"), F.flatten(F.collect_list("genomes")).alias("genomes")
    )


def solve_blocks(items: DataFrame, n_blocks: int, level: int, p: PackParams) -> DataFrame:
    """items(doc_id, piece, size) -> (doc_id, piece, size, block, bin, open): each block packed by its islands.

    items are read from a checkpoint, so that a row keeps its number.
    """
    dealt = items.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(n_blocks)))
    blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece", "size"))).alias("items"))
    islands = F.explode(F.sequence(F.lit(0), F.lit(p.islands - 1))).alias("island")
    state = blocks.select("block", islands, "items", F.lit(None).cast("array<binary>").alias("genomes"))
    n_tasks = max(1, -(-n_blocks * p.islands // p.task_states))
    state = _round(_spread(state, n_tasks), p, level * 1000)
    for r in range(1, p.rounds):
        state = _round(_migrate(state, p, n_tasks), p, level * 1000 + r)
    best = state.groupBy("block").agg(F.max_by(F.struct("items", F.element_at("genomes", 1).alias("genome")), F.struct("fitness", "island")).alias("b"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, items, genome in zip(b["block"].to_pylist(), b["items"], b["genome"].to_pylist()):
                rows = items.values
                sizes = rows.field("size").to_numpy(zero_copy_only=False)
                at = np.frombuffer(genome, np.uint32)
                fill = np.bincount(at, sizes, minlength=int(at.max()) + 1)
                worst = np.zeros(len(fill), bool)
                worst[np.argsort(fill, kind="stable")[: p.open_bins]] = True
                yield pa.RecordBatch.from_arrays(
                    [rows.field("doc_id"), rows.field("piece"), rows.field("size"), pa.array([block] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(worst[at])],
                    names=["doc_id", "piece", "size", "block", "bin", "open"],
                )

    return best.select("block", "b.items", "b.genome").mapInArrow(emit, "doc_id bigint, piece int, size int, block bigint, bin int, open boolean")


def pack(documents: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """(doc_id, piece, start, n_tokens, container): one row per document, or per piece of one longer than a container.

    start: first token of the piece in its document. container: unique name, null for documents without tokens.
    """
    p = params
    checkpoint_dir(documents.sparkSession)
    cap = F.lit(p.capacity)
    # tokenised once: the pieces are written to the checkpoint folder, a few bytes a document
    pieces = (
        token_counts(documents, p)
        .select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / cap) - 1).cast("int"))).alias("piece"))
        .select("doc_id", "piece", F.least(cap, F.col("n_tokens") - F.col("piece") * cap).cast("int").alias("size"))
        .checkpoint()
    )
    # numbered by place in the checkpoint, so that even rows without or with equal ids get containers of their own
    whole = pieces.withColumn("container", F.concat(F.lit("full-"), F.monotonically_increasing_id())).where(F.col("size") == cap)
    none = pieces.where("size = 0").withColumn("container", F.lit(None).cast("string"))
    done = [whole, none]
    items = pieces.where((F.col("size") > 0) & (F.col("size") < cap))
    n = items.count()
    level = 0
    while n:
        n_blocks = max(1, -(-n // p.block_items))
        solved = solve_blocks(items, n_blocks, level, p).checkpoint()
        solved = solved.withColumn("container", F.concat_ws("-", F.lit(f"l{level}"), "block", "bin"))
        left = solved.where("open").count() if n_blocks > 1 else 0
        # each level must halve what is left, or tiny items could go round for ever; blocks that don't are solved for good
        again = 0 < 2 * left <= n
        done.append((solved.where(~F.col("open")) if again else solved).select("doc_id", "piece", "size", "container"))
        if not again:
            break
        items, n, level = solved.where("open").select("doc_id", "piece", "size"), left, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", (F.col("piece").cast("bigint") * cap).alias("start"), F.col("size").alias("n_tokens"), "container")
