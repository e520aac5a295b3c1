"""Test items that leaked into a corpus: which document carries a passage of which item.

The items form a small inverted index over word triples with BM25 weights, its postings cut into blocks of item numbers
with the greatest weight of each block. Every passage (a window of words) of every document is a query: windows for which
no block can reach the threshold are dropped by one vectorised upper bound, the others go through block-max WAND, and each
item retrieved is verified by aligning the words around each run of triples it shares with the document with its passage,
and by the overlap with its question and answer.

A document leaks an item if a stretch of at least `min_words` successive words of the passage is there, a few of them
replaced, dropped or added. Edits at the ends of a stretch hide its ends, so what must be seen is `min_words` less `few`
agreeing words, of which `edit_share` may be edited; where the document also holds the answer and most of the words that
are the question's own, `doubtful_share` may. Introduction and question are no evidence by themselves, nor is wording that
several items share: words in runs of `shared_run` words that stand in another item too do not count. Texts are taken
whole, with transfer encoding and markup undone, as lower-case words.

More items than `max_items` are searched in several passes over the documents, what items share being found over all of
them; every pass holds one index.

Defined cases: null or empty texts leak nothing; repeated documents are each reported; items without text or with a
passage shorter than three words never match; items with equal passages are each reported and share nothing with each
other; an empty table on either side gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm import mail
from meterloom.session import kept

WORD = re.compile(r"[^\W_]+")
_LIST_MARK = re.compile(r"(?m)^([\s>|*+-]*)\(?[0-9]{1,2}[.)](?=\s)")
#: Three word numbers below this fit 63 bits.
MAX_WORDS = 1 << 21


@dataclass(frozen=True)
class LeakParams:
    window: int = 32  # words of a passage taken as one query
    stride: int = 16
    block_items: int = 16
    k1: float = 1.2
    b: float = 0.3
    min_score: float = 2.2  # in weights of a triple that one item alone has
    min_words: int = 15
    few: int = 3  # edits that the shortest stretch may have, wherever they are
    edit_share: float = 0.22
    doubtful_share: float = 0.34  # if question and answer are there too
    question_share: float = 0.6  # of the question's own words
    shared_run: int = 8  # successive words that no two items have in common by accident
    max_items: int = 20_000  # in one index


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def normal_words(message: str) -> list[str]:
    return words_of(_LIST_MARK.sub(r"\1", mail.readable(message)))


def split_item(text: str) -> tuple[str, str]:
    """Passage and question: all paragraphs but the introduction, and the last one."""
    parts = [p for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]
    if len(parts) < 3:
        return text, ""
    return "\n".join(parts[1:-1]), parts[-1]


def run_codes(words: list[str], n: int) -> list[int]:
    """A 64-bit hash of every run of n words."""
    return [int.from_bytes(hashlib.blake2b("\n".join(words[i : i + n]).encode(), digest_size=8).digest(), "big", signed=True) for i in range(len(words) - n + 1)]


def class_code(passage: list[str]) -> int:
    """The same for items with equal passages."""
    return run_codes(passage, len(passage))[0] if passage else 0


def shared_runs(items: list[tuple[int, str, str | None]], n: int) -> set[int]:
    """Hashes of the runs of n words that stand in items with different passages."""
    first: dict[int, int] = {}
    out: set[int] = set()
    for _, text, _ in items:
        of = class_code(words_of(split_item(text)[0]))
        for code in run_codes(words_of(text), n):
            if first.setdefault(code, of) != of:
                out.add(code)
    return out


class TooManyWords(ValueError):
    """An index can't number the different words of its items."""


class ItemIndex:
    """BM25 over word triples with block maxima. Immutable after construction; small enough to be shipped in a closure."""

    def __init__(self, items: list[tuple[int, str, str | None]], p: LeakParams, shared: set[int] | None = None):
        self.p = p
        self.ids = [i for i, _, _ in items]
        split = [split_item(t) for _, t, _ in items]
        self.passages = [words_of(a) for a, _ in split]
        questions = [set(words_of(q)) for _, q in split]
        asked = Counter(w for q in questions for w in q)
        # what many questions say is not a question's own
        self.questions = [{w for w in q if asked[w] <= max(1, len(items) // 20)} for q in questions]
        self.answers = [words_of(a or "") for _, _, a in items]
        shared = shared_runs(items, p.shared_run) if shared is None else shared
        # per passage, how many of the words before each place count as evidence
        self.own = [self._own_before(x, shared, p.shared_run) for x in self.passages]
        vocabulary = sorted({w for x in self.passages for w in x})
        self.word_no = {w: i for i, w in enumerate(vocabulary)}
        self.base = len(vocabulary) + 1
        if self.base > MAX_WORDS:
            raise TooManyWords
        places: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, x in enumerate(self.passages):
            no = [self.word_no[w] for w in x]
            for j in range(len(no) - 2):
                places[(no[j] * self.base + no[j + 1]) * self.base + no[j + 2]][k].append(j)
        self.codes = np.array(sorted(places), np.int64)
        n = len(items)
        mean = max(1.0, sum(map(len, self.passages)) / max(1, n))
        self.postings: list[list[tuple[int, float, list[int]]]] = []  # per term: item, weight, places; by item
        for c in self.codes.tolist():
            of = places[c]
            idf = math.log(1 + (n - len(of) + 0.5) / (len(of) + 0.5))
            row = []
            for k in sorted(of):
                tf = len(of[k])
                row.append((k, idf * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(self.passages[k]) / mean)), of[k]))
            self.postings.append(row)
        self.threshold = p.min_score * math.log(1 + (n - 0.5) / 1.5)
        self.blocks = max(1, -(-n // p.block_items))
        # block maxima as flat arrays: term -> slice of (block, weight)
        starts, block_no, block_max = [0], [], []
        for row in self.postings:
            best: dict[int, float] = {}
            for k, w, _ in row:
                best[k // p.block_items] = max(w, best.get(k // p.block_items, 0.0))
            block_no += best.keys()
            block_max += best.values()
            starts.append(len(block_no))
        self.block_starts = np.array(starts, np.int64)
        self.block_no = np.array(block_no, np.int64)
        self.block_max = np.array(block_max)
        self.block_list, self.block_top = [int(x) for x in block_no], [float(x) for x in block_max]
        self.term_max = np.array([max((w for _, w, _ in row), default=0.0) for row in self.postings])

    @staticmethod
    def _own_before(passage: list[str], shared: set[int], n: int) -> list[int]:
        own = np.ones(len(passage), bool)
        for j, code in enumerate(run_codes(passage, n)) if shared else ():
            if code in shared:
                own[j : j + n] = False
        return np.r_[0, np.cumsum(own)].tolist()

    def terms(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place, term) of every triple of words that the index knows."""
        none = np.zeros(0, np.int64)
        if len(words) < 3 or not len(self.codes):
            return none, none
        get = self.word_no.get
        no = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero((no[:-2] >= 0) & (no[1:-1] >= 0) & (no[2:] >= 0))
        code = (no[at] * self.base + no[at + 1]) * self.base + no[at + 2]
        term = np.searchsorted(self.codes, code)
        term[term == len(self.codes)] = 0
        hit = self.codes[term] == code
        return at[hit], term[hit]

    def open_windows(self, at: np.ndarray, term: np.ndarray) -> list[int]:
        """Windows in which some block of items may reach the threshold, by the sums of block maxima."""
        p = self.p
        lengths = self.block_starts[term + 1] - self.block_starts[term]
        entry = np.repeat(self.block_starts[term] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        first = np.repeat(at // p.stride, lengths)
        spans = p.window // p.stride
        out: set[int] = set()
        cell = np.concatenate([(first - s) * self.blocks + self.block_no[entry] for s in range(spans)])
        weight = np.tile(self.block_max[entry], spans)
        keep = cell >= 0
        cells, where = np.unique(cell[keep], return_inverse=True)
        sums = np.bincount(where, weight[keep]) if len(cells) else np.zeros(0)
        out.update((cells[sums >= self.threshold] // self.blocks).tolist())
        return sorted(out)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose BM25 score over `terms` reaches the threshold, by block-max WAND."""
        counts: dict[int, int] = defaultdict(int)
        for t in terms:
            counts[t] += 1
        size = self.p.block_items
        lists = []
        # terms of one item only, which nearly all are, make one list an item
        alone: dict[int, float] = defaultdict(float)
        for t, c in counts.items():
            row = self.postings[t]
            if len(row) == 1:
                alone[row[0][0]] += row[0][1] * c
            else:
                lists.append([row, 0, float(self.term_max[t]) * c, t, c])
        lists += [[[(k, w)], 0, w, -1, 1] for k, w in alone.items()]
        found = []
        while True:
            lists = [x for x in lists if x[1] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[2]
                if bound >= self.threshold:
                    pivot = x[0][x[1]][0]
                    while i + 1 < len(lists) and lists[i + 1][0][lists[i + 1][1]][0] == pivot:
                        i += 1
                    break
            if pivot < 0:
                return found
            block = pivot // size
            in_block = sum(self._block_max(x[3], block) * x[4] if x[3] >= 0 else x[2] if x[0][0][0] // size == block else 0.0 for x in lists[: i + 1])
            if in_block < self.threshold:
                # nothing in this block for these lists: on to the next block, or to the next list's item if nearer
                to = (block + 1) * size
                if i + 1 < len(lists):
                    to = min(to, lists[i + 1][0][lists[i + 1][1]][0])
                to = max(to, pivot + 1)
                for x in lists[: i + 1]:
                    self._advance(x, to)
                continue
            if lists[0][0][lists[0][1]][0] == pivot:
                score = sum(x[0][x[1]][1] * x[4] for x in lists[: i + 1] if x[0][x[1]][0] == pivot)
                if score >= self.threshold:
                    found.append((pivot, score))
                for x in lists[: i + 1]:
                    self._advance(x, pivot + 1)
            else:
                for x in lists[: i + 1]:
                    self._advance(x, pivot)

    def _block_max(self, term: int, block: int) -> float:
        s, e = int(self.block_starts[term]), int(self.block_starts[term + 1])
        i = bisect_left(self.block_list, block, s, e)
        return self.block_top[i] if i < e and self.block_list[i] == block else 0.0

    @staticmethod
    def _advance(x: list, to: int) -> None:
        x[1] = bisect_left(x[0], to, x[1], key=lambda r: r[0])

    def search(self, words: list[str]) -> list[tuple[int, float, int, int, float, bool]]:
        """(item number, best score, words of its passage found, edits, share of its question, answer seen) for a document's words."""
        p = self.p
        at, term = self.terms(words)
        if not len(at) or float(self.term_max[term].sum()) < self.threshold:
            return []
        best: dict[int, float] = {}
        for w in self.open_windows(at, term):
            lo, hi = np.searchsorted(at, [w * p.stride, w * p.stride + p.window])
            for k, score in self.wand(term[lo:hi].tolist()):
                best[k] = max(score, best.get(k, 0.0))
        out = []
        if best:
            pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for a, t in zip(at.tolist(), term.tolist()):
                for k, _, places in self.postings[t]:
                    if k in best:
                        pairs[k] += [(a, j) for j in places]
            seen, joined = set(words), f" {' '.join(words)} "
            for k, score in best.items():
                q, answer = self.questions[k], self.answers[k]
                asked = len(q & seen) / len(q) if q else 0.0
                answered = bool(answer) and f" {' '.join(answer)} " in joined
                places = sorted(pairs[k])
                stretch = self.verify(words, k, places, p.edit_share)
                if not stretch and answered and asked >= p.question_share:
                    stretch = self.verify(words, k, places, p.doubtful_share)
                if stretch:
                    out.append((k, score, *stretch, asked, answered))
        return out

    def verify(self, words: list[str], k: int, pairs: list[tuple[int, int]], share: float) -> tuple[int, int] | None:
        """The longest stretch of item k's passage in the document: (words of the passage, edits), or None.

        A stretch always holds three words in a row without an edit, so every unbroken run of shared triples is taken as the
        core of a stretch and aligned outwards on both sides, edits counted word by word. A stretch ends before words of
        which more are edited than agree. Edits and words that other items share leave at least min_words - few.
        """
        p, passage, own = self.p, self.passages[k], self.own[k]
        seen = p.min_words - p.few
        best: tuple[int, int] | None = None
        places = sorted(a for a, _ in pairs)
        # an edit breaks three triples at most
        least = min((s - 2 - 3 * int(share * s) for s in range(seen, len(passage) + 1)), default=len(pairs) + 1)
        for a, j, n in sorted(self._runs(pairs), key=lambda r: -r[2]):
            if best and best[0] - best[1] >= len(passage):
                break
            most = int(share * len(passage))
            if share < 0.33:
                # so the triples within reach, by place and by shift, bound the words of a stretch and its edits
                far = len(passage) + most
                if bisect_right(places, a + n + far) - bisect_left(places, a - far) < least:
                    continue
                shared = sum(-far <= x - a <= n + far and abs(x - y - a + j) <= most for x, y in pairs)
                if shared < least:
                    continue
                most = min(most, int(share * (shared + 6) / (1 - 3 * share)))
            right = self._reach(words, passage, a + n, j + n, 1, most)
            # what the right side leaves of the edits allowed
            spare = max(share * (n + after) - y for y, after in right)
            left = self._reach(words, passage, a - 1, j - 1, -1, min(most, int(spare + share * j)))
            for x, before in left:
                for y, after in right:
                    span, edits = before + n + after, x + y
                    if edits <= share * span and own[j + n + after] - own[j - before] - edits >= seen:
                        if best is None or (span - edits, -edits) > (best[0] - best[1], -best[1]):
                            best = (span, edits)
        return best

    @staticmethod
    def _runs(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(a, j, words) of every unbroken run of shared triples."""
        out, last = [], None
        for d, a in sorted((a - j, a) for a, j in pairs):
            if last and last[0] == d and last[1] + last[2] - 2 == a:
                last[2] += 1
            else:
                last = [d, a, 3]
                out.append(last)
        return [(a, a - d, n) for d, a, n in out]

    @staticmethod
    def _reach(words: list[str], passage: list[str], a: int, j: int, step: int, most: int) -> list[tuple[int, int]]:
        """(edits, words of the passage) of the ends that a stretch may have from (a, j) in direction `step`.

        Furthest-reaching points per shift between document and passage, one edit more each round. An end is an agreeing word
        up to which no more words are edited than agree, from wherever one counts.
        """
        rows = len(words) - a if step > 0 else a + 1
        cols = len(passage) - j if step > 0 else j + 1
        # by shift, how many words of the passage lie behind the furthest point; -2 where there is none
        mid, none = most + 1, [-2] * (2 * most + 3)
        far = none
        out: list[tuple[int, int]] = [(0, 0)]
        top = gain = 0
        for e in range(most + 1):
            now = none.copy()
            ends = []
            for d in range(-e, e + 1):
                i = mid + d
                x = max(far[i] + 1, far[i - 1], far[i + 1] + 1) if e else 0
                last = min(cols, rows - d)
                if x > last:
                    x = last
                if x < 0 or x + d < 0:
                    continue
                while x < last and words[a + step * (x + d)] == passage[j + step * x]:
                    x += 1
                now[i] = x
                # points behind the last round's cost one edit less
                y, old = x, max(top, far[i], -d)
                while y > old and words[a + step * (y - 1 + d)] != passage[j + step * (y - 1)]:
                    y -= 1
                if y > old and max(y, y + d) - 2 * e >= gain:
                    ends.append((y, max(y, y + d) - 2 * e))
            far = now
            if ends:
                top = max(ends)[0]
                gain = max(g for _, g in ends)
                out.append((e, top))
            if top == cols:
                break
        return out


def _known(items: DataFrame) -> DataFrame:
    return items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text", "answer")


def shared_runs_of(items: DataFrame, n: int) -> DataFrame:
    """(run): `shared_runs` of a table of items of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b["text"].to_pylist():
                codes = run_codes(words_of(text), n)
                of = class_code(words_of(split_item(text)[0]))
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array([of] * len(codes), pa.int64())], names=["run", "of"])

    return items.select("text").mapInArrow(run, "run bigint, of bigint").groupBy("run").agg(F.min("of").alias("a"), F.max("of").alias("b")).where("a <> b").select("run")


_SCHEMA = "doc_id bigint, item_id bigint, score double, words int, edits int, question_share double, answer_seen boolean"


def find_leaks(documents: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, score, words, edits, question_share, answer_seen): every leak, one row per document and item."""
    p = params
    items = _known(items)
    head = items.limit(p.max_items + 1).collect()
    if len(head) <= p.max_items:
        return _search(documents, [(r.item_id, r.text, r.answer) for r in head], p, None)
    # several indexes, one after the other; what items share is known for all of them
    shares = -(-items.count() // p.max_items) + 1
    dealt = items.withColumn("_share", F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)))
    shared = kept(shared_runs_of(items, p.shared_run), "shared-runs")
    out = documents.sparkSession.createDataFrame([], _SCHEMA)
    for k in range(shares):
        mine = dealt.where(F.col("_share") == k)
        rows = [(r.item_id, r.text, r.answer) for r in mine.collect()]
        if rows:
            runs = {r.run for r in shared_runs_in(mine, shared, p.shared_run).collect()}
            out = out.unionByName(kept(_search(documents, rows, p, runs), "leaks"))
    return out


def shared_runs_in(items: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """The shared runs that stand in these items; no more than they have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(run_codes(words_of(text), n), pa.int64())], names=["run"])

    return items.select("text").mapInArrow(run, "run bigint").distinct().join(shared, "run")


def _search(documents: DataFrame, items: list[tuple[int, str, str | None]], p: LeakParams, shared: set[int] | None) -> DataFrame:
    items = sorted(items, key=lambda r: (r[0], r[1]))
    try:
        index = ItemIndex(items, p, shared)
    except TooManyWords:
        half = len(items) // 2
        shared = shared_runs(items, p.shared_run) if shared is None else shared
        return _search(documents, items[:half], p, shared).unionByName(_search(documents, items[half:], p, shared))
    held = documents.sparkSession.sparkContext.broadcast(index)
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for k, *found in ix.search(normal_words(text.as_py() or "")):
                    rows.append((doc_id, ix.ids[k], *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
