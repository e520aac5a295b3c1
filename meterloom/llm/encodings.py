"""Text decoded with the wrong encoding: which messages hold some, and what stood there.

A noisy-channel model over words that hold characters beyond ASCII. The source model is the corpus itself: on how many
different lines a word stands, and how often a character occurs. The channel is a decoder that took bytes of one encoding
for another, or lost some. Each word is laid out as a lattice over its bytes: an edge keeps a character, or reads the bytes
of two to four neighbours as one character of UTF-8, or is a wildcard where bytes were lost (U+FFFD, controls, lead bytes
whose rest is gone). A Viterbi search under the character counts gives the likeliest path without and with wildcards; it is
repeated on its own result, which undoes repeated damage. Every proposed reading is then scored under the corpus's word
frequencies: a reading's gain in characters and in frequency together must outweigh the word as it stands, and wildcards
take the most frequent word that fits. Confusions between one-byte encodings, a lattice of one edge a byte, look like text
and need a reading that the corpus holds far more often than the word.

Statistics cover every word of every document and count different lines, quote marks apart, so that copies and quotes do
not make a word likelier; characters that can be read as UTF-8 are left out of the character counts. Documents are read
once for their words, which are kept in the shared folder. Words are judged once each, not once per document, spread over
as many tasks as their number asks for; only the character table (at most one row per code point) is collected.

A lone character counts as damage where the corpus has a reading of it in the same surroundings in a hundred times as many
messages, so one that stands alone for good reason, but hardly ever, may be taken for damage.

Defined cases: null or empty texts hold no damage; repeated documents are each found; a message whose damage can't be
undone is still found, and its text stays; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm import mail
from meterloom.session import kept

LOST = "�"
WORD = re.compile("(?<![A-Za-z])[A-Za-z]*+(?:[^\x00-\x7f\xa0  　]\xa0?[A-Za-z]*)+")
#: A lone character beyond ASCII and what follows it: a digit, a blank, another ASCII character but a letter, a line's end.
SYMBOL = re.compile("(?<![A-Za-z\x80-\U0010ffff])([^\x00-\x7f\xa0\u2028\u2029\u3000\ufffd])(?![A-Za-z\x80-\U0010ffff])(.?)")
QUOTE = re.compile(r"^[\s>|]+")
#: Encodings that bytes may have been taken for, and encodings they may have been in.
TAKEN_FOR = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp1253", "cp1254", "cp1257", "koi8_r", "cp866", "cp852", "iso8859_2", "iso8859_5")
WERE_IN = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp1253", "iso8859_2", "cp866", "cp852")
C1 = re.compile("[\x80-\x84\x86-\x9f]")


#: Leads of two- and three-byte sequences that are common in texts, and their bytes.
LEADS = {"Ã": 0xC3, "Ä": 0xC4, "Å": 0xC5, "â": 0xE2}


@dataclass(frozen=True)
class EncodingParams:
    gain: float = 4.0  # log-likelihood, of characters and word frequency together, by which a UTF-8 reading must be better
    seen: int = 3  # different lines that must hold a character before it is offered as a reading
    slack: float = 6.0  # log-likelihood by which a one-byte reading may fall behind before word counts are asked
    word_lines: int = 5  # different lines that must hold a one-byte reading
    ratio: float = 4.0  # and how many times more than the word as it stands
    sure: float = 6.0  # or log-likelihood, as for UTF-8, that makes one line enough
    symbol_ratio: float = 100.0  # the same for a lone character, in messages
    never: float = -30.0  # log-likelihood of a character that no source writes
    lost: float = -8.0  # and of a wildcard
    task_words: int = 1_000  # words that one task judges
    shipped_fixes: int = 200_000  # fixes up to which every worker holds them while texts are restored


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes that the encoding leaves undefined come out as C1 controls."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


def _chars_of(encoding: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            pass
    return out


class Channel:
    """Readings of a word under the corpus's character counts."""

    def __init__(self, counts: dict[str, int], p: EncodingParams):
        self.p = p
        self.counts = counts
        total = sum(counts.values()) + 1.0
        self.logs = {c: math.log((n + 0.5) / total) for c, n in counts.items()}
        self.unseen = math.log(0.5 / total)
        self.to_bytes = {e: _bytes_of(e) for e in TAKEN_FOR}
        # one-byte confusions as character maps, each distinct map once
        maps: dict[tuple, dict[int, str]] = {}
        for e in TAKEN_FOR:
            for w in WERE_IN:
                if e != w:
                    right = _chars_of(w)
                    m = {ord(c): right[b] for c, b in self.to_bytes[e].items() if b in right}
                    maps.setdefault(tuple(sorted(m.items())), m)
        self.maps = list(maps.values())

    def log(self, word: str) -> float:
        return sum(self._char(c) for c in word if c > "\x7f")

    def _char(self, c: str) -> float:
        return self.p.never if c == LOST or C1.match(c) else self.logs.get(c, self.unseen)

    def _decoded(self, word: str, i: int, table: dict[str, int]) -> tuple[str, int] | None:
        """The UTF-8 character whose bytes start at i, and how many characters it takes."""
        b = table.get(word[i])
        if b is None or not 0xC2 <= b <= 0xF4:
            return None
        k = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        if i + k > len(word):
            return None
        data = [b]
        for c in word[i + 1 : i + k]:
            x = table.get(c, 0)
            if not 0x80 <= x <= 0xBF:
                return None
            data.append(x)
        try:
            return bytes(data).decode(), k
        except UnicodeDecodeError:
            return None

    def edges(self, word: str, i: int, table: dict[str, int]) -> list[tuple[int, str, float, bool]]:
        """(end, text, log-likelihood, wildcard) of the lattice's edges from character i of a word."""
        c = word[i]
        if c <= "\x7f":
            return [(i + 1, c, 0.0, False)]
        out = [(i + 1, c, self._char(c), False)]
        if c == LOST:
            end = i
            while end < len(word) and word[end] == LOST:
                end += 1
            return [*out, (end, "*", self.p.lost, True)]
        d = self._decoded(word, i, table)
        if d and (self.counts.get(d[0], 0) >= self.p.seen or d[0] in table or d[0] == "\ufeff"):
            out.append((i + d[1], d[0], self._char(d[0]) if d[0] > "\x7f" else 0.0, False))
        if C1.match(c) or (not d and c in LEADS and table.get(c) == LEADS[c]):
            out.append((i + 1, "*", self.p.lost, True))
        return out

    def viterbi(self, word: str, table: dict[str, int]) -> list[tuple[str, float]]:
        """The best path through the lattice of one word and one encoding, without wildcards and with some."""
        n = len(word)
        best = [[-math.inf] * 2 for _ in range(n + 1)]
        back: list[list[tuple[int, int, str]]] = [[(0, 0, "")] * 2 for _ in range(n + 1)]
        best[0][0] = 0.0
        for i in range(n):
            if best[i][0] == best[i][1] == -math.inf:
                continue
            for end, text, logp, wild in self.edges(word, i, table):
                for state in (0, 1):
                    score, to = best[i][state] + logp, int(wild or state)
                    if score > best[end][to]:
                        best[end][to], back[end][to] = score, (i, state, text)
        paths = []
        for state in (0, 1):
            out: list[str] = []
            i, s = n, state
            while i:
                i, s, text = back[i][s]
                out.append(text)
            paths.append(("".join(reversed(out)) if best[n][state] > -math.inf else "", best[n][state]))
        return paths

    def utf8_reading(self, word: str, least: float | None = None) -> tuple[str, float] | None:
        """The word with UTF-8 damage undone, as often as it was done, and what its characters gain; or None."""
        least = self.p.gain if least is None else least
        start = score = self.log(word)
        now = word
        while True:
            # every pass makes the word shorter
            top, top_score = now, score
            for table in self.to_bytes.values():
                # without an edge that reads UTF-8 the word as it stands is the only path
                if not any(c > "\x7f" and self._decoded(now, i, table) for i, c in enumerate(now)):
                    continue
                w, s = self.viterbi(now, table)[0]
                if w != now and s > top_score:
                    top, top_score = w, s
            if top == now or top_score < score + (least if now == word else 0.5):
                return (now, score - start) if now != word else None
            now, score = top, top_score

    def patterns(self, word: str) -> list[str]:
        """The word with a * for what was lost, by the best paths with wildcards that keep some ASCII letter."""
        if not any(c == LOST or c in LEADS or C1.match(c) for c in word):
            return []
        out = {self.viterbi(word, self.to_bytes["cp1252"])[1][0]}
        return sorted(x for x in out if re.search("[A-Za-z]", x))

    def unread(self, word: str) -> str:
        """The characters beyond ASCII that no encoding reads as the bytes of a known UTF-8 character."""
        left = [c > "\x7f" for c in word]
        for table in self.to_bytes.values():
            for i, c in enumerate(word):
                d = self._decoded(word, i, table) if c > "\x7f" else None
                if d and self.counts.get(d[0], 0) >= self.p.seen:
                    left[i : i + d[1]] = [False] * d[1]
        return "".join(c for c, x in zip(word, left) if x)

    def byte_readings(self, word: str) -> list[tuple[str, float]]:
        """Readings of the same length in which another one-byte encoding was meant, and what their characters gain."""
        kept = self.log(word)
        high = {ord(c) for c in word if c > "\x7f"}
        out: dict[str, float] = {}
        for m in self.maps:
            if all(c in m for c in high):
                w = word.translate(m)
                if w != word and not w.isascii():
                    gain = self.log(w) - kept
                    if gain >= -self.p.slack:
                        out[w] = gain
        return sorted(out.items())

    def decode(self, word: str) -> list[tuple[str, str | None, float]]:
        """(how, reading, gain of its characters) of every reading the lattices of a word propose.

        A null reading says that the word can't stand as it is whatever its readings are worth. A wildcard's reading is
        the word with * for what was lost.
        """
        out: list[tuple[str, str | None, float]] = []
        if len(word) == 2 and word[0] > "\x7f" and word[1] in SURROUNDINGS:
            # what is cut off at a line's end may leave a lone letter
            if not (word[1] == "$" and word[0].isalpha()):
                out += [("symbol", r, g) for r, g in self.byte_readings(word)]
        elif LOST in word:
            out.append(("lost", None, 0.0))
            out += [("lost", m, 0.0) for m in self.patterns(word)]
            return out
        else:
            reading = self.utf8_reading(word, 0.0)
            if reading:
                out.append(("utf8", *reading))
            if len(word) > 1:
                out += [("byte", r, g) for r, g in self.byte_readings(word)]
            if len(word) > 2:
                out += [("lead", m, 0.0) for m in self.patterns(word)]
        if C1.search(word):
            out.append(("control", None, 0.0))
        return out


#: What may follow a lone character: a digit, a blank, a line's end, other punctuation.
SURROUNDINGS = "0 $."


def symbol_word(m: re.Match) -> str:
    """A lone character with what follows it, of which only the kind counts."""
    after = m[2]
    return m[1] + ("$" if not after or after in "\r\n" else " " if after in " \t" else "0" if after.isdigit() else ".")


def words_per_document(documents: DataFrame) -> DataFrame:
    """(doc_id, word, lines): the different words beyond ASCII of each document, transfer encodings undone, with hashes of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list[int] = []
            words: list[str] = []
            lines: list[list[int]] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = text.as_py()
                if not t:
                    continue
                t = mail.undo_transfer(t)
                if t.isascii():
                    continue
                # most lines are plain ASCII and need no pattern
                found: dict[str, set[int]] = defaultdict(set)
                for line in t.split("\n"):
                    if not line.isascii():
                        h = int.from_bytes(hashlib.blake2b(" ".join(QUOTE.sub("", line).split()).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                        for w in WORD.findall(line):
                            found[w].add(h)
                        for m in SYMBOL.finditer(line):
                            found[symbol_word(m)].add(h)
                ids += [doc_id] * len(found)
                words += found
                lines += map(list, found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words, pa.string()), pa.array(lines, pa.list_(pa.int64()))], names=["doc_id", "word", "lines"]
            )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, word string, lines array<bigint>")


def vocabulary(pairs: DataFrame) -> DataFrame:
    """(word, n, docs): how many different lines and how many documents hold each word."""
    once = pairs.select("word", F.posexplode("lines").alias("at", "line")).groupBy("word", "line").agg(F.count_if(F.col("at") == 0).alias("docs"))
    return kept(once.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("docs")), "vocabulary")


def character_counts(vocab: DataFrame, params: EncodingParams = EncodingParams()) -> dict[str, int]:
    """At most one entry per code point; estimated again without what can be read as UTF-8 under the first counts."""

    def count(words: DataFrame) -> dict[str, int]:
        chars = words.select(F.explode(F.split("word", "")).alias("c"), "n").where("c > '\x7f'").groupBy("c").agg(F.sum("n").alias("n"))
        return {r.c: r.n for r in chars.collect()}

    first = vocab.sparkSession.sparkContext.broadcast(Channel(count(vocab), params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [first.value.unread(w) for w in b["word"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), b["n"]], names=["word", "n"])

    return count(vocab.select("word", "n").mapInArrow(run, "word string, n bigint"))


def propose(vocab: DataFrame, params: EncodingParams = EncodingParams()) -> DataFrame:
    """(word, n, docs, how, reading, gain): what the lattices of every word propose."""
    channel = vocab.sparkSession.sparkContext.broadcast(Channel(character_counts(vocab, params), params))
    schema = "word string, n bigint, docs bigint, how string, reading string, gain double"
    names, types = zip(*[x.split() for x in schema.split(", ")])
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[t] for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = channel.value.decode
        for b in batches:
            rows = [(word, n, docs, *r) for word, n, docs in zip(*(c.to_pylist() for c in b.columns)) for r in decode(word)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names=list(names))

    tasks = -(-vocab.count() // params.task_words) or 1
    return vocab.select("word", "n", "docs").repartition(tasks, "word").mapInArrow(run, schema)


def damaged_words(vocab: DataFrame, params: EncodingParams = EncodingParams()) -> DataFrame:
    """(word, restored, how): words that arose from a wrong decoding; restored is null where no reading is likely."""
    p = params
    found = kept(propose(vocab, p), "readings")
    sure = found.where("reading is null").select("word", F.col("reading").alias("restored"), "how", F.lit(0.0).alias("score"))
    # readings that are words (any case) under the corpus's word frequencies; one of UTF-8 may also be new to the corpus
    counts = vocab.groupBy(F.lower("word").alias("_w")).agg(F.sum("n").alias("_lines"), F.sum("docs").alias("_docs"))
    read = found.where("how in ('utf8', 'byte', 'symbol') and reading is not null").join(counts, F.lower("reading") == F.col("_w"), "left")
    char, after = F.substring("word", 1, 1), F.substring("word", 2, 1)
    alone = vocab.where((F.length("word") == 2) & after.isin(*SURROUNDINGS) & ~((after == "$") & char.rlike("\\p{L}")))
    alone = alone.groupBy(char.alias("_c")).agg(F.sum("docs").alias("_alone"))
    lone = F.col("how") == "symbol"
    read = read.join(alone, lone & (char == F.col("_c")), "left")
    read = read.join(alone.toDF("_rc", "_reading_alone"), lone & (F.substring("reading", 1, 1) == F.col("_rc")), "left")
    lines, docs = F.coalesce("_lines", F.lit(0)), F.coalesce("_docs", F.lit(0))
    score = F.col("gain") + F.log((lines + 1) / (F.col("n") + 1))
    # lone characters go by documents: one that stands in several copies of a text is more likely meant, and one that is
    # common in other surroundings may just be rare in these
    likely = (
        F.when(F.col("how") == "utf8", score >= p.gain)
        .when(lone, (docs >= p.word_lines) & (docs >= p.symbol_ratio * F.col("docs")) & (F.col("_reading_alone") >= p.symbol_ratio * F.col("_alone")))
        .otherwise((lines >= p.ratio * F.col("n")) & (lines >= p.word_lines) | (lines > 0) & (score >= p.sure))
    )
    read = read.where(likely).select("word", F.col("reading").alias("restored"), "how", score.alias("score"))
    # wildcards: the most frequent word that fits the pattern
    masks = (
        vocab.where(~F.col("word").contains(LOST))
        .select(F.regexp_replace("word", "[^\\x00-\\x7f]+", "*").alias("_m"), F.col("word").alias("_fit"), F.col("n").alias("_n"))
        .groupBy("_m")
        .agg(F.max_by("_fit", F.struct("_n", "_fit")).alias("_fit"), F.max("_n").alias("_n"))
    )
    wild = found.where("how in ('lost', 'lead') and reading is not null").join(masks, F.regexp_replace("reading", "[*\\x80-\\x{10ffff}]+", "*") == F.col("_m"))
    enough = (F.col("_n") >= p.word_lines) & (F.col("_n") >= 2 * p.ratio * F.col("n"))
    lead = F.hex(F.encode(F.regexp_extract("_fit", "[^\\x00-\\x7f]", 0), "UTF-8"))
    first = F.regexp_extract("word", "[^\\x00-\\x7f]", 0)
    held = F.coalesce(*[F.when(first == c, f"{b:X}") for c, b in LEADS.items()])
    wild = wild.where(enough & ((F.col("how") == "lost") | ((lead.substr(1, 2) == held) & (F.col("_fit") != F.col("word")))))
    wild = wild.select("word", F.col("_fit").alias("restored"), "how", F.log("_n").alias("score"))
    # one reading a word: UTF-8 before one-byte encodings before wildcards, the better score first
    rank = F.when(F.col("restored").isNull(), 9).when(F.col("how") == "utf8", 0).when(F.col("how").isin("byte", "symbol"), 1).otherwise(2)
    best = F.min_by(F.struct("restored", "how"), F.struct(rank, -F.col("score"), "restored")).alias("b")
    return sure.unionByName(read).unionByName(wild).groupBy("word").agg(best).select("word", "b.*")


def find_damage(documents: DataFrame, params: EncodingParams = EncodingParams()) -> DataFrame:
    """(doc_id, word, restored, how): every damaged word of every document, once each. Documents are read once."""
    pairs = kept(words_per_document(documents), "words")
    bad = damaged_words(vocabulary(pairs), params)
    return pairs.join(bad, "word").select("doc_id", "word", "restored", "how")


def _mended(text: str, fixes: dict[str, str | None]) -> tuple[str, int, int]:
    """The text with its transfer encodings undone and damaged words replaced; how many could be, and how many could not."""
    hit: set[str] = set()

    def word(m: re.Match) -> str:
        if m[0] not in fixes:
            return m[0]
        hit.add(m[0])
        return fixes[m[0]] or m[0]

    def symbol(m: re.Match) -> str:
        w = symbol_word(m)
        if w not in fixes:
            return m[0]
        hit.add(w)
        return (fixes[w] or w)[0] + m[2]

    out = SYMBOL.sub(symbol, WORD.sub(word, mail.undo_transfer(text)))
    n = sum(fixes[w] is not None for w in hit)
    return out, n, len(hit) - n


def restore(documents: DataFrame, params: EncodingParams = EncodingParams()) -> DataFrame:
    """(doc_id, restored_text, n_restored, n_left): affected messages, transfer encodings undone, damaged words replaced.

    Up to `shipped_fixes` different damaged words, every worker holds them all and texts stay where they are read; beyond,
    every text is sent the fixes of its own words, by its hash, as copies have them in common. The rows are the same.
    """
    schema = "doc_id bigint, restored_text string, n_restored bigint, n_left bigint"
    names, types = ["doc_id", "restored_text", "n_restored", "n_left"], [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    code = F.xxhash64("text").alias("_code")
    pairs = kept(words_per_document(documents.select(code.alias("doc_id"), "text")), "words")
    bad = kept(damaged_words(vocabulary(pairs), params), "damaged")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", code)
    shipped = None
    if bad.count() <= params.shipped_fixes:
        shipped = documents.sparkSession.sparkContext.broadcast({r.word: r.restored for r in bad.collect()})
    else:
        fixes = pairs.join(bad, "word").groupBy(F.col("doc_id").alias("_code")).agg(F.collect_set(F.struct("word", "restored")).alias("fixes"))
        rows = rows.join(fixes, "_code").select("doc_id", "text", "fixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                text = b["text"][i].as_py()
                if text:
                    by = shipped.value if shipped else {x["word"]: x["restored"] for x in b["fixes"][i].as_py()}
                    mended = _mended(text, by) if by else (text, 0, 0)
                    if mended[1] or mended[2]:
                        out.append((b["doc_id"][i].as_py(), *mended))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, types)], names=names)

    return rows.mapInArrow(run, schema)
