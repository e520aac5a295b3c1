import base64
import random
from collections import defaultdict

from meterloom.llm import leaks

WORDS = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "jo", "ki") for b in ("lan", "mer", "nis", "pot", "rud", "sel", "tam", "vor", "wix", "zen")]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def make_items(rnd, n=40):
    intro = "Read the passage below and answer the question that follows in one short phrase please now."
    return [(i, f"{intro}\n\n{sentence(rnd, 70).capitalize()}.\n\nQuestion: What does the passage say about {rnd.choice(WORDS)}?", "the answer") for i in range(n)]


def edit(rnd, words, k):
    w = list(words)
    for at in sorted(rnd.sample(range(2, len(w) - 2), k), reverse=True):
        what = rnd.randrange(3)
        if what == 0:
            w[at] = "changed"
        elif what == 1:
            del w[at]
        else:
            w.insert(at, "added")
    return w


def test_wand_equals_exhaustive_scoring():
    rnd = random.Random(1)
    ix = leaks.ItemIndex(make_items(rnd), leaks.LeakParams())
    for _ in range(300):
        terms = [rnd.randrange(len(ix.codes)) for _ in range(rnd.randrange(1, 30))] + [t for t in [rnd.randrange(len(ix.codes))] for _ in range(rnd.randrange(4))]
        start = rnd.randrange(len(ix.codes) - 10)
        terms += range(start, start + rnd.randrange(10))
        scores = defaultdict(float)
        for t in terms:
            for k, w, _ in ix.postings[t]:
                scores[k] += w
        want = sorted((k, round(s, 9)) for k, s in scores.items() if s >= ix.threshold)
        assert sorted((k, round(s, 9)) for k, s in ix.wand(terms)) == want


def test_leaks_are_found_and_near_misses_are_not(spark):
    rnd = random.Random(7)
    items = make_items(rnd)
    passage = {i: leaks.words_of(leaks.split_item(t)[0]) for i, t, _ in items}
    docs, want, n = [], set(), 0

    def add(text, *found):
        nonlocal n
        docs.append((n, text, f"extra {n}"))
        want.update((n, f) for f in found)
        n += 1

    for _ in range(60):
        add(sentence(rnd, 300))
    for k in range(30):
        part = passage[k][10:30]
        add(f"{sentence(rnd, 40)} {' '.join(part)} {sentence(rnd, 40)}", k)
        add(f"{sentence(rnd, 40)} {' '.join(edit(rnd, passage[k][5:45], 3))} {sentence(rnd, 40)}", k)
        add(f"{sentence(rnd, 40)} {' '.join(passage[k][10:20])} {sentence(rnd, 40)}")
        add(f"{sentence(rnd, 40)} {' '.join(passage[k][20:8:-1])} {sentence(rnd, 40)}")
    p = passage[3][20:44]
    add("> > " + "\n> > ".join(" ".join(p[i : i + 5]).upper() + "," for i in range(0, len(p), 5)), 3)
    add("<html><body><p>" + " ".join(f"<b>{w}</b>" if i % 3 else w for i, w in enumerate(p)) + "</p></body></html>", 3)
    add("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(" ".join(p).encode()).decode(), 3)
    add("1. " + " ".join(p[:8]) + "\n2. " + " ".join(p[8:16]) + "\n* " + " ".join(p[16:]), 3)
    add(items[5][1], 5)
    add(" ".join(passage[1][:20]) + " and " + " ".join(passage[2][30:60]), 1, 2)
    add(items[0][1].split("\n\n")[0] + " " + items[0][1].split("\n\n")[2])
    add(None)
    add("")
    add("short text")
    add("word " * 100_000 + " ".join(passage[9]), 9)
    docs += [docs[60]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([*items, (900, None, None), (901, "tiny", "x"), (902, "", None)], "item_id bigint, text string, answer string")
    rows = leaks.find_leaks(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert sum(r.doc_id == 60 for r in rows) == 2
    whole = next(r for r in rows if r.item_id == 5 and r.doc_id == [d[0] for d in docs if d[1] == items[5][1]][0])
    assert whole.words == 70 and whole.edits == 0 and whole.question_share == 1.0
    assert leaks.find_leaks(df.limit(0), it).count() == 0
    assert leaks.find_leaks(df, it.limit(0)).count() == 0


def fewest_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def one_item(words):
    """An index that also holds other items, so that a triple of the first has weight."""
    others = [(i, sentence(random.Random(i), 60), None) for i in range(1, 30)]
    return leaks.ItemIndex([(0, " ".join(words), None), *others], leaks.LeakParams())


def test_edits_are_counted_word_by_word():
    passage = [f"p{i}" for i in range(15)]
    ix = one_item(passage)
    noise = [f"n{i}" for i in range(40)]
    doc = noise[:20] + [*passage[:2], "x", *passage[3:12], "y", *passage[13:]] + noise[20:]
    assert [(k, span, edits) for k, _, span, edits, *_ in ix.search(doc)] == [(0, 15, 2)]
    # agreeing words between two edits are none
    passage = [f"p{i}" for i in range(40)]
    ix = one_item(passage)
    doc = noise[:20] + [*passage[:8], "x", passage[9], "y", *passage[11:20]] + noise[20:]
    assert [(k, span, edits) for k, _, span, edits, *_ in ix.search(doc)] == [(0, 20, 2)]


def test_planted_stretches_are_found_with_their_edits():
    rnd = random.Random(3)
    p = leaks.LeakParams()
    for _ in range(150):
        passage = [f"p{i}" for i in range(40)]
        n = rnd.randrange(15, 26)
        part = edit(rnd, passage[8 : 8 + n], rnd.randrange(1, int(p.edit_share * n) + 1))
        doc = [*(f"n{i}" for i in range(9)), *part, *(f"n{i}" for i in range(9, 20))]
        ix = one_item(passage)
        at, term = ix.terms(doc)
        got = ix.verify(doc, 0, [(a, j) for a, t in zip(at.tolist(), term.tolist()) for _, _, places in ix.postings[t] for j in places], p.edit_share)
        edits = fewest_edits(part, passage[8 : 8 + n])
        # edits crowded at an end are cut off with the words beyond
        assert got and got[0] - got[1] >= n - edits - 2 and (got[0] < n or got == (n, edits))


def test_a_reworded_start_does_not_hide_what_follows():
    passage = [f"p{i}" for i in range(60)]
    ix = one_item(passage)
    noise = [f"n{i}" for i in range(40)]
    for n in (15, 18, 24):
        doc = noise[:20] + passage[5:8] + [f"r{i}" for i in range(8)] + passage[16 : 16 + n] + noise[20:]
        assert [(k, span, edits) for k, _, span, edits, *_ in ix.search(doc)] == [(0, n, 0)]


def edit_anywhere(rnd, words, k):
    w = list(words)
    for at in sorted(rnd.sample(range(len(w)), k), reverse=True):
        what = rnd.randrange(3)
        if what == 0:
            w[at] = "changed"
        elif what == 1:
            del w[at]
        else:
            w.insert(at, "added")
    return w


def test_recall_on_edited_stretches():
    """Stretches of 15 to 40 words with up to 3 edits, the ends included: at least 0.9 of each kind are found, of 15 unedited words all."""
    rnd = random.Random(11)
    ix = leaks.ItemIndex(make_items(rnd, 60), leaks.LeakParams())
    table = {}
    for n in (15, 16, 18, 20, 24, 30, 40):
        for k in range(4):
            hits = 0
            for _ in range(60):
                item = rnd.randrange(60)
                at = rnd.randrange(70 - n)
                part = edit_anywhere(rnd, ix.passages[item][at : at + n], k)
                doc = [*sentence(rnd, 80).split(), *part, *sentence(rnd, 80).split()]
                hits += item in {x[0] for x in ix.search(doc)}
            table[n, k] = hits / 60
    assert min(table.values()) >= 0.9 and all(v == 1 for (_, k), v in table.items() if k == 0), table


def test_accidental_agreement_is_no_leak():
    """Texts of the items' own few words agree by chance, and copies of up to 9 words, chance adding some, are too short."""
    rnd = random.Random(12)
    ix = leaks.ItemIndex(make_items(rnd, 60), leaks.LeakParams())
    for _ in range(300):
        item, at, n = rnd.randrange(60), rnd.randrange(50), rnd.randrange(3, 10)
        doc = [*sentence(rnd, 150).split(), *ix.passages[item][at : at + n], *sentence(rnd, 150).split()]
        assert ix.search(doc) == []


def test_wording_that_items_share_is_no_evidence():
    rnd = random.Random(13)
    items = make_items(rnd, 30)
    common = sentence(rnd, 25)
    for k in (3, 4, 5):
        i, text, a = items[k]
        items[k] = (i, text.replace("\n\nQuestion", f" {common}\n\nQuestion"), a)
    items += [(100, items[9][1], "x"), (101, items[9][1], "x")]
    ix = leaks.ItemIndex(items, leaks.LeakParams())
    noise = sentence(rnd, 60)
    assert ix.search(f"{noise} {common} {noise}".split()) == []
    # a stretch must have enough words of its own beside them
    own = ix.passages[3][-40:]
    assert [x[0] for x in ix.search(f"{noise} {' '.join(own[-35:])} {noise}".split())] == []
    assert [x[0] for x in ix.search(f"{noise} {' '.join(own[-40:])} {noise}".split())] == [3]
    # equal passages are one and the same
    assert [x[0] for x in ix.search(f"{noise} {' '.join(ix.passages[9][:20])} {noise}".split())] == [9, 30, 31]


def test_question_and_answer_decide_on_doubtful_stretches():
    rnd = random.Random(14)
    items = [(i, f"Intro words here.\n\n{sentence(rnd, 60)}.\n\nQuestion: why does q{i}a meet q{i}b near q{i}c?", f"the answer{i}") for i in range(30)]
    ix = leaks.ItemIndex(items, leaks.LeakParams())
    p = ix.passages[7][5:29]
    w = [x if i % 6 not in (4, 5) else f"new{i}" for i, x in enumerate(p)]
    assert sum(a != b for a, b in zip(w, p)) / len(p) > 0.22
    text = " ".join(w)
    assert ix.search(text.split()) == []
    assert ix.search(f"{text} why q7a q7b q7c".split()) == [] and ix.search(f"{text} the answer7".split()) == []
    found = ix.search(f"{text} why q7a meets q7b near q7c the answer7".split())
    assert [(x[0], x[4], x[5]) for x in found] == [(7, 1.0, True)]


def test_more_items_than_one_index_holds(spark):
    rnd = random.Random(15)
    items = make_items(rnd, 25)
    common = sentence(rnd, 25)
    items = [(i, t.replace("\n\nQuestion", f" {common}\n\nQuestion") if i in (2, 17) else t, a) for i, t, a in items]
    passage = {i: leaks.words_of(leaks.split_item(t)[0]) for i, t, _ in items}
    docs = [(i, f"{sentence(rnd, 30)} {' '.join(passage[i][5:25])} {sentence(rnd, 30)}") for i in range(25)] + [(99, f"{sentence(rnd, 30)} {common} {sentence(rnd, 30)}")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string, answer string")
    for most in (20_000, 8):
        got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, it, leaks.LeakParams(max_items=most)).collect()}
        assert got == {(i, i) for i in range(25)}, most
