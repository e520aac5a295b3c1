import random

import pytest

from meterloom.llm import encodings as enc

CLEAN = ["café", "naïve", "résumé", "façade’s", "Señora", "für", "März", "Straße", "größte", "środę", "łódź", "крыши", "месяц", "Наша", "после", "μετά", "“quiet”", "don’t", "isn’t", "½", "£", "€", "–", "à", "°C"]


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    return [" plain words and ".join(rnd.sample(CLEAN, 8)) for _ in range(n)]


def wrong(text, as_, was="utf-8"):
    table = {b: ch for ch, b in enc._bytes_of(as_).items() if not (0x80 <= ord(ch) < 0xA0)}
    return "".join(table.get(b, chr(b)) for b in text.encode(was))


def find(spark, texts, params=enc.EncodingParams()):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, word string")
    found = enc.find_damage(df, params).collect()
    return df, {(r.doc_id, r.word): r.restored for r in found}


def test_damage_of_every_kind(spark):
    texts = corpus()
    n = len(texts)
    bad = [
        (wrong("That was für Señora", "cp1252"), "für Señora"),
        (wrong(wrong("one résumé", "cp1252"), "cp1252"), "résumé"),
        (wrong(wrong(wrong("a façade’s", "cp1252"), "cp1252"), "cp1252"), "façade’s"),
        (wrong("в крыши месяц", "cp1251"), "крыши месяц"),
        (wrong("ein café", "cp437"), "café"),
        (wrong("ein März", "cp850"), "März"),
        (wrong("ein größte", "mac_roman"), "größte"),
        (wrong("ein naïve", "mac_roman", "cp1252"), "naïve"),
        (wrong("крыши и месяц", "cp1252", "cp1251"), "крыши"),
        (wrong("w środę", "mac_roman", "cp1250"), "środę"),
        ("one r�sum� there", "résumé"),
        ("it don’t matter: £5".encode().decode("latin-1"), "don’t"),
    ]
    texts += [t for t, _ in bad]
    _, found = find(spark, texts)
    docs = {d for d, _ in found}
    assert docs == set(range(n, len(texts)))
    for i, (_, said) in enumerate(bad):
        for w in said.split():
            assert w in {r for (d, _), r in found.items() if d == n + i}, (i, w, found)


def test_correct_text_is_no_case(spark):
    decoys = [
        "AÇÃO, LIÇÃO, IRMÃ. © ® ™ ° ¬ ¦", "├── depot\n│   └── plan.txt", "∑ = √(a² + b²) ± ½, ∂f/∂x ≈ 3·10⁻⁴", "Ð og Þ eru íslenskir stafir; Ægir á að læra þá.",
        "Тест: ПРОВЕРКА СВЯЗИ — «ёлка», № 5.", "ΑΒΓ: η ώρα είναι 5 μ.μ.", "Âme, âge, pâte, ÊTRE, Åre", "次の会議は静かに点検されます。", "Grüß\xa0 Gott", "d’été à l’élève", None, "", "ascii only",
        "Subject: =?UTF-8?B?Q2Fmw6k=?=", "Content-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9",
    ]
    # as often as rare but correct text is in a corpus
    _, found = find(spark, corpus() + decoys * 3)
    assert found == {}


def test_lone_letters_for_symbols(spark):
    base = [f"{t} • one – two £5" for t in corpus()]
    _, found = find(spark, [*base, "ò one û two ú7", "um été"])
    assert found == {(400, "ò "): "• ", (400, "û "): "– ", (400, "ú0"): "£0"}
    df = spark.createDataFrame(list(enumerate([*base, "ò one û two ú7"])), "doc_id bigint, text string")
    assert enc.restore(df).first().restored_text == "• one – two £7"


def test_damage_inside_a_transfer_encoding(spark):
    texts = [*corpus(), "Content-Transfer-Encoding: quoted-printable\n\ncaf=C3=83=C2=A9"]
    _, found = find(spark, texts)
    assert set(found.values()) == {"café"}


def test_restored_text(spark):
    texts = [*corpus(), "Hello " + wrong("café", "cp1252") + ", a � and r�sum�."]
    df, _ = find(spark, texts)
    r = enc.restore(df).first()
    assert (r.restored_text, r.n_restored, r.n_left) == ("Hello café, a � and résumé.", 2, 1)


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert enc.find_damage(empty).count() == 0 and enc.restore(empty).count() == 0


@pytest.mark.parametrize("as_", ["cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1250"])
def test_round_trip_of_one_word(as_):
    ch = enc.Channel(dict.fromkeys("éüñß’ł", 1000) | {"Ã": 10, "©": 50}, enc.EncodingParams())
    assert ch.utf8_reading(wrong("dé’ß", as_))[0] == "dé’ß"
    assert ch.utf8_reading("dé’ß") is None


def test_wildcards_are_edges_of_the_lattice():
    ch = enc.Channel(dict.fromkeys("éüñß’ł", 1000) | {"Ã": 10, "©": 50}, enc.EncodingParams())
    cp1252 = ch.to_bytes["cp1252"]
    assert ch.viterbi("r�sum��s", cp1252)[1][0] == "r*sum*s"
    assert ch.viterbi("caf\x81 rÃ©sum�", cp1252)[1][0] == "caf* résum*"
    kept, wild = ch.viterbi("CafÃ", cp1252)
    assert kept[0] == "CafÃ" and wild[0] == "Caf*" and kept[1] > wild[1]
    assert ch.viterbi("plain", cp1252) == [("plain", 0.0), ("", -enc.math.inf)]


def test_rare_words_are_restored(spark):
    """A word that stands on one line only is a reading where its characters are much likelier."""
    texts = [*corpus(), "a façade stood", wrong("the façade", "mac_roman", "cp1252"), wrong("so unique a façadière", "cp1252")]
    # what a small corpus can be sure of
    _, found = find(spark, texts, enc.EncodingParams(sure=4.0))
    assert {(d - 400, r) for (d, _), r in found.items()} == {(1, "façade"), (2, "façadière")}


def test_lone_symbols_in_any_surroundings(spark):
    base = [f"{t} ± 5 © one ±, é à\nthe ©" for t in corpus()]
    _, found = find(spark, [*base, "▒ 6", "the ⌐", "▒, so", "un Ó deux", "cut off Ó"])
    assert found == {(400, "▒ "): "± ", (401, "⌐$"): "©$", (402, "▒."): "±.", (403, "Ó "): "à "}


def test_restoring_with_and_without_shipped_fixes(spark):
    base = corpus(200)
    texts = [*base, wrong("ein café – für", "cp1252"), "r�sum�", wrong("ein März", "cp850"), None, "", wrong("ein café – für", "cp1252")]
    df = spark.createDataFrame([(None if i == 201 else min(i, 204), t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, word string")
    rows = [sorted(map(str, enc.restore(df, enc.EncodingParams(shipped_fixes=n)).collect())) for n in (1000, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_copies_and_quotes_of_a_damaged_message_change_nothing(spark):
    base = corpus()
    bad = wrong("ein été à la façade’s für Señora", "cp1252")
    copies = [f"{'> ' * (i % 4)}{bad}" for i in range(len(base) // 2)]
    _, found = find(spark, [*base, *copies, wrong("another naïve", "cp1252")])
    assert {d for d, _ in found} == set(range(len(base), len(base) + len(copies) + 1))
    assert {found[len(base) + i, wrong("für", "cp1252")] for i in range(len(copies))} == {"für"}


def test_one_byte_damage_in_many_quotes(spark):
    base = corpus()
    n = len(base)
    quotes = [f"{'> ' * (i % 4)}{wrong('ein naïve', 'mac_roman', 'cp1252')}" for i in range(n // 2)]
    _, found = find(spark, [*base, *quotes])
    assert {d for d, _ in found} == set(range(n, n + len(quotes)))
    assert set(found.values()) == {"naïve"}


ALPHABETS = {
    "fr": ("bcdflmnprstv", "aeioué", "éèêàçôîû"), "de": ("bdfghklmnrst", "aeiouü", "äöüß"), "es": ("bcdlmnprst", "aeioó", "ñáíóú"),
    "pl": ("bcdkmnprswz", "aeioyó", "łśćżźąęó"), "ru": ("бвгдклмнпрст", "аеиоуы", "ъьэюяж"), "el": ("βγδκλμνπρστ", "αεηιοω", "άέήίόώ"),
}
#: Bytes of what text, taken for what.
DAMAGES = [("utf-8", e) for e in ("cp1252", "cp1251", "cp437", "cp850", "mac_roman", "iso8859_2")] + [("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1251")]


def generated_words(rnd, alphabet, n=40):
    c, v, extra = ALPHABETS[alphabet]
    words = []
    for _ in range(n):
        w = "".join(rnd.choice(c) + rnd.choice(v) for _ in range(rnd.randrange(2, 4)))
        at = rnd.randrange(1, len(w) + 1)
        words.append(w[:at] + rnd.choice(extra) + w[at:])
    return words


def test_held_out_damage_of_a_generated_corpus(spark):
    """Words, texts and damages are drawn anew: recall and precision by message, and the share of words restored exactly."""
    rnd = random.Random(77)
    words = {a: generated_words(rnd, a) for a in ALPHABETS}
    rank = [1 / (i + 1) for i in range(40)]
    texts, bad, originals = [], set(), {}
    for i in range(2400):
        a = rnd.choice(sorted(words))
        lines = [" and ".join(rnd.choices(words[a], rank, k=5)) for _ in range(4)]
        if i % 10 == 0:
            was, taken = rnd.choice(DAMAGES)
            n = rnd.randrange(4)
            try:
                damaged = wrong(lines[n], taken, was)
            except UnicodeEncodeError:
                was, taken = "utf-8", "cp1252"
                damaged = wrong(lines[n], taken, was)
            if i % 40 == 0:
                damaged = "".join("\ufffd" if c > "\x7f" and rnd.random() < 0.3 else c for c in lines[n])
            if damaged != lines[n]:
                bad.add(i)
                originals[i] = lines[n]
                lines[n] = damaged
        texts.append("\n".join(lines))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.restored_text for r in enc.restore(df).collect()}
    recall, precision = len(bad & set(found)) / len(bad), len(bad & set(found)) / len(found)
    right = sum(originals[i] in found[i].split("\n") for i in bad & set(found)) / len(bad)
    assert recall >= 0.97 and precision >= 0.97 and right >= 0.8, (recall, precision, right)
