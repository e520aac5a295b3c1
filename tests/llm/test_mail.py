import base64
import quopri

from meterloom.llm import mail


def test_plain_text_stands():
    t = "Subject: x\n\nBody = 3 =41 <a@b.example> & co\n"
    assert mail.undo_transfer(t) == t and mail.readable(t) == t


def test_base64_and_quoted_printable():
    body = "Grüße, wörld\nline two – end\n"
    b64 = base64.encodebytes(body.encode()).decode()
    t = f"Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{b64}"
    assert body in mail.undo_transfer(t)
    qp = quopri.encodestring(body.encode()).decode()
    t = f'Content-Type: multipart/mixed; boundary="=_x"\n\n--=_x\nContent-Transfer-Encoding: quoted-printable\n\n{qp}\n--=_x\nplain =41\n--=_x--\n'
    out = mail.undo_transfer(t)
    assert body in out and "plain =41" in out
    assert mail.undo_transfer(t.replace("\n", "\r\n")).count("Grüße") == 1


def test_latin_charset_missing_boundary_and_binary():
    t = "Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\ncaf=E9 ="
    assert "café" in mail.undo_transfer(t)
    junk = base64.b64encode(bytes(range(256))).decode()
    t = f"Content-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\n{junk}\n--b\nafter"
    assert mail.undo_transfer(t).endswith("--b\nafter") and junk not in mail.undo_transfer(t)
    broken = "Content-Transfer-Encoding: base64\n\nA\n"
    assert "A" in mail.undo_transfer(broken)
    assert mail.undo_transfer("Content-Transfer-Encoding: base64") == "Content-Transfer-Encoding: base64"


def test_encoded_words():
    assert mail.undo_transfer("Subject: =?UTF-8?B?Q2Fmw6k=?= =?utf-8?q?_na=C3=AFve?=\n") == "Subject: Café naïve\n"
    assert mail.undo_transfer("Subject: =?x?B?!!?= end") == "Subject: =?x?B?!!?= end"


def test_markup():
    assert mail.drop_markup("<html><p>a <b>b</b>c</p><br>d&nbsp;e &amp; f</html>").split() == ["a", "bc", "d", "e", "&", "f"]
    assert mail.drop_markup("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
