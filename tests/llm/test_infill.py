"""Fill-in-the-middle texts against a plain definition, and exact round trips."""

import hashlib
import random
import re

from paneleffect.llm import infill


def plain_definition(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if h[3] % 100 < 20:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_equals_the_definition_and_restores(frame):
    rng = random.Random(4)
    pieces = ["ab", "Z", " ", "\n", "é", "漢", "😀", "<", ">", "<P", "S>", "M", "1", "́", "\x00", "\r\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(300)]
    texts += ["", None, "<P>", "a<M>b", "x<S>", "a", "é", "<" * 50, "word " * 200_000, "😀" * 3000]
    rows = [(rng.choice([k, -k, 10**17 + k]), text) for k, text in enumerate(texts)] + [(None, "no id"), (3, "copy"), (3, "copy")]
    out = infill.restored(infill.infilled(frame(rows))).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"], r["restored"]) for r in out)
    want = []
    for doc_id, text in rows:
        n, form, p, m, output = plain_definition(doc_id, text)
        want.append((doc_id is None, doc_id or 0, n, form, p or 0, m or 0, output, text or ""))
    assert got == sorted(want)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert all((r["form"] == "plain") == (r["prefix_chars"] is None) == (r["middle_chars"] is None) for r in out)


def test_rotations_exchange_blocks():
    for text in (b"", b"a", b"abcdefg"):
        for low in range(len(text) + 1):
            for high in range(low, len(text) + 1):
                p, m, s = text[:low], text[low:high], text[high:]
                for form, want in (("psm", b"<P>" + p + b"<S>" + s + b"<M>" + m), ("spm", b"<S>" + s + b"<P>" + p + b"<M>" + m), ("plain", text)):
                    assert infill.arranged(text, low, high, form) == want
                    assert infill.rebuilt(want, form) == text


def test_no_rows_and_ids_as_text(frame):
    assert infill.digest(frame([])).collect() == []
    out = infill.infilled(frame([("7", "some words here")], "doc_id string, text string")).first()
    assert tuple(out)[1:] == plain_definition("7", "some words here")
