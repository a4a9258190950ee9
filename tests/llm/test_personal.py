"""Personal data: base spans against the patterns themselves, and disguises planted in prose."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from lodeframe.llm import personal
from lodeframe.llm.queries import op13_personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text: str) -> dict[str, list]:
    return {kind: [m.span() for m in re.finditer(p, text) if passes(kind, m[0])] for kind, p in PLAIN.items()}


def test_base_spans_equal_the_patterns(smallest):
    rng = random.Random(13)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", " ", "+", "1", "25", "4111111111111111", "4111-1111 1111-1111", "10.0.0.1", "256.1.1.1.1", "+1 (743) 555-3824", "+4 9", "é", "\n", "_%", "(", "999999999999"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(6000)]
    texts += [r["text"] or "" for r in pq.read_table(f"{smallest}/documents.parquet").to_pylist()]
    for t in texts:
        assert personal.base_spans(t) == plain_spans(t), t


DISGUISED = {
    "email": [
        "enbest.54 at mail3.example.com", "enbest dot fly at mail3 dot example dot com", "jane (at) example (dot) com", "jane[at]example[.]com", "j.doe {at} mail.example {dot} org", "jаne@exаmple.com", "jane＠example．com", "jane AT example DOT org",
        "ja​ne@exam­ple.com", "john.x @ example.com", "jane_at_example.org", "jane arroba example punto es", "jane@example dot com", "𝐣𝐚𝐧𝐞@example.com", "jane <at> mail <dot> example <dot> net",
    ],
    "ip": ["192[.]168[.]10[.]1", "192 dot 168 dot 0 dot 1", "１９２.168.0.１", "one nine two dot one six eight dot one zero dot one", "10(dot)20(dot)30(dot)40", "192․168․0․1", "l92.168.0.1".replace("l", "1‍")],
    "card": ["four one one one one one one one one one one one one one one one", "４111 1111 1111 1111", "4111​1111​1111​1111", "4111‑1111–1111−1111", "4111\xa01111\xa01111\xa01111", "411111l1111O1117".replace("O1117", "11111"), "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "٤111 1111 1111 1111"],
    "phone": ["plus one seven four three five five five three eight two four", "+1 (743) five five five-three eight two four", "＋1 (743) 555-3824", "+1 (743) 555–3824", "+1 (743) 55​5-3824", "plus uno siete cuatro tres cinco cinco cinco tres ocho dos cuatro"],
}


@pytest.mark.parametrize("kind", personal.KINDS)
def test_disguises_are_found_at_their_place(kind):
    for what in DISGUISED[kind]:
        for before, after in (("Éon la, ", ", le reste."), ("", ""), ("日本 was ", "\nNext line at the end."), ("write to ", " or later")):
            text = before + what + after
            base, added = personal.spans(text)
            assert (len(before), len(before) + len(what)) in added[kind], (what, added)
            assert base == plain_spans(text)


CLEAN = [
    "See us at example.com or at the dot. The ratio 3.5 at 4.2 is one, two, three of four.", "un la un. +1 (743) 555-3824 un le un de", "neuf et sept, one by one; two dots at noon", "Version 1.2.3 at 10.0.0.300 and 1 234 567",
    "token = \"f33e61083db5dbdf4bd2369d2f80176e57f7fda2\"", "Он был в школе. Ο άνθρωπος. 日本語。", "look at this.thing and that.other", "a (a) first.thing (b) second", "write to a@b.c@d.e", "dos tres",
]


def test_clean_texts_stay_as_they_are(smallest):
    for t in [*CLEAN, *(r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist())]:
        assert not any(personal.spans(t)[1].values()), t


def test_long_texts_take_linear_time():
    began = time.process_time()
    for t in ("a" * 500_000, "1" * 500_000, "1." * 250_000, "a@" * 200_000, "+1 " * 150_000, "one " * 100_000, "a dot " * 60_000 + "at x", " at " * 100_000 + ".com", "é​" * 100_000, "[at]" * 100_000 + ".a", "9" * 400_000 + "O" * 5):
        base, added = personal.spans(t)
        assert sum(map(len, added.values())) <= 1 and not base["phone"]
    assert time.process_time() - began < 60


def test_rows(spark, smallest):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, "x (at) y (dot) com"), (2, None), (3, ""), (4, "é 10.0.0.1, a@b.co 4111111111111111")]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, n_email int")
    got = sorted(map(tuple, personal.personal_data(frame).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "ip:2:10,email:12:18,card:19:35"
    want = [(1, 1, 0, 0, 0, 0, sha("email:0:6"), "email:0:6")] * 2 + [(None, 1, 0, 0, 0, 1, sha(""), "email:0:18"), (2, 0, 0, 0, 0, 0, sha(""), ""), (3, 0, 0, 0, 0, 0, sha(""), ""), (4, 1, 1, 1, 0, 0, sha(listed), listed)]
    assert got == sorted(want, key=repr)
    assert personal.personal_data(frame.limit(0)).collect() == []
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{smallest}/documents.parquet").to_pylist()}
    for r in op13_personal_data(spark, smallest).collect():
        assert r.base_sha256 == sha(personal.listed(plain_spans(texts[r.doc_id])))


def test_copies_map_back():
    copy = personal.Copy("abcdef", [(1, 3, "X"), (4, 5, ""), (5, 6, "YZ")])
    assert copy.text == "aXdYZ" and copy.source(1, 2) == (1, 3) and copy.source(0, 3) == (0, 4) and copy.source(2, 4) == (3, 6)
