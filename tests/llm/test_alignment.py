"""Cross-tokenizer alignment against a plain version, token by token."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodeframe.llm import alignment
from lodeframe.llm.queries import aligned_tokenizers, op12_token_alignment


@pytest.fixture(scope="module")
def pair() -> alignment.Pair:
    return alignment.Pair(*aligned_tokenizers())


BYTE = alignment._byte_of()


def plain_groups(pair: alignment.Pair, text: str | None) -> list[tuple[list[int], list[int]]]:
    """Whole texts through the tokenizers, cuts as sets of offsets."""
    if not text:
        return []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    bytes_a = [bytes(BYTE[c] for c in pair.a.id_to_token(i)) for i in a]
    pieces = [pair.b.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    cuts = sorted(set(ends_a) & set(ends_b))
    out, i, j = [], 0, 0
    for cut in cuts:
        x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def plain_rows(pair: alignment.Pair, docs: list[tuple]) -> list[tuple]:
    groups = [plain_groups(pair, text) for _, text in docs]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    counts = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), g, c in zip(docs, groups, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def test_query_equals_plain_version(spark, smallest, pair):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{smallest}/documents.parquet").to_pylist()]
    assert sorted(map(tuple, op12_token_alignment(spark, smallest).collect()), key=repr) == plain_rows(pair, docs)


ODD = [
    None, "", " ", "   ", "a", "  two  blanks  ", "tab\tx\n\n y", "\0nul", "é ́a", "日本語 テキスト。次", "▁marked", "x ▁", "<s> </s> <|endoftext|>a <0x41>", "nbsp\xa0 and　 wide  x", "a  b　\n c", "a\x1c b\x1c\x1d c", "it's  I'LL\r\n x", "🙂🙂 👩‍👩‍👧", "\u0085   z",
    " leading", "trailing ", "a\n b", "a \nb", "\n", " \n ", "İstanbul ﬁ ½", "1234567 89,0.5 --- ***", "ab" * 3000, "ßü" * 2000 + " q",
]


def test_odd_texts_and_rows(spark, pair):
    rng = random.Random(12)
    chars = "ab é▁\n\t 日🙂'1.\xa0\u2003"
    texts = [*ODD, *ODD[:6], *("".join(rng.choice(chars) for _ in range(rng.choice([3, 40, 400]))) for _ in range(60))]
    docs = [(rng.choice([None, k, 5]), t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, pack int, docs string").repartition(6)
    assert sorted(map(tuple, alignment.alignments(frame, *aligned_tokenizers()).collect()), key=repr) == plain_rows(pair, docs)
    assert alignment.alignments(frame.limit(0), *aligned_tokenizers()).collect() == []


def test_words_are_encoded_as_in_their_text(pair):
    """The same groups, whether texts are cut into words or not."""
    assert pair.apart
    words = pair.words("a b\n c\xa0 d  e")
    assert "".join(words) == " a b\n c\xa0 d  e" and len(words) == 3
    for text in filter(None, ODD):
        a, b = pair.encode(pair.words(text))
        assert [i for x in a for i in x] == pair.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert [i for x in b for i in x] == pair.b.encode(text)


def test_small_packs_and_a_full_table_change_nothing(pair, monkeypatch):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choices(["one", "other", "Straße", "日本", "x\n\ny"], k=rng.randrange(1, 40)))) for k in range(30)]
    whole = alignment.align(pair, alignment.Known(), *map(list, zip(*docs, strict=True)))
    known = alignment.Known()
    rows, counts = [], Counter()
    for k in range(0, 30, 4):
        part = alignment.align(pair, known, *map(list, zip(*docs[k : k + 4], strict=True)))
        rows += part[0]
        counts.update(dict(zip(part[1].tolist(), part[2].tolist(), strict=True)))
    assert rows == whole[0] and counts == dict(zip(whole[1].tolist(), whole[2].tolist(), strict=True))
    monkeypatch.setattr(alignment, "WORDS", 2)
    assert known.full()


def test_large_groups_are_counted_by_id():
    """A group of many tokens on both sides, as its expansion says."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 7, 200)
    to_a, to_b = np.array([2, 290, 300]), np.array([1, 195, 200])
    owner, pair, times = alignment.links(a, b, to_a, to_b, np.array([0, 1, 1]))
    want = Counter()
    for k, (s, e, t, f) in enumerate(zip([0, 2, 290], to_a, [0, 1, 195], to_b, strict=True)):
        want.update((min(k, 1), int(x) << 32 | int(y)) for x in a[s:e] for y in b[t:f])
    assert dict(zip(zip(owner.tolist(), pair.tolist(), strict=True), times.tolist(), strict=True)) == want


def test_ranks_and_cuts():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randrange(1, 300)
        cut = lambda: sorted({n, *rng.sample(range(1, n + 1), rng.randrange(n))})
        a, b = cut(), cut()
        got = alignment.shared_cuts(np.diff(a, prepend=0), np.diff(b, prepend=0))
        shared = sorted(set(a) & set(b))
        assert [x.tolist() for x in got] == [[a.index(c) + 1 for c in shared], [b.index(c) + 1 for c in shared]]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "a", "0123456789", "日本語の文字"])
def test_long_texts_without_a_blank(pair, alphabet):
    """One word of 200,000 characters, as one text."""
    text = "".join(random.Random(4).choices(alphabet, k=200_000))
    row = alignment.align(pair, alignment.Known(), [1], [text])[0][0]
    groups = plain_groups(pair, text)
    told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    assert (row["n_groups"], row["n_links"], row["groups_sha256"]) == (len(groups), sum(len(a) * len(b) for a, b in groups), hashlib.sha256(told.encode()).hexdigest())
