"""Fingerprints, licenses, toxicity and decontamination on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
import pytest

from lodeframe.llm import bytewords, decontaminate, lcp, licenses, toxicity
from lodeframe.llm.queries import op6_benchmark_decontamination, op7_toxicity
from lodeframe.llm.sql import ORACLES


def prose(rng: random.Random, n: int) -> str:
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "zu", "ter", "an") for b in ("ri", "n", "vo", "st", "qua", "é")]
    return " ".join(rng.choices(pool, k=n))


# Fingerprints


def test_fingerprint_rows(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.choice([0, 1, 3, 50, 2000]))) for k in range(40)] + [(40, None), (41, "a"), (42, "日本" * 30_000), (None, "last")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, part string").repartition(7)
    got = {r.doc_id: r for r in lcp.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = {}
    for (doc, text), (following_id, following) in zip(order, [*order[1:], order[0]], strict=True):
        text, following = text or "", following or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.near_next == 1) >= (r.fingerprint == got[following_id].fingerprint)


def test_equal_passages_share_phrases_at_any_offset():
    rng = random.Random(2)
    passage, other = prose(rng, 3000), prose(rng, 3000)
    shifted = prose(rng, 7) + " " + passage + " " + prose(rng, 11)
    a, b, c = lcp.sketches([passage, shifted, other])
    assert lcp.likeness(a[None], b[None])[0] > 0.9
    assert lcp.likeness(a[None], c[None])[0] < 0.3


MASK = (1 << 64) - 1


def scramble(x: int) -> int:
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def tossed(own: int, left: int) -> int:
    """Twice the place of the lowest bit in which two labels differ, and own's bit there; equal ones give 0."""
    low = (own ^ left) & -(own ^ left)
    return 2 * (low.bit_length() - 1) + bool(own & low) if low else 0


def plain_level(symbols: list[int], bits: int) -> list[int]:
    """Names of the blocks of one text, symbol by symbol; ``bits`` is the width of a symbol."""
    runs: list[list[int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    width = (1 << bits) - 1
    seq = [s if n == 1 else scramble(s + (n << 40) & MASK) & width for s, n in runs]
    if not seq:
        return []
    label = [tossed(s, seq[k - 1] if k else s ^ 1) for k, s in enumerate(seq)]
    for _ in range(2):
        label = [tossed(x, label[k - 1] if k else x ^ 1) for k, x in enumerate(label)]
    cuts = [0] + [k for k in range(1, len(seq) - 1) if label[k - 1] < label[k] > label[k + 1]]
    names = []
    for a, b in zip(cuts, [*cuts[1:], len(seq)], strict=True):
        total = sum((s + 0x5851F42D4C957F2D) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, s in enumerate(seq[a:b]))
        names.append(scramble((total + b - a) & MASK))
    return names


def plain_sketch(text: str) -> list[int]:
    least: dict[int, int] = {}
    symbols, bits = [ord(c) for c in text], 32
    for level in (1, 2, 3):
        symbols, bits = plain_level(symbols, bits), 64
        if level == 1:
            continue
        seen: dict[int, int] = {}
        for s in symbols:
            short = s >> 20
            turn = seen[short] = seen.get(short, -1) + 1
            name = scramble(scramble((short << 20) ^ scramble(turn)) + level & MASK)
            least[name >> 58] = min(least.get(name >> 58, MASK), name)
    return [scramble(least[k]) % lcp.EMPTY if k in least else lcp.EMPTY for k in range(lcp.BINS)]


def test_parsing_equals_a_plain_version():
    rng = random.Random(9)
    texts = ["", "a", "aa", "ab", "aaaaab", "日本" * 50, "x" * 1000, *(prose(rng, n) for n in (1, 4, 60, 900)), "".join(rng.choice("ab") for _ in range(3000))]
    # Alone, so that the number of the text is 0 and its names stand for themselves.
    assert [lcp.sketches([t])[0].tolist() for t in texts] == [plain_sketch(t) for t in texts]


def test_sketch_is_the_same_alone_and_in_company():
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (0, 1, 5, 400)]
    assert (lcp.sketches(texts) == [lcp.sketches([t])[0] for t in texts]).all()


# Licenses


def test_licenses_are_found_with_their_spans(spark):
    rng = random.Random(4)
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "without any charge").replace("Software", "Program", 1)
    texts = {1: mit, 2: f"{prose(rng, 500)} é {changed} {prose(rng, 500)}", 3: prose(rng, 1000), 4: "", 5: None, 6: " ".join(mit.split()[:60]), 7: f"{mit}\n{prose(rng, 20)}\n{mit}"}
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, license string")
    found = [r for r in licenses.scan(docs).collect() if r.license == "MIT"]
    assert sorted(r.doc_id for r in found) == [1, 2, 7, 7]
    for r in found:
        span = texts[r.doc_id][r.start : r.end]
        assert span.startswith("Permission is hereby granted") and span.endswith("IN THE SOFTWARE") and 0.8 <= r.coverage <= 1
    assert {r.doc_id: r.coverage for r in found if r.doc_id == 1} == {1: 1.0}


def test_repeated_notices_and_long_insertions(spark):
    rng = random.Random(6)
    notice, mit = licenses.TEMPLATES["MIT notice"], licenses.TEMPLATES["MIT"].split()
    texts = [
        "\n".join([notice] * 5), f"{notice} {notice}", "Licensed under the Apache Software License, Version 2.0", "Released under an MIT License.",
        " ".join([*mit[:80], *prose(rng, 40).split(), *mit[80:]]), " ".join([*mit[:50], *prose(rng, 60).split(), *mit[50:]]),
        " ".join(w if k % 6 else "changed" for k, w in enumerate(mit)), f"{prose(rng, 200_000)} {notice}", " ".join([notice] * 3000),
    ]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    count = {(d, name): sum(r.doc_id == d and r.license == name for r in rows) for d in range(len(texts)) for name in licenses.TEMPLATES}
    assert {k: n for k, n in count.items() if n} == {(0, "MIT notice"): 5, (1, "MIT notice"): 2, (2, "Apache-2.0 notice"): 1, (3, "MIT notice"): 1, (4, "MIT"): 1, (5, "MIT"): 1, (6, "MIT"): 1, (7, "MIT notice"): 1, (8, "MIT notice"): 3000}


def best_alignment(template: list[str], document: list[str]) -> int:
    """Matched words of the best alignment without a band, cell by cell."""
    score = [(0, 0)] * (len(document) + 1)
    for word in template:
        last, row = score, [score[0]]
        for j, other in enumerate(document):
            hit = (last[j][0] + licenses.MATCH, last[j][1] + 1) if word == other else (0, 0)
            row.append(max(last[j + 1], hit, (max(0, row[j][0] - 1), row[j][1] if row[j][0] > 1 else 0)))
        score = row
    return max(score)[1]


def test_recall_of_edited_copies(spark):
    """Copies with up to a fifth of their words changed, left out or added, against full alignment."""
    rng = random.Random(8)
    plain_words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    texts, owner = [], []
    for name, template in licenses.TEMPLATES.items():
        for _ in range(12):
            own = plain_words(template)
            for _ in range(round(rng.uniform(0, 0.25) * len(own))):
                at, what = rng.randrange(len(own)), rng.random()
                own[at : at + 1] = [] if what < 0.3 else ["other"] if what < 0.7 else [own[at], "added"]
            texts.append(" ".join([*prose(rng, 30).replace("é", "e").split(), *own, *prose(rng, 30).replace("é", "e").split()]))
            owner.append(name)
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = set()
    for k, (text, name) in enumerate(zip(texts, owner, strict=True)):
        template = plain_words(licenses.TEMPLATES[name])
        if best_alignment(template, text.split()) >= 0.8 * len(template):
            want.add((k, name))
    assert len(want) > 100 and len(want & found) >= 0.9 * len(want), (len(want), len(want & found))
    assert {(k, n) for k, n in found if n == owner[k]} <= want


# Toxicity


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op7_toxicity(spark, sf_dir).select("doc_id", "held_out", "score", "predicted").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(rows[d].score, t) for d, t in labels.items() if d in rows and rows[d].held_out]
    assert len(held) > 50 and all(0 <= s <= 1 for s, _ in held)
    good = [s for s, t in held if t == 1]
    bad = [s for s, t in held if t == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    right = sum((s >= 0.5) == (t == 1) for s, t in held) / len(held)
    assert auc > 0.9 and right > 0.9, (auc, right)


def plain_scores(text: str, model: toxicity.Model) -> tuple[float, list[float]]:
    """Score of a text and of its sentences with evidence, one word at a time."""
    sentences: list[set[int]] = [set()]
    for piece in re.findall(rb"[A-Za-z0-9\x80-\xff]+|[.!?\n]", text.encode()):
        if piece in b".!?\n":
            sentences.append(set())
            continue
        row, table = toxicity._features(next(bytewords.words(pa.array([piece], pa.binary()), bytewords.ALPHANUMERIC)))
        sentences[-1] |= {int(f) for f in table[row[0]] if f}
    clean, found = 1 - model.leak, []
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    low = sigmoid(toxicity.BASE)
    for s in sentences:
        z = sum(float(model.weight[f]) for f in s)
        if z > 0:
            found.append((sigmoid(toxicity.BASE + z) - low) / (1 - low))
            clean *= 1 - found[-1]
    return 1 - clean, found


def test_scores_equal_the_plain_noisy_or(spark, smallest):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert (model.weight > 0).sum() > 10 and model.leak <= toxicity.LEAK
    rows = toxicity.score(docs.where("doc_id % 3 = 0").unionByName(docs.limit(0)), model).collect()
    spans: dict = {}
    for r in toxicity.offending(docs.where("doc_id % 3 = 0"), model).collect():
        spans.setdefault(r.doc_id, []).append(r)
    assert any(r.score >= 0.5 for r in rows)
    for r in rows:
        score, each = plain_scores(r.text or "", model)
        most = max(each, default=0)
        want = sum(p >= 0.5 or (score >= 0.5 and p > most - 1e-9) for p in each)
        assert r.score == pytest.approx(score, abs=1e-6) and r.offending_sentences == want == len(spans.get(r.doc_id, []))
        # What is toxic can be shown.
        assert r.score < 0.5 or want
        for s in spans.get(r.doc_id, []):
            alone = plain_scores(r.text[s.start : s.end], model)[1]
            assert len(alone) == 1 and alone[0] == pytest.approx(s.score, abs=1e-6)


def test_long_documents_do_not_empty_the_sample(spark):
    rows = [(k, "calm words about weather. " * 3 + f"vile grotz {k}! more" * (k % 2)) for k in range(100)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(1000 + k, 0) for k in range(5)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + [(1000 + k, "long word " * 40_000) for k in range(5)] + [(1, "another text of this id")], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    assert (toxicity.train(docs.repartition(9), labels).weight == model.weight).all()
    assert {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()} == {k for k in range(100) if k % 2}


def test_toxicity_edges(spark):
    rows = [(k, f"calm words about weather number {k}. more of it here.", 0) for k in range(40)] + [(100 + k, f"calm words about weather. you vile grotz number {k}! more here", 1) for k in range(20)]
    docs = spark.createDataFrame([(d, t, 3) for d, t, _ in rows] + [(500, None, 3), (None, "you vile grotz!", 3), (501, "", 3), (501, "word " * 200_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(d, x) for d, _, x in rows] + [(None, 1), (500, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.count() == len(rows) + 4 and scored.columns == ["doc_id", "text", "score", "offending_sentences"]
    by = {r.doc_id: r.score for r in scored.where("doc_id is null or doc_id < 500").collect()}
    assert by[None] > 0.5 and by[0] < 0.5 and by[100] > 0.5
    spans = toxicity.offending(docs.where("doc_id = 100"), model).collect()
    text = dict((d, t) for d, t, _ in rows)[100]
    assert [text[r.start : r.end] for r in spans] == ["you vile grotz number 0"]
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), none).collect() == []


# Decontamination


def test_decontamination_sql(spark, smallest, rows_of, duck_rows):
    assert rows_of(op6_benchmark_decontamination(spark, smallest)) == duck_rows(ORACLES["op6_benchmark_decontamination"])


@pytest.mark.parametrize("size", [5, 6, 11, 14, 60])
def test_items_inside_long_documents(spark, size):
    rng = random.Random(size)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(size))) for k in range(20)] + [(50, "too short text"), (51, None), (None, " ".join(f"n{j}" for j in range(size)))]
    host = [f"h{j}" for j in range(20_000)]
    docs = []
    for k, text in items[:20]:
        at = rng.randrange(len(host))
        docs.append((k, " ".join(host[:at]) + " " + text.upper() + ", " + " ".join(host[at:]), 1.0))
    docs += [(100, None, 0.0), (101, "", 0.0), (None, items[0][1], 0.0), (102, items[-1][1], 0.0), (102, items[-1][1], 0.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id if r.item_id is not None else -1) for r in decontaminate.contained_items(frame, bench).collect())
    assert got == sorted([(k, k) for k in range(20)] + [(-1, 0), (102, -1)])
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [100, 101]
