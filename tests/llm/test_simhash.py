from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from lodeframe.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_print(text: str | None, words: int = 4) -> int:
    found = WORD.findall(lowered(text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int], radius: int) -> list[int]:
    """For each print the least place that it reaches."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    pool = [f"Wort{i}" for i in range(300)] + ["é", "日本", "x y"]
    out: list[str | None] = [None, "", " \t\n", "one", "One  two", "a b c d", "A\tB C D"]
    for _ in range(25):
        base = rng.choices(pool, k=rng.randint(3, 200))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(pool)
            out.append(" ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fingerprints_and_components_equal_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    prints = simhash.materialise(simhash.fingerprints(docs), "prints")
    got = {r.doc_id: r for r in simhash.near_duplicates(prints).select("doc_id", simhash.as_hex("fingerprint").alias("f"), "component_id").collect()}
    plain = [plain_print(t) for _, t in rows]
    assert {d: r.f for d, r in got.items()} == {d: f"{p:016x}" for (d, _), p in zip(rows, plain, strict=True)}
    assert [got[d].component_id for d, _ in rows] == plain_components(plain, 4)


def test_chains_cross_blocks(spark):
    """Random fingerprints with planted neighbours, in blocks far smaller than their groups."""
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    for p in list(prints[:20]):
        for _ in range(6):
            for b in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
                p ^= 1 << b
            prints.append(p)
    signed = [simhash._signed(p) for p in prints]
    frame = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, block=3).collect()}
    assert [got[i] for i in range(len(prints))] == plain_components(prints, 4)


def test_popcount_distance_is_a_lower_bound(spark):
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    counts = simhash._counts(prints)
    manhattan = np.bitwise_count(counts[:-1] ^ counts[1:])
    assert (manhattan <= np.bitwise_count(prints[:-1] ^ prints[1:])).all()
    frame = spark.createDataFrame([(simhash._signed(int(p)),) for p in prints], "f long")
    assert [r[0] & (1 << 64) - 1 for r in frame.select(simhash.segment_counts("f")).collect()] == counts.tolist()


def test_keep_one_keeps_the_least_id_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, "a"), (3, long + " end", "b"), (3, long + " end", "b"), (None, "alone here now it stands", "c"), (None, long, "d"), (9, "quite another text of some words", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 9), (True, 0)]
