"""Near-duplicate documents against brute-force Jaccard similarity."""

from __future__ import annotations

import random
from functools import partial

import numpy as np
import pytest
from test_simhash import WORD, lowered, plain_print

import corpus_pipeline
from lodeframe.llm import neardocs, simhash


def plain_set(text: str | None) -> frozenset[str]:
    found = WORD.findall(lowered(text or ""))
    return frozenset([" ".join(found[i : i + 5]) for i in range(len(found) - 4)] or ([" ".join(found)] if found else []))


def similarity(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_kept(texts: list[str | None]) -> list[int]:
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            # Exact: 5 * overlap >= 4 * union.
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return sorted(set(label))


def edited(rng: random.Random) -> list[str | None]:
    """Texts at all similarities from 0.6 on, texts that share a passage, short and empty ones."""
    pool = [f"w{i}" for i in range(2000)]
    passage = rng.choices(pool, k=40)
    out: list[str | None] = ["", None, "one two", "One  TWO", "a b c d e", "a b c d e f g h", "a b c d e f g h i"]
    for _ in range(40):
        base = rng.choices(pool, k=rng.randint(20, 400)) + (passage if rng.random() < 0.4 else [])
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            for at in rng.sample(range(len(near)), max(1, round(len(near) * rng.uniform(0, 0.06)))):
                near[at] = rng.choice(pool)
            out.append(" ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_one_equals_brute_force(spark, seed):
    texts = edited(random.Random(seed))
    sets = [plain_set(t) for t in texts]
    bands = [s for a in range(len(sets)) for b in range(a) if 0.6 < (s := similarity(sets[a], sets[b])) < 1]
    assert sum(0.8 <= s < 0.9 for s in bands) > 5 and sum(s < 0.8 for s in bands) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == plain_kept(texts)


def test_large_groups_are_dealt_in_blocks(spark):
    texts = [t for t in edited(random.Random(3)) if t]
    base = [f"x{i}" for i in range(60)]
    for k in range(20):
        texts.append(" ".join([*base[:k], f"own{k}", *base[k:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows, groups = neardocs.near_documents(docs, block=4, elements=256)
    component = {(r.node, r.tail): r.component for r in groups.collect()}
    least: dict = {}
    for r in rows.orderBy("doc_id").collect():
        least.setdefault(component.get((r.node, r.tail), (r.node, r.tail)), r.doc_id)
    assert sorted(least.values()) == plain_kept(texts)


def test_repeated_shingles_do_not_merge_clean_texts(spark):
    """One repeated shingle decides the SimHash of both texts; their sets share a tenth."""
    common = " ".join(["again"] * 400)
    texts = [common + " " + " ".join(f"{side}{i}" for i in range(40)) for side in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 1]


def test_the_stage_links_by_simhash_first(spark, monkeypatch):
    """Fingerprints of five-word shingles link, sets confirm, and the set join is left with what fingerprints lack."""
    rng = random.Random(7)
    base, other = ([f"{side}{i}" for i in range(300)] for side in "xy")
    texts = [" ".join([*base, f"end{k}"]) for k in range(12)]  # within four bits of one another
    for _ in range(6):  # alike, yet most of them more than four bits apart
        near = list(other)
        for at in rng.sample(range(300), 6):
            near[at] = f"z{rng.random()}"
        texts.append(" ".join(near))
    again = " ".join(["again"] * 400)
    texts += [again + " " + " ".join(f"{side}{i}" for i in range(40)) for side in "ab"]  # one fingerprint, unlike sets
    texts += [again + " " + " ".join(f"c{i}" for i in range(40)) + f" end{k}" for k in range(2)]
    docs = spark.createDataFrame([(k, t, None, None, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    seen = {}

    def spy(module, name):
        inner = getattr(module, name)

        def call(*args, **more):
            out = inner(*args, **more)
            seen[name] = (args, out)
            return out

        monkeypatch.setattr(module, name, call)

    spy(simhash, "near_duplicates")
    spy(neardocs, "checked_links")
    spy(neardocs, "unsettled")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(texts)
    prints = {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in seen["near_duplicates"][0][0].collect()}
    assert prints == {k: plain_print(t, 5) for k, t in enumerate(texts)}
    links = seen["checked_links"][1].collect()
    ids = {r.id: r.doc for r in seen["unsettled"][0][1].collect()}
    pairs = [(ids[r.a], ids[r.b]) for r in links]
    assert len([p for p in pairs if max(p) < 12]) == 11  # one comparison each
    assert all(similarity(plain_set(texts[a]), plain_set(texts[b])) >= 0.8 for a, b in pairs)
    before, after = (seen["unsettled"][0][0].count(), seen["unsettled"][1].count())
    assert 0 < after < before


def test_leaders_of_large_groups_go_to_several_tasks(spark):
    texts = [" ".join([f"x{i}" for i in range(60)] + [f"end{k}"]) for k in range(30)] + ["quite another text " * 5]
    sets = [plain_set(t) for t in texts]
    docs = spark.createDataFrame([(k, t, 0, k) for k, t in enumerate(texts)], "id long, text string, tail int, node long")
    packed = docs.mapInArrow(partial(neardocs._elements, rank=np.zeros(neardocs.BUCKETS, np.int32), size=5), "node long, tail int, id long, elements binary")
    groups = docs.selectExpr("id", "7L as component")
    for most in (4, 2048):
        got = {(r.a, r.b) for r in neardocs.checked_links(groups, packed, most).collect()}
        assert got == {(k, 0) for k in range(1, 31) if similarity(sets[0], sets[k]) >= 0.8} and len(got) == 29
