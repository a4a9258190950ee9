from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.llm import linedup, setjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(line: str) -> frozenset[str]:
    return frozenset("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(line))


def plain(docs: list[tuple[int, str | None]]) -> dict[tuple[int, int], tuple]:
    """(class place, links, earliest match, removed) by place (doc, line)."""
    lines = {(d, k): tokens(line) for d, text in docs for k, line in enumerate((text or "").split("\n")) if tokens(line)}
    first: dict[frozenset, tuple[int, int]] = {}
    for place in sorted(lines):
        first.setdefault(lines[place], place)
    sets = list(first)
    match: dict[frozenset, list[frozenset]] = {s: [] for s in sets}
    for n, a in enumerate(sets):
        for b in sets[:n]:
            if 5 * len(a & b) >= 4 * len(a | b):
                match[a].append(b)
                match[b].append(a)
    out = {}
    for place, s in lines.items():
        other = min((first[m] for m in match[s]), default=None)
        out[place] = (first[s], len(match[s]), other, place > first[s] or (other is not None and other < place))
    return out


def corpus(seed: int, size: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(80)] + ["É", "日本", "Über"]
    bases = [rng.sample(pool, rng.randint(1, 30)) for _ in range(12)] + [[f"t{i}" for i in range(260)], [f"u{i}" for i in range(120)]]
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t\n")]
    for d in range(3, size):
        lines = []
        for _ in range(rng.randint(1, 6)):
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(words) // 5))):
                words[rng.randrange(len(words))] = rng.choice(pool)
            rng.shuffle(words)
            lines.append((" ".join(words)).upper() if rng.random() < 0.2 else "  ".join(words))
        out.append((d * 3, "\n".join(lines)))
    return out


@pytest.mark.parametrize(("seed", "block", "elements"), [(1, linedup.BLOCK, linedup.ELEMENTS), (2, 3, 60), (3, 20, 500)])
def test_join_equals_brute_force(spark, seed, block, elements):
    docs = corpus(seed, 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {}
    for r in linedup.matched_lines(frame, block, elements).collect():
        other = None if r.match_doc_id is None else (r.match_doc_id, r.match_line)
        got[r.doc_id, r.line] = ((r.class_doc_id, r.class_line), r.links, other, r.removed)
    assert got == plain(docs)


def test_removed_lines_leave_the_text(spark):
    docs = [(1, "alpha beta gamma delta epsilon\nother words stay"), (2, "first\nALPHA beta gamma delta epsilon\n\nlast"), (3, None)]
    frame = spark.createDataFrame([(d, t, "x", None if t is None else len(t)) for d, t in docs], "doc_id long, text string, tag string, n_chars long")
    got = {r.doc_id: r for r in linedup.drop_matched_lines(frame).collect()}
    assert [got[d].text for d in (1, 2, 3)] == [docs[0][1], "first\n\nlast", None]
    assert got[2].n_chars == len("first\n\nlast") and got[1].tag == "x"


def test_words_of_equal_short_hashes_stay_apart(spark):
    """These pairs agree in the first 20 and the last 24 bits of their names."""
    for a, b in (("w730af1", "wf5898"), ("w4845e0", "wa6e03")):
        docs = [(1, a), (2, b), (3, f"{a} one two three four five six"), (4, f"{b} one two three four five seven")]
        kept = {r.doc_id: r.text for r in linedup.drop_matched_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert kept == dict(docs)


def test_two_words_of_one_name_stay_apart():
    """Elements are told apart by both names; every place of the join keeps to that."""
    rng = np.random.default_rng(3)
    name = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    check = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    name[20:] = name[:20]  # as many collisions as can be
    rows = [rng.permutation(40)[: rng.integers(4, 40)] for _ in range(60)] + [np.arange(12), np.arange(1, 13), np.arange(20, 32)]
    s = setjoin.distinct(np.concatenate([name[r] for r in rows]), np.concatenate([check[r] for r in rows]), np.repeat(np.arange(len(rows)), [r.size for r in rows]))
    assert s.n.tolist() == [r.size for r in rows] and len({*zip(s.node.tolist(), s.tail.tolist(), strict=True)}) == len({frozenset(r.tolist()) for r in rows})
    packed = [x.as_py() for x in setjoin.pack_sets(s)]
    got = set()
    for key in np.unique(s.token).tolist():
        own = [k for k, d in enumerate(packed) if key in np.frombuffer(d, np.uint64, len(d) // 16)]
        if len(own) > 1:
            for at, ok in setjoin.Block([packed[k] for k in own], key).tiles():
                for a, b in zip(*np.nonzero(ok), strict=True):
                    assert (pair := (own[a + at], own[b])) not in got
                    got.add(pair)
    sets = [set(r.tolist()) for r in rows]
    assert got == {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("members", "words"), [(300, 12), (150, 150)])
def test_blocks_of_many_near_copies(members, words):
    """Widely shared words go through a matrix, rare ones through lists; tiles don't change the links."""
    rng = np.random.default_rng(members)
    pool = rng.integers(0, 1 << 63, (2, 4000), dtype=np.uint64)
    base = rng.permutation(4000)[:words]
    base = base[np.argsort(pool[0][base])]  # the first is their key
    rows = []
    for _ in range(members):
        own = base.copy()
        at = rng.integers(1, words, rng.integers(0, words // 6 + 1))
        own[at] = rng.integers(0, 4000, at.size)
        rows.append(np.unique(np.append(own, base[0])))
    s = setjoin.distinct(pool[0][np.concatenate(rows)], pool[1][np.concatenate(rows)], np.repeat(np.arange(members), [r.size for r in rows]))
    data, token = [x.as_py() for x in setjoin.pack_sets(s)], setjoin.distinct(pool[0][base[:1]], pool[1][base[:1]], np.zeros(1, int)).token
    block = setjoin.Block(data, int(token[0]))
    block.CELLS, block.COLUMNS = 20 * members, 7
    block.grids = None
    got = {(int(a) + at, int(b)) for at, ok in block.tiles() for a, b in zip(*np.nonzero(ok), strict=True)}
    order = {t: k for k, t in enumerate(np.sort(np.unique(s.token)).tolist())}
    sets = [[order[t] for t in np.frombuffer(d, np.uint64, len(d) // 16).tolist()] for d in data]
    want = set()
    for b in range(members):
        for a in range(b):
            both = set(sets[a]) & set(sets[b])
            if 5 * len(both) >= 4 * len(set(sets[a]) | set(sets[b])) and min(both) == order[int(token[0])]:
                want.add((a, b))
    assert got == want and want


def test_null_ids_and_shared_ids(spark):
    line = "one two three four five six"
    frame = spark.createDataFrame([(None, line), (4, line), (4, "one two three four five six\nnew line here"), (4, line)], "doc_id long, text string")
    rows = linedup.matched_lines(frame).collect()
    same = [r for r in rows if r.line == 0]
    assert len(rows) == 5 and all(r.class_doc_id is None for r in same)
    assert [r.removed for r in sorted(same, key=lambda r: r.doc_id or 0)] == [False, True, True, True]
    assert [r.text for r in linedup.drop_matched_lines(frame).where("doc_id is null").collect()] == [line]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, links long")
    assert linedup.matched_lines(frame).count() == 0
    assert linedup.drop_matched_lines(frame).collect() == []


def _random_sets(seed: int, members: int) -> setjoin.Sets:
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, (2, 50), dtype=np.uint64)
    pool[0][40:] = pool[0][:10]  # names that collide
    base = [rng.permutation(50)[: rng.integers(8, 40)] for _ in range(6)]
    rows = []
    for _ in range(members):
        own = base[rng.integers(6)].copy()
        own[rng.integers(0, own.size, 2)] = rng.integers(0, 50, 2)
        rows.append(np.unique(own))
    return setjoin.distinct(pool[0][np.concatenate(rows)], pool[1][np.concatenate(rows)], np.repeat(np.arange(members), [r.size for r in rows]))


def test_small_blocks_are_verified_together():
    """One pass over many blocks gives the links that each block gives by itself, parts or not."""
    packed = [x.as_py() for x in setjoin.pack_sets(_random_sets(5, 120))]
    rng = np.random.default_rng(1)
    rows = []
    for key in np.unique(_random_sets(5, 120).token).tolist():
        own = [k for k, d in enumerate(packed) if key in np.frombuffer(d, np.uint64, len(d) // 16)]
        for j in (0, 1):
            rows += [(key, 0, j, int(rng.integers(2)) if j else 0, k, packed[k]) for k in own]
    table = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["key", "i", "j", "part", "id", "elements"])
    want, steps = set(), 0
    blocks: dict = {}
    for r in rows:
        blocks.setdefault(r[:3], []).append(r)
    for (key, i, j), own in blocks.items():
        block = setjoin.Block([r[5] for r in own], key, np.array([r[3] for r in own]) if i != j else None)
        want |= {(key, j, own[a + at][4], own[b][4]) for at, ok in block.tiles() for a, b in zip(*np.nonzero(ok), strict=True)}
    for few in (setjoin.FEW, 10, 0):
        got, setjoin.FEW, keep = set(), few, setjoin.FEW
        try:
            for own, pairs in setjoin.verified_blocks(iter([table]), ("id",)):
                steps += few == keep
                key, j, ids = (own.column(c).to_pylist() for c in ("key", "j", "id"))
                for a, b in pairs:
                    assert all(key[x] == key[y] and j[x] == j[y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
                    got |= {(key[x], j[x], ids[x], ids[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        finally:
            setjoin.FEW = keep
        assert got == want and want
    assert steps < len(blocks)


def test_prefix_rows_travel_packed(monkeypatch):
    """Shares hold every row of a key; large groups are handed on in pieces, and nothing is lost."""
    monkeypatch.setattr(setjoin, "HELD", 500)
    rng = np.random.default_rng(2)
    n = 4000
    key = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 900, n))
    size = rng.choice([5, 90, 150, 300, 70_000], n)
    cols = {"key": key, "node": rng.integers(-(1 << 62), 1 << 62, n), "tail": rng.integers(-9, 9, n).astype(np.int32), "size": (size << 32) | rng.integers(0, 5, n)}
    cols |= {f"b{k}": rng.integers(-(1 << 62), 1 << 62, n) for k in range(4)}
    told = lambda c: list(zip(*(c[x].tolist() for x in setjoin.PREFIX), strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(cols[c]) for c in setjoin.PREFIX], setjoin.PREFIX)
    # Two tasks give out their rows; one task reads them in order of share.
    out = [r for at in (0, 2000) for b in setjoin.packed(iter([batch.slice(at + k, 100) for k in range(0, 2000, 100)]), 6) for r in b.to_pylist()]
    assert len(out) < n / 20 and sum(r["rows"] for r in out) == n
    out.sort(key=lambda r: r["share"])
    batches = pa.Table.from_pylist(out, pa.schema([("share", pa.int32()), ("rows", pa.int32()), ("data", pa.binary())])).to_batches(max_chunksize=3)
    got, large, small = [], set(), []
    for part, over in setjoin.whole_groups(iter(batches), 50, rows=300):
        got += told(part)
        if over:
            large |= set(part["key"].tolist())
            assert len(part["key"]) < 3000
        else:
            own = told(part)
            assert own == sorted(own, key=lambda r: r[:3])
            small.append({r[0] for r in own})
    assert sorted(got) == sorted(told(cols)) and large == {7}
    assert sum(map(len, small)) == len(set.union(*small)) and 7 not in set.union(*small)
