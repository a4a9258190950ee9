"""The Merkle manifest against SQL, a plain version and a lookup of single leaves."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from lodeframe.llm import manifest
from lodeframe.llm.queries import op11_merkle_manifest
from lodeframe.llm.sql import ORACLES


def test_query_equals_sql(spark, smallest, rows_of, duck_rows):
    assert rows_of(op11_merkle_manifest(spark, smallest)) == duck_rows(ORACLES["op11_merkle_manifest"])


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row: tuple) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes: list[str]) -> tuple[str, list[str]]:
    """The root, and for each node the siblings up to it, by whole levels."""
    below = [[k] for k in range(len(nodes))]
    others = [""] * len(nodes)
    while len(nodes) > 1:
        runs = [range(k, min(k + 8, len(nodes))) for k in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for x in below[k]:
                    others[x] += "".join(nodes[j] for j in run if j != k)
        below = [[x for k in run for x in below[k]] for run in runs]
        nodes = [h("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], others


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """Rows are (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row[0]))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {x: plain_tree([leaf for *_, leaf, _ in sorted(trees[x], key=lambda r: r[:3])]) for x in langs}
    root, above = plain_tree([subs[x][0] for x in langs]) if langs else ("", [])
    return [(doc, leaf, subs[x][0], root, h(subs[x][1][k] + above[at])) for at, x in enumerate(langs) for k, (*_, leaf, doc) in enumerate(sorted(trees[x], key=lambda r: r[:3]))]


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def proved(spark, rows: list[tuple]) -> list:
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], f"{SCHEMA}, digest string, turn int").repartition(5)
    return manifest.manifest(frame, manifest.tampered()).collect()


def check(got: list, rows: list[tuple]) -> None:
    assert sorted(map(repr, ((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got))) == sorted(map(repr, plain_manifest(rows)))
    changed = defaultdict(set)
    for row in rows:
        upper = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]) if row[4] is not None else None
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        changed[plain_leaf(row)].add(not hit or upper == row[4])
    assert all({r.verified} == changed[r.leaf] and r.verified == (r.folded_root == r.root) for r in got)


def test_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 3, -5, 9, 10**15]), rng.choice([None, "", "web"]), rng.choice([None, "", "de", "é", "𝒳", "｡"]), rng.choice([None, 0, -7]), rng.choice([None, "", "ABC É", "abc", "Z" * 100_000])) for _ in range(300)]
    check(proved(spark, rows), rows)


def test_many_languages_of_many_sizes(spark):
    rows = [(k, "s", f"l{n:03}", k, f"Text {k}") for n, size in enumerate([1, 2, 7, 8, 9, 64, 65, 511, 512, 513] + [1] * 600) for k in range(size)]
    check(proved(spark, rows), rows)


def test_a_large_language(spark):
    """More leaves than a block of blocks' run: two rounds, the last block with one leaf."""
    rows = [(k, None, "en", 1, "A" if k % 2 else "b") for k in range(8 * manifest.BLOCK + 1)] + [(1, None, "fr", 1, "c")]
    check(proved(spark, rows), rows)


def test_one_row_and_none(spark):
    row = (6, "s", "en", 4, "Text")
    only = proved(spark, [row])[0]
    assert only.leaf == only.subroot == only.root == plain_leaf(row) and only.proof_sha256 == h("")
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_untouched_rows_verify(spark):
    got = manifest.manifest(spark.createDataFrame([(k, "s", "en", 1, "A") for k in range(30)], SCHEMA)).collect()
    assert all(r.verified for r in got) and len({r.root for r in got}) == 1


def test_blocks_equal_levels():
    for n in (1, 2, 8, 9, 64, 65, 512):
        nodes = [h(str(k)) for k in range(n)]
        root, paths = manifest.visit(nodes, manifest.height(n))
        want, others = plain_tree(nodes)
        assert root == want and [h("".join(a + b for a, b in p)) for p in paths] == [h(x) for x in others]
        assert all(manifest.fold(x, p) == root for x, p in zip(nodes, paths, strict=True))
