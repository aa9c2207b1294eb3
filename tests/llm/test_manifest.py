"""Merkle manifest against plain loops."""

import hashlib
import random
import zlib

import pytest

from geoloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [v + more if k == 3 and v is not None else v for k, v in enumerate(row[:5])]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else "", i & 1))
        i >>= 1
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for i, (_, _, digest, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            siblings = path(trees[k], i) + path(top, n)
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else digest
            for other, left in siblings:
                node = h(other, node) if left else h(node, other)
            root = top[-1][0]
            out.append((r[0], digest, trees[k][-1][0], root, h(*[s for s, _ in siblings]), node, node == root))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA):
    return sorted([tuple(r) for r in merkle.proof_report(spark.createDataFrame(rows, schema)).collect()], key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 900])
def test_sparse_null_repeated_and_negative_ids(spark, n):
    rng = random.Random(n)
    ids = [None, 7, -1, 2**62, -(2**62)]
    rows = [
        (
            rng.choice([*ids, i, i, i * 1000003, -i * 777, i % 50]), rng.choice([None, "a", "é"]),
            rng.choice([None, "", "de", "fr", "fr", "fr"]), rng.choice([None, 3, 9]), rng.choice([None, "", "x y", str(i % 9)]),
        )
        for i in range(n)
    ]
    assert found(spark, rows) == plain(rows)


def test_dense_ids_beyond_one_array_of_slots(spark):
    rows = [(i, None, "de", 2**63 - 1 if i == 5 else i, "t") for i in range(1300)]
    assert found(spark, rows) == plain(rows)


def test_rows_that_repeat_in_full_and_a_group_of_null_ids_alone(spark):
    rows = [(None, "s", None, None, None)] * 3 + [(4, "s", "de", 1, "t")] * 5
    assert found(spark, rows) == plain(rows)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, []) == []
    rows = [(k, "s", "de", 1, "t", "g", 5, "leaf") for k in range(5)]
    assert found(spark, rows, SCHEMA + ", g string, pos long, leaf string") == plain(rows)


def test_the_manifest_gives_places_and_paths(spark):
    rows = [(k, "s", "de" if k % 2 else None, 1, "t") for k in range(9)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.lang or "", r.place, r.doc_id) for r in got) == sorted(("de" if k % 2 else "", k // 2, k) for k in range(9))
    assert all(len(r.path) == (3 if r.lang is None else 2) + 1 for r in got)
