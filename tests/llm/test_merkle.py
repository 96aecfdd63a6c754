import hashlib
import random
import zlib

import numpy as np
import pytest

from bandstream.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        run = levels[-1]
        levels.append([h(*run[i : i + 3]) for i in range(0, len(run), 3)])
    return levels


def plain(rows):
    """Sorted result rows by building every tree whole; rows are (id, source, lang, n, text)."""
    of = {}
    for row in rows:
        of.setdefault(row[1], []).append(row)
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    parts = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {p: tree([leaf(r) for r in sorted(of[p], key=order)]) for p in parts}
    top, out = tree([trees[p][-1][0] for p in parts]), []
    for n, part in enumerate(parts):
        for k, row in enumerate(sorted(of[part], key=order)):
            changed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4]:
                changed[4] = row[4].replace("\n", "")
            digest, proof = leaf(changed), []
            for levels, at in ((trees[part], k), (top, n)):
                for level in levels[:-1]:
                    run, slot = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    proof += run[:slot] + run[slot + 1 :]
                    digest = h(*run[:slot], digest, *run[slot + 1 :])
                    at //= 3
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[part][-1][0], root, h(*proof), digest, digest == root))
    return sorted(out, key=str)


def test_compression_function():
    data = [hashlib.sha256(bytes([i])).digest() for i in range(9)]
    state = merkle.starts(9)
    for blocks in range(1, 4):
        state = merkle.absorb(state, merkle.as_hex(merkle.words(b"".join(data))))
        found = merkle.texts(merkle.finish(state, np.full(9, blocks)))
        assert found == [h(d.hex() * blocks) for d in data]


def put(folder, rows, extra=()):
    folder.docs([(i, text, lang, source, n) for i, source, lang, n, text in rows], extra)


def documents(sizes, seed=1):
    draw, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            text = draw.choice([None, "", "a\nb\n", "é\n" * 9, "no break", "日本\n"])
            rows.append((len(rows) * 7 % 1009, source, draw.choice([None, "en"]), draw.choice([None, 3]), text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize(
    "sizes",
    [
        {"one": 1},
        {"hot": 100},
        {None: 1, "": 2, "a": 3, "b": 4, "B": 28, "é": 9, "\U0001f600": 10, "z": 82},
    ],
)
def test_whole_trees(spark, folder, levels, sizes):
    rows = documents(sizes)
    put(folder, rows, ["tree", "place", "part", "digest", "TOTAL"])
    docs = spark.read.parquet(f"{folder.path}/documents.parquet")
    found = [tuple(r) for r in merkle.verified(merkle.leaves(docs), levels).collect()]
    assert sorted(found, key=str) == plain(rows)
    assert any(not r[-1] for r in found) or len(rows) == 1


def test_repeated_rows_and_ids(spark, folder):
    rows = [(1, "a", None, 1, "x\n"), (1, "a", None, 1, "x\n"), (1, "a", "en", 1, "y"), (None, "a", None, None, None),
            (None, None, None, None, "z\n"), (2, None, None, None, "long " * 5000)]
    put(folder, rows)
    found = [tuple(r) for r in merkle.op12_merkle(spark, folder.path).collect()]
    assert sorted(found, key=str) == plain(rows)
