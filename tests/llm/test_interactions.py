"""The filter audit against a plain loop over orders and documents."""
import re
from itertools import permutations

import numpy as np
import pytest

from edge import CLASHES, documents, labels
from roamlog.llm import interactions as I


def plain(rows, marks):
    """Every order applied document by document. ``rows``: (id, text, part); ``marks``: {id: (good, toxic)}."""
    out = {}
    fails = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        f += "E" * any((t2 or "") == t and i is not None and i2 is not None and i2 < i for i2, t2, _ in rows)
        fails.append((part or "", f, *marks.get(i, (0, 0))))
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failing = sum(f in x[1] for x in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(x[1] == f for x in mine),
                                          sum(x[2] for x in gone), sum(x[3] for x in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in I.COUNTS) for r in df.collect()}


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    known = labels(spark, [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (9, 1, 1), (99, 1, 1)])
    got = I.audit(docs, known)
    assert got.columns == ["part", "filter_order", "step", *I.COUNTS]
    assert collected(got) == plain(rows, {1: (1, 0), 2: (1, 1), 9: (1, 1)})
    assert set(CLASHES) & set(docs.columns)


def test_copies(spark):
    """Copies in several parts, with repeated ids, blanks and a null id beside them."""
    long = " ".join(f"w{k}" for k in range(250))
    rows = [(k, long, "en" if k % 3 else "fr", "s") for k in range(60, 0, -1)]
    rows += [(1, long, "en", "s"), (1, long, None, "s"), (None, long, "en", "s"), (70, None, "", "s"), (71, "", None, "s"), (72, "A" * 9, "", "s")]
    assert collected(I.audit(documents(spark, rows), labels(spark))) == plain([(i, t, p) for i, t, p, _ in rows], {})


def test_empty(spark):
    assert I.audit(documents(spark, []), labels(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_are_the_first_failing_position(seed):
    rng = np.random.default_rng(seed)
    masks = rng.integers(0, 32, 50)
    steps = I.removal_steps(masks)
    for r, mask in enumerate(masks):
        for o, order in enumerate(I.ORDERS):
            hit = [k for k, f in enumerate(order, 1) if mask >> "ABCDE".index(f) & 1]
            assert steps[r, o] == (hit[0] if hit else 6)
