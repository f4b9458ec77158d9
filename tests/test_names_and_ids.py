"""Names and ids of unions, against going through them one after another; proposals for moved folders."""

from __future__ import annotations

import random
import re

import pytest

from visledger.operators import edit, setops


def in_turn(names):
    seen, out = set(), []
    for name in names:
        m = re.fullmatch(r"(.*)_v(\d+)", name)
        stem, k = (m[1], int(m[2])) if m else (name, 0)
        while name in seen:
            k += 1
            name = f"{stem}_v{k:03d}"
        seen.add(name)
        out.append(name)
    return out


def test_names_fill_the_gaps_as_one_after_another(spark):
    rng = random.Random(4)
    pool = ["foo", "foo", "foo_v001", "foo_v002", "foo_v2", "foo_v007", "bar", "baz_v001", "baz_v001", "qux", "v_v1", "a b"]
    rows = [(i // 60, i, rng.choice([*pool, None])) for i in range(180)]
    got = {r["id"]: r["name"] for r in setops.unique_names(spark.createDataFrame(rows, "_src int, id bigint, name string")).collect()}
    named = [r for r in rows if r[2] is not None]
    assert [got[i] for _, i, _ in named] == in_turn([n for *_, n in named])
    assert all(got[i] is None for _, i, n in rows if n is None) and len(got) == len(rows)


def ids_in_turn(sources, reuse):
    blocked, next_id, out = set(), 0, []
    for s, ids in enumerate(sources):
        mapping: dict = {}
        for old in ids:
            if old in mapping:
                continue
            if reuse and old not in blocked:
                mapping[old] = old
                next_id = max(next_id, old + 1)
            else:
                mapping[old] = next_id
                next_id += 1
        blocked |= set(mapping.values())
        out += [(s, old, new) for old, new in mapping.items()]
    return sorted(out)


@pytest.mark.parametrize("reuse", [True, False])
def test_ids_as_one_after_another(spark, reuse):
    rng = random.Random(1)
    for sources in ([[1, 1, 3, 3, 200, 4], [204, 1, 2, 3, 3, 4, 5, 9]], [[rng.randint(0, 60) for _ in range(40)] for _ in range(3)], [[5], [], [5, 5, 7]]):
        rows = [(s, k, i) for s, ids in enumerate(sources) for k, i in enumerate(ids)]
        got = sorted(map(tuple, setops.remap_ids(spark.createDataFrame(rows, "_src int, nth bigint, id bigint"), reuse).collect()))
        assert got == ids_in_turn([s for s in sources], reuse)


def test_a_move_of_few_files_among_many_is_proposed(spark):
    lost = [(f"gone/{i}.png",) for i in range(500)] + [(f"old/deep/{i}/x.png",) for i in range(3)]
    there = [(f"elsewhere/{i}.txt",) for i in range(50)] + [(f"new/{i}/x.png",) for i in range(3)] + [(f"many/{i}/x.png",) for i in range(300)]
    got = [tuple(r) for r in edit.find_reroot(*(spark.createDataFrame(x, "file_name string") for x in (lost, there))).collect()]
    assert got == [] or all(r[3] == 503 for r in got)  # 'x.png' alone is in too many places to tell
    there = there[:53]
    got = [tuple(r) for r in edit.find_reroot(*(spark.createDataFrame(x, "file_name string") for x in (lost, there))).collect()]
    assert got[0] == ("old/deep", "new", 3, 503)
